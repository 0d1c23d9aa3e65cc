"""Formats for spark.read.format and df.write.format, by Spark's Python data source API (S06, S07, S12, S27, S30, S31, fetchers and converters of 2.13).

`register(spark)` makes them known to a session: result_lines, json_objects, harness_logs and stable_json. Files are
opened by pyarrow, in the stores it knows (local or mounted folders, HDFS, S3, GCS); for a store that only Spark reads,
`readers` has functions on Spark's own formats.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tallyloom.operators.converters import NO_METRICS, as_number, leaf_tasks
from tallyloom.sources.readers import framework

#: Text of one Arrow batch, in characters, and bytes read at once.
BATCH, BLOCK = 4 << 20, 1 << 20
#: Small logs read by one task, at most: so many files, or bytes.
LOGS, LOG_BYTES = 256, 16 << 20
#: Name of the manifest of a folder of stable_json.
MANIFEST = "_manifest.json"


def opened(path: str) -> tuple[stores.FileSystem, str]:
    """The store of a path and the path within; file:/x and file:///x are the same."""
    if ":" in path.split("/", 1)[0]:
        return stores.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return stores.LocalFileSystem(), path


def files_below(store: stores.FileSystem, path: str) -> list[stores.FileInfo]:
    """The files of a folder and its folders, or the file itself, by path; names that begin with _ or . are left out, as Spark does."""
    top = store.get_file_info(path)
    if top.type == stores.FileType.NotFound:
        raise FileNotFoundError(path)
    if top.type == stores.FileType.File:
        return [top]
    found = store.get_file_info(stores.FileSelector(path, recursive=True))
    hidden = lambda f: any(part[:1] in "_." for part in f.path[len(top.path) :].split("/") if part)
    return sorted((f for f in found if f.type == stores.FileType.File and not hidden(f)), key=lambda f: f.path)


@dataclass
class Piece(InputPartition):
    """Bytes of a file from start up to end."""

    path: str
    start: int
    end: int


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about BATCH characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def lines_of(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at start or later and before end; every line begins in one piece of its file."""
    at = start
    if start:
        file.seek(start - 1)
        at += len(file.readline()) - 1
    while at < end and (line := file.readline()):
        yield at, line
        at += len(line)


class ResultLines(DataSource):
    """S06 `result_lines`: (file, offset, value) of the lines that hold an object of JSON, after `prefix` (RESULT_JSON:) or alone.

    Options: path, prefix, pieceBytes (a file is read in pieces of so many bytes, 64 MB; compressed files whole). Blanks
    around a line and around the object are stripped, bytes that are no UTF-8 replaced; lines with the prefix and no object after it, and all
    other lines, are left out. value is JSON text as it stands, sound or not: parse it by from_json or parse_json.
    """

    @classmethod
    def name(cls) -> str:
        return "result_lines"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)


class _LineReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.prefix, self.bytes = options["path"], options.get("prefix", "RESULT_JSON:"), int(options.get("pieceBytes", 64 << 20))

    def partitions(self) -> list[Piece]:
        store, path = opened(self.path)
        whole = lambda f: f.path.endswith((".gz", ".bz2", ".zst", ".lz4"))
        return [Piece(f.path, at, f.size if whole(f) else min(at + self.bytes, f.size)) for f in files_below(store, path) if f.size for at in range(0, f.size, f.size if whole(f) else self.bytes)] or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        yield from in_batches(self.rows(piece), pa.schema([("file", pa.string()), ("offset", pa.int64()), ("value", pa.string())]))

    def rows(self, piece: Piece) -> Iterator[tuple]:
        if not piece.path:
            return
        store, _ = opened(self.path)
        packed = piece.path.endswith((".gz", ".bz2", ".zst", ".lz4"))
        source = store.open_input_stream(piece.path) if packed else store.open_input_file(piece.path)
        with io.BufferedReader(source, BLOCK) as file:
            for at, line in lines_of(file, piece.start, 1 << 62 if packed else piece.end):
                text = line.decode("utf-8", "replace").strip()
                text = text[len(self.prefix) :].strip() if self.prefix and text.startswith(self.prefix) else text
                if text.startswith("{"):
                    yield piece.path, at, text


def objects_of(read: Callable[[int], str]) -> Iterator[tuple[int, str]]:
    """(offset, text) of the objects of JSON that stand one after another in a stream, arrays opened, whatever stands between.

    An object that is broken is passed over by its first sign, so sound ones within it count. Text is held from the object's first sign
    to its end, or to the place where it breaks.
    """
    decoder, text, at, gone, ended = json.JSONDecoder(), "", 0, 0, False
    while True:
        begins = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        at = min(begins, default=len(text))
        if begins:
            try:
                value, to = decoder.raw_decode(text, at)
            except json.JSONDecodeError as fault:
                if ended or not (fault.msg.startswith("Unterminated string") or fault.pos >= len(text) - 16):
                    at += 1
                    continue
            except RecursionError:
                at += 1
                continue
            else:
                for one in value if isinstance(value, list) else [value]:
                    yield gone + at, json.dumps(one, ensure_ascii=False, sort_keys=True)
                at = to
                continue
        elif ended:
            return
        text, gone, at = text[at:], gone + at, 0
        more = read(max(BLOCK, len(text)))
        text, ended = text + more, not more


class JsonObjects(DataSource):
    """S07 `json_objects`: (file, offset, value) of the values of files in which JSON documents stand one after another without separators.

    offset is the code point where the document begins; members of an array have that of the array. Objects have their
    keys sorted. A file is one partition, as nothing tells where a document begins but reading up to it, and is read in blocks.
    """

    @classmethod
    def name(cls) -> str:
        return "json_objects"

    def schema(self) -> str:
        return "file string, offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ObjectReader(self.options)


class _ObjectReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self) -> list[Piece]:
        store, path = opened(self.path)
        return [Piece(f.path, 0, f.size) for f in files_below(store, path) if f.size] or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.path:
            return
        store, _ = opened(self.path)
        with io.TextIOWrapper(io.BufferedReader(store.open_input_stream(piece.path), BLOCK), "utf-8", "replace", newline="") as file:
            rows = ((piece.path, at, value) for at, value in objects_of(file.read))
            yield from in_batches(rows, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("value", pa.string())]))


@dataclass
class Log(InputPartition):
    """The documents of one run: its files and the names beside them."""

    log: str
    files: tuple[str, ...]
    children: frozenset[str]


@dataclass
class Logs(InputPartition):
    """Runs that one task reads, one after another."""

    runs: list[Log]


class HarnessLogs(DataSource):
    """S27, converters `harness_logs`: (log, framework, document, value, fault) of the documents of runs below a folder.

    A folder with run_spec.json is a run, whose documents are its JSON files; every other .json file, and every .eval
    archive, is a run by itself, an archive's documents being its JSON members. framework is told by names and keys
    (S22); value is JSON text. A file that is no JSON, or an archive that is none, gives its fault and no value; other files are left out.
    A run is never cut; small ones are read several to a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "harness_logs"

    def schema(self) -> str:
        return "log string, framework string, document string, value string, fault string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(self.options)


class _LogReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self) -> list[Logs]:
        store, path = opened(self.path)
        folders: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        for f in files_below(store, path):
            folders.setdefault(f.path.rpartition("/")[0], []).append(f.path)
            size[f.path] = f.size
        runs = []
        for folder, files in folders.items():
            names = frozenset(f.rpartition("/")[2] for f in files)
            documents = tuple(f for f in files if f.endswith((".json", ".eval")))
            if "run_spec.json" in names:
                runs.append(Log(folder, documents, names))
            else:
                runs += [Log(f, (f,), frozenset()) for f in documents]
        parts, files, held = [Logs([])], 0, 0
        for run in runs:
            more = sum(size[f] for f in run.files)
            if parts[-1].runs and (files + len(run.files) > LOGS or held + more > LOG_BYTES):
                parts.append(Logs([]))
                files, held = 0, 0
            parts[-1].runs.append(run)
            files, held = files + len(run.files), held + more
        return parts

    def read(self, part: Logs) -> Iterator[pa.RecordBatch]:
        yield from in_batches((row for run in part.runs for row in self.rows(run)), pa.schema([(c, pa.string()) for c in ("log", "framework", "document", "value", "fault")]))

    def rows(self, run: Log) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for path in run.files:
            name = path.rpartition("/")[2]
            with io.BufferedReader(store.open_input_file(path), BLOCK) as file:
                if not name.endswith(".eval"):
                    yield self.row(run, name, file.read())
                    continue
                try:
                    with zipfile.ZipFile(file) as archive:
                        for member in sorted(m for m in archive.namelist() if m.endswith(".json")):
                            yield self.row(run, member, archive.read(member), "inspect")
                except (zipfile.BadZipFile, zlib.error, EOFError, ValueError) as fault:  # a file shorter than an archive's end is a ValueError
                    yield run.log, "inspect", name, None, str(fault)

    def row(self, run: Log, name: str, body: bytes, kind: str | None = None) -> tuple:
        try:
            text = body.decode("utf-8-sig")
            value = json.loads(text)
        except ValueError as fault:
            return run.log, kind or framework(run.log, set(), set(run.children)), name, None, str(fault)
        keys = set(value) if isinstance(value, dict) else set()
        return run.log, kind or framework(run.log, keys, set(run.children)), name, text, None


def stable(value):
    """A value with every float to 12 significant digits, at every depth."""
    if isinstance(value, float):
        return float(format(value, ".12g"))
    if isinstance(value, dict):
        return {k: stable(v) for k, v in value.items()}
    return [stable(v) for v in value] if isinstance(value, list) else value


@dataclass
class Written(WriterCommitMessage):
    """One task's file."""

    file: str
    rows: int
    bytes: int
    sha256: str


class StableJson(DataSource):
    """S30, S31 `stable_json`: JSON lines with sorted keys and floats to 12 significant digits, and a manifest of the files.

    Each task digests and counts what it writes, and the manifest (rows, bytes and SHA-256 in all and by file) is written when all
    tasks are done, under a new name that is then moved: a folder without it was not finished. A file's name carries the partition and
    a random part, so tasks that run twice do not meet; those that do not count are not in the manifest. Partitions without rows have no file.
    Mode overwrite removes the files of the manifest before once the new one stands; append adds to it (one writer at a time).
    Reading gives (file, value) of the manifest's files; reading fails on a file whose size or digest is another.
    Times and decimals are written as Python prints them; the types that count are text, numbers, flags, lists and structs.
    """

    @classmethod
    def name(cls) -> str:
        return "stable_json"

    def schema(self) -> str:
        return "file string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ManifestReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _StableWriter(self.options["path"], overwrite)


class _StableWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, folder = opened(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.jsonl"
        digest, rows, size, out = hashlib.sha256(), 0, 0, None
        for batch in iterator:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024).to_pylist()
                body = "".join(json.dumps(stable(row), ensure_ascii=False, sort_keys=True, default=str) + "\n" for row in part).encode()
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                out.write(body)
                digest.update(body)
                rows, size = rows + len(part), size + len(body)
        if out is not None:
            out.close()
        return Written(name, rows, size, digest.hexdigest())

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        before = read_manifest(store, folder)["files"]
        new = [vars(m) for m in messages if m and m.rows]
        files = new if self.overwrite else before + new
        told = {"bytes": sum(f["bytes"] for f in files), "files": files, "rows": sum(f["rows"] for f in files)}
        fresh = f"{folder}/_{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as out:
            out.write(json.dumps(told, indent=1, sort_keys=True).encode())
        store.move(fresh, f"{folder}/{MANIFEST}")
        for f in before if self.overwrite else []:
            store.delete_file(f"{folder}/{f['file']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        for m in messages:
            if m and m.rows:
                store.delete_file(f"{folder}/{m.file}")


def read_manifest(store: stores.FileSystem, folder: str) -> dict:
    """A folder's manifest; one without files if there is none."""
    if store.get_file_info(f"{folder}/{MANIFEST}").type == stores.FileType.NotFound:
        return {"bytes": 0, "files": [], "rows": 0}
    with store.open_input_stream(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.read())


@dataclass
class Listed(InputPartition):
    """A file of a manifest."""

    file: str
    bytes: int
    sha256: str


class _ManifestReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self) -> list[Listed]:
        store, folder = opened(self.path)
        return [Listed(f["file"], f["bytes"], f["sha256"]) for f in read_manifest(store, folder)["files"]] or [Listed("", 0, "")]

    def read(self, listed: Listed) -> Iterator[pa.RecordBatch]:
        yield from in_batches(self.rows(listed), pa.schema([("file", pa.string()), ("value", pa.string())]))

    def rows(self, listed: Listed) -> Iterator[tuple]:
        if not listed.file:
            return
        store, folder = opened(self.path)
        digest, size = hashlib.sha256(), 0
        with io.BufferedReader(store.open_input_stream(f"{folder}/{listed.file}"), BLOCK) as file:
            for line in file:
                digest.update(line)
                size += len(line)
                yield listed.file, line.decode().rstrip("\n")
        if (size, digest.hexdigest()) != (listed.bytes, listed.sha256):
            raise ValueError(f"{listed.file}: {size} bytes with SHA-256 {digest.hexdigest()}, not as the manifest has it")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, lines, sha256) of every file below a path, read in blocks, so a file may be larger than memory; files are dealt to tasks one by one."""
    store, top = opened(path)
    names = [(f.path,) for f in files_below(store, top)]

    def run(batches):
        for batch in batches:
            kept, rows = opened(path)[0], []
            for name in batch.column(0).to_pylist():
                digest, size, lines = hashlib.sha256(), 0, 0
                with kept.open_input_file(name) as file:
                    while block := file.read(BLOCK):
                        digest.update(block)
                        size, lines = size + len(block), lines + block.count(b"\n")
                rows.append({"file": name, "bytes": size, "lines": lines, "sha256": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("lines", pa.int64()), ("sha256", pa.string())]))

    listed = spark.createDataFrame(names, "file string").repartition(max(1, min(len(names), 4096)), "file")
    return listed.mapInArrow(run, "file string, bytes long, lines long, sha256 string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, bytes, sha256) of the files of a folder of stable_json, as the manifest has them."""
    return spark.createDataFrame([(f["file"], f["rows"], f["bytes"], f["sha256"]) for f in read_manifest(*opened(path))["files"]], "file string, rows long, bytes long, sha256 string")


def audited(spark: SparkSession, path: str) -> DataFrame:
    """The files of a manifest beside the files that are there: (file, rows, listed, found, sound), sound if size, lines and SHA-256 are as listed. Hidden files, as the manifest itself, take no part."""
    there = digests(spark, path).select(F.substring_index("file", "/", -1).alias("file"), F.col("bytes").alias("_bytes"), "lines", F.col("sha256").alias("_sha256"))
    told = F.coalesce((F.col("bytes") == F.col("_bytes")) & (F.col("rows") == F.col("lines")) & (F.col("sha256") == F.col("_sha256")), F.lit(False))
    return manifest(spark, path).join(there, "file", "full").select("file", "rows", F.col("sha256").isNotNull().alias("listed"), F.col("_sha256").isNotNull().alias("found"), told.alias("sound"))


def write_stable(rows: DataFrame, path: str, key: list[str], mode: str = "overwrite", files: int | None = None) -> None:
    """Rows in the order of `key` as stable_json: the files of the manifest one after another are the same bytes on every run if the key tells rows apart."""
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key)
    ranges.write.format("stable_json").mode(mode).save(path)


def write_logs(logs: DataFrame, path: str, body: str) -> None:
    """A file of its own for each row's text (null: none), written by the row's task: no commit moves files one by one.

    Names carry the partition and the place in its order of texts, so a task that runs again writes the same files over its first ones, if
    the same rows come to it.
    """

    def write(rows):
        from pyspark import TaskContext

        store, folder = opened(path)
        for i, row in enumerate(rows):
            with store.open_output_stream(f"{folder}/{TaskContext.get().partitionId():05d}-{i:08d}.json") as out:
                out.write(row[0].encode())

    store, folder = opened(path)
    store.create_dir(folder, recursive=True)
    logs.select(body).where(F.col(body).isNotNull()).sortWithinPartitions(body).foreachPartition(write)


FORMATS = (ResultLines, JsonObjects, HarnessLogs, StableJson)

#: Fetchers by name: (spark, path) to documents (document, value); converters by framework: documents to records.
FETCHERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.name(): lambda spark, path, name=f.name(): spark.read.format(name).load(path) for f in FORMATS}
CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def converter(kind: str):
    """Register a function of (documents of one framework) to records under the framework's name."""

    def known(f):
        CONVERTERS[kind] = f
        return f

    return known


def converted(documents: DataFrame, kinds: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Records of every registered framework, united by name; documents of others are left out, see `unconverted`."""
    frames = [make(documents.where(F.col("framework") == kind)) for kind, make in (CONVERTERS if kinds is None else kinds).items()]
    if not frames:
        raise ValueError("no converter is registered")
    one = frames[0]
    for other in frames[1:]:
        one = one.unionByName(other, allowMissingColumns=True)
    return one


def unconverted(documents: DataFrame) -> DataFrame:
    """Documents by framework that no converter takes, and broken ones: (framework, documents, broken)."""
    left = ~F.col("framework").isin(*CONVERTERS) if CONVERTERS else F.lit(True)
    return documents.where(left | F.col("fault").isNotNull()).groupBy("framework").agg(F.count("*").alias("documents"), F.count("fault").alias("broken"))


@converter("lm_eval")
def lm_eval_records(documents: DataFrame) -> DataFrame:
    """(log, task, metric, score) of the results of lm_eval logs: tasks with a result, their metrics that are numbers, without standard errors; what follows the comma of a name is the filter."""
    results = F.try_variant_get(F.try_parse_json("value"), F.lit("$.results"), "map<string,map<string,variant>>")
    rows = documents.where("value IS NOT NULL").select("log", F.explode(leaf_tasks(results)).alias("task", "_m")).select("log", "task", F.explode("_m").alias("_k", "_v"))
    told = rows.where(~F.col("_k").isin(*NO_METRICS) & ~F.contains("_k", F.lit("_stderr,")))
    return told.select("log", "task", F.substring_index("_k", ",", 1).alias("metric"), F.substring_index("_k", ",", -1).alias("filter"), as_number(F.col("_v")).alias("score")).where("score IS NOT NULL")


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for f in FORMATS:
        spark.dataSource.register(f)
