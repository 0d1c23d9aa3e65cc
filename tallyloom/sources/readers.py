"""Readers (S01-S12, S14-S24 but for the network, S13): typed frames from trees of records, JSON lines, CSV, Parquet and marked-up text."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import textmeta


def record_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every JSON record below a folder, but for aggregates, samples and naive records; broken files keep their text in _corrupt_record."""
    found = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").schema(schema + ", _corrupt_record string").json(path)
    file = F.col("_metadata.file_path")
    return found.withColumn("file", file).where(~F.col("file").contains("aggregated") & ~F.col("file").rlike("/(samples|naive)/"))


def results_before_fault(spark: SparkSession, path: str, array: str = "evaluation_results") -> DataFrame:
    """Every file's results up to the first that is broken: (file, n, offset, result, head, fault).

    result is the JSON text of one element of the top-level array, n its number from 0, offset its first code point; head
    is the JSON object of the members read before the array. A file that goes on after its last sound result with
    something that is no JSON, or has no such array, adds one row without result, where fault says what is wrong and
    offset where; an empty file has no rows. Files are read by Spark, so any store serves; a record file is small enough to be one value.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    file = F.col("_metadata.file_path")
    texts = found.select(file.alias("file"), "value").where(~F.col("file").contains("aggregated") & ~F.col("file").rlike("/(samples|naive)/"))

    def run(batches):
        for batch in batches:
            rows = [(name, *row) for name, text in zip(batch["file"], batch["value"], strict=True) for row in _elements(text, array)]
            yield pd.DataFrame(rows, columns=["file", "n", "offset", "result", "head", "fault"])

    return texts.mapInPandas(run, "file string, n long, offset long, result string, head string, fault string")


def _elements(text: str, array: str):
    """The elements of a top-level array of an object's text, one by one, as (n, offset, result, head, fault)."""
    decoder, blank = json.JSONDecoder(), " \t\r\n"
    head: dict = {}
    at = 0

    def skip(signs: str) -> None:
        nonlocal at
        while at < len(text) and text[at] in blank:
            at += 1
        if signs:
            if at >= len(text) or text[at] not in signs:
                raise ValueError(f"one of {signs} expected")
            at += 1

    def value():
        nonlocal at
        skip("")
        found, at = decoder.raw_decode(text, at)
        return found

    try:
        skip("{")
        while True:
            key = value()
            skip(":")
            if key == array:
                break
            head[key] = value()
            skip("")
            if text[at : at + 1] == "}":
                raise ValueError(f"no {array}")
            skip(",")
        skip("[")
        skip("")
        n, told = 0, json.dumps(head, ensure_ascii=False)
        while text[at : at + 1] != "]":
            skip("")
            begin, result = at, value()
            if not isinstance(result, dict):
                at = begin
                raise ValueError("no object")
            yield n, begin, json.dumps(result, ensure_ascii=False), told, None
            n += 1
            skip("")
            if text[at : at + 1] != "]":
                skip(",")
        json.loads(text)  # the rest of the file
    except ValueError as fault:
        yield None, getattr(fault, "pos", at), None, None, str(fault)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, missing: list[str] | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones left out, and a missing file is an empty frame unless strict. `missing` collects such paths."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("mode", "DROPMALFORMED").schema(schema).json(path)
    except AnalysisException as absent:
        if strict or absent.getCondition() != "PATH_NOT_FOUND":
            raise
        if missing is not None:
            missing.append(path)
        return spark.createDataFrame([], schema)


def scored_lines(spark: SparkSession, path: str, schema: str, status: str = "status", score: str = "score", missing: list[str] | None = None) -> DataFrame:
    """The lines of finished runs: status ok and a score."""
    return json_lines(spark, path, schema, missing=missing).where((F.col(status) == "ok") & F.col(score).isNotNull())


def prefixed_lines(spark: SparkSession, path: str, schema: str, prefix: str = "RESULT_JSON:") -> DataFrame:
    """JSON after a prefix, or plain JSON lines; other log lines are left out."""
    line = F.trim("value")
    body = F.when(line.startswith(prefix), F.trim(F.substring(line, len(prefix) + 1, F.length(line)))).when(line.startswith("{"), line)
    return spark.read.text(path).select(F.from_json(body, schema).alias("r")).where("r IS NOT NULL").select("r.*")


def raw_objects(text: Column) -> Column:
    """The objects of JSON documents that stand one after another, arrays opened, as an array of JSON text."""
    def cut(body: str | None) -> list[str]:
        out, at, decoder = [], 0, json.JSONDecoder()
        body = body or ""
        while at < len(body):
            if body[at] not in "{[":
                at += 1
                continue
            try:
                value, at = decoder.raw_decode(body, at)
            except ValueError:
                at += 1
                continue
            out += [json.dumps(v, sort_keys=True) for v in (value if isinstance(value, list) else [value])]
        return out

    @F.pandas_udf("array<string>")
    def objects(s: pd.Series) -> pd.Series:
        return s.map(cut)

    return objects(text)


def csv_text(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV as text, absent values empty, the byte order mark stripped from the first name."""
    rows = spark.read.option("header", True).option("encoding", encoding).csv(path)
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in rows.columns))


def csv_any(spark: SparkSession, path: str) -> DataFrame:
    """CSV as text in UTF-8 if all its lines are, else in cp1252, which is Latin-1 but for the bytes from 80 to 9F."""
    sound = spark.read.text(path).agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True))).first()[0]
    if sound:
        return csv_text(spark, path)
    control = "".join(map(chr, range(0x80, 0xA0)))
    shown = "".join(bytes([ord(c)]).decode("cp1252", "ignore") or c for c in control)
    rows = csv_text(spark, path, "ISO-8859-1")
    return rows.select(*(F.translate(f"`{c}`", control, shown).alias(c.translate(str.maketrans(control, shown))) for c in rows.columns))


def parquet_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose columns may differ."""
    return spark.read.option("mergeSchema", True).parquet(path)


def pinned(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The digest of a file and whether it is the pinned one."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), (F.sha2("content", 256) == sha256).alias("pinned"))


def pinned_rows(spark: SparkSession, path: str, sha256: str, column: str, values: list[str], order: str) -> DataFrame:
    """The rows with one of the values, in order, of Parquet whose files all have the pinned digest; else ValueError."""
    others = [r for r in pinned(spark, path, sha256).select("path", "sha256").where(F.col("sha256") != sha256).limit(1).collect()]
    if others:
        raise ValueError(f"{others[0].path}: checksum {others[0].sha256} is not the expected {sha256}")
    return spark.read.parquet(path).where(F.col(column).isin(*values)).orderBy(order)


def newest(spark: SparkSession, folder: str, prefix: str, suffix: str, read: Callable[[str], DataFrame], tries: int = 3) -> DataFrame | None:
    """The rows of the newest file whose name begins and ends so, by names that carry their date; an empty or unreadable one gives way to the next, up to `tries`."""
    from pyspark.errors import PySparkException

    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {f.getPath().getName(): f.getPath().toString() for f in store.listStatus(top)} if store.exists(top) else {}
    for name in sorted((n for n in found if n.startswith(prefix) and n.endswith(suffix)), reverse=True)[:tries]:
        try:
            rows = read(found[name])
            if not rows.isEmpty():
                return rows
        except PySparkException:
            continue
    return None


def first_of(*frames: DataFrame) -> DataFrame | None:
    """The first frame with rows."""
    return next((df for df in frames if not df.isEmpty()), None)


def table_rows(markdown: Column) -> Column:
    """(name, score) of the rows of a Markdown table: the first non-empty cell and the last number from 1 to 10 on the line."""
    rows = F.filter(F.split(markdown, "\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike(r"^\|[\s:|-]+\|?$"))
    cells = lambda x: F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    scores = lambda x: F.filter(F.transform(cells(x), lambda c: c.try_cast("double")), lambda v: v.between(1, 10))
    return F.filter(F.transform(rows, lambda x: F.struct(F.try_element_at(cells(x), F.lit(1)).alias("name"), F.try_element_at(scores(x), F.lit(-1)).alias("score"))), lambda r: r["score"].isNotNull())


def paper_list(spark: SparkSession, path: str) -> DataFrame:
    """Id, title and authors of lines `id - title (authors)`; comments are skipped, the first line of an id counts."""
    line = F.col("value")
    parsed = spark.read.text(path).where(~line.startswith("#")).select(*(F.regexp_extract(line, r"^\s*(\S+)\s+-\s+(.*?)\s*(?:\(([^()]*)\))?\s*$", i).alias(c) for i, c in enumerate(("paper", "title", "authors"), 1)), F.monotonically_increasing_id().alias("_at"))
    return parsed.where("paper <> ''").groupBy("paper").agg(F.min_by(F.struct("title", "authors"), "_at").alias("r")).select("paper", "r.*")


def feed(spark: SparkSession, path: str, schema: str, tag: str = "entry") -> DataFrame:
    """Entries of an Atom feed."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def headings(html: Column) -> Column:
    """The text of the headings h1 to h4."""
    inner = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-4])[^>]*>(.*?)</h\1>"), 2)
    return F.transform(inner, lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))


def sections(html: Column) -> Column:
    """(title, text) of each heading h1 to h4 and what follows it up to the next, without tags."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))
    part = r"(?is)<h[1-4](?:\s[^>]*)?>(.*?)</h[1-4]>(.*?)(?=<h[1-4][\s>]|\z)"
    titles, texts = F.regexp_extract_all(html, F.lit(part), 1), F.regexp_extract_all(html, F.lit(part), 2)
    return F.zip_with(F.transform(titles, lambda c: F.lower(plain(c))), F.transform(texts, plain), lambda a, b: F.struct(a.alias("title"), b.alias("text")))


def title_fits(html: Column, expected: Column) -> Column:
    """Whether the page's title or first heading has one of the expected title's capitalised words (without any: one of its first three words)."""
    shown = F.lower(F.concat_ws(" ", F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    names = F.regexp_extract_all(expected, F.lit(r"[A-Z][a-zA-Z0-9.]+"), 0)
    few = F.slice(F.filter(F.split(F.lower(expected), r"\s+"), lambda w: w != ""), 1, 3)
    return F.exists(F.when(F.size(names) > 0, names).otherwise(few), lambda w: F.contains(shown, F.lower(w)))


def framework(path: str, keys: set[str], children: set[str] = frozenset(), below: set[str] = frozenset()) -> str:
    """Which harness wrote a log, by extension, the names in a folder and in its folders, or the keys of a document."""
    if path.endswith(".eval") or {"eval", "samples"} <= keys:
        return "inspect"
    if {"run_spec.json", "scenario_state.json"} <= children:
        return "helm"
    if {"results", "config"} <= keys or {"results", "configs"} <= keys or any(c.startswith("results") and c.endswith(".json") for c in children):
        return "lm_eval"
    return "helm" if path.endswith(("run_spec.json", "stats.json")) or "run_spec" in keys or "run_spec.json" in below else "unknown"


def front_matter(text: Column) -> Column:
    """The YAML between the first --- and the next at a line's start, as JSON text; {} if there is none or it is broken."""

    def parse(card: str | None) -> str:
        import yaml

        end = card.find("\n---", 3) if card and card.startswith("---") else -1
        try:
            return json.dumps((yaml.safe_load(card[3:end].strip()) if end >= 0 else None) or {}, default=str)
        except (yaml.YAMLError, ValueError, TypeError):
            return "{}"

    @F.pandas_udf("string")
    def parsed(s: pd.Series) -> pd.Series:
        return s.map(parse)

    return parsed(text)


def card_results(front: Column) -> Column:
    """Results in a model card's front matter (JSON text): (benchmark, metric_name, score, dataset, verified, shots, temperature, chain_of_thought); metrics without a number are left out."""
    get = F.try_variant_get
    many = lambda v, path: F.coalesce(get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    said = lambda v, *paths: F.coalesce(*(F.nullif(get(v, p, "string"), F.lit("")) for p in paths), F.lit(""))
    blocks = F.flatten(F.transform(many(F.try_parse_json(front), "$['model-index']"), lambda e: many(e, "$.results")))

    def of(block):
        plain = F.schema_of_variant(get(block, "$.dataset", "variant")) == "STRING"
        data = F.when(plain, said(block, "$.dataset")).otherwise(said(block, "$.dataset.name", "$.dataset.type"))
        args = said(block, "$.dataset.args", "$.dataset.config")

        def one(m):
            metric = said(m, "$.name", "$.type")
            every = F.concat_ws(" ", data, args, metric)
            return F.struct(
                F.coalesce(F.nullif(data, F.lit("")), F.nullif(metric, F.lit("")), F.lit("unknown")).alias("benchmark"), F.coalesce(F.nullif(metric, F.lit("")), F.lit("accuracy")).alias("metric_name"),
                get(m, "$.value", "double").alias("score"), data.alias("dataset"), F.coalesce(get(m, "$.verified", "boolean"), F.lit(False)).alias("verified"),
                F.coalesce(textmeta.shots(F.concat_ws(" ", data, args)), textmeta.shots(metric)).alias("shots"), textmeta.temperature(every).alias("temperature"), textmeta.chain_of_thought(every).alias("chain_of_thought"),
            )

        return F.filter(F.transform(many(block, "$.metrics"), one), lambda r: r["score"].isNotNull())

    return F.flatten(F.transform(blocks, of))


def paper_records(spark: SparkSession, trees: list[str], lines: str, schema: str, skipped: tuple[str, ...] = ("summary.json", "metric_configs_from_llm.json", "extraction_results.json")) -> DataFrame:
    """The records below the first folder that exists, else those of a JSON lines file; bookkeeping files and documents that are no object are left out."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    tree = next((t for t in trees if at(t).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at(t))), None)
    if tree is None:
        return json_lines(spark, lines, schema)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(tree, wholetext=True)
    named = files.where(~F.substring_index(F.col("_metadata.file_path"), "/", -1).isin(*skipped))
    kept = named.where(F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False)))
    return kept.select(F.from_json("value", schema).alias("r")).select("r.*")


def record_at(want: DataFrame, records: DataFrame) -> DataFrame:
    """For each wanted path (w, title, model, benchmark) the record (h, title, model, benchmark) it stands for; null h without one.

    Models agree flattened or as words in any order, a benchmark flattened begins as the wanted one
    does (any if none is wanted); of these the closest title with at least 0.6 of the wanted words counts, ties to the least h. Models meet in an equi-join.
    """
    flat = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    words = lambda c: F.array_join(F.array_sort(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: x != "")), " ")
    keyed = lambda df, *rest: df.select(*rest, F.explode(F.array_distinct(F.array(F.concat(F.lit("f"), flat("model")), F.concat(F.lit("w"), words("model"))))).alias("_m"))
    left = keyed(want, "w", F.col("title").alias("_t"), flat(F.coalesce("benchmark", F.lit(""))).alias("_b"))
    right = keyed(records, "h", F.coalesce("title", F.lit("")).alias("_u"), flat(F.coalesce("benchmark", F.lit(""))).alias("_c"))
    close = textmeta.title_share(F.col("_t"), F.col("_u"))
    near = left.join(right, "_m").where(F.startswith("_c", "_b")).withColumn("_s", close).where("_s >= 0.6")
    best = near.groupBy("w").agg(F.min_by("h", F.struct(-F.col("_s"), "h")).alias("h"))
    return want.join(best, "w", "left")


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], max_age: float, refresh: bool = False) -> DataFrame:
    """The rows of make(), kept as Parquet below folder/key for max_age seconds.

    Each fetch is a folder named by its time in milliseconds, so a reader never sees one that is being replaced; only
    finished ones count (with their success marker). The folder can be in any store that Spark reads. Errors of make() are raised.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{key}")
    store, now = top.getFileSystem(spark._jsc.hadoopConfiguration()), int(time.time() * 1000)
    names = [f.getPath().getName() for f in store.listStatus(top)] if store.exists(top) else []
    done = [n for n in names if n.isdigit() and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{n}/_SUCCESS"))]
    newest = max(done, key=int, default=None)
    if refresh or newest is None or now - int(newest) >= 1000 * max_age:
        newest = str(now)
        make().write.mode("overwrite").parquet(f"{top}/{newest}")
    return spark.read.parquet(f"{top}/{newest}")
