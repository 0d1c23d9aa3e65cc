"""Registered formats: lines, objects, harness logs, and JSON with a manifest."""

import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import formats, readers


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def load(spark, name, path, **options):
    return spark.read.format(name).options(**options).load(str(path)).collect()


def test_result_lines(known, tmp_path):
    lines = [json.dumps({"n": i, "s": "é" * (i % 7)}, ensure_ascii=False) for i in range(500)]
    body = "".join(f"  RESULT_JSON: {x} \r\n" if i % 3 == 0 else f"{x}\n" if i % 3 == 1 else f"step {i}\n\n{x}\n" for i, x in enumerate(lines)) + "RESULT_JSON: none\n" + '{"n": -1'
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "log.txt").write_text(body, encoding="utf-8", newline="")
    (tmp_path / "a" / "z.gz").write_bytes(gzip.compress(b'RESULT_JSON:{"n": -2}\n' * 3))
    (tmp_path / "a" / "empty.txt").write_text("")
    (tmp_path / "a" / "_hidden").write_text('{"n": -3}')
    raw = body.encode()
    reader = lambda size: formats.ResultLines({"path": str(tmp_path / "a"), "pieceBytes": size}).reader(None)
    for size in (1, 7, 64):  # pieces shorter than a line
        assert sorted(v for p in reader(size).partitions() for f, _, v in reader(size).rows(p) if f.endswith("log.txt")) == sorted([*lines, '{"n": -1']), size
    for size in (1000, 64 << 20):
        rows = load(known, "result_lines", tmp_path / "a", pieceBytes=size)
        plain = [r for r in rows if r.file.endswith("log.txt")]
        assert sorted(r.value for r in plain) == sorted([*lines, '{"n": -1']), size
        assert all(r.value.encode() in raw[r.offset : raw.find(b"\n", r.offset) if raw.find(b"\n", r.offset) >= 0 else len(raw)] for r in plain)
        assert [r.value for r in rows if r.file.endswith(".gz")] == ['{"n": -2}'] * 3 and not any("-3" in r.value for r in rows)
    (tmp_path / "none").mkdir()
    assert load(known, "result_lines", tmp_path / "none") == []
    with pytest.raises(Exception, match="absent"):
        load(known, "result_lines", tmp_path / "absent")


def test_objects_stream():
    pieces = ['{"a": 1}{"b": [1, {"c": 2}]}', "[{\"x\": 1}, 5]", " noise ", '{"s": "}{ \\" é"}', '{"bad": oops, "in": {"d": 4}}', '{"n": -12.5e3}\n\n', "]", '{"cut": {"e": 5}']
    text = "".join(pieces)
    seen = [(at, json.loads(v)) for at, v in formats.objects_of(io.StringIO(text).read)]
    want = [{"a": 1}, {"b": [1, {"c": 2}]}, {"x": 1}, 5, {"s": '}{ " é'}, {"d": 4}, {"n": -12500.0}, {"e": 5}]
    assert [v for _, v in seen] == want and all(text[at] in "{[" for at, _ in seen)
    for size in (1, 2, 3, 5, 17):  # however the stream is cut
        stream = io.StringIO(text)
        assert [(at, json.loads(v)) for at, v in formats.objects_of(lambda _, s=size, f=stream: f.read(s))] == seen, size
    long = json.dumps({"t": "x" * 3_000_000})
    assert len(list(formats.objects_of(io.StringIO(long * 3).read))) == 3
    assert list(formats.objects_of(io.StringIO("").read)) == [] and list(formats.objects_of(io.StringIO("[" * 5).read)) == []


def test_json_objects(known, tmp_path):
    text = '{"b": 2, "a": 1}[{"c": 3}]x{"é": "ü"}'
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(text, encoding="utf-8")
    rows = load(known, "json_objects", tmp_path)
    assert sorted(r.value for r in rows) == sorted(['{"a": 1, "b": 2}', '{"c": 3}', '{"é": "ü"}'] * 3)
    old = known.createDataFrame([(text,)], "t string").select(F.explode(readers.raw_objects(F.col("t"))).alias("v")).collect()
    assert sorted(json.loads(r.v)["é"] if "é" in json.loads(r.v) else "" for r in old) == ["", "", "ü"] and len(old) == 3


def test_harness_logs(known, tmp_path):
    lm = {"results": {"t": {"acc,none": 0.5, "acc_stderr,none": 0.1, "alias": "t"}}, "configs": {}}
    files = {"x/results_1.json": json.dumps(lm), "h/run_spec.json": "{}", "h/scenario_state.json": '{"a": 1}', "h/stats.json": "[]", "h/notes.txt": "{}", "x/broken.json": "{", "x/other.json": '{"k": 1}'}
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    with zipfile.ZipFile(tmp_path / "r.eval", "w") as archive:
        archive.writestr("header.json", '{"eval": {}}')
        archive.writestr("samples/1.json", '{"id": 1}')
        archive.writestr("notes.md", "x")
    (tmp_path / "bad.eval").write_text("no archive")
    documents = known.read.format("harness_logs").load(str(tmp_path))
    rows = {(r.framework, r.document): r for r in documents.collect()}
    assert set(rows) == {("lm_eval", "results_1.json"), ("helm", "run_spec.json"), ("helm", "scenario_state.json"), ("helm", "stats.json"), ("unknown", "broken.json"), ("unknown", "other.json"), ("inspect", "header.json"), ("inspect", "samples/1.json"), ("inspect", "bad.eval")}
    assert {k for k, r in rows.items() if r.fault} == {("unknown", "broken.json"), ("inspect", "bad.eval")} and all((r.value is None) == (r.fault is not None) for r in rows.values())
    assert len({r.log for r in rows.values() if r.framework == "helm"}) == 1
    assert [tuple(r)[1:] for r in formats.converted(documents).collect()] == [("t", "acc", "none", 0.5)]
    assert {r.framework: (r.documents, r.broken) for r in formats.unconverted(documents).collect()} == {"helm": (3, 0), "unknown": (2, 1), "inspect": (3, 1)}
    assert formats.FETCHERS["harness_logs"](known, str(tmp_path)).count() == 9
    with pytest.raises(ValueError):
        formats.converted(documents, {})


def test_small_logs_share_a_task(tmp_path, monkeypatch):
    for i in range(600):
        (tmp_path / f"{i:03}.json").write_text('{"results": {}, "configs": {}}')
    (tmp_path / "h").mkdir()
    for name in ("run_spec.json", "scenario_state.json", "stats.json"):
        (tmp_path / "h" / name).write_text("{}")
    reader = formats.HarnessLogs({"path": str(tmp_path)}).reader(None)
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(p.runs) for p in parts) == 601
    rows = [row for p in parts for batch in reader.read(p) for row in batch.to_pylist()]
    assert len({(r["log"], r["document"]) for r in rows}) == len(rows) == 603 and [r["framework"] for r in rows].count("helm") == 3
    monkeypatch.setattr(formats, "LOG_BYTES", 1)  # less than one log
    assert len(reader.partitions()) == 601


def test_stable_json(known, tmp_path):
    path = str(tmp_path / "out")
    rows = known.range(2500).select("id", (F.col("id") / 3).alias("x"), F.when(F.col("id") % 5 > 0, F.lit("é")).alias("s"), F.array(F.col("id") * 0.1).alias("l"), F.struct(F.lit(0.1 + 0.2).alias("y")).alias("d"))

    def body():
        told = json.loads((tmp_path / "out" / formats.MANIFEST).read_text())
        for f in told["files"]:
            data = (tmp_path / "out" / f["file"]).read_bytes()
            assert (f["bytes"], f["sha256"], f["rows"]) == (len(data), hashlib.sha256(data).hexdigest(), data.count(b"\n"))
        return told, b"".join((tmp_path / "out" / f["file"]).read_bytes() for f in told["files"])

    formats.write_stable(rows.repartition(7), path, ["id"])
    told, first = body()
    assert told["rows"] == 2500 and told["bytes"] == len(first) and len(list((tmp_path / "out").glob("part-*"))) == len(told["files"])
    assert [json.loads(x)["id"] for x in first.splitlines()] == list(range(2500))
    assert first.splitlines()[1].decode() == '{"d": {"y": 0.3}, "id": 1, "l": [0.1], "s": "é", "x": 0.333333333333}'
    formats.write_stable(rows.repartition(3), path, ["id"])
    again, second = body()
    assert second == first and len(list((tmp_path / "out").glob("part-*"))) == len(again["files"])  # the files before are gone
    formats.write_stable(rows.where("id < 3"), path, ["id"], mode="append")
    assert body()[0]["rows"] == 2503 and known.read.format("stable_json").load(path).count() == 2503
    found = {r.file.rsplit("/", 1)[1]: (r.bytes, r.lines, r.sha256) for r in formats.digests(known, path).collect()}
    assert found == {f["file"]: (f["bytes"], f["rows"], f["sha256"]) for f in body()[0]["files"]}
    (tmp_path / "out" / "part-left-over.jsonl").write_text("{}\n")  # of a task that did not count
    assert known.read.format("stable_json").load(path).count() == 2503
    audit = {r.file: (r.listed, r.found, r.sound) for r in formats.audited(known, path).collect()}
    assert audit.pop("part-left-over.jsonl") == (False, True, False) and set(audit.values()) == {(True, True, True)}
    hurt = tmp_path / "out" / body()[0]["files"][0]["file"]
    hurt.write_bytes(hurt.read_bytes().replace(b"1", b"2", 1))
    with pytest.raises(Exception, match="not as the manifest"):
        known.read.format("stable_json").load(path).count()
    assert [r.file for r in formats.audited(known, path).where("listed AND NOT sound").collect()] == [hurt.name]
    formats.write_stable(rows.where("false"), str(tmp_path / "none"), ["id"])
    assert known.read.format("stable_json").load(str(tmp_path / "none")).count() == 0
    failing = rows.select(F.when(F.col("id") == 2400, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        failing.repartition(4).write.format("stable_json").mode("overwrite").save(str(tmp_path / "failed"))
    assert not (tmp_path / "failed" / formats.MANIFEST).exists()
