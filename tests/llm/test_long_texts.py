"""Texts of very many lines and matches, and very many copies under ids that tell nothing apart: each within seconds."""

import hashlib
import re
import time

from pyspark.sql import functions as F


def within(seconds, began):
    took = time.perf_counter() - began
    assert took < seconds, took


def test_many_lines_and_copies(spark):
    from tallyloom.llm import lines

    text = "\n".join(f"line {i}" if i % 7 else "shared" for i in range(50_000))
    rows = [(None, text, 0)] + [(str(i), "shared", 1) for i in range(12)] + [(None, "shared\nshared\nown", 2)] * 3000
    began = time.perf_counter()
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string, at int"), in_documents=10).select("at", "n_dropped", F.sha2("text", 256).alias("h")).collect()
    within(90, began)
    kept = "\n".join(f"line {i}" for i in range(50_000) if i % 7)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(r["at"], r["n_dropped"], r["h"]) for r in got} == {(0, 7143, sha(kept)), (1, 1, sha("")), (2, 3, sha(""))} and len(got) == 3013


def test_many_copies_of_one_text(spark):
    from tallyloom.llm import substrings

    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(610))
    rows = [("a page", text)] * 2000 + [("b", "x" * 50)]
    began = time.perf_counter()
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    within(120, began)
    assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got} == {("a page", 610, 610, 1), ("b", 50, 0, 0)} and len(got) == 2001


def test_many_matches(spark):
    from tallyloom.llm import pii

    text = " é, ".join(f"user{i}@mail{i % 9}.example.com" if i % 3 else f"10.0.{i % 256}.{i % 250}" for i in range(8000)) + "."
    began = time.perf_counter()
    spans = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").select("doc_id", F.posexplode(F.array(*(pii._found(F.col("text"), p, ()) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}"))))).collect()
    within(60, began)
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+){3}")):
        got = next(r["col"] for r in spans if r["doc_id"] == 1 and r["pos"] == kind)
        want = [(m.start(), m.end(), m.group(), text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 2]) for m in re.finditer(pattern, text)]
        assert [tuple(x) for x in got] == want


def test_context_of_close_matches(spark):
    """Matches that touch, and gaps shorter than the context."""
    from tallyloom.llm import pii

    texts = ["", "ab", "abababab", "x ab", "ab  ab" * 30 + "é日", "ab" * 300 + "z", "日" * 40 + "ab" + "é"]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", pii._found(F.col("text"), "ab", ()).alias("s")).collect():
        t = r["text"]
        assert [tuple(x) for x in r["s"]] == [(m.start(), m.end(), "ab", t[max(0, m.start() - 24) : m.start()], t[m.end() : m.end() + 2]) for m in re.finditer("ab", t)]
