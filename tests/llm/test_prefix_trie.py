"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import prefix_trie as t

SCHEMA = "conv_id long, turn long, role string, text string, node int, depth string, part string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], text))
    turns = {c: [(r[2], r[4]) for r in sorted(rs)] for c, rs in own.items()}
    source = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    rebuilt = {c: tuple(turns.get(source(c), [])[: zlib.crc32(str(c).encode()) % 6] + turns[c][zlib.crc32(str(c).encode()) % 6 :]) for c in turns}
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out = []
    for path, convs in members.items():
        subtree = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in subtree)
        kids = sum(len(p) == len(path) + 1 for p in subtree)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in subtree) for p in subtree)
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(path))))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def ours(df, **sizes):
    c = F.col("conv_id")
    nodes = t.prefix_trie(df, borrowed=(c - c % 100, F.crc32(c.cast("string")) % 6, 5), **sizes)
    return sorted((tuple(r) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()), key=str)


def made(seed, convs, most):
    rng = random.Random(seed)
    texts = ["", "a", "bb", "é日", "long " * 40, None]
    rows = []
    for c in convs:
        for i in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([i, i, i, None]), rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "u", rng.choice(texts[: rng.choice([1, 2, 6])]), 1, "x", "y"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fan,table,ends", [(64, 50_000, 4096), (2, 40, 3), (2, 1, 1)])
def test_against_brute_force(spark, fan, table, ends):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rows = made(1, [*range(-140, -90), *range(-20, 30), *range(95, 130), 201, 250, 300], 9) + [(None, 0, "u", "a", 1, "x", "y")]
        rows += rows[:30]  # repeated rows are turns of their own
        assert ours(spark.createDataFrame(rows, SCHEMA).repartition(5), fan=fan, table=table, list_of=ends) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_deep_and_hot(spark):
    """A conversation of many turns and very long texts, many copies of one conversation, chains that hang on chains."""
    rows = [(100 * c, i, "u", f"t{i}", 0, "", "") for c in range(12) for i in range(c + 1)]  # each goes on where the one before ends
    rows += [(100 * c, i, "u", "same" if i else "x" * 300_000, 0, "", "") for c in range(20, 60) for i in range(3)]
    rows += [(100 * c + 1, 0, "u", "alone", 0, "", "") for c in range(60, 70)]
    rows += [(9900, i, "u", f"d{i % 3}", 0, "", "") for i in range(150)] + [(10000, i, "u", f"d{i % 3}" if i < 149 else "fork", 0, "", "") for i in range(150)]
    assert ours(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_and_plain(spark):
    assert ours(spark.createDataFrame([], SCHEMA)) == []
    got = t.prefix_trie(spark.createDataFrame([(7, None, None, None), (9, 1, "", "")], "conv_id long, turn long, role string, text string")).orderBy("depth").collect()
    assert [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved"], r["n_ends"]) for r in got] == [(7, 0, None, 2, 1, 1, 0, 0), (7, 1, 7, 2, 0, 1, 0, 2)]
