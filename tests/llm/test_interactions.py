"""The audit of filters against applying every order of them, document by document."""

import math
import re
from collections import Counter
from itertools import permutations

import pytest

from tallyloom.llm import interactions as x

SCHEMA = "doc_id long, text string, source string, n long, good int, mask int, part string"
LABELS = "doc_id long, quality int, toxic int"


def test_walk_visits_every_order_by_single_swaps():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in x.adjacent_swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n)


def brute(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    docs = [(d, t or "", s or "") for d, t, s, *_ in rows]
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t] = min(smallest.get(t, d), d)

    def fails(d, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {f for f, yes in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and d > smallest[t]), strict=True) if yes}

    failed = [(d, s, fails(d, t)) for d, t, s in docs]
    out, removed_by = {}, Counter()
    for part in {s for _, _, s in docs}:
        mine = [(d, f) for d, s, f in failed if s == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                earlier = sum(f in r[1] and bool(r[1] & set(order[: step - 1])) for r in mine)
                out[part, "".join(order), step] = [len(left), len(gone), earlier, sum(r[1] == {f} for r in mine), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                removed_by[part, f] += len(gone)
    return sorted((*key, *counts, removed_by[key[0], key[1][key[2] - 1]]) for key, counts in out.items())


def ours(spark, rows, labels):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in x.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect())


def test_against_every_order(spark):
    plain = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", "x", plain, plain, plain + " #", "WORD " * 70, "same " * 80, plain.upper() + " |", "é" * 30 + "A", "\x0b\x0c a b " * 60, "long " * 60_000, plain * 40]
    rows = [(i, t, ["s", None, "t"][i % 3], 1, 2, 3, "z") for i, t in enumerate(texts)]
    rows += [(None, plain, "s", 0, 0, 0, ""), (None, plain, "u", 0, 0, 0, ""), (3, plain, "s", 0, 0, 0, ""), (3, plain, "t", 0, 0, 0, ""), (-4, "x", "t", 0, 0, 0, "")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(10)] + [(3, 0, None), (None, 1, 1), (99, 1, 1)]
    assert ours(spark, rows, labels) == brute(rows, labels)


def test_hot_text_and_ids(spark):
    """Thousands of copies of one text, of one id, and of rows without id."""
    rows = [(i, "copy", f"s{i % 3}", 0, 0, 0, "") for i in range(3000)] + [(None, f"text {i % 40}", "s0", 0, 0, 0, "") for i in range(2000)] + [(7, f"other {i % 50}", "s1", 0, 0, 0, "") for i in range(2000)]
    assert ours(spark, rows, [(7, 1, 1)]) == brute(rows, [(7, 1, 1)])


def test_empty(spark):
    assert ours(spark, [], []) == []
    with pytest.raises(ValueError, match="filters"):
        x.audit(spark.createDataFrame([], "part string, n array<long>, good array<long>, toxic array<long>"), "ABCDEFGHI")
