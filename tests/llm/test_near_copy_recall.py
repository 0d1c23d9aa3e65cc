"""Links of op4_near_copies against brute force: `python tests/llm/test_near_copy_recall.py FOLDER 100` measures ids divisible by 100 against all rows."""

import os
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

DIR = "/root/testdata/sf0.01"
BLANKS = " \t\n\v\f\r"


def shingles(text, words=5):
    own = [w for w in (text or "").translate({ord(c): " " for c in BLANKS}).translate({c: c + 32 for c in range(65, 91)}).split(" ") if w]
    return frozenset(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))) if own else frozenset()


def brute_force(docs, every, threshold=Fraction(4, 5)):
    """doc_id of each query to the least ids of the other shingle sets that it is linked with."""
    least = {}
    for i, t in sorted(docs):
        least.setdefault(shingles(t), i)
    number = {}
    small = {i: frozenset(number.setdefault(x, len(number)) for x in s) for s, i in least.items() if s}
    del number
    asked = {i: s for i, t in docs if i % every == 0 and (s := shingles(t))}
    queries = {least[s]: small[least[s]] for s in asked.values()}
    where = defaultdict(list)
    for q, s in queries.items():
        for x in s:
            where[x].append(q)
    links = defaultdict(set)
    for i, s in small.items():
        shared = Counter(q for x in s if x in where for q in where[x])
        for q, n in shared.items():
            if q != i and Fraction(n, len(s) + len(queries[q]) - n) >= threshold:
                links[q].add(i)
    return {i: links[least[s]] for i, s in asked.items()}


def compare(spark, folder, every):
    """(true links of the queries, links counted, true links whose ends are in one class, queries with more links than true)."""
    from tallyloom.llm.queries import op4_near_copies

    want = brute_force([tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()], every)
    got = {r.doc_id: (r.class_id, r.n_links) for r in op4_near_copies(spark, folder).select("doc_id", "class_id", "n_links").collect()}
    true = sum(map(len, want.values()))
    counted = sum(min(len(x), got[i][1]) for i, x in want.items())
    together = sum(got[i][0] == got[j][0] for i, x in want.items() for j in x)
    return true, counted, together, sum(got[i][1] > len(x) for i, x in want.items()), sum(map(bool, want.values())), len(want)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_recall(spark):
    true, counted, together, too_many, _, _ = compare(spark, DIR, 1)
    assert true > 0 and counted >= 0.9 * true and together >= 0.9 * true and too_many == 0


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    os.environ["PYTHONPATH"] = sys.path[0]
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "32").config("spark.ui.enabled", "false").getOrCreate()
    print("true links, counted, in one class, queries with too many, queries with links, queries:", compare(session, sys.argv[1], int(sys.argv[2])))
