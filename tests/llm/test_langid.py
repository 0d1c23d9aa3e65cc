"""Language filters against exact sets, and held-out accuracy."""

import os
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import langid as x

DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score double, lang_pred string"


def grams(text, n):
    """n-grams as text, with a blank for an edge."""
    t = unicodedata.normalize("NFC", text).lower()
    t = " " + "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in t) + " "
    return [g for i in range(len(t) - n + 1) if " " not in (g := t[i : i + n])[1:-1] and g.strip()]


TEXTS = ["", " 12 !", "a", "Ab  c", "l'État, c'est MOI.", "日本語のテキスト", "été été", "नमस्ते", "x" * 50, "ab" * 40 + "\n\n" + "Zz", "İI ß 😀a"]


@pytest.mark.parametrize("window", [1 << 20, 7, 1])
def test_grams(monkeypatch, window):
    monkeypatch.setattr(x, "WINDOW", window)
    codes, starts, lettered = x._codes(TEXTS)
    assert lettered.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]
    for n in x.LENGTHS:
        ours, want = defaultdict(list), {i: grams(t, n) for i, t in enumerate(TEXTS)}
        name = {}
        for places, hashes in x._grams(codes, n):
            for p, h in zip(places, hashes, strict=True):
                text = int(np.searchsorted(starts, p, "right")) - 1
                g = "".join(chr(c) if c else " " for c in codes[p : p + n])
                assert name.setdefault(h, g) == g
                ours[text].append(g)
        assert {i: Counter(g) for i, g in ours.items()} == {i: Counter(g) for i, g in want.items() if g}


def test_filters_hold_what_they_should():
    rng = np.random.default_rng(3)
    hashes, member = rng.integers(0, 2**64, 60_000, dtype=np.uint64), rng.integers(0, 70, 60_000)
    model = x.build([f"l{i:02}" for i in range(70)], [1] * 70, hashes, member)
    assert model.planes.shape[0] == 2  # 70 languages need two words
    found = model.lookup(hashes)
    assert all(found[m // 64, i] >> np.uint64(m % 64) & np.uint64(1) for i, m in enumerate(member[:3000]))
    others = model.lookup(rng.integers(0, 2**64, 200_000, dtype=np.uint64))
    wrong = np.array([((others[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(70)])
    assert np.abs(wrong - model.false_positives()).max() < 2e-3


def small(spark):
    words = {"aa": "alba lama kala bala", "bb": "brog drog krog grob", "cc": "sisi misi lisi kisi"}
    rows = [(i, " ".join(words[k].split()[(i * 7 + j * j) % 4] for j in range(30)), k, 0.5, "zz") for i, k in enumerate(list(words) * 30)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_and_members(spark):
    docs = small(spark).unionByName(spark.createDataFrame([(900, None, "aa", 0.0, ""), (901, "alba", None, 0.0, ""), (902, "", "aa", 0.0, "")], SCHEMA)).repartition(3)
    exact = defaultdict(Counter)
    for r in docs.where("text IS NOT NULL AND lang IS NOT NULL").collect():
        for n in x.LENGTHS:
            exact[r["lang"], n].update(grams(r["text"], n))
    code = lambda g: int(next(iter(x._grams(np.array([0 if c == " " else ord(c) for c in g], np.uint32), len(g))))[1].astype(np.int64)[0])
    assert {(r["lang"], r["n"], r["gram"]): r["n_times"] for r in x.counts(docs).collect()} == {(k, n, code(g)): v for (k, n), c in exact.items() for g, v in c.items()}
    share = {(k, g): v / sum(c.values()) for (k, n), c in exact.items() for g, v in c.items()}
    top = {g: max(share.get((k, g), 0) for k in ("aa", "bb", "cc")) for _, g in share}
    want = {(code(g), k) for (k, g), s in share.items() if s >= 0.01 and s >= 0.3 * top[g]}
    assert {(r["gram"], r["lang"]) for r in x.members(x.counts(docs), 0.01, 0.3).collect()} == want


def test_cases(spark):
    model = x.train(small(spark), F.lit(True))
    assert model.languages == ["aa", "bb", "cc"] and model.documents == [30, 30, 30]
    rows = [(1, None, "bb", 0.0, ""), (2, "", None, 0.0, ""), (3, "12 !?", "aa", 0.0, ""), (4, "krog drog", "aa", 9.0, ""), (5, "日本", "bb", 0.0, ""), (None, "misi lisi", "bb", 0.0, ""), (7, "alba kala " * 150_000, None, 0.0, ""), (4, "krog drog", "aa", 9.0, "")]
    got = x.identify(spark.createDataFrame(rows, SCHEMA), model, ["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == [("1", "und"), ("2", "und"), ("3", "und"), ("4", "bb"), ("4", "bb"), ("5", "aa"), ("7", "aa"), ("None", "cc")]
    assert all(0 <= r["score"] <= 1 and (r["score"] > 0.9) == (r["doc_id"] not in (1, 2, 3, 5)) for r in got)
    assert x.identify(spark.createDataFrame([], SCHEMA), model, ["doc_id"]).collect() == []
    none = x.train(spark.createDataFrame([], SCHEMA), F.lit(True))
    assert none.languages == [] and x.identify(spark.createDataFrame(rows[3:4], SCHEMA), none, ["doc_id"]).first()["lang_pred"] == "und"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_held_out_accuracy(spark):
    from tallyloom.llm.queries import QUERIES

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op13_langid"](spark, DIR).collect()]
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
