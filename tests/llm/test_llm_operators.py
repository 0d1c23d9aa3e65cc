"""The ten operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

WORDS = "der die und that of thing tion haus maison casa lorem ipsum dolor sit amet alpha beta gamma delta".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i) % len(WORDS)] + str((seed + i) % 9 if i % 6 == 0 else "") for i in range(n))


PASSAGE = sentence(99, 60)
TEXTS = [
    None, "", " \n\t", "x", "one two", sentence(1, 80), sentence(1, 80), sentence(1, 78) + " other end", "head " + PASSAGE + " tail", sentence(3, 30) + "\n" + PASSAGE, sentence(4, 2000), "a" * 700,
    "Line\nline \n LINE\nunique " + sentence(5, 5), "line\n" * 3 + "é" * 120, "Write to a.b@c.de.f or 10.0.0.255, +1 (555) 010-9999; 4111 1111 1111 1111.", "ip 300.1.1.1 and 1.2.3.4.5 +12 a@b 1234567890123",
    "日本語 テスト  double  space\n\n x", "don't we'll <|endoftext|> ", "idiot moron stupid " * 12, PASSAGE + "\n" + PASSAGE,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 7 else None, t, "en", "s", 0, 1) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label int").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pii(docs, none):
    from tallyloom.llm import pii

    patterns = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
    ]
    got = rows_of(pii.find(docs))
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = sorted((m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(patterns) for m in re.finditer(p, r["text"] or "") if ok(m.group()))
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"] if s["base"]] == [w[2] for w in want]
    assert next(r for r in rows_of(pii.redact(docs)) if r["doc_id"] == 14)["text"] == "Write to [EMAIL] or [IP], [PHONE]; [CARD]."
    assert pii.find(none).count() == 0 and pii.redact(none).count() == 0


def test_substrings(docs, none):
    from tallyloom.llm import substrings

    for length in (200, 40):
        seen = Counter()
        for r in docs.collect():
            b = (r["text"] or "").encode()
            seen.update(b[i : i + length] for i in range(len(b) - length + 1))
        got = rows_of(substrings.dedup_substrings(docs, length, digests=True).join(docs.select("doc_id", "text"), "doc_id"))
        assert got
        for r in got:
            b = (r["text"] or "").encode()
            gone = bytearray(len(b))
            for i in range(len(b) - length + 1):
                if seen[b[i : i + length]] > 1:
                    gone[i : i + length] = b"\1" * length
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    assert substrings.dedup_substrings(docs, 200).count() == len(TEXTS) + 1
    assert substrings.dedup_substrings(none, 200).count() == 0


def test_suffix_sort_survives_lying_hashes(monkeypatch):
    import numpy as np

    from tallyloom.llm import substrings

    powers = substrings._powers(4096)
    texts = [b"abcdefgh" * 6, b"zzabcdefghabcdefgh" + b"q" * 30, bytes(range(60))]

    def brute():
        flags = Counter(t[i : i + 20] for t in texts for i in range(len(t) - 19))
        return [[flags[t[i : i + 20]] > 1 for i in range(len(t) - 19)] for t in texts]

    assert [list(map(bool, f)) for f in substrings.repeated(texts, [0, 0, 0], 20, powers)] == brute()
    monkeypatch.setattr(substrings.Prefixes, "of", lambda self, start, length: np.zeros(np.broadcast(start, length).shape, np.uint64))
    assert [list(map(bool, f)) for f in substrings.repeated(texts, [0, 0, 0], 20, powers)] == brute()


def test_crowded_grams_are_counted(docs, monkeypatch):
    from tallyloom.llm import substrings

    want = sorted(map(str, rows_of(substrings.dedup_substrings(docs, 40, digests=True))))
    monkeypatch.setattr(substrings, "MOST_CLASSES", 1)
    assert sorted(map(str, rows_of(substrings.dedup_substrings(docs, 40, digests=True)))) == want


@pytest.mark.parametrize(("least", "shortest"), [(2, 1), (3, 5)])
def test_lines(docs, none, least, shortest):
    from tallyloom.llm import lines

    blank = " \t\n\v\f\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(blank))
    found = Counter(k for r in docs.collect() for k in {key(x) for x in (r["text"] or "").split("\n")} if len(k) >= shortest)
    got = rows_of(lines.dedup_lines(docs.withColumn("n_lines", F.lit("clash")).withColumn("before", F.col("text")), in_documents=least, shortest=shortest))
    assert len(got) == len(TEXTS) + 1
    for r in got:
        own = (r["before"] or "").split("\n")
        kept = [x for x in own if found[key(x)] < least]
        assert (r["n_lines"], r["n_dropped"], r["text"]) == (len(own), len(own) - len(kept), "\n".join(kept))
    assert lines.dedup_lines(none).count() == 0


def test_lines_keep_first(spark):
    from tallyloom.llm import lines

    df = spark.createDataFrame([(1, "a\nb\na"), (2, "A \nc"), (3, "d")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(df, in_documents=2, keep_first=True).collect()}
    assert got == {1: "a\nb", 2: "c", 3: "d"}


def test_near_copies(docs, none, monkeypatch):
    from tallyloom.llm import neardup

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    keyed = docs.select("text", *neardup.row_key()).distinct().collect()
    sets = {(r["_id"], r["_th"]): shingles(r["text"]) for r in keyed}
    of = defaultdict(list)
    for k, s in sets.items():
        of[s or k].append(k)
    rep = {k: min(of[s or k]) for k, s in sets.items()}
    near = lambda a, b: bool(sets[a]) and bool(sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    heads = sorted(set(rep.values()))
    links = {a: [b for b in heads if b != a and near(a, b)] for a in heads}
    label = {h: h for h in heads}
    for _ in heads:
        label = {h: min([label[h], *(label[x] for x in links[h])]) for h in heads}
    want = {k: (label[rep[k]][0], rep[k][0], len(links[rep[k]])) for k in sets}
    for group in (512, 1):
        monkeypatch.setattr(neardup, "GROUP", group)
        got = {(r["_id"], r["_th"]): (r["class_id"], r["copy_of"], r["n_links"]) for r in neardup.near_duplicates(docs).collect()}
        assert got == want and any(n for _, _, n in want.values())
    kept = neardup.keep_first(docs)
    assert kept.count() == len({label[rep[k]] for k in sets if sets[k]}) + sum(not shingles(r["text"]) for r in docs.collect()) and kept.columns == docs.columns
    assert neardup.near_duplicates(none).count() == 0


def test_toxicity(spark, none):
    from tallyloom.llm import toxicity

    bad = ["idiot", "moron", "stupid", "loser"]
    rows = [(i, sentence(i, 40) + (" " + " ".join(bad[(i + j) % 4] for j in range(3)) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.train(df.drop("y"), df.select("doc_id", F.col("y").alias("toxic")), F.col("doc_id") % 3 != 1)
    got = toxicity.score(df, model, ["doc_id", "y"]).where("doc_id % 3 = 1").collect()
    assert sum(r["predicted"] == r["y"] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    fewer = toxicity.train(df.drop("y"), df.select("doc_id", F.col("y").alias("toxic")), F.col("doc_id") % 3 != 1, most_labels=120)
    assert 0 < len(fewer.lexicon) and sum(r["predicted"] == r["y"] for r in toxicity.score(df, fewer, ["doc_id", "y"]).collect()) >= 0.9 * len(rows)
    hidden = spark.createDataFrame([(1, sentence(2, 30) + " you 1d10t, m0r0n and st*pid l0ser"), (2, sentence(2, 30)), (3, None), (4, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(hidden, model, ["doc_id"]).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}
    assert toxicity.restore("an i d i o t and a stuuupid", model.trigrams) == "an idiot and a stupid"
    blank = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(none, blank, ["doc_id"]).count() == 0


def tiktoken_of():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, none):
    from tallyloom.llm import bpe

    library, args = tiktoken_of(), (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = rows_of(bpe.encode(docs, *args).join(docs.select("doc_id", "text"), "doc_id"))
    for r in got:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"])
    assert {r["text"] for r in bpe.decode(bpe.encode(docs, *args), *args).collect()} == {t or "" for t in TEXTS}
    assert bpe.encode(none, *args, digests=True).count() == 0
    table = bpe.MinimalPerfectHash([b"a", b"b", b"cc"], [5, 6, 7])
    assert [table.get(k) for k in (b"a", b"b", b"cc", b"c")] == [5, 6, 7, None] and len(table.keys) == 3


def test_quality(docs, none):
    from tallyloom.llm import quality

    got = rows_of(quality.cascade(docs).join(docs.select("doc_id", "text"), "doc_id"))
    for r in got:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += line in seen
            if re.search(r"[^\x20\x09-\x0D]", line):
                seen.add(line)
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeat), failed)
        assert not (failed and r["kept"])
    for order in (list(quality.RULES), list(quality.RULES)[::-1]):
        assert sorted((r["n_words"], r["kept"]) for r in quality.cascade(docs, order=order).collect()) == sorted((r["n_words"], r["kept"]) for r in quality.cascade(docs).collect())
    assert quality.cascade(none).count() == 0 and [r["rule"] for r in quality.plan(none)] == list(quality.RULES)


@pytest.mark.parametrize(("order", "fan_bits", "lane"), [(3, 8, 5), (4, 1, 256), (2, 8, 256), (1, 8, 5)])
def test_lm(docs, none, monkeypatch, order, fan_bits, lane):
    from tallyloom.llm import lm

    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lm.BackoffAutomaton.walk, "__defaults__", (lane,))
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    learned = [r["text"] or "" for r in docs.where(train).collect()]
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    grams = Counter()
    for t in learned:
        x = ["start", *tokens(t)]
        grams.update(tuple(x[i : i + n]) for n in range(1, order + 1) for i in range(len(x) - n + 1))
    one = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "start"}
    n, v = sum(one.values()), len(one)
    p = lambda x: (one.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))

    def probability(context, x):
        if not context:
            return p(x)
        lower, seen = probability(context[1:], x), grams[context]
        return lower if seen < 2 else (grams[*context, x] + 4 * lower) / (seen + 4)

    got = rows_of(lm.score(docs.withColumn("block", F.lit("clash")), train, order=order, fan_bits=fan_bits))
    want = {}
    for r in docs.collect():
        x = ["start", *tokens(r["text"])]
        full = sum(math.log10(probability(tuple(x[max(0, i - order + 1) : i]), x[i])) for i in range(1, len(x)))
        want[r["doc_id"]] = (len(x) - 1, sum(one.get(t, 0) > 0 for t in x[1:]), sum(math.log10(p(t)) for t in x[1:]), full)
    assert len(got) == len(TEXTS) + 1
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (w[0], w[1], n)
        assert r["base_score"] == pytest.approx(w[2], rel=1e-9) and r["score"] == pytest.approx(w[3], rel=1e-9)
    assert lm.score(none, train).count() == 0


def test_automaton_follows_failure_arcs_over_several_levels():
    import numpy as np

    from tallyloom.llm import lm

    block = lm.Block(["a b c d", "a b c d", "x b c e", "y c f"], 3)
    counts = block.counts(np.ones(4, bool))
    automaton, single = block.automaton(counts, 17, 9, 0.1, 4.0, 2)
    names = {w: i + 2 for i, w in enumerate(["a", "b", "c", "d", "x", "e", "y", "f"])}
    state, chain = automaton.start, []
    for w in "abc":
        _, after = automaton.step(np.array([state]), np.array([names[w]]))
        state = int(after[0])
    while state:
        chain.append(state)
        state = int(automaton.back[state])
    assert len(chain) == 2  # "b c", then "c", then the empty context
    p, _ = automaton.step(np.array([chain[0]]), np.array([names["f"]]))
    seen = {"b c": 3, "c": 4}
    lower = (1 + 4 * (1 + 0.1) / (17 + 0.1 * 10)) / (seen["c"] + 4)
    assert p[0] == pytest.approx(math.log10(4 / (seen["b c"] + 4) * lower))


def test_top_k(spark):
    from tallyloom.llm import vectors

    vecs = [[math.sin(i * 3 + j * (i % 7 + 1)) for j in range(6)] for i in range(120)] + [[0.5] * 6] * 35
    rows = [(i, v) for i, v in enumerate(vecs)] + [(200, None), (None, [1.0] * 6), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, [None] + [0.0] * 5), (220, [1.0, 2.0])]
    rows += [(0, vecs[0]), (20, vecs[3]), (7, vecs[7]), (140, vecs[140]), (160, [2.0**30] * 6), (161, [2.0**31, -1.0, 3.5, 2.0**24, 0.25, -(2.0**30)]), (180, [1e30, -1e30, 1.0, 0.0, 0.0, 0.5]), (181, [3e38] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    usable = [(r["vec_id"], [math.floor(64 * x) for x in r["embedding"]]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    assert any(abs(x) > 2**90 for _, v in usable for x in v)
    want = []
    for at, (q, a) in enumerate(usable):
        if q % 20 == 0 and len(a) == 6:
            scored = [(max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), -i) for n, (i, b) in enumerate(usable) if n != at and len(b) == 6]
            want += [(q, n, -i, s) for n, (s, i) in enumerate(sorted(scored, reverse=True)[:7], 1)]
    for options in ({}, {"components": 200, "least_group": 1}):
        got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vectors.top_k(df, F.col("vec_id") % 20 == 0, 7, **options).collect()]
        assert sorted(got) == sorted(want)
    named = df.withColumn("vec_id", F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 4, "0")))
    got = [(int(r["query_id"][1:]), r["rank"], int(r["vec_id"][1:]), r["score"]) for r in vectors.top_k(named, F.substring("vec_id", 2, 9).cast("long") % 20 == 0, 7).collect()]
    assert sorted(got) == sorted(want)
    assert vectors.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from tallyloom.llm import packing

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert 50256 in library.encode(next(t for t in TEXTS if t and "endoftext" in t), add_special_tokens=False).ids
    capacity = 64
    got = rows_of(packing.pack(docs, P.path("byte_bpe_50k.json"), capacity, 2, keep_ids=True))
    by_doc = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) <= capacity and r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
        by_doc[r["doc_id"]].append(r)
    for r in docs.collect():
        parts = sorted(by_doc[r["doc_id"]], key=lambda x: (x["piece"], x["sequence_id"]))
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        one = [p for k, p in enumerate(parts) if k == 0 or p["piece"] != parts[k - 1]["piece"]]
        assert [i for p in one for i in p["ids"]] == ids and [p["start"] for p in one] == [sum(q["length"] for q in one[:k]) for k in range(len(one))]
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= math.ceil(sum(r["length"] for r in got) / capacity) + 1
    assert packing.pack(none, P.path("byte_bpe_50k.json")).count() == 0


def test_both_libraries_give_the_same_ids(tmp_path):
    import json

    from tallyloom.llm import packing

    path = P.path("byte_bpe_50k.json")
    tokens = packing.Tokens(path)
    latin = [chr(c) for c in (10, *range(0x20, 0x7F), *range(0xC0, 0x250))]
    texts = [t or "" for t in TEXTS] + [a + b + c for a in latin for b in " '\n1x\u00e9" for c in " sx\n"] + ["a <|endoftext|> b", "a" * 5000, " " * 9000 + "x", "it's we'LL \u00d7\u00f7 1\u0149a"]
    assert tokens.same is not None and tokens.encode(texts) == tokens.whole(texts) == tokens.remembered(texts)
    changed = json.load(open(path))
    changed["model"]["merges"][5:7] = changed["model"]["merges"][6:4:-1]
    (tmp_path / "other.json").write_text(json.dumps(changed))
    assert packing.same_merges(str(tmp_path / "other.json")) is None


def test_fullest_is_the_best_subset():
    from itertools import product

    from tallyloom.llm import packing

    counts = {7: 2, 5: 3, 11: 1, 3: 1}
    for room in range(1, 40):
        best = max(s for c in product(*(range(n + 1) for n in counts.values())) if (s := sum(k * m for k, m in zip(counts, c, strict=True))) <= room)
        got = packing.fullest(counts, room)
        assert sum(k * m for k, m in got) == best and all(m <= counts[k] for k, m in got)


def test_pipeline_stages_keep_columns(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.drop("label").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(18, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == columns, name
        now.write.parquet(str(tmp_path / name.replace(" ", "-")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
    out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
    assert out.select("doc_id").distinct().count() == now.select("doc_id").distinct().count() <= len(TEXTS)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()
