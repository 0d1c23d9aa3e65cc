"""Toxicity of texts as readers see them: a noisy channel restores disguised words, then a classifier scores the restored text."""

from __future__ import annotations

import math
import re
from zlib import crc32
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import forget, map_arrow, staged, text_of

#: Letters of the language model: a-z, then the word's edge and any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, SIZE = 26, 27, 28
#: Signs that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c",
    "<": "c", "{": "c", "[": "c", "#": "h", "%": "o", "^": "a", "*": "aeiouy", "?": "aeiouy", "_": "", "-": "", ".": "", "~": "", "=": "", "'": "", "`": "", ",": "", ":": "", ";": "",
    ")": "", "]": "", "}": "", "/": "", "\\": "", "&": "", '"': "", ">": "",
}
#: log probabilities of the channel: a letter as itself, as a sign, a letter written again, a sign that stands for nothing.
PLAIN, SIGN, AGAIN, NOTHING = math.log(0.90), math.log(0.06), math.log(0.03), math.log(0.01)
#: Digits and signs drawn like a letter seldom stand for nothing.
DRAWN, SELDOM = frozenset("0123456789@$"), math.log(0.0002)
#: Words of the lexicon count so many times in the language model, relative to the mean word.
BOOST = 200.0
#: Hash buckets of word features. Every feature that speaks is in the lexicon, so this bounds it.
BUCKETS = 1 << 18
#: Documents of the rarer label that must have a feature, and the least log-odds, before it speaks.
LEAST_DOCUMENTS, LEAST_ODDS = 4, 2.5
#: Steps of 1/20 in which calibration counts sums of evidence; the last bin takes the rest.
BINS = 400
#: Labels to learn from, about: more are sampled by a hash of the id. The bound makes the labels fit to broadcast, so that no
#: text is shuffled to its label. It bounds the fit only; every text is scored, and the letters are counted in all of them.
MOST_LABELS = 500_000

_WORDS = re.compile(r"[^\W\d_]+")
#: A word is disguised if a sign or digit stands beside letters inside it, or if a letter comes three times or more.
_SIGN = re.compile(r"[^\W\d_][0-9@$!|+*#%^?(\-_.~=]+[^\W_]|[0-9@$!|+*#%^][^\W\d_]|[^\W\d_][$*#%@!|+0-9]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_TAIL = re.compile(r"([^\w\s])\1\1+$")  # a decoration, not letters
#: No word has a letter three times in a row; however often it is written, it stands for two at most.
_MORE = re.compile(r"([^\W\d_])\1{2,}")
#: Four single letters or more, set apart.
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?!\S)")


def fold(word: str) -> list[int]:
    import unicodedata

    out = []
    for c in word.lower():
        if c in LETTERS:
            out.append(LETTERS.index(c))
        else:
            base = unicodedata.normalize("NFKD", c)[0]
            out.append(LETTERS.index(base) if base in LETTERS else OTHER)
    return out


@dataclass
class Model:
    """trigrams: log probabilities of a letter after two; lexicon: features and their log-odds; slope, weight: the calibration."""

    trigrams: object
    lexicon: dict[int, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    constant: float = 0.0


def features(word: str) -> list[int]:
    """Hash buckets of a lower-case restored word: itself and its beginnings of 4 to 6 letters."""
    n = len(word)
    whole = crc32(b"=" + word.encode()) % BUCKETS
    if n < 4:
        return [whole]
    return [whole, *(crc32(word[:k].encode()) % BUCKETS for k in range(4, min(n, 6) + 1))]


def viterbi(signs: str, trigrams, words: bool = False) -> str:
    """The likeliest letters behind signs. States are the last two letters; a sign may be a letter, repeat the last, or be nothing.

    words: signs are single letters set apart, and before each of them a word may end and another begin, which gives a blank.
    No state is dropped: there are SIZE ** 2 at most, so the result is the best path and the time linear in the signs.
    """
    best: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
    for c in signs.lower():
        if words and c.isalnum():
            p, path = max(((p + trigrams[a][b][EDGE], path) for (a, b), (p, path) in best.items() if b != EDGE), key=lambda x: x[0], default=(-math.inf, ()))
            if path and ((EDGE, EDGE) not in best or best[EDGE, EDGE][0] < p):
                best[EDGE, EDGE] = p, (path, EDGE)
        if c in LOOKALIKES:
            options = [(LETTERS.index(x), SIGN) for x in LOOKALIKES[c]]
            drop = 0.0 if not options else SELDOM if c in DRAWN else NOTHING
        elif c.isspace():
            options, drop = [], 0.0
        else:
            options, drop = [(fold(c)[0], PLAIN)], None
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (p, path) in best.items():
            row = trigrams[a][b]
            for x, cost in options:
                q, key = p + cost + row[x], (b, x)
                if key not in after or after[key][0] < q:
                    after[key] = q, (path, x)
                if x == b and ((a, b) not in after or after[a, b][0] < p + AGAIN):
                    after[a, b] = p + AGAIN, path
            if drop is not None and ((a, b) not in after or after[a, b][0] < p + drop):
                after[a, b] = p + drop, path
        best = after
    _, path = max(((p + trigrams[a][b][EDGE], path) for (a, b), (p, path) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, x = path
        out.append(LETTERS[x] if x < 26 else " " if x == EDGE else "·")
    return "".join(reversed(out))


def decoded(signs: str, trigrams, words: bool = False) -> str:
    core = _MORE.sub(r"\1\1", _TAIL.sub("", signs.strip(".,;:?\"')]}>(")))
    return viterbi(core, trigrams, words) if len(core) > 2 and any(map(str.isalpha, core)) else ""


def words_of(token: str, trigrams) -> list[str]:
    """The words of a token between blanks, and the word that it disguises, if it does."""
    out = [token] if (plain := token.isalpha()) else _WORDS.findall(token)
    if len(token) > 2 and (not plain and _SIGN.search(token) or len(token) > len(set(token)) + 1 and _TRIPLE.search(token)):
        if word := decoded(token, trigrams):
            out.append(word)
    return out


def spaced(text: str, trigrams) -> list[str]:
    """Words written letter by letter; a run may hold several."""
    return [w for m in _SPACED.findall(text) for w in decoded(m, trigrams, True).split()]


def restore(text: str, trigrams) -> str:
    """The text with its disguised words decoded."""
    joined = _SPACED.sub(lambda m: decoded(m.group(), trigrams, True) or m.group(), text)
    return re.sub(r"\S+", lambda m: (words_of(m.group(), trigrams)[len(_WORDS.findall(m.group())) :] or [m.group()])[0], joined)


def letter_counts(docs: DataFrame, text_column: str = "text"):
    """Trigram counts of letters over all texts, SIZE ** 3 numbers; a task sends what it has seen once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tallyloom.llm.common import slices

        total, table = np.zeros(SIZE**3, np.int64), _letter_table()
        for batch in slices(batches, 0):
            codes = np.frombuffer(f"  {' '.join(batch.column(0).to_pylist())} ".encode("utf-32-le"), "<u4")
            letters = table[np.minimum(codes, len(table) - 1)]
            one = letters[1:-1]
            two = np.where(one == EDGE, EDGE, letters[:-2])  # before a word's first letter stand two edges
            keep = (one != EDGE) | (letters[2:] != EDGE)
            total += np.bincount(((two * SIZE + one) * SIZE + letters[2:])[keep], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["k", "n"])

    import numpy as np

    out = np.zeros(SIZE**3)
    for r in docs.select(text_of(text_column).alias("text")).mapInArrow(run, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out.reshape(SIZE, SIZE, SIZE)


def _letter_table():
    """Letter of every code point up to Latin Extended-B, an edge for what is none; the last entry stands for all beyond."""
    import numpy as np

    return np.array([fold(chr(c))[0] if chr(c).isalpha() else EDGE for c in range(0x250)] + [OTHER], np.int32)


def smoothed(counts, lexicon: dict[str, float] | None = None):
    """log probabilities of trigrams, backed by bigrams and single letters; words of the lexicon weigh BOOST mean trigram counts."""
    import numpy as np

    counts = counts.copy()
    if lexicon:
        share = BOOST * max(1.0, counts.sum() / max(1, np.count_nonzero(counts))) / 100
        for word in lexicon:
            letters = [EDGE, EDGE, *fold(word), EDGE]
            for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
                counts[a, b, c] += share
    one = (counts.sum((0, 1)) + 1) / (counts.sum() + SIZE)
    pair = counts.sum(0)
    two = (pair + 50 * one) / (pair.sum(1, keepdims=True) + 50)
    three = (counts + 50 * two[None]) / (counts.sum(2, keepdims=True) + 50)
    return np.log(three).tolist()


def _odds(docs: DataFrame, text_column: str, label: str, trigrams) -> DataFrame:
    """Documents of each label that have a feature, over all rows given; summed over tasks."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        from tallyloom.llm.common import slices

        found = {0: Counter(), 1: Counter()}
        held: dict[str, list[int]] = {}
        for batch in slices(batches, 0):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = t.lower()
                mine = {f for w in spaced(low, trigrams) for f in features(w)}
                for token in set(low.split()):
                    if (f := held.get(token)) is None:
                        held[token] = f = [x for w in words_of(token, trigrams) for x in features(w)]
                    mine.update(f)
                found[y].update(mine)
                forget(held, 300_000)
        for y, counts in found.items():
            items = list(counts.items())
            for at in range(0, len(items), 50_000):
                part = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()), pa.array([v if y == 0 else 0 for _, v in part], pa.int64()), pa.array([v if y else 0 for _, v in part], pa.int64())], ["f", "n0", "n1"])

    counted = docs.select(text_of(text_column).alias("text"), F.col(label)).mapInArrow(run, "f int, n0 bigint, n1 bigint")
    return counted.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", most_labels: int = MOST_LABELS) -> Model:
    """Fit on the labelled rows where learn is true; the letters' language model counts all docs.

    At most about most_labels labelled ids are learned from, drawn by a hash of the id if there are more. Feature counts are
    taken from one half of the rows and the calibration from the other (by the id's hash), both over every row of their
    half. An id labelled twice has the greater label; null ids and labels are not learned from. What reaches the driver is
    bounded: SIZE ** 3 letter counts, BUCKETS features and words, 2 * BINS calibration counts; so are the labels broadcast.
    """
    counts = letter_counts(docs, text_column)
    every = staged(labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label).cast("int").alias("_y")), "labels")
    share = min(1.0, most_labels / max(1, every.count()))
    known = F.broadcast(every.where(F.pmod(F.xxhash64(id_column, F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20))))
    rows = docs.where(learn).select(id_column, text_of(text_column).alias("text")).join(known, id_column).select(F.xxhash64(id_column).bitwiseAND(F.lit(1)).alias("_half"), "text", F.when(F.col("_y") > 0, 1).otherwise(0).alias("_y"))
    plain = smoothed(counts)
    first = rows.where("_half = 0")
    n = {r["_y"]: r["count"] for r in first.groupBy("_y").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
    speaks = _odds(first, "text", "_y", plain).withColumn("w", odds).where((F.col("n1") >= LEAST_DOCUMENTS) & (F.col("w") >= LEAST_ODDS))
    lexicon = {r["f"]: float(r["w"]) for r in speaks.collect()}
    model = Model(plain, lexicon)
    model.words = _lexicon_words(first, model)
    model.trigrams = smoothed(counts, model.words)
    binned = evidence(rows.where("_half = 1"), model, ["_y"]).groupBy("_y", F.least(F.floor(F.col("evidence") * 20), F.lit(BINS - 1)).cast("int").alias("b")).count().collect()
    model.slope, model.constant = calibrate([(r["b"] / 20, r["_y"], r["count"]) for r in binned])
    return model


def _lexicon_words(rows: DataFrame, model: Model) -> dict[str, float]:
    """The whole words of toxic rows whose own feature is in the lexicon; of words that share a bucket the most frequent."""
    lexicon = model.lexicon

    def make():
        def step(batch):
            found = {w: f for t in batch.column(0).to_pylist() for w in _WORDS.findall(t.lower()) if (f := crc32(("=" + w).encode()) % BUCKETS) in lexicon}
            return list(found), list(found.values())

        return step

    found = map_arrow(rows.where("_y = 1").select("text"), make, "w string, f int", 0).groupBy("f", "w").count()
    return {r["w"]: lexicon[r["f"]] for r in found.groupBy("f").agg(F.max_by("w", F.struct("count", "w")).alias("w")).collect()}


def calibrate(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic slope and constant of (evidence, label, count), by Newton's steps with a weak prior."""
    import numpy as np

    x, y, n = (np.array(c, float) for c in zip(*points, strict=True)) if points else (np.zeros(0),) * 3
    a, b = 1.0, -3.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(n * (y - p) * x) - 0.1 * (a - 1), np.sum(n * (y - p)) - 0.1 * (b + 3)])
        w = n * p * (1 - p)
        h = np.array([[np.sum(w * x * x) + 0.1, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    return float(max(a, 0.0)), float(b)


def evidence(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns of keep and evidence: the sum over a text's distinct restored tokens of the best log-odds among a token's features."""
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    lexicon, trigrams = model.lexicon, model.trigrams

    class Weights(dict):
        def __missing__(self, token):
            forget(self, 300_000)
            self[token] = w = max((lexicon.get(f, 0.0) for word in words_of(token, trigrams) for f in features(word)), default=0.0)
            return w

    def make():
        weights = Weights()

        def step(batch):
            out = []
            for t in batch.column(0).to_pylist():
                low = t.lower()
                tokens = {*low.split(), *spaced(low, trigrams)}
                out.append(float(sum(map(weights.__getitem__, tokens))))
            return (*(batch.column(i + 1) for i in range(len(keep))), out)

        return step

    return map_arrow(docs.select(text_of(text_column).alias("_text"), *keep), make, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", evidence double", 0)


def score(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text", threshold: float = 0.7) -> DataFrame:
    """The columns of keep, score (0 to 1) and predicted (1 from threshold on): one row per input row, one pass, no shuffle.

    A null or empty text has no evidence and gets the score of that. Very long texts are read whole; repeated rows are
    scored alike. A model without training rows scores all texts alike.
    """
    z = F.lit(model.slope) * F.col("evidence") + F.lit(model.constant)
    scored = evidence(docs, model, keep, text_column).withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(*keep, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
