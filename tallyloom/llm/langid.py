"""Language identification by bit-sliced Bloom filters: one look-up of an n-gram returns the bits of all languages that contain it."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_arrow, staged, text_of

#: Letters of an n-gram; the edge of a word counts as one.
LENGTHS = (2, 3, 4)
#: A language contains an n-gram if it makes up so much of the language's n-grams of its length. So no language has more than 1 / LEAST_SHARE of a length, however large the corpus.
LEAST_SHARE = 2e-5
#: And if its share is at least so much of that in the language where it is most frequent: quotations and mislabelled texts do not make it one's own.
LEAST_OF_TOP = 0.3
#: Positions of a filter for each n-gram of the language that has most, and how many of them an n-gram sets.
PLACES, HASHES = 16, 5
#: Code points whose n-grams a task has in memory at a time.
WINDOW = 1 << 20
UNKNOWN = "und"


@functools.cache
def _kinds():
    """For every code point: 2 a letter, 1 a mark that belongs to one, 0 an edge."""
    import unicodedata

    import numpy as np

    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _codes(texts: list[str]):
    """The letters of all texts, lower-cased, as code points with 0 for everything else and around each text; where each text's own 0 stands, and if it has a letter."""
    import unicodedata

    import numpy as np

    folded = [unicodedata.normalize("NFC", t).lower() for t in texts]
    starts = np.cumsum([0] + [len(t) + 1 for t in folded])
    codes = np.frombuffer("\0".join(["", *folded, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds()[codes]
    lettered = np.add.reduceat((kinds == 2).astype(np.int64), starts[:-1]) > 0 if texts else np.zeros(0, bool)
    return np.where(kinds > 0, codes, 0).astype(np.uint32), starts, lettered


def _mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(codes, n: int):
    """Windows (places, hashes) of the n-grams of a code array: no edge inside, and not edges alone. Each n-gram comes once."""
    import numpy as np

    for at in range(0, max(0, len(codes) - n + 1), WINDOW):
        piece = codes[at : at + WINDOW + n - 1]
        m = len(piece) - n + 1
        good = (piece[:m] > 0) | (piece[1 : m + 1] > 0)
        for i in range(1, n - 1):
            good &= piece[i : i + m] > 0
        places = np.flatnonzero(good)
        h = np.full(len(places), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + piece[places + i]
        yield places + at, _mixed(h)


@dataclass(frozen=True)
class LanguageFilters:
    """One Bloom filter a language, sliced by bits: a row of `planes` holds one position of up to 64 languages' filters."""

    languages: list[str]
    documents: list[int]
    planes: object  # [words, positions], unsigned

    @property
    def fill(self):
        """How full each language's filter is."""
        import numpy as np

        bits = self.planes.dtype.itemsize * 8
        return np.array([((self.planes[i // bits] >> self.planes.dtype.type(i % bits)) & self.planes.dtype.type(1)).mean() for i in range(len(self.languages))])

    def false_positives(self):
        """The chance that a language's filter claims an n-gram which it does not hold."""
        return self.fill**HASHES

    def lookup(self, hashes):
        """[words, n-grams]: the bits of the languages that contain each n-gram."""
        import numpy as np

        size = self.planes.shape[1] - 1
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        found = None
        for i in range(HASHES):
            rows = self.planes[:, ((hashes + np.uint64(i) * step) & np.uint64(size)).astype(np.int64)]
            found = rows if found is None else found & rows
        return found

    def popcounts(self, codes, starts):
        """How many n-grams each text has, and how many of them each language contains: [texts], [texts, languages]."""
        import numpy as np

        texts, bits = len(starts) - 1, self.planes.dtype.itemsize * 8
        total, hits = np.zeros(texts, np.int64), np.zeros((texts, len(self.languages)), np.int64)
        for n in LENGTHS:
            for places, hashes in _grams(codes, n):
                if not len(places):
                    continue
                text = np.searchsorted(starts, places, "right") - 1
                first = np.flatnonzero(np.diff(text, prepend=-1))
                own = text[first]
                total[own] += np.diff(np.append(first, len(text)))
                found = self.lookup(hashes)
                for i in range(len(self.languages)):
                    hits[own, i] += np.add.reduceat(((found[i // bits] >> found.dtype.type(i % bits)) & found.dtype.type(1)).astype(np.int64), first)
        return total, hits

    def decide(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of each text and how far it leads: its corrected count over the sum of the two highest, 0 if no language has any."""
        import numpy as np

        codes, starts, lettered = _codes(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, hits = self.popcounts(codes, starts)
        wrong = self.false_positives()
        true = np.maximum((hits - total[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0.0)
        order = np.lexsort((np.broadcast_to(-np.array(self.documents), true.shape), -true), axis=1)
        best = np.take_along_axis(true, order[:, :2], 1)
        both = best.sum(1)
        score = np.where(lettered & (both > 0), best[:, 0] / np.maximum(both, 1e-300), 0.0)
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(order[:, 0], lettered, strict=True)], score.tolist()


def build(languages: list[str], documents: list[int], grams, member) -> LanguageFilters:
    """Filters from hashes of n-grams and, beside each, the number of a language that contains it."""
    import numpy as np

    most = max(np.bincount(member, minlength=1)) if len(member) else 1
    size = 1 << int(np.ceil(np.log2(max(1024, PLACES * most))))
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= np.dtype(k).itemsize * 8), np.uint64)
    bits = np.dtype(kind).itemsize * 8
    planes = np.zeros((max(1, -(-len(languages) // bits)), size), kind)
    grams = grams.astype(np.uint64)
    step = (grams >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        at = ((grams + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)
        for number in range(len(languages)):
            planes[number // bits, at[member == number]] |= kind(1 << number % bits)
    return LanguageFilters(languages, documents, planes)


def counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Rows (lang, n, gram, n_times): a task counts in sorted arrays, which it sends when they are long; sums of these are shuffled."""
    most = 1 << 20

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[tuple[str, int], list] = {}

        def packed(parts):
            hashes, times = np.concatenate([h for h, _ in parts]), np.concatenate([t for _, t in parts])
            unique, at = np.unique(hashes, return_inverse=True)
            return unique, np.bincount(at, times, len(unique)).astype(np.int64)

        def sent(key):
            hashes, times = packed(held.pop(key))
            for at in range(0, len(hashes), 50_000):
                h, t = hashes[at : at + 50_000], times[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(h)), pa.array([key[1]] * len(h), pa.int32()), pa.array(h.astype(np.int64)), pa.array(t)], names=["lang", "n", "gram", "n_times"])

        from tallyloom.llm.common import slices

        for piece in slices(batches, 1):
            langs, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            for lang in sorted(set(langs)):
                codes = _codes([t for t, own in zip(texts, langs, strict=True) if own == lang])[0]
                for n in LENGTHS:
                    key = lang, n
                    for _, hashes in _grams(codes, n):
                        unique, times = np.unique(hashes, return_counts=True)
                        held.setdefault(key, []).append((unique, times))
                        if len(held[key]) > 1 and sum(len(h) for h, _ in held[key]) > most // 2:
                            held[key] = [packed(held[key])]
                            if len(held[key][0][0]) > most // 4:
                                yield from sent(key)
        for key in sorted(held):
            yield from sent(key)

    rows = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "lang string, n int, gram bigint, n_times bigint").groupBy("lang", "n", "gram").agg(F.sum("n_times").alias("n_times"))


def members(counted: DataFrame, least_share: float = LEAST_SHARE, least_of_top: float = LEAST_OF_TOP) -> DataFrame:
    """Rows (gram, lang): the languages that contain each n-gram. At most 1 / least_share rows for a language and length."""
    totals = counted.groupBy("lang", "n").agg(F.sum("n_times").alias("total"))
    frequent = counted.join(totals, ["lang", "n"]).select("lang", "n", "gram", (F.col("n_times") / F.col("total")).alias("share")).where(F.col("share") >= least_share)
    top = frequent.groupBy("n", "gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("of"))
    return top.select("gram", F.explode(F.filter("of", lambda x: x["share"] >= least_of_top * F.col("top"))).alias("x")).select("gram", "x.lang")


def train(docs: DataFrame, chosen: Column, text_column: str = "text", lang_column: str = "lang", least_share: float = LEAST_SHARE, least_of_top: float = LEAST_OF_TOP) -> LanguageFilters:
    """Learn from every chosen row with a text and a language; the driver gets the members, whose number the least share bounds, and the languages with their documents.

    A null or empty text, or a null language, teaches nothing; repeated rows count each; texts of any length are counted
    whole, window by window. Without rows there are no languages.
    """
    rows = docs.where(chosen)
    known = sorted((r["lang"], r["n"]) for r in rows.where(F.col(text_column).isNotNull()).groupBy(F.col(lang_column).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect() if r["lang"] is not None)
    number = {lang: i for i, (lang, _) in enumerate(known)}
    found = members(staged(counts(rows, text_column, lang_column), "langid-counts"), least_share, least_of_top).toPandas()
    return build([x for x, _ in known], [n for _, n in known], found["gram"].to_numpy("int64"), found["lang"].map(number).to_numpy("int64"))


def identify(docs: DataFrame, model: LanguageFilters, keep: list[str], text_column: str = "text") -> DataFrame:
    """keep, lang_pred and score of every row; texts stay where they lie.

    A text without letters, empty or null is `und` with score 0. A text of which no language contains an n-gram gets the
    language with most documents, with score 0; so do ties, by documents, then by name. Repeated rows get one result,
    an empty table none; other columns are not looked at.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        def step(piece):
            pred, score = model.decide(piece.column(0).to_pylist())
            return [*piece.columns[1:], pred, score]

        return step

    return map_arrow(docs.select(text_of(text_column).alias("_text"), *keep), make, f"{schema}, lang_pred string, score double", 0)
