"""Quality rules as a short-circuit cascade: rules are ordered by rejection per cost, measured on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tallyloom.llm.common import map_arrow, text_of

#: Rows (at most) on which costs and selectivities are measured. It sets only the order of the rules, never a verdict.
SAMPLE_ROWS = 2000
#: Up to so many words a twentieth of them must be distinct; beyond, the number asked for grows with the root of the length.
DISTINCT_AT = 2000
_SYMBOLS = "#*$%&|<>"
_STRIP = "\x20\x09\x0a\x0b\x0c\x0d"


def _count(text: str, marks: str) -> int:
    return sum(map(text.count, marks))


@dataclass
class Doc:
    """A text with what the base measures have already found."""

    text: str
    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def base(text: str) -> Doc:
    import numpy as np

    words = text.encode().split()  # of bytes, split() takes exactly the six ASCII blanks
    n = len(words)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_STRIP):
            seen.add(line)
    repeat = 0
    if n >= 4:
        ids: dict[str, int] = {}
        w = np.fromiter([ids.setdefault(x, len(ids)) for x in words], np.int64, n)
        v = len(ids)
        if v < 1 << 21:
            windows = (w[:-2] * v + w[1:-1]) * v + w[2:]
        else:
            pairs = np.unique(w[:-2] * v + w[1:-1], return_inverse=True)[1]
            windows = pairs * v + w[2:]
        order = np.sort(windows)
        again = order[1:][order[1:] == order[:-1]]
        if again.size:
            hit = np.isin(windows, again)
            marked = np.zeros(n, bool)
            marked[:-2] |= hit
            marked[1:-1] |= hit
            marked[2:] |= hit
            repeat = int(marked.sum())
    return Doc(text, words, len(text) - _count(text, _STRIP), _count(text, _SYMBOLS), dup, repeat)


def _share_alpha(d: Doc) -> bool:
    return 10 * sum(1 for w in d.words if not w.isalpha() and not any(map(str.isalpha, w.decode()))) > 5 * len(d.words)


def _mean_length(d: Doc) -> bool:
    return not 2 * len(d.words) <= d.word_chars <= 15 * len(d.words)


def _symbols(d: Doc) -> bool:
    return 2 * d.n_symbols > len(d.words)


def _dup_lines(d: Doc) -> bool:
    return d.n_dup_lines > 4 and 2 * d.n_dup_lines > d.text.count("\n") + 1


def _bullets(d: Doc) -> bool:
    lines = [x for x in d.text.split("\n") if x.strip(_STRIP)]
    return len(lines) >= 4 and 10 * sum(x.lstrip(_STRIP)[0] in "-*•|" for x in lines) > 9 * len(lines)


def _ellipsis(d: Doc) -> bool:
    lines = [x for x in d.text.split("\n") if x.strip(_STRIP)]
    return len(lines) >= 4 and 10 * sum(x.rstrip(_STRIP).endswith(("...", "…")) for x in lines) > 3 * len(lines)


def _top_word(d: Doc) -> bool:
    from collections import Counter

    return len(d.words) >= 50 and 10 * Counter(d.words).most_common(1)[0][1] > 3 * len(d.words)


def _distinct(d: Doc) -> bool:
    # a vocabulary grows with the root of a text's length, so the share asked for falls as 1 / root beyond DISTINCT_AT words
    n = len(d.words)
    return n >= 50 and 400 * len(set(d.words)) ** 2 < n * min(n, DISTINCT_AT)


def _braces(d: Doc) -> bool:
    return 20 * _count(d.text, "{}") > len(d.words)


def _controls(d: Doc) -> bool:
    return 50 * d.text.count("�") > len(d.text)


#: Each rule says whether it rejects a text. The verdict is the same in every order: kept if none rejects.
RULES = {
    "no_letters": _share_alpha, "mean_length": _mean_length, "symbols": _symbols, "dup_lines": _dup_lines, "bullets": _bullets,
    "ellipsis": _ellipsis, "top_word": _top_word, "distinct": _distinct, "braces": _braces, "replacement": _controls,
}


def base_failed(d: Doc, min_words: int = 50, repeat_percent: int = 50) -> bool:
    n = len(d.words)
    return n < min_words or 100 * d.n_repeat_words > repeat_percent * n


def plan(docs: DataFrame, text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Measure each rule's cost and selectivity on a bounded sample and order the rules by rejections per second.

    Independent rules are cheapest in this order. An empty table gives the written order. Texts are measured where they
    lie, and the limit takes their measurements: partitions are read one by one until there are enough, nothing is
    shuffled, and the driver gets two small arrays for each row of the sample.
    """

    def make():
        def measured(d):
            rejected, seconds = [], []
            for rule in RULES.values():
                began = time.perf_counter()
                rejected.append(rule(d))
                seconds.append(time.perf_counter() - began)
            return rejected, seconds

        def step(batch):
            found = [None if base_failed(d := base(t)) else measured(d) for t in batch.column(0).to_pylist()]
            return [m and m[0] for m in found], [m and m[1] for m in found]

        return step

    texts = docs.select(text_of(text_column).alias("text"))
    rows = [r for r in map_arrow(texts, make, "rejected array<boolean>, seconds array<double>", 0).limit(sample_rows).collect() if r["rejected"]]
    tried, out = len(rows), []
    for at, name in enumerate(RULES):
        rejected, seconds = sum(r["rejected"][at] for r in rows), sum(r["seconds"][at] for r in rows)
        share, cost = ((rejected + 0.5) / (tried + 1), seconds / tried + 1e-9) if tried else (0.0, 1.0)
        out.append({"rule": name, "selectivity": share, "cost": cost, "per_cost": share / cost, "at": at})
    return sorted(out, key=lambda r: (-r["per_cost"], r["at"]))


def cascade(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", order: list[str] | None = None, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Measures and verdict of every text: base measures, base_failed, the first rule that rejects, kept.

    Returns id_column, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by (null if
    none), kept. One row per input row, one pass, no shuffle. A null or empty text has no words and fails. A text that
    fails the base rules meets no other rule; after that, the first rejecting rule ends the cascade. rejected_by
    depends on the order, which follows the sample's timings; kept does not.
    """
    order = [r["rule"] for r in plan(docs, text_column)] if order is None else order
    id_type = docs.schema[id_column].dataType.simpleString()

    def make():
        rules = [(name, RULES[name]) for name in order]

        def step(batch):
            found = [base(t) for t in batch.column(1).to_pylist()]
            failed = [base_failed(d, min_words, repeat_percent) for d in found]
            by = [None if f else next((name for name, rule in rules if rule(d)), None) for d, f in zip(found, failed, strict=True)]
            return (
                batch.column(0), [len(d.words) for d in found], [d.word_chars for d in found], [d.n_symbols for d in found], [d.n_dup_lines for d in found],
                [d.n_repeat_words for d in found], failed, ["base" if f else b for f, b in zip(failed, by, strict=True)], [not f and b is None for f, b in zip(failed, by, strict=True)],
            )

        return step

    schema = f"{id_column} {id_type}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, rejected_by string, kept boolean"
    return map_arrow(docs.select(id_column, text_of(text_column).alias("text")), make, schema)
