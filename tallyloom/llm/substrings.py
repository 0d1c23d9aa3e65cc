"""Exact substring dedup: suffixes that can be alike are brought together by anchors and sorted with hashed comparisons.

Every window of `length` bytes is represented by its minimal gram (an anchor). Alike windows have alike anchors, so only
suffixes that share an anchor's gram need comparing. Anchors whose whole neighbourhood (the union of the windows they
stand for) is found twice settle all their windows by counting. The rest, mostly the ends of repeated passages, are
sorted as suffixes: prefix polynomial hashes give the common extension of two suffixes by binary search, which makes a
comparison of the merge sort logarithmic; neighbours that agree are compared byte by byte, in case a hash lied.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_arrow, partitions_for, row_key, staged, text_of

#: Bytes of a gram, as a share of the length; bytes that are hashed at a time; suffixes that are sorted at a time.
GRAM_SHARE, CHUNK, SORTED = 0.4, 1 << 19, 1 << 17
#: Neighbourhoods of one gram that one task sorts; those of a more frequent gram are counted window by window instead, over all tasks.
MOST_CLASSES = 2048
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2 ** 64."""
    import numpy as np

    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Prefixes:
    """Prefix polynomial hashes of a buffer: the hash of any of its substrings in constant time."""

    def __init__(self, data, powers):
        import numpy as np

        self.data, self.up = data, powers[0]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[1][: len(data)], out=self.sums[1:])

    def of(self, start, length):
        # the sum's terms carry base ** -position; multiplied by base ** start they depend on the content alone
        return (self.sums[start + length] - self.sums[start]) * self.up[start]


def anchors_of(texts: list[bytes], length: int, gram: int, powers):
    """(text, first window, last window, anchor) for the runs of windows that an anchor stands for; positions within texts.

    Texts are hashed side by side in chunks; a text longer than a chunk is cut into overlapping ones, which only splits runs.
    """
    import numpy as np

    jobs, held, size = [], [], 0
    for t, data in enumerate(texts):
        for at in range(0, max(1, len(data) - length + 1), CHUNK - length + 1):
            part = data[at : at + CHUNK]
            if len(part) < length:
                continue
            if size + len(part) > CHUNK and held:
                jobs.append(held)
                held, size = [], 0
            held.append((t, at, part))
            size += len(part)
    if held:
        jobs.append(held)
    out = []
    for job in jobs:
        data = np.frombuffer(b"".join([x[2] for x in job]), np.uint8)
        sizes = np.array([len(x[2]) for x in job])
        starts = np.cumsum(sizes) - sizes
        n = len(data)
        hashes = Prefixes(data, powers).of(np.arange(n - gram + 1), gram)
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        low = (hashes >> np.uint64(20) << np.uint64(20)) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
        span, have = length - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        anchor = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        valid = np.zeros(n + 1, np.int8)
        np.add.at(valid, starts, 1)
        np.add.at(valid, starts + sizes - length + 1, -1)
        anchor[np.cumsum(valid[: len(anchor)]) == 0] = -1
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(anchor)]]) - 1
        keep = anchor[first] >= 0
        first, last = first[keep], last[keep]
        which = np.searchsorted(starts, first, "right") - 1
        shift = np.array([x[1] for x in job])[which] - starts[which]
        out.append((np.array([x[0] for x in job])[which], first + shift, last + shift, anchor[first] + shift))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4


def sorted_suffixes(prefixes: Prefixes, at, group, length: int):
    """Order of the suffixes at `at` by group, then by their first `length` bytes: a bottom-up merge sort, all merges of a level at once."""
    import numpy as np

    data = prefixes.data
    head = np.zeros(len(at), np.uint64)
    for i in range(8):
        head = head << np.uint64(8) | data[at + i].astype(np.uint64)
    order = np.lexsort((head, group))
    g, h = group[order], head[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
    stop = start + np.repeat(sizes, sizes)
    width = 1
    while width < (sizes.max() if len(sizes) else 0):
        live = np.flatnonzero(stop - start > width)
        base = start[live]
        offset = live - base
        run = offset // width
        right = run % 2 == 1
        lo = base + np.where(right, run - 1, run + 1) * width
        other = np.minimum(lo, stop[live])
        lo, hi = other.copy(), np.minimum(other + width, stop[live])
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            a, b = at[order[mid]], at[order[live[open_]]]
            common = extension(prefixes, a, b, length)
            ends = np.minimum(common, length - 1)
            x, y = data[a + ends], data[b + ends]
            before = np.where(common >= length, right[open_], x < y)  # equal: those of the left run stay in front
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        place = base + run // 2 * 2 * width + offset % width + (lo - other)
        fresh = order.copy()
        fresh[place] = order[live]
        order, width = fresh, width * 2
    return order


def extension(prefixes: Prefixes, a, b, length: int):
    """Length of the common prefix of the suffixes a and b, length at most, by binary search on hashes."""
    import numpy as np

    lo, hi = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = prefixes.of(a, mid) == prefixes.of(b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def repeated(contexts: list[bytes], groups: list[int], length: int, powers):
    """For each context a flag a window: whether another window of the same group (of any context) has the same bytes."""
    import numpy as np

    data = np.frombuffer(b"".join(contexts), np.uint8)
    prefixes = Prefixes(data, powers)
    windows = np.array([len(c) - length + 1 for c in contexts])
    sizes = windows + length - 1
    starts = np.cumsum(sizes) - sizes
    first = np.cumsum(windows) - windows
    at = np.arange(windows.sum()) - np.repeat(first, windows) + np.repeat(starts, windows)
    group = np.repeat(np.array(groups), windows)
    order = sorted_suffixes(prefixes, at, group, length)
    a, b = at[order[:-1]], at[order[1:]]
    same = np.flatnonzero((group[order[:-1]] == group[order[1:]]) & (prefixes.of(a, length) == prefixes.of(b, length)))
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    lied = False
    for k in range(0, len(same), 4096):
        part = same[k : k + 4096]
        lied |= not (view[a[part]] == view[b[part]]).all()
    flags = np.zeros(len(at), bool)
    if lied:  # a hash agreed where bytes differ: count whole windows instead
        seen: dict[tuple[int, bytes], list[int]] = {}
        for i, (g, s) in enumerate(zip(group.tolist(), at.tolist(), strict=True)):
            seen.setdefault((g, data[s : s + length].tobytes()), []).append(i)
        for members in seen.values():
            flags[members] = len(members) > 1
    else:
        flags[order[same]] = flags[order[same + 1]] = True
    return np.split(flags, first[1:])


def _runs(flags, shift: int) -> list[tuple[int, int]]:
    import numpy as np

    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()
    return [(shift + s, shift + e - 1) for s, e in zip(edges[::2], edges[1::2], strict=True)]


_SPANS = "_id bigint, _th bigint, s bigint, e bigint"


def repeated_windows(docs: DataFrame, length: int, id_column: str, text_column: str) -> DataFrame:
    """_id, _th, s, e: every window that starts at s to e of the row's text is found elsewhere too."""
    import numpy as np

    gram = max(1, int(length * GRAM_SHARE))
    spark = docs.sparkSession
    keyed = docs.select(*row_key(id_column, text_column), text_of(text_column).alias("text"))

    def find():
        from xxhash import xxh3_64_intdigest as digest

        powers = _powers(CHUNK + 1)

        def step(batch):
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            t, a, b, p = anchors_of(texts, length, gram, powers)
            rows = list(zip(t.tolist(), a.tolist(), b.tolist(), p.tolist(), strict=True))
            grams = np.array([digest(texts[i][q : q + gram]) for i, _, _, q in rows], np.uint64).view(np.int64)
            unions = np.array([digest(texts[i][x : y + length], q - x) for i, x, y, q in rows], np.uint64).view(np.int64)
            return ids[t], hashes[t], (a << 8 | (b - a)) if length <= 256 else a * length + (b - a), grams, unions

        return step

    wide = 256 if length <= 256 else length
    found = staged(map_arrow(keyed, find, "_id bigint, _th bigint, pos bigint, gram bigint, around bigint", 2), "anchors")
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("a0"), F.max("around").alias("a1")).where("n > 1")
    shared = staged(found.join(grams.select("gram", (F.col("a0") == F.col("a1")).alias("alike")), "gram"), "shared")
    mixed = shared.where(~F.col("alike"))
    classes = staged(mixed.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_th", "pos")).alias("r")).select("gram", "around", "n", "r.*"), "classes")
    spans = [F.floor(F.col("pos") / wide).alias("s"), (F.floor(F.col("pos") / wide) + F.col("pos") % wide).alias("e")]
    settled = shared.where("alike").unionByName(mixed.join(classes.where("n > 1").select("gram", "around"), ["gram", "around"], "left_semi").select(shared.columns)).select("_id", "_th", *spans)

    crowded = classes.groupBy("gram").count().where(F.col("count") > MOST_CLASSES).select("gram")
    asked = classes.join(crowded.withColumn("crowd", F.lit(True)), "gram", "left").select("_id", "_th", F.struct("gram", "pos", (F.col("n") == 1).alias("alone"), F.coalesce("crowd", F.lit(False)).alias("crowd")).alias("x"))
    asked = asked.groupBy("_id", "_th").agg(F.collect_list("x").alias("x"))
    cut_schema = "_id bigint, _th bigint, s bigint, gram bigint, alone boolean, crowd boolean, around binary"

    def cut():
        def step(batch):
            rows = []
            for i, h, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                for x in wanted:
                    s, n = divmod(x["pos"], wide)
                    rows.append((i, h, s, x["gram"], x["alone"], x["crowd"], data[s : s + n + length]))
            return list(zip(*rows, strict=True)) if rows else None

        return step

    around = staged(map_arrow(keyed.join(asked, ["_id", "_th"]).select("_id", "_th", "text", "x"), cut, cut_schema, 2), "around")

    def resolve(batches):
        import pyarrow as pa

        powers = _powers(SORTED * 4 + (length << 2) + 2)
        held: list[tuple] = []
        windows = size = 0

        def finish():
            number: dict[int, int] = {}
            groups = [number.setdefault(x[3], len(number)) for x in held]
            need = sum(len(x[6]) for x in held) + 2
            rows = []
            for x, flags in zip(held, repeated([x[6] for x in held], groups, length, powers if need <= len(powers[0]) else _powers(need)), strict=True):
                if x[4]:
                    rows += [(x[0], x[1], s, e) for s, e in _runs(flags, x[2])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([],) * 4)], ["_id", "_th", "s", "e"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if held and row[3] != held[-1][3] and (windows > SORTED or size > 2 * SORTED):
                    yield finish()
                    windows = size = 0
                held.append(row)
                windows += len(row[6]) - length + 1
                size += len(row[6])
        if held:
            yield finish()

    n = partitions_for(spark)
    sorted_ = around.where(~F.col("crowd")).repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(resolve, _SPANS)

    def windows_of():
        from xxhash import xxh3_128_digest as digest

        def step(batch):
            rows = [(i, h, s + k, bool(alone), digest(data[k : k + length])) for i, h, s, alone, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True) for k in range(len(data) - length + 1)]
            return list(zip(*rows, strict=True)) if rows else None

        return step

    single = map_arrow(around.where("crowd").select("_id", "_th", "s", "alone", "around"), windows_of, "_id bigint, _th bigint, s bigint, alone boolean, w binary", 4)
    twice = single.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    counted = single.where("alone").join(twice, "w", "left_semi").select("_id", "_th", "s", F.col("s").alias("e"))
    return settled.unionByName(sorted_).unionByName(counted)


def dedup_substrings(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """Remove every byte that a string of `length` bytes covers which starts anywhere else too, the same text included.

    Returns id_column, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: bytes, as a cut may fall
    inside a character), or for digests kept_sha256. One row per input row; texts are UTF-8, null is empty, and shorter
    texts lose nothing. Strings are judged on the input, so of repeated rows and exact copies every byte of those with
    `length` bytes goes. Null ids and extra columns do no harm; an empty table gives no rows. Exact but for 64-bit hashes
    of neighbourhoods (128-bit hashes of the windows of very frequent grams), by which equal ones are counted.
    """
    # rows alike in id and text bring the same spans, which a set holds once
    spans = repeated_windows(docs, length, id_column, text_column).groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "e")).alias("_spans"))
    keyed = docs.select(F.col(id_column), *row_key(id_column, text_column), text_of(text_column).alias("text"))
    joined = keyed.join(spans, ["_id", "_th"], "left").select(id_column, "text", "_spans")

    def make():
        import numpy as np

        def step(batch):
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                removed = runs = 0
                if spans:
                    edges = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edges, [x["s"] for x in spans], 1)
                    np.add.at(edges, [x["e"] + length for x in spans], -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    removed, runs = int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                else:
                    kept = data
                for column, value in zip(out, (len(data), removed, runs, hashlib.sha256(kept).hexdigest() if digests else kept), strict=True):
                    column.append(value)
            return (batch.column(0), *out)

        return step

    id_type = docs.schema[id_column].dataType.simpleString()
    return map_arrow(joined, make, f"{id_column} {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digests else "kept binary"))
