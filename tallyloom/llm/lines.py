"""Line dedup with two Bloom filters (seen once, seen twice): only suspected repeats are shuffled and counted exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_arrow, partitions_for, row_key, slices, staged, text_of

#: Bits of a filter for each line, and the most that a filter may have (32 MB). A full filter suspects more lines, so it costs
#: shuffle, never a result.
BITS_A_LINE, MOST_BITS, LEAST_BITS = 16, 1 << 28, 1 << 16
PROBES = 3
BLOCK = 1 << 16  # bytes of a filter that travel together
_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str) -> list[bytes]:
    """The key of every line: white space stripped at both ends, A-Z lower-cased."""
    return [x.strip(_SPACE) for x in text.encode().lower().split(b"\n")]


def _hashes(texts: list[str], shortest: int):
    """64-bit hashes of the distinct keys of each text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest as digest

    return np.array([digest(k) for t in texts for k in set(line_keys(t)) if _points(k) >= shortest], np.uint64)


def _points(key: bytes) -> int:
    """Code points of UTF-8 bytes (a key that ASCII lower-casing and stripping left valid)."""
    return len(key) if key.isascii() else len(key.decode())


def _probe(hashes, bits: int):
    import numpy as np

    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]


def _has(filter_, hashes, bits: int):
    import numpy as np

    found = np.ones(len(hashes), bool)
    for at in _probe(hashes, bits):
        found &= (filter_[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def _add(filter_, hashes, bits: int) -> None:
    import numpy as np

    for at in _probe(hashes, bits):
        np.bitwise_or.at(filter_, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def seen_twice(docs: DataFrame, text_column: str, bits: int, shortest: int) -> bytes:
    """The filter of keys that two documents or more may have; bits / 8 bytes.

    Every task fills its own pair of filters. Pairs are folded block by block, in a stream: what both sides have seen
    once joins the filter of those seen twice.
    """

    def fill(batches):
        import numpy as np
        import pyarrow as pa

        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for batch in slices(batches, 0):
            found, counts = np.unique(_hashes(batch.column(0).to_pylist(), shortest), return_counts=True)
            _add(twice, found[(counts > 1) | _has(once, found, bits)], bits)
            _add(once, found, bits)
        for k, at in enumerate(range(0, bits >> 3, BLOCK)):
            a, b = once[at : at + BLOCK], twice[at : at + BLOCK]
            if a.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "once": [a.tobytes()], "twice": [b.tobytes()]})

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        block, once, twice = None, None, None
        for batch in batches:
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if k != block:
                    if block is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "twice": [twice.tobytes()]})
                    block, once, twice = k, a.copy(), b.copy()
                else:
                    twice |= b | (once & a)
                    once |= a
        if block is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "twice": [twice.tobytes()]})

    filled = docs.select(text_of(text_column).alias("text")).mapInArrow(fill, "block int, once binary, twice binary")
    folded = filled.repartition(min(partitions_for(docs.sparkSession), max(1, (bits >> 3) // BLOCK)), "block").sortWithinPartitions("block").mapInArrow(fold, "block int, twice binary")
    out = bytearray(bits >> 3)
    for r in folded.toLocalIterator():
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(r["twice"])] = r["twice"]
    return bytes(out)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", in_documents: int = 10, shortest: int = 1, keep_first: bool = False) -> DataFrame:
    """Drop the lines whose key at least in_documents documents have (all of them, or with keep_first all but the first).

    Returns the columns of docs with text replaced, and n_lines (before) and n_dropped; one row per input row. A line's
    key is the line stripped of ASCII white space, A-Z lower-cased; keys of fewer than shortest code points are left
    alone, so empty lines stay. A null or empty text is one empty line and becomes empty. Rows count as documents: of
    repeated rows each counts, and all get the same lines dropped; with keep_first, the first line is that of the least
    (id, text hash, line number), where ids that are no whole numbers count as the least. Extra columns stay, whatever their names; those named n_lines or n_dropped give way.
    """
    lines = docs.agg(F.coalesce(F.sum(F.length(text_of(text_column)) - F.length(F.replace(text_of(text_column), F.lit("\n"), F.lit(""))) + 1), F.lit(1))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_LINE * int(lines) - 1).bit_length()))
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast(seen_twice(docs, text_column, bits, shortest))

    def suspects():
        import hashlib

        import numpy as np
        from xxhash import xxh3_64_intdigest as digest

        filter_ = np.frombuffer(twice.value, np.uint8)

        def step(batch):
            out: list[list] = [[], [], [], []]
            rows, keys, at = [], [], []
            for r, t in enumerate(batch.column(2).to_pylist()):
                where: dict[bytes, list[int]] = {}
                for i, k in enumerate(line_keys(t)):
                    where.setdefault(k, []).append(i)
                for k, i in where.items():
                    if _points(k) >= shortest:
                        rows.append(r)
                        keys.append(k)
                        at.append(i)
            likely = np.flatnonzero(_has(filter_, np.array([digest(k) for k in keys], np.uint64), bits)) if keys else []
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for j in likely:
                for column, value in zip(out, (ids[rows[j]], hashes[rows[j]], hashlib.sha256(keys[j]).digest(), at[j]), strict=True):
                    column.append(value)
            return out

        return step

    keyed = docs.select(*row_key(id_column, text_column), text_of(text_column).alias("text"))
    found = staged(map_arrow(keyed, suspects, "_id bigint, _th bigint, key binary, at array<int>", 2), "lines")
    least = F.min(F.struct("_id", "_th", F.col("at")[0].alias("line"))).alias("first")
    frequent = found.groupBy("key").agg(F.count("*").alias("n"), *([least] if keep_first else [])).where(F.col("n") >= in_documents).drop("n")
    # written, so that both sides of the join come from a table and adaptive execution can split a line that very many documents have
    hits = found.hint("merge").join(staged(frequent, "frequent"), "key")
    if keep_first:
        own = (F.col("first._id") == F.col("_id")) & (F.col("first._th") == F.col("_th"))
        hits = hits.withColumn("at", F.when(own, F.filter("at", lambda i: i != F.col("first.line"))).otherwise(F.col("at")))
    # rows alike in id and text bring the same places, which a set holds once
    dropped = hits.groupBy("_id", "_th").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("_at"))

    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]).alias("_doc"), *row_key(id_column, text_column))
    whole = text_of(F.col("_doc").getField(text_column))
    parts = F.split(whole, "\n", -1)
    # the lines are bound to a variable, so that the text is split once and not for each line that stays
    without = F.transform(F.array(parts), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("_at")), lambda i: p[i]), "\n"))[0]
    done = kept.join(dropped, ["_id", "_th"], "left").withColumns({"_lines": F.size(parts).cast("long"), "_dropped": F.coalesce(F.size("_at"), F.lit(0)).cast("long")})
    text = F.when(F.col("_dropped") > 0, without).otherwise(whole)
    return done.select(F.col("_doc").withField(f"`{text_column}`", text).alias("_doc"), "_lines", "_dropped").select("_doc.*", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
