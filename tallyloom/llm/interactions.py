"""How filters interact: what each would remove in every order, from the counts of failure masks, and each one's Shapley value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import staged, text_of

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: The most filters: an audit has a row for each order, part and step.
MOST_FILTERS = 8


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D on a text: few words, few distinct words, many capitals, marks of tables and code."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, filters: dict[str, Column], id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """Rows (part, _id, _hash, mask, n): documents of a part and id with one text, and the filters that it fails, as bits in the order given.

    The last bit is set where the text is also that of a smaller id anywhere in the table. Texts are read once and travel
    as 128 bits of their hash. Only the smallest id of each hash is looked up, by hash and id together, so the copies of
    one text spread over all tasks. A row without id is never a copy, nor does it make others copies.
    """
    text = text_of(text_column)
    mask = sum((F.when(failed, 1 << bit).otherwise(0) for bit, failed in enumerate(filters.values())), F.lit(0))
    hashed = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    rows = docs.select(F.col(id_column).alias("_id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), hashed.alias("_hash"), mask.cast("int").alias("mask"))
    rows = staged(rows.groupBy("_hash", "_id", "part", "mask").agg(F.count("*").alias("n")), "failure-masks")
    first = rows.groupBy("_hash").agg(F.min("_id").alias("_id")).where("_id IS NOT NULL").withColumn("_first", F.lit(True))
    copy = F.when(F.col("_id").isNotNull() & F.col("_first").isNull(), 1 << len(filters)).otherwise(0)
    return rows.join(first, ["_hash", "_id"], "left").select("part", "_id", "_hash", (F.col("mask") + copy).cast("int").alias("mask"), "n")


def mask_cells(masks: DataFrame, labels: DataFrame, n_filters: int, id_column: str = "doc_id") -> DataFrame:
    """One row a part: arrays n, good and toxic of 2 ** n_filters counts, by failure mask. good: labelled quality = 1; toxic: toxic = 1.

    A label given twice counts once; ids without label are neither. Rows without id spread over the tasks of the join by their texts' hashes.
    """
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = known.withColumn("_at", F.col("_id").cast("string"))
    rows = masks.withColumn("_at", F.coalesce(F.col("_id").cast("string"), F.hex("_hash"))).join(known, ["_id", "_at"], "left")
    of = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c)
    cells = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))
    by_mask = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("cells"))
    each = lambda c: F.transform(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1)), lambda m: F.coalesce(F.try_element_at("cells", m)[c], F.lit(0))).alias(c)
    return by_mask.select("part", each("n"), each("good"), each("toxic"))


def adjacent_swaps(n: int):
    """The places i (swapped with i + 1) of a walk through all orders of n things by single adjacent transpositions, n! - 1 of them.

    The largest thing sweeps from one end to the other; between sweeps the others take one step of their own walk, shifted
    by one while the largest stands in front.
    """
    if n < 2:
        return
    inner, front = adjacent_swaps(n - 1), False
    while True:
        yield from range(n - 1) if front else range(n - 2, -1, -1)
        front = not front
        step = next(inner, None)
        if step is None:
            return
        yield step + front


def walk(letters: str, counts):
    """All orders with what each step removes, and for each filter: all that fail it, that fail it only, and its removals summed over the orders.

    counts: an array [parts, masks, measures]. removed: [parts, step, measures]; the walk keeps it and computes anew only
    the two steps that a swap touches, from the mask cells that no earlier filter holds.
    """
    import numpy as np

    k = len(letters)
    masks = np.arange(1 << k)

    def step(before: int, bit: int):
        return counts[:, (masks & before == 0) & (masks >> bit & 1 == 1)].sum(1)

    fails = np.stack([step(0, bit)[:, 0] for bit in range(k)], 1)
    unique = np.stack([counts[:, 1 << bit, 0] for bit in range(k)], 1)
    order, removed = list(range(k)), np.empty((len(counts), k, counts.shape[2]), np.int64)
    for i in range(k):
        removed[:, i] = step(sum(1 << b for b in order[:i]), order[i])
    shapley = np.zeros_like(fails)
    found, swaps = [], adjacent_swaps(k)
    while True:
        shapley[:, order] += removed[:, :, 0]
        found.append((list(order), removed.copy()))
        at = next(swaps, None)
        if at is None:
            return found, fails, unique, shapley
        order[at], order[at + 1] = order[at + 1], order[at]
        before = sum(1 << b for b in order[:at])
        removed[:, at], removed[:, at + 1] = step(before, order[at]), step(before | 1 << order[at], order[at + 1])


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """For every part, order of the filters (named by letters, bit by bit) and step: counts of what happens there.

    Returns part, filter_order, step (from 1), kept, removed, redundant (fail, but removed earlier), unique_fails (fail
    this filter only), good_lost, toxic_lost, shapley (removed by the filter, summed over all orders). One pass over the
    cells, a few parts at a time; a table without parts gives no rows.
    """
    if not 1 <= len(letters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(letters)}")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counts)
    arrow, k, orders = to_arrow_schema(StructType.fromDDL(schema)), len(letters), math.factorial(len(letters))
    few = max(1, 60_000 // (k * orders))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, few):
                piece = batch.slice(at, few)
                measures = np.stack([np.array(piece.column(c).to_pylist(), np.int64) for c in (1, 2, 3)], 2)
                found, fails, unique, shapley = walk(letters, measures)
                total, parts = measures[:, :, 0].sum(1), piece.num_rows
                for order, removed in found:
                    columns = [total[:, None] - removed[:, :, 0].cumsum(1), removed[:, :, 0], fails[:, order] - removed[:, :, 0], unique[:, order], removed[:, :, 1], removed[:, :, 2], shapley[:, order]]
                    name = "".join(letters[b] for b in order)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(0).take(pa.array(np.repeat(np.arange(parts), k))), pa.array([name] * (parts * k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), parts)), *(pa.array(c.ravel()) for c in columns)], schema=arrow,
                    )

    return cells.select("part", "n", "good", "toxic").mapInArrow(run, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source", filters: dict[str, Column] | None = None) -> DataFrame:
    """audit() of the filters given (text_filters by default) and, last, of exact copies: every part has a row for each order and step.

    The last letter follows that of the filters. A null text is empty, a null part the empty string; long texts are
    read where they lie; repeated rows count each, and none is a copy of another of its id; other columns, of any name,
    are not looked at; an empty table gives no rows.
    """
    filters = text_filters(text_of(text_column)) if filters is None else filters
    letters = "".join(filters) + chr(ord(max(filters)) + 1)
    masks = failure_masks(docs, filters, id_column, text_column, part_column)
    return audit(mask_cells(masks, labels, len(letters), id_column), letters)
