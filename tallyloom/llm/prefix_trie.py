"""A prefix trie of conversations: partitions emit small node tables, hash-keyed merges add them up in a tree, a rollup sums subtrees.

Texts are never shuffled: a turn travels as the hash of its role and text and its length in code points.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import partitions_for, staged, text_of

#: Partial tables that one merge of the tree adds up, and so the rows that a node has there (each flush of a full table adds one).
FAN = 64
#: Nodes that a task holds at a time; a full table is emitted and begun anew, as the merges add up whatever there is.
TABLE = 50_000
#: Conversation ids of one end list that a row holds; longer lists go on in further rows.
ENDS = 4096

#: part: the partition that emitted the row; first_end: the first of ends; conv_id: the smallest member seen.
_PARTIAL = "node binary, parent binary, depth int, size bigint, conv_id bigint, n_convs bigint, part int, first_end bigint, ends array<bigint>"
_WHOLE = "node binary, parent binary, depth int, size bigint, conv_id bigint, n_convs bigint, n_ends bigint, ends_sha256 string"
ROOT = bytes(16)


def _child(parent: bytes, key: bytes) -> bytes:
    return hashlib.blake2b(parent + key, digest_size=16).digest()


class NodeTable:
    """Nodes of the conversations that a task has walked so far, with the members and the ends of each."""

    def __init__(self, part: int, longest: int) -> None:
        self.part, self.longest, self.nodes, self.held = part, longest, {}, 0

    def add(self, node: bytes, parent: bytes | None, depth: int, size: int, conv: int, members: int = 1) -> list:
        entry = self.nodes.get(node)
        if entry is None:
            entry = self.nodes[node] = [parent, depth, size, conv, 0, []]
            self.held += 1
        entry[3] = min(entry[3], conv)
        entry[4] += members
        return entry

    def end(self, conv: int, node: bytes, parent: bytes | None, depth: int, size: int) -> None:
        self.add(node, parent, depth, size, conv, 0)[5].append(conv)
        self.held += 1

    def rows(self):
        for node, (parent, depth, size, conv, members, ends) in self.nodes.items():
            ends.sort()
            for at in range(0, max(1, len(ends)), self.longest):
                piece = ends[at : at + self.longest]
                yield node, parent, depth, size, conv, 0 if at else members, self.part, piece[0] if piece else None, piece
        self.nodes, self.held = {}, 0


def _streamed(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow of a generator from rows to rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(run(_rows(batches)), arrow), schema)


def _batches(rows, arrow):
    """Arrow batches of rows, so that a task holds a few at a time."""
    import pyarrow as pa

    part, weight = [], 0
    for row in rows:
        part.append(row)
        weight += 1 + (len(row[-1]) // 8 if row[-1] else 0)
        if weight >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)
            part, weight = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _walk(rows, longest: int, most: int, list_of: int):
    """Walk the turns of a partition, conversation by conversation, the source of borrowed turns before those that borrow from it."""
    from pyspark import TaskContext

    table = NodeTable(TaskContext.get().partitionId(), list_of)
    source = conv = None
    heads: list[tuple[bytes, int]] = []
    at, own, skip, late = None, 0, 0, None  # at: node, parent, depth, size

    def begin(c):
        table.add(ROOT, None, 0, 0, c)
        return ROOT, None, 0, 0

    def step(c, here, key, size):
        there = _child(here[0], key), here[0], here[2] + 1, size
        table.add(*there, c)
        return there

    def close(upto=None):
        """Note the end of the conversation walked; that of the source, walked first, only when its id's turn has come, as end lists ascend."""
        nonlocal late
        if conv == source:
            late = conv, at
        else:
            table.end(conv, *at)
        if late is not None and (upto is None or upto > late[0]):
            table.end(late[0], *late[1])
            late = None

    for src, c, take, key, size in rows:
        if c != conv or src != source:
            if conv is not None:
                close(c if src == source else None)
            if src != source:
                source, heads = src, []
            if table.held >= most:
                yield from table.rows()
            conv, at, own, skip = c, begin(c), 0, 0 if c == src else take
            for head_key, head_size in heads[:skip]:
                at = step(c, at, head_key, head_size)
        if conv == source and own < longest:
            heads.append((key, size))
        if own >= skip:
            at = step(c, at, key, size)
        own += 1
        if table.held >= 2 * most:  # within one conversation of very many turns
            yield from table.rows()
    if conv is not None:
        close()
    yield from table.rows()


def _merged(rows, last: bool, list_of: int = ENDS):
    """Add up the rows of each node, which come together and by first_end; the last merge digests the end list as it streams by."""

    def digested(node, parent, depth, size, conv, members, n, digest):
        return node, parent, depth, size, conv, members, n, digest.hexdigest()

    node = None
    for new, parent, depth, size, conv, members, part, first, ends in rows:
        if node is not None and new != node[0]:
            yield digested(*node, n, digest) if last else (*node, group, held[0] if held else None, held)
            node = None
        if node is None:
            node, held, n, digest, group = [new, parent, depth, size, conv, 0], [], 0, hashlib.sha256(), part
        node[4], node[5] = min(node[4], conv), node[5] + members
        if last:
            if ends:
                digest.update((("," if n else "") + ",".join(map(str, ends))).encode())
                n += len(ends)
            continue
        if held and len(held) + len(ends) > list_of:
            yield *node, group, held[0], held
            node[5], held = 0, []
        held = held + ends
    if node is not None:
        yield digested(*node, n, digest) if last else (*node, group, held[0] if held else None, held)


def merge(tables: DataFrame, parts: int, fan: int = FAN, list_of: int = ENDS) -> DataFrame:
    """One row a node from partial tables of `parts` partitions: rounds of merges, each adding up `fan` neighbouring tables of a node.

    A node that every partition has (the root) thus never brings more than about fan rows to one task. Partitions lie in
    order of conversation id, so end lists are joined, not sorted, and pass through a task in pieces.
    """
    while parts > fan:
        parts = -(-parts // fan)
        tables = tables.withColumn("part", F.expr(f"part div {fan}").cast("int")).repartition("node", "part").sortWithinPartitions("node", "part", "first_end")
        tables = _streamed(tables, lambda rows: _grouped(rows, list_of), _PARTIAL)
    tables = tables.repartition("node").sortWithinPartitions("node", "first_end")
    return _streamed(tables, lambda rows: _merged(rows, True), _WHOLE)


def _grouped(rows, list_of: int):
    """The rows of a task, merged for each node and group of tables."""
    from itertools import groupby

    for _, own in groupby(rows, key=lambda r: (r[0], r[6])):
        yield from _merged(own, False, list_of)


def node_tables(
    conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    borrowed: tuple[Column, Column, int] | None = None, table: int = TABLE, list_of: int = ENDS,
) -> DataFrame:
    """Partial node tables of all conversations, a row a node and task (more where a table or an end list was full).

    borrowed: for a conversation, the id whose first turns replace its own, how many, and the most that any takes. That id
    must borrow from itself and must not fall as ids grow; both lie in one range of ids then, so nothing is joined.
    """
    own = F.col(id_column).cast("long")
    source, take, longest = borrowed or (own, F.lit(0), 0)
    role, text = text_of(role_column), text_of(text_column)
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where(own.isNotNull()).select(source.cast("long").alias("_source"), own.alias("_conv"), take.cast("int").alias("_take"), F.col(turn_column).alias("_turn"), role.alias("_role"), key.alias("_key"), F.length(text).cast("long").alias("_size"))
    ordered = turns.repartitionByRange("_source").sortWithinPartitions("_source", F.col("_conv") != F.col("_source"), "_conv", F.col("_turn").asc_nulls_first(), "_role", "_key")
    return _streamed(ordered.select("_source", "_conv", "_take", "_key", "_size"), lambda rows: _walk(rows, longest, table, list_of), _PARTIAL)


def prefix_trie(
    conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    borrowed: tuple[Column, Column, int] | None = None, fan: int = FAN, table: int = TABLE, list_of: int = ENDS,
) -> DataFrame:
    """The nodes of the trie of all conversations, a row each, with sums over subtrees.

    Returns node and parent (16-byte hashes of the turns up to there), conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved (each node of the subtree: members but one times code points of its last text),
    n_ends and ends_sha256 (of the decimal ids that end there, ascending, comma-joined). Turns are ordered by turn, null
    first, ties by role, then by the hash of the text; a repeated row is a turn of its own. A null role or text is empty,
    a row without id takes no part, an empty table has no nodes, other columns are not looked at. Texts of any length
    are hashed where they lie. The turns of one conversation pass through one task one by one and are never held together.

    The nodes that a conversation owns (it is their smallest member) form a chain, so subtrees are summed over chains:
    within a chain by a window, between chains in doubling steps, as many as the log of how deep chains hang on chains.
    """
    spark = conversations.sparkSession
    tables = node_tables(conversations, id_column, turn_column, role_column, text_column, borrowed, table, list_of)
    nodes = staged(merge(tables, partitions_for(spark), fan, list_of), "trie-nodes").withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
    chains = nodes.groupBy("conv_id").agg(F.min_by("parent", "depth").alias("above"), F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saved").alias("saved"))
    hung = staged(chains.join(nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("up"), F.col("depth").alias("at")), "above", "left").drop("above"), "trie-chains")
    forks = hung.where("up IS NOT NULL").select(F.col("up").alias("conv_id"), F.col("at").alias("bottom")).distinct().withColumn("forked", F.lit(True))
    sums = hung.join(forks, ["conv_id", "bottom"], "left").select("conv_id", "up", "saved", F.when(F.col("forked"), 0).otherwise(1).cast("long").alias("leaves"))
    totals = _subtree_sums(sums)
    below = hung.where("up IS NOT NULL").select("conv_id", "up", "at").join(totals, "conv_id").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("more"))
    tops = hung.where("up IS NOT NULL").select("conv_id", F.col("top").alias("depth"), F.col("up").alias("parent_conv_id"))
    facts = nodes.drop("size").unionByName(below, allowMissingColumns=True).unionByName(tops, allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = facts.repartition("conv_id").groupBy("conv_id", "depth").agg(
        *(F.max(c).alias(c) for c in ("node", "parent", "n_convs", "n_ends", "ends_sha256", "parent_conv_id")), zero("kids").alias("kids"), zero("leaves").alias("leaves"), (zero("saved") + zero("more")).alias("saved"),
    )
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    told = one.withColumn("n_children", F.col("kids") + F.when(F.lag("depth").over(up).isNotNull(), 1).otherwise(0)).withColumn("leaves", F.col("leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0))
    running = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return told.select(
        "node", "parent", "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.sum("leaves").over(running).alias("n_leaves"), F.sum("saved").over(running).alias("saved"), "n_ends", "ends_sha256",
    )


def _subtree_sums(sums: DataFrame) -> DataFrame:
    """Sums of leaves and saved over all chains that hang on a chain, at any distance, for rows of conv_id and the chain above (up).

    After step k a row has the sums of all below it at a distance under 2^k and points 2^k up; so the rows that point at it
    bring just those from there to 2^(k+1).
    """
    sums = staged(sums, "trie-sums")
    while not sums.where("up IS NOT NULL").isEmpty():
        brought = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = sums.where("up IS NOT NULL").select(F.col("conv_id").alias("up"), F.col("up").alias("upper"))
        grown = sums.join(brought, "conv_id", "left").select("conv_id", "up", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))
        sums = staged(grown.join(further, "up", "left").select("conv_id", F.col("upper").alias("up"), "leaves", "saved"), "trie-sums")
    return sums.drop("up")
