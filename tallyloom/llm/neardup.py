"""N-gram Jaccard self-join by a MinHash LSH forest, every link verified exactly.

A text's signature is cut into trees of some labels each. A tree is a prefix trie of its label strings, kept sorted:
texts that agree in their first labels stand side by side and share a node. The join starts at the deepest prefixes. From the pairs
found there, each with its chance of being found at that depth, it estimates the share of links that the forest has
shown so far, and shortens the prefixes label by label until the share reaches the target recall. Nodes give edges
between likely pairs only (their signatures agree enough), edges give candidate components, and within these every
pair's shingle sets are intersected exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import map_arrow, numbered, partitions_for, row_key, staged, text_of
from tallyloom.llm.graph import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
#: Share of equal signature entries from which a pair is likely (4 to 5 deviations below what 0.8 gives).
LIKELY = 0.6
#: Texts that are compared with each other at once: signatures of a node, texts of a component. Larger ones are cut into
#: chunks, and every pair of chunks is one group.
NODE, GROUP = 4096, 512


def chance(similarity: Column, depth: int, trees: int) -> Column:
    """How likely a pair of that similarity shares a prefix of that depth in at least one tree."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(float(depth))), F.lit(float(trees)))


def estimated_recall(edges: DataFrame, depth: int, trees: int, threshold: float) -> float:
    """Share of links found at a depth: each edge found stands for 1 / chance edges like it; one at the threshold is always reckoned with."""
    links = edges.where(F.col("s") >= threshold).select("u", "v", "s").distinct()
    found, stands = links.agg(F.count("*"), F.coalesce(F.sum(1 / chance(F.col("s"), depth, trees)), F.lit(0.0))).first()
    unseen = 1 / (1 - (1 - threshold**depth) ** trees) - 1
    return found / (stands + unseen) if found else 1 - unseen


def word_list(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingle_hashes(texts: list[str], words: int):
    """Distinct 64-bit shingle hashes of each text, ascending. A text of fewer words is one shingle of them all, or none."""
    import numpy as np
    from xxhash import xxh3_64_intdigest as digest

    number: dict[bytes, int] = {}
    flat, sizes = [], []
    for t in texts:
        own = word_list(t)
        sizes.append(len(own))
        flat += [number.setdefault(w, len(number)) for w in own]
    hashes = np.array([digest(w) for w in number], np.uint64)[np.array(flat, np.int64)] if flat else np.empty(0, np.uint64)
    ends = np.cumsum(sizes)
    factors = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for i in range(words)]
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for i, f in enumerate(factors):
        rolled += (hashes[i : i + n] ^ (hashes[i : i + n] >> np.uint64(31))) * f
    rolled = (rolled ^ (rolled >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    rolled ^= rolled >> np.uint64(27)
    out = []
    for end, size in zip(ends.tolist(), sizes, strict=True):
        if size >= words:
            out.append(np.unique(rolled[end - size : end - words + 1]))
        else:
            out.append(np.array([digest(b" ".join(map(bytes, hashes[end - size : end].view("V8").tolist())))] if size else [], np.uint64))
    return out


def _signatures(texts: list[str], words: int, entries: int, seeds):
    import numpy as np

    sets = shingle_hashes(texts, words)
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), entries), np.uint32)
    some = np.flatnonzero(sizes)
    at = 0
    while at < len(some):  # some hundred thousand shingles at a time stay in the processor's cache
        stop, total = at, 0
        while stop < len(some) and (stop == at or total + sizes[some[stop]] <= 1 << 17):
            total += sizes[some[stop]]
            stop += 1
        rows = some[at:stop]
        values = np.concatenate([sets[r] for r in rows])
        starts = np.cumsum(sizes[rows]) - sizes[rows]
        for j in range(entries):
            out[rows, j] = np.minimum.reduceat((values * seeds[0][j] + seeds[1][j]) >> np.uint64(32), starts)
        at = stop
    return sets, out


def signatures(docs: DataFrame, words: int, entries: int, id_column: str, text_column: str) -> DataFrame:
    """_id, _th, set (128-bit hash of the shingle set), n (its size), sig (entries of 4 bytes)."""

    def make():
        import numpy as np
        from xxhash import xxh3_128_digest as digest

        draw = np.random.Generator(np.random.PCG64(7))
        seeds = draw.integers(1, 1 << 63, entries, np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, entries, np.uint64)

        def step(batch):
            sets, sig = _signatures(batch.column(2).to_pylist(), words, entries, seeds)
            return batch.column(0), batch.column(1), [digest(s.tobytes()) for s in sets], [len(s) for s in sets], [x.tobytes() for x in sig]

        return step

    keyed = docs.select(*row_key(id_column, text_column), text_of(text_column).alias("text"))
    return map_arrow(keyed, make, "_id bigint, _th bigint, set binary, n int, sig binary", 2)


def _chunked(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of a key (column n_key counts them) dealt to the pairs (i, j) of chunks of about size rows: columns i, j, chunk."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n_key") / size)).cast("int")
    dealt = df.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(11)), chunks).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})


def _groups(batches, key: int):
    """Rows (tuples) of a sorted stream, group by group."""
    held = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:key] != row[:key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _spanning(a, b, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (a, b)."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((min(x, y), max(x, y)))
    return out


def _node_edges(sig, need: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows that agree in `need` labels or more.

    First every row that no earlier one has taken takes those like it, which settles a group of copies in one comparison
    a row. Then a row is compared with those of other trees of the forest, if there are any.
    """
    import numpy as np

    n, out = len(sig), []
    tree, taken = np.arange(n), np.zeros(n, bool)

    def unite(x, hits):
        for y in hits.tolist():
            if tree[x] != tree[y]:
                out.append((min(x, y), max(x, y)))
                tree[tree == max(tree[x], tree[y])] = min(tree[x], tree[y])

    for x in range(n - 1):
        if not taken[x]:
            rest = np.flatnonzero(~taken[x + 1 :]) + x + 1
            hits = rest[(sig[rest] == sig[x]).sum(1) >= need]
            if len(fresh := hits[tree[hits] == hits]) == len(hits):  # all still alone
                out.extend((x, y) for y in fresh.tolist())
                tree[fresh] = tree[x]
            else:
                unite(x, hits)
            taken[hits] = True
    for x in range(n):
        others = np.flatnonzero(tree[x + 1 :] != tree[x]) + x + 1
        if others.size:
            unite(x, others[(sig[others] == sig[x]).sum(1) >= need])
    return out


def likely_edges(reps: DataFrame, depth: int, trees: int, deepest: int, likely: float) -> DataFrame:
    """u, v, s: node by node of the tries at a depth, a spanning forest of the pairs whose signatures agree in a share s of at least `likely`."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, F.substring("sig", t * (4 * deepest) + 1, F.lit(4 * depth))))
    prefixes = reps.select("node", F.posexplode(keys).alias("tree", "prefix"))
    shared = prefixes.groupBy("prefix").agg(F.count("*").alias("n_key")).where("n_key > 1")
    members = _chunked(prefixes.join(shared, "prefix"), "prefix", NODE).select("prefix", "tree", "i", "j", "node", "chunk")
    # the whole label string of the tree is the order within a node: the trie below it, side by side
    labels = F.substring(F.col("sig"), F.col("tree") * (4 * deepest) + 1, F.lit(4 * deepest)).alias("labels")
    rows = members.join(reps.select("node", "sig"), "node").select("prefix", "i", "j", labels, "sig", "node._id", "node._th")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        out: list[tuple] = []
        for group in _groups(batches, 3):
            sig = np.frombuffer(b"".join([r[4] for r in group]), np.uint32).reshape(len(group), -1)
            pairs = _node_edges(sig, int(np.ceil(likely * sig.shape[1])))
            out += [(*group[x][5:7], *group[y][5:7], float((sig[x] == sig[y]).mean())) for x, y in pairs]
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.float64()), strict=True)], ["a", "b", "c", "d", "s"])

    dealt = rows.repartition(partitions_for(reps.sparkSession), "prefix", "i", "j").sortWithinPartitions("prefix", "i", "j", "labels")
    found = dealt.mapInArrow(run, "a bigint, b bigint, c bigint, d bigint, s double")
    ends = F.struct(F.col("a").alias("_id"), F.col("b").alias("_th")), F.struct(F.col("c").alias("_id"), F.col("d").alias("_th"))
    return found.select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v"), "s")


def forest_edges(reps: DataFrame, trees: int, deepest: int, likely: float, threshold: float, recall: float) -> tuple[DataFrame, int, float]:
    """Edges at the longest prefixes that reach the target recall, with their depth and the recall estimated there.

    At one label it ends in any case. A depth's nodes hold all those of longer prefixes, so the last depth's edges are all.
    """
    for depth in range(deepest, 0, -1):
        edges = staged(likely_edges(reps, depth, trees, deepest, likely), "near")
        reached = estimated_recall(edges, depth, trees, threshold)
        if reached >= recall or depth == 1:
            return edges, depth, reached


def _exact_sets(texts: list[str], words: int):
    """Shingles of each text as exact numbers (no hashes): equal numbers are equal word sequences."""
    import numpy as np

    number: dict[bytes, int] = {}
    flat, sizes = [], []
    for t in texts:
        own = word_list(t)
        short = words - len(own) if 0 < len(own) < words else 0
        sizes.append(len(own) + short)
        flat += [number.setdefault(w, len(number) + 1) for w in own] + [0] * short
    w = np.array(flat, np.int64)
    if len(w) < words:
        return [np.empty(0, np.int64) for _ in texts], 0
    n = len(w) - words + 1
    code = w[:n]
    for i in range(1, words):
        code = np.unique(code * (len(number) + 1) + w[i : i + n], return_inverse=True)[1]
    ends = np.cumsum(sizes)
    return [np.unique(code[e - s : e - words + 1]) if s else np.empty(0, np.int64) for e, s in zip(ends.tolist(), sizes, strict=True)], int(code.max()) + 1


def intersections(left, right, n: int):
    """Sizes of the intersections of all sets of left with all of right, by products of incidence blocks."""
    import numpy as np

    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    counts = np.zeros(n, np.int32)
    for s in left if right is left else [*left, *right]:
        counts[s] += 1
    column = np.full(n, -1)
    shared = np.flatnonzero(counts > 1)
    column[shared] = np.arange(len(shared))
    out = np.zeros((len(left), len(right)), np.float32)

    def block(sets, lo, hi):
        m = np.zeros((len(sets), hi - lo), np.float32)
        for i, s in enumerate(sets):
            c = column[s]
            m[i, c[(c >= lo) & (c < hi)] - lo] = 1
        return m

    for lo in range(0, len(shared), 8192):
        hi = min(lo + 8192, len(shared))
        a = block(left, lo, hi)
        out += a @ (a if right is left else block(right, lo, hi)).T
    return out.astype(np.int64)


def exact_links(texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """a, b, n: the links of a text within a task's group (b null), and a spanning forest of the links (n 0).

    texts: group, i, j, chunk, _id, _th, text; a group's texts of chunks i and j meet, each pair of texts in one task.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for group in _groups(batches, 3):
            across = group[0][1] != group[0][2]
            sets, n = _exact_sets([r[6] for r in group], words)
            sizes = np.array([len(s) for s in sets])
            if across:
                x = [k for k, r in enumerate(group) if r[3] == group[0][1]]
                y = [k for k, r in enumerate(group) if r[3] != group[0][1]]
                if not x or not y:
                    continue
                both = intersections([sets[k] for k in x], [sets[k] for k in y], n)
                near = both >= threshold * (sizes[x][:, None] + sizes[y][None] - both) - 1e-9
                a, b = np.nonzero(near)
                a, b = np.array(x)[a], np.array(y)[b]
            else:
                both = intersections(sets, sets, n)
                a, b = np.nonzero(np.triu(both >= threshold * (sizes[:, None] + sizes[None] - both) - 1e-9, 1))
            links = np.bincount(a, minlength=len(group)) + np.bincount(b, minlength=len(group))
            rows = [(*group[k][4:6], None, None, int(links[k])) for k in np.flatnonzero(links)]
            rows += [(*group[p][4:6], *group[q][4:6], 0) for p, q in _spanning(a.tolist(), b.tolist(), len(group))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["a", "b", "c", "d", "n"])

    dealt = texts.repartition(partitions_for(texts.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    return dealt.mapInArrow(run, "a bigint, b bigint, c bigint, d bigint, n bigint")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL) -> DataFrame:
    """Groups of near copies: _id, _th (see row_key), class_id, copy_of, n_copies, n_links for each distinct id and text.

    Texts with the same set of word shingles are copies of the one with the least id (copy_of), and copies are not
    expanded into pairs. n_links: other shingle sets with a Jaccard similarity of threshold or more, each counted once.
    class_id: the least id that copies and links lead to. Words are runs of other than ASCII white space, A-Z
    lower-cased; a text of fewer than `words` words is one shingle of them all. A null or empty text, or one of blanks,
    has no shingles: it is alone, with no links. Repeated rows are one row here. Candidates have the given recall as the
    forest estimates it on these rows (see estimated_recall), links are exact. Large nodes and components are cut into pairs of chunks, so no task
    gathers a whole group; what leaves a task grows with texts, not with pairs. Ids must be whole numbers (see numbered()).
    """
    signed = staged(signatures(docs, words, trees * deepest, id_column, text_column), "signatures")
    sets = staged(signed.where("n > 0").groupBy("set").agg(F.count("*").alias("n_copies"), F.min(F.struct("_id", "_th", "sig")).alias("r")).select("set", "n_copies", F.struct("r._id", "r._th").alias("node"), "r.sig"), "sets")
    edges, _, _ = forest_edges(sets.select("node", "sig"), trees, deepest, LIKELY, threshold, recall)
    likely = components(edges)
    members = signed.where("n > 0").select("_id", "_th", "set").distinct().join(sets.select("set", "n_copies", "node"), "set")
    if likely is None:
        linked = None
    else:
        likely = staged(likely, "likely")
        sized = likely.join(likely.groupBy("label").agg(F.count("*").alias("n_key")), "label").withColumnRenamed("u", "node")
        sized = sized.select("node", "n_key", F.xxhash64("label").alias("group"), F.col("node._id").alias("_id"), F.col("node._th").alias("_th"))
        keyed = docs.select(*row_key(id_column, text_column), text_of(text_column).alias("text"))
        # always a merge join: a side that is broadcast while it is small would hide what the texts cost once it is not
        texts = keyed.join(sized.hint("merge"), ["_id", "_th"]).dropDuplicates(["_id", "_th"])
        dealt = _chunked(texts, "group", GROUP).select("group", "i", "j", "chunk", "_id", "_th", "text")
        found = staged(exact_links(dealt, words, threshold), "links")
        links = found.where("c IS NULL").groupBy(F.struct(F.col("a").alias("_id"), F.col("b").alias("_th")).alias("node")).agg(F.sum("n").alias("n_links"))
        linked = components(found.where("c IS NOT NULL").select(F.struct(F.col("a").alias("_id"), F.col("b").alias("_th")).alias("u"), F.struct(F.col("c").alias("_id"), F.col("d").alias("_th")).alias("v")))
    if linked is None:
        out = members.select("_id", "_th", F.col("node").alias("label"), "node", "n_copies", F.lit(0).cast("long").alias("n_links"))
    else:
        about = linked.withColumnRenamed("u", "node").join(links, "node", "left")
        out = members.join(about, "node", "left").select("_id", "_th", F.coalesce("label", "node").alias("label"), "node", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = signed.where("n = 0").select("_id", "_th").distinct()
    alone = alone.select("_id", "_th", F.struct("_id", "_th").alias("label"), F.struct("_id", "_th").alias("node"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).select("_id", "_th", F.col("label._id").alias("class_id"), F.col("node._id").alias("copy_of"), "n_copies", "n_links", (F.col("label") == F.struct("_id", "_th")).alias("first"))


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs with one document of each group of near copies, the one of the least id (then text hash); texts without words all stay.

    Of rows alike in id and text the least by their columns stays. Ids that are no whole numbers are numbered in their order.
    """
    docs, names = numbered(docs, id_column)
    if names is not None:
        order = [c for c in docs.columns if c != id_column]
        kept = keep_first(docs, id_column, text_column, **options).join(names.withColumnRenamed("number", id_column), id_column, "left").drop(id_column).withColumnRenamed("name", id_column)
        return kept.select(id_column, *order)
    groups = near_duplicates(docs, id_column, text_column, **options).where("first").select("_id", "_th")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), text_of(text_column).alias("_text"), *row_key(id_column, text_column))
    worded = F.col("_text").rlike(r"[^\x20\x09-\x0D]")
    stay = keyed.where(worded).join(groups, ["_id", "_th"], "left_semi").groupBy("_id", "_th").agg((F.min_by("_doc", F.to_json("_doc")) if "map<" in docs.schema.simpleString() else F.min("_doc")).alias("_doc"))
    return stay.select("_doc.*").unionByName(keyed.where(~worded).select("_doc.*"))
