"""Exact top-k by vector-approximation files: scan quantised cells for bounds, then read exact vectors until the kth is certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import numbered, partitions_for, staged

#: Cells of each dimension; candidates whose cells are scanned at once; queries that scan together.
CELLS, SCANNED, TOGETHER = 64, 4096, 512
#: Components of a group of candidates, and the least vectors that make a group worth a task. A task holds one group at a time.
GROUP_COMPONENTS, LEAST_GROUP = 1 << 22, 2048
SCALE = 64
#: Integers from here on are no longer told apart by doubles, or their products overflow: such vectors are multiplied as Python integers.
EXACT, GIANT = float(1 << 53), float(1 << 300)
LONGEST = (1 << 63) - 1


def integers(values):
    """floor(64 * x) as doubles (floors of doubles are doubles); infinite where the product leaves their range."""
    import numpy as np

    with np.errstate(over="ignore"):
        return np.floor(np.asarray(values, float) * SCALE)


def exact_products(a, b) -> list[int]:
    """Inner products of the rows of a with those of b, components taken as x for floor(64 * x), saturated to 64 bits."""
    from math import floor

    whole = lambda x: floor(x * SCALE) if abs(x) < EXACT else int(x) * SCALE
    sums = (sum(whole(x) * whole(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True))
    return [max(-LONGEST - 1, min(LONGEST, s)) for s in sums]


class Group:
    """Candidates of one dimension with their approximation: a grid of cells, made once, that every query scans.

    Alike vectors score alike, so of more than k + 1 of them only those of the least ids can be among the k best of a
    query (one may be its own row); the others are left out.
    """

    def __init__(self, raw, ids, rows, copies, k: int, cells: int = CELLS):
        import numpy as np

        again = np.repeat(np.arange(len(ids)), np.minimum(copies, k + 1))
        raw, ids, rows = raw[again], ids[again], rows[again]
        alike = np.unique(raw + 0.0, axis=0, return_inverse=True)[1].ravel() if len(raw) > k + 1 else np.zeros(0, np.int64)
        if len(alike) and np.bincount(alike).max() > k + 1:
            order = np.lexsort((ids, alike))
            new = np.ones(len(order), bool)
            new[1:] = alike[order[1:]] != alike[order[:-1]]
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            keep = np.sort(order[nth <= k])
            raw, ids, rows = raw[keep], ids[keep], rows[keep]
        self.raw, self.ids, self.rows, self.by_row = raw, ids, rows, np.argsort(rows, kind="stable")
        self.vectors = integers(raw)
        self.most = float(np.abs(self.vectors).max()) if self.vectors.size else 0.0
        self.giant = self.most >= GIANT
        if not self.giant:
            self.least = self.vectors.min(0)
            self.width = np.maximum(1, np.ceil((self.vectors.max(0) - self.least + 1) / cells))
            self.code = np.minimum((self.vectors - self.least) // self.width, cells - 1).astype(np.uint8)
            # in cells wider than doubles can tell integers apart, the far end is taken a little further
            self.half = np.maximum(self.vectors.max(0) - self.least - (cells - 1) * self.width, self.width) / 2 * (1 + 1e-9) - 0.5 * (self.width < 2**40)
            self.middle = self.least + (self.width - (self.width < 2**40)) / 2

    def own(self, rows):
        """Position of each query's own row (the first of its copies), or -1."""
        import numpy as np

        sorted_ = self.rows[self.by_row]
        at = np.searchsorted(sorted_, rows)
        found = np.minimum(at, len(sorted_) - 1)
        return np.where((at < len(sorted_)) & (sorted_[found] == rows), self.by_row[found], -1)

    def scores(self, raw, queries, which, at):
        """Exact scores of queries[which] with candidates at, 64-bit integers."""
        import numpy as np

        if np.abs(queries[which]).max(initial=0) * self.most * queries.shape[1] < EXACT:
            return np.einsum("ij,ij->i", queries[which], self.vectors[at]).astype(np.int64)
        return np.array(exact_products(raw[which], self.raw[at]), np.int64)

    def nearest(self, raw, rows, k: int):
        """(query, score, id), sorted, of the k best candidates of each query.

        Cells are scanned some thousand candidates at a time. The kth best exact score so far (at first, the kth best
        lower bound) tells which upper bounds can still matter; exact vectors of those are read from the highest bound on,
        in runs, and the kth score of each run ends the reading or narrows what follows.
        """
        import numpy as np

        queries, own = integers(raw), self.own(rows)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        kth = np.full(len(queries), -np.inf)
        plain = not self.giant and np.abs(queries).max(initial=0) < GIANT
        if plain:
            scale = np.maximum(1.0, np.abs(queries).max(1, initial=0))[:, None] * self.width.max()
            step = (queries * self.width / scale).astype(np.float32)
            offset = queries @ self.middle
            # what the middle of a cell can miss, and what 32- and 64-bit sums can lose
            slack = np.abs(queries) @ self.half + (queries.shape[1] + 4) * (2.0**-22 * np.abs(queries * self.width).sum(1) * CELLS + 2.0**-51 * (np.abs(queries) @ np.abs(self.middle))) + 0.5
        for start in range(0, len(self.ids), SCANNED):
            stop = min(start + SCANNED, len(self.ids))
            if plain:
                middle = step @ self.code[start:stop].T.astype(np.float32)
                mine = np.flatnonzero((own >= start) & (own < stop))
                middle[mine, own[mine] - start] = -np.inf
                least = kth
                if stop - start > k and np.isinf(kth).any():
                    low = np.partition(middle, stop - start - k, axis=1)[:, stop - start - k]
                    least = np.minimum(np.maximum(kth, low * scale[:, 0] + offset - slack), 2.0**63)
                    least[least <= -(2.0**63)] = -np.inf  # scores beyond 64 bits are alike
                bar = (least - offset - slack) / scale[:, 0]
                which, at = np.nonzero(middle >= (bar - np.abs(bar) * 2.0**-22)[:, None].astype(np.float32))
                keep = middle[which, at] > -np.inf
                which, at = which[keep], at[keep]
                upper = middle[which, at].astype(float) * scale[which, 0] + offset[which] + slack[which]
            else:
                which, at = np.nonzero(np.ones((len(queries), stop - start), bool))
                keep = at + start != own[which]
                which, at = which[keep], at[keep]
                upper = np.full(len(which), np.inf)
            order = np.lexsort((-upper, which))
            which, at, upper = which[order], at[order] + start, upper[order]
            while len(which):
                first = np.searchsorted(which, which, "left")
                now = np.arange(len(which)) - first < max(4 * k, 64)
                scores = self.scores(raw, queries, which[now], at[now])
                best = top(*(np.concatenate(x) for x in zip(best, (which[now], scores, self.ids[at[now]]), strict=True)), k)
                counts = np.bincount(best[0], minlength=len(queries))
                full = counts >= k
                worst = best[1][np.cumsum(counts)[full] - 1].astype(float)
                kth[full] = np.where(worst <= -(2.0**63), -np.inf, worst - np.abs(worst) * 2.0**-50)
                left = ~now & (upper >= kth[which])
                which, at, upper = which[left], at[left], upper[left]
        return best


def top(which, scores, ids, k: int):
    """The k best of each query: highest score, then least id."""
    import numpy as np

    order = np.lexsort((ids, ~scores, which))
    which, scores, ids = which[order], scores[order], ids[order]
    keep = np.arange(len(which)) - np.searchsorted(which, which, "left") < k
    return which[keep], scores[keep], ids[keep]


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", components: int = GROUP_COMPONENTS, least_group: int = LEAST_GROUP) -> DataFrame:
    """Each query's k highest integer inner products over all other rows: query_id, rank (from 1), vec_id, score.

    A component x becomes floor(64 * x). Rows whose id or vector is null, or whose vector is empty or has a null or
    non-finite component, take no part; only vectors of a query's dimension are its candidates. Ties go to the smaller
    id. Repeated rows are candidates each, and queries each: every query row gets its own k results and leaves out itself
    alone. An empty table, or one without queries, gives no rows; extra columns are ignored. Products are exact whatever
    the components (in doubles where these hold them, else in Python integers); a score beyond 64 bits is the nearest
    64-bit number and ranks as that. Ids that are not integers are numbered in their order first.

    Alike rows are counted, not gathered. Candidates are dealt by a hash to groups of bounded size; a task holds one group and its
    cells while all queries, a bounded batch at a time, pass by: so cells are made once, and queries, not candidates, are
    copied. A group returns k results a query.
    """
    import numpy as np

    spark = rows.sparkSession
    v, id_type = F.col(vector_column), rows.schema[id_column].dataType.simpleString()
    usable = rows.where(F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))))
    usable = usable.select(F.col(id_column).alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    usable, names = numbered(usable, "id")
    points = usable.groupBy(F.col("id").cast("long").alias("id"), "v").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"))
    points = staged(points.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v")}), "points")
    sizes = points.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    parts = max(1, -(-int(sizes[1]) // components), min(partitions_for(spark), -(-sizes[0] // least_group)))
    columns = ["dim", "part", "kind", "row", "id", "n", "v"]
    held = points.withColumns({"part": F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"), "kind": F.lit(0)}).select(columns)
    asked = points.where("asks > 0").withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "kind": F.lit(1)}).select(columns)
    met = held.unionByName(asked).repartition(max(parts, partitions_for(spark)), "dim", "part").sortWithinPartitions("dim", "part", "kind")

    def search(batches):
        import pyarrow as pa

        key, group, waiting = None, None, []
        for batch in batches:
            dim, part, kind = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                if key != (dim[start], part[start]):
                    key, group, waiting = (dim[start], part[start]), None, []
                for at in range(start, stop, TOGETHER if kind[start] else stop - start):
                    run = batch.slice(at, min(TOGETHER, stop - at) if kind[start] else stop - at)
                    row, ids, n = (run.column(c).to_numpy() for c in (3, 4, 5))
                    raw = run.column(6).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, key[0])
                    if kind[start] == 0:
                        waiting.append((raw, ids, row, n))
                        continue
                    if group is None and waiting:
                        group, waiting = Group(*(np.concatenate(x) for x in zip(*waiting, strict=True)), k), []
                    if group is not None:
                        which, scores, found = group.nearest(raw, row, k)
                        yield pa.RecordBatch.from_arrays([pa.array(row[which]), pa.array(scores), pa.array(found)], ["row", "score", "vec_id"])

    partial = met.mapInArrow(search, "row bigint, score bigint, vec_id bigint")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    about = points.where("asks > 0").select("row", F.col("id").alias("query_id"), "asks")
    out = ranked.join(about, "row").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("asks").cast("int"))))
    if names is not None:
        for c in ("query_id", "vec_id"):
            out = out.join(names, out[c] == names["number"]).drop(c, "number").withColumnRenamed("name", c)
    else:
        out = out.withColumns({c: F.col(c).cast(id_type) for c in ("query_id", "vec_id")})
    return out.select("query_id", "rank", "vec_id", "score")
