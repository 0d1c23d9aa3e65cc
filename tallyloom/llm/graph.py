"""Connected components of a large graph by repeated contraction to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame | None:
    """(u, label) for every node of edges (u, v): label is the least node of its component. None without edges.

    A round maps every node to its least neighbour or itself and contracts the edges; each round is written, so that lost
    executors cost one round, and the number of rounds is logarithmic in practice (one for stars).
    """
    maps, left = [], staged(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hop = staged(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label")), "labels")
        maps.append(hop)
        ends = left.join(hop, "u").select(F.col("label").alias("a"), "v").join(hop.withColumnRenamed("u", "v"), "v").select(F.least("a", "label").alias("u"), F.greatest("a", "label").alias("v"))
        left = staged(ends.where("u <> v").distinct(), "edges")
    if not maps:
        return None
    out = maps[0]
    for hop in maps[1:]:
        out = out.join(hop.select(F.col("u").alias("label"), F.col("label").alias("further")), "label", "left").select("u", F.coalesce("further", "label").alias("label"))
    return out
