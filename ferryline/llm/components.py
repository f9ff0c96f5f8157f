"""Connected components of a large undirected graph, by repeated contraction.

Every round each vertex takes the least of itself and its neighbours, follows two such steps, and the edges are renamed by
these labels; a graph's image under any such map stays connected, so a component shrinks to one vertex.  Rounds are written
to the shared folder.  Minima are summed up before shuffling, so a vertex with very many neighbours is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame | None:
    """``edges`` (a long, b long) -> (node, label), for nodes with an edge to another node; None if there are none."""
    maps = []
    edges = common.cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b"), F.col("a")))
        step = common.cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")))
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        names = common.cut(step.join(hop, "label").select("node", F.col("next").alias("label")))
        maps.append(names)
        left = names.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = names.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        renamed = edges.join(left, "a").join(right, "b").filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        edges = common.cut(renamed)
    if not maps:
        return None
    out = maps[0]
    for nxt in maps[1:]:
        nxt = nxt.select(F.col("node").alias("label"), F.col("label").alias("next"))
        out = out.join(nxt, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return common.cut(out) if len(maps) > 1 else out
