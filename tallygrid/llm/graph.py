"""Connected components by alternating stars: every job is a group minimum and a join back, so a node with very many
links is pre-aggregated and its rows can be split; each round's edges are written to the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.session import materialise


def _hook(pairs: DataFrame, upward: bool) -> DataFrame:
    """(u, v) with u's smallest neighbour m: link u's neighbours to m. ``upward``: those above u, else u and those below."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = pairs.join(least, "u")
    if upward:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b), root being the smallest node reached."""
    pairs = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        sign = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == seen:
            break
        seen = sign
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(both, True).where("u > v").distinct()
        pairs = materialise(_hook(large, False).where("u > v").distinct(), "edges")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
