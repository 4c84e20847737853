"""Connected components of an edge table by alternating large and small stars
(Kiveris et al., "Connected components in MapReduce and beyond", 2014)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apptflow.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges (a, b) but the roots.

    Every pass shortens the paths to the smallest node; it ends when all edges
    lead straight to their roots. Passes are checkpointed, nothing is collected
    but a count and a checksum.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .filter("a <> b").distinct())
    sign = _signature(e)
    while sign[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(least, F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u"))
        small = (small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        e = cut_lineage(small)
        last, sign = sign, _signature(e)
        if sign == last:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
