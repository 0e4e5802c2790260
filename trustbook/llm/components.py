"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is joins and aggregates over the edge table, which is cut off its lineage by a written
table; the driver sees a count and a checksum of a round and never a link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = edges.join(least, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node of u's component, for every node u that is not that node itself.

    edges: columns u and v, in either order; null ends and loops don't count.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(edges, "edges")
    mark = _mark(now)
    while mark[0]:
        new = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    return now
