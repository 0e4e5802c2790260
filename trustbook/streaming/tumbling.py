"""Streaming buckets: tumbling windows over ingest time, late by at most the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.trust import STREAM


def buckets(samples: DataFrame, resolution: str = "250 milliseconds", late: str = "2 seconds") -> DataFrame:
    """samples: venue, symbol, wall_ts, mid, spread. One row per stream and bucket once the watermark has passed it.

    Ingest time is ours and comes in order, so the watermark only bounds state; venue time never orders anything.
    """
    s = samples.where("mid IS NOT NULL").withWatermark("wall_ts", late)
    out = s.groupBy(F.window("wall_ts", resolution), *STREAM).agg(F.count(F.lit(1)).alias("samples"), F.sum("mid").alias("mids"), F.sum("spread").alias("spreads"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.min_by("mid", "wall_ts").alias("first"), F.max_by("mid", "wall_ts").alias("last"))
    return out.select(*STREAM, F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), "samples", "mids", "spreads", "high", "low", "first", "last")
