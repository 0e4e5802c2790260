"""Snapshots that nodes publish, as JSON lines: the latest of each node, and its views as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEW = "venue string, status string, integrity string, age_ms long, status_for_ms long, last_verified_ms long, bid string, ask string, last_trade_age_ms long"
LINE = f"node string, received_ms long, seq long, len long, capacity long, dropped long, symbols array<struct<symbol:string,venues:array<struct<{','.join(f'{c.split()[0]}:{c.split()[1]}' for c in VIEW.split(', '))}>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Published lines; one that can't be parsed is left out, so that a node's last good snapshot stays."""
    return spark.read.schema(LINE).option("mode", "DROPMALFORMED").json(path).where("node IS NOT NULL")


def latest(lines: DataFrame) -> DataFrame:
    """The last snapshot of each node."""
    cols = [c for c in lines.columns if c != "node"]
    return lines.groupBy("node").agg(F.max_by(F.struct(*cols), F.struct("received_ms", "seq")).alias("s")).select("node", "s.*")


def views(snapshots: DataFrame) -> DataFrame:
    """One row per node, symbol and venue. A live view that names no guarantee is taken for the weakest."""
    s = snapshots.select("node", "received_ms", F.explode("symbols").alias("x")).select("node", "received_ms", "x.symbol", F.explode("x.venues").alias("v")).select("node", "received_ms", "symbol", "v.*")
    return s.withColumn("integrity", F.when((F.col("status") == "live") & F.col("integrity").isNull(), "order_only").otherwise(F.col("integrity")))
