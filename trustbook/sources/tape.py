"""Raw-frame tapes: JSON lines, gzip by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TAPE


def _clean(df: DataFrame, fallback_symbol: str | None) -> DataFrame:
    symbol = F.coalesce("symbol", F.lit(fallback_symbol)) if fallback_symbol else F.col("symbol")
    return df.where("venue IS NOT NULL").withColumns({"symbol": symbol, "source": F.coalesce("source", F.lit("web_socket")), "kind": F.coalesce("kind", F.lit("frame"))})


def read(spark: SparkSession, path: str, fallback_symbol: str | None = None) -> DataFrame:
    """Frames of a tape; blank lines are skipped, a malformed line fails the read."""
    return _clean(spark.read.schema(TAPE).option("mode", "FAILFAST").json(path), fallback_symbol)


def follow(spark: SparkSession, path: str, fallback_symbol: str | None = None, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream over a folder of tapes."""
    return _clean(spark.readStream.schema(TAPE).option("maxFilesPerTrigger", files_per_trigger).json(path), fallback_symbol)


def write(frames: DataFrame, path: str, files: int = 1) -> None:
    """Frames and boundaries, in order: files by range of time, lines by time. A string column can't hold invalid text."""
    ordered = frames.select(*(f.name for f in TAPE.fields)).repartitionByRange(files, "elapsed_nanos").sortWithinPartitions("elapsed_nanos")
    ordered.write.mode("append").option("compression", "gzip").json(path)


def paced(frames: DataFrame, speed: float) -> DataFrame:
    """When each frame is due at a speed, from the fixed start of the tape (a plan, not a sleep)."""
    first = frames.agg(F.min("elapsed_nanos").alias("o"))
    return frames.join(F.broadcast(first)).withColumn("due_ns", F.floor((F.col("elapsed_nanos") - F.col("o")) / speed).cast("long")).drop("o")
