"""Market messages derived from the driver's ``events`` table, and prints from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
HOUR_NS = 3_600_000_000_000


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message: event_id, at_ns, venue, venue_rank, integrity, symbol, kind, side, tv, qty, user_id, venue_ts_ns.

    Snapshots carry one level on each side (side NULL here), deltas one level, trades a print.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    kind = F.create_map(*(F.lit(x) for pair in {"signup": "snapshot", "view": "delta", "click": "delta", "purchase": "trade", "error": "session_ended"}.items() for x in pair))
    v = F.col("user_id") % 3
    return e.select(
        "event_id",
        "user_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("at_ns"),
        F.concat(F.lit("v"), v).alias("venue"),
        v.cast("int").alias("venue_rank"),
        F.when(v == 0, 1).when(v == 1, 2).otherwise(0).alias("integrity"),
        F.concat(F.lit("S"), F.expr("(user_id div 3) % 2")).alias("symbol"),
        kind[F.col("event_type")].alias("kind"),
        F.when(F.col("event_type") == "view", "bid").when(F.col("event_type") == "click", "ask").alias("side"),
        F.floor(F.col("value").cast("decimal(18,8)")).cast("long").alias("tv"),
        F.get_json_object("props", "$.k").cast("long").alias("qty"),
    )


def priced(m: DataFrame) -> DataFrame:
    """Adds levels (what a message says: two of a snapshot, one of a delta) and price (of a trade), on an integer grid around 1000."""
    level = lambda side, price: F.struct(F.lit(side).alias("side"), price.cast("decimal(18,8)").alias("price"), F.col("qty").cast("decimal(18,8)").alias("qty"))
    bid, ask = level("bid", 999 - F.col("tv")), level("ask", 1001 + F.col("tv"))
    levels = F.when(F.col("kind") == "snapshot", F.array(bid, ask)).when(F.col("side") == "bid", F.array(bid)).when(F.col("side") == "ask", F.array(ask))
    return m.withColumns({"levels": levels, "price": F.when(F.col("kind") == "trade", (1000 + F.col("tv")))})


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as prints: venue, symbol, price, qty, at_ns."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_shipdate")
    price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 10000).cast("decimal(14,0)") * F.expr("0.0001BD")).cast("decimal(18,8)")
    return li.select(F.col("l_returnflag").alias("venue"), F.col("l_linestatus").alias("symbol"), price.alias("price"), F.col("l_quantity").cast("decimal(18,8)").alias("qty"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("at_ns"))
