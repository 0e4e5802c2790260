"""Across venues: consolidated touch and consolidated windows, with every exclusion named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio_bps, round_dp

MAX_AGE_NS = 2_000_000_000


def eligibility(top: DataFrame, max_age_ns: int = MAX_AGE_NS) -> DataFrame:
    """Adds exclusion (NULL: eligible) and exclusion_text: trust, then age (missing is infinite), then quotes."""
    reason = F.when(~F.coalesce(F.col("live"), F.lit(False)), "untrusted").when(F.col("age_ns").isNull() | (F.col("age_ns") > max_age_ns), "stale").when(F.col("bid").isNull() & F.col("ask").isNull(), "no_quote")
    ms = F.coalesce(F.call_function("div", F.col("age_ns"), F.lit(1_000_000)).cast("string"), F.lit("?"))
    text = F.when(F.col("exclusion") == "untrusted", "book is not trusted").when(F.col("exclusion") == "stale", F.concat(F.lit("no update for "), ms, F.lit("ms"))).when(F.col("exclusion") == "no_quote", "book holds no levels")
    return top.withColumn("exclusion", reason).withColumn("exclusion_text", text)


def cross_touch(top: DataFrame, max_age_ns: int = MAX_AGE_NS) -> DataFrame:
    """One row per symbol. Ties keep the first venue by rank; floors and ages are over the legs used.

    top: venue, venue_rank, symbol, live, integrity, bid, ask, age_ns. Aggregates of fixed size, so
    the map side combines venues before the shuffle on symbol.
    """
    e = eligibility(top, max_age_ns)
    ok = F.col("exclusion").isNull()
    leg = lambda price: F.struct(price, "venue", "integrity", "age_ns")
    by = lambda sign, price: F.when(ok & F.col(price).isNotNull(), F.struct(sign * F.col(price), "venue_rank"))
    out = e.groupBy("symbol").agg(
        F.min_by(leg("bid"), by(-1, "bid")).alias("b"),
        F.min_by(leg("ask"), by(1, "ask")).alias("a"),
        F.count_if(ok).alias("venues_used"),
        F.array_sort(F.collect_list(F.when(~ok, F.struct("venue_rank", "venue", F.col("exclusion").alias("reason"), F.col("exclusion_text").alias("text"))))).alias("excluded"),
    )
    b, a = F.col("b"), F.col("a")
    out = out.select(
        "symbol", b["bid"].alias("bid"), b["venue"].alias("bid_venue"), a["ask"].alias("ask"), a["venue"].alias("ask_venue"), "venues_used", "excluded",
        F.least(b["integrity"], a["integrity"]).alias("integrity_floor"), F.greatest(b["age_ns"], a["age_ns"]).alias("oldest_leg_ns"),
    )
    out = out.withColumn("spread", F.col("ask") - F.col("bid")).withColumn("mid", (F.col("ask") + F.col("bid")) / 2)
    return out.withColumns({"spread_bps": ratio_bps("spread", "mid"), "crossed": F.coalesce(F.col("spread") <= 0, F.lit(False)), "single_venue": F.coalesce(F.col("bid_venue") == F.col("ask_venue"), F.lit(False)), "oldest_leg_ms": F.call_function("div", F.col("oldest_leg_ns"), F.lit(1_000_000))})


def weakest_integrity(top: DataFrame) -> DataFrame:
    """The weakest guarantee over the live books of each symbol (another set than the legs of the touch)."""
    return top.groupBy("symbol").agg(F.min(F.when(F.col("live"), F.col("integrity"))).alias("weakest"), F.count_if("live").alias("live_venues"))


def cross_windows(readings: DataFrame, streams: DataFrame, lag_ms: Column | None = None) -> DataFrame:
    """One row per symbol and span: merged from what venues publish (already rounded), so that merging in any order agrees.

    A venue without the span or without data is named; the coverage floor and the largest lag are over
    venues that are used, integrity over those with samples. There is no first, last or change here.
    """
    r = readings.withColumn("lag_ms", F.lit(0).cast("long") if lag_ms is None else lag_ms)
    spans = r.select("symbol", "span_ms").distinct()
    every = streams.select("venue", "venue_rank", "symbol").distinct().join(spans, "symbol")
    cols = ["samples", "trades", "mean", "high", "low", "volume", "vwap", "trusted_ms", "integrity_floor", "lag_ms"]
    both = every.join(r.select("venue", "symbol", "span_ms", *cols, F.lit(True).alias("published")), ["venue", "symbol", "span_ms"], "left")
    reason = F.when(F.col("published").isNull(), "span_not_published").when((F.col("samples") == 0) & (F.col("trades") == 0), "no_data")
    both = both.withColumn("reason", reason)
    used, sampled = F.col("reason").isNull(), F.col("reason").isNull() & (F.col("samples") > 0)
    out = both.groupBy("symbol", "span_ms").agg(
        F.count_if(used).alias("venues_used"),
        F.coalesce(F.sum(F.when(used, F.col("samples"))), F.lit(0)).alias("samples"),
        F.coalesce(F.sum(F.when(used, F.col("trades"))), F.lit(0)).alias("trades"),
        F.max(F.when(used, F.col("high"))).alias("high"),
        F.min(F.when(used, F.col("low"))).alias("low"),
        F.sum(F.when(sampled, (F.col("mean") * F.col("samples")).cast("decimal(38,8)"))).alias("mids"),
        F.sum(F.when(used & F.col("vwap").isNotNull(), (F.col("vwap").cast("decimal(20,8)") * F.col("volume").cast("decimal(17,0)")).cast("decimal(38,8)"))).alias("notional"),
        F.sum(F.when(used & F.col("vwap").isNotNull(), F.col("volume"))).alias("priced"),
        F.sum(F.when(used, F.col("volume"))).alias("volume"),
        F.coalesce(F.min(F.when(used, F.col("trusted_ms"))), F.lit(0)).alias("trusted_ms_floor"),
        F.min(F.when(sampled, F.col("integrity_floor"))).alias("integrity_floor"),
        F.coalesce(F.max(F.when(used, F.col("lag_ms"))), F.lit(0)).alias("max_lag_ms"),
        F.array_sort(F.collect_list(F.when(~used, F.struct("venue_rank", "venue", "reason")))).alias("excluded"),
    )
    out = out.withColumn("mean", F.when(F.col("samples") > 0, round_dp(F.col("mids") / F.col("samples"), 8))).withColumn("vwap", round_dp(F.col("notional").cast("decimal(28,8)") / F.nullif(F.col("priced"), F.lit(0)), 8))
    return out.withColumn("range_bps", ratio_bps(F.col("high") - F.col("low"), "mean")).drop("mids", "notional", "priced")


def reasons(excluded: str = "excluded") -> Column:
    """Exclusions as 'venue:reason' joined by commas, in venue order."""
    return F.array_join(F.transform(excluded, lambda x: F.concat(x["venue"], F.lit(":"), x["reason"])), ",")
