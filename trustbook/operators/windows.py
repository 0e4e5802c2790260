"""Rolling windows: samples to buckets, buckets to spans.

Buckets are aggregated once (partial and final), every span reads the same buckets. Coverage
comes from live intervals cut at bucket borders, never from the presence of samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio_bps, round_dp
from .trust import STREAM

MS = 1_000_000


@dataclass(frozen=True)
class WindowSpec:
    """Resolution and spans in milliseconds; a resolution is 1 ms at least, a span one resolution at least."""

    resolution_ms: int = 250
    spans_ms: tuple[int, ...] = (1_000, 10_000, 60_000)

    @property
    def resolution_ns(self) -> int:
        return max(1, self.resolution_ms) * MS

    @property
    def buckets(self) -> tuple[int, ...]:
        """Buckets of each span, rounded up."""
        res = max(1, self.resolution_ms)
        return tuple(-(-max(s, res) // res) for s in self.spans_ms)


def index(at: Column, origin: Column, res_ns: int) -> Column:
    """Number of the bucket that holds an instant (exact: longs only)."""
    d = at - origin
    return F.call_function("div", d - F.pmod(d, F.lit(res_ns)), F.lit(res_ns))


def sample_buckets(samples: DataFrame, origin: Column, res_ns: int) -> DataFrame:
    """samples: venue, symbol, at_ns, mid, spread, integrity (live and two-sided only)."""
    s = samples.where("mid IS NOT NULL").withColumn("idx", index(F.col("at_ns"), origin, res_ns))
    return s.groupBy(*STREAM, "idx").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("mid").alias("mids"), F.sum("spread").alias("spreads"),
        F.min_by("mid", "at_ns").alias("first"), F.max_by("mid", "at_ns").alias("last"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.min("integrity").alias("integrity"),
    )


def trade_buckets(trades: DataFrame, origin: Column, res_ns: int) -> DataFrame:
    """trades: venue, symbol, at_ns, price, qty; whatever the state of the book."""
    t = trades.withColumn("idx", index(F.col("at_ns"), origin, res_ns))
    return t.groupBy(*STREAM, "idx").agg(F.count(F.lit(1)).alias("trades"), F.sum("qty").alias("volume"), F.sum((F.col("price") * F.col("qty")).cast("decimal(38,8)")).alias("notional"))


def trusted_buckets(status: DataFrame, origin: Column, until: Column, res_ns: int, first_idx: Column | None = None) -> DataFrame:
    """(venue, symbol, idx, trusted_ms): live time in each bucket, cut to whole milliseconds bucket by bucket.

    status: what ``trust.changes`` gives. Only the buckets from ``first_idx`` up to ``until`` are made.
    """
    lo, hi = F.greatest(F.col("from_ns"), origin), F.least(F.coalesce(F.col("to_ns"), until), until)
    live = status.where("live").select(*STREAM, lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    start, end = index(F.col("lo"), origin, res_ns), index(F.col("hi") - 1, origin, res_ns)
    live = live.withColumns({"i0": start if first_idx is None else F.greatest(start, first_idx), "i1": end}).where("i1 >= i0")
    cut = live.withColumn("idx", F.explode(F.sequence("i0", "i1")))
    a, b = origin + F.col("idx") * res_ns, origin + (F.col("idx") + 1) * res_ns
    overlap = F.least(F.col("hi"), b) - F.greatest(F.col("lo"), a)
    return cut.withColumn("overlap", overlap).groupBy(*STREAM, "idx").agg(F.expr(f"sum(overlap) div {MS}").alias("trusted_ms"))


def finish(df: DataFrame) -> DataFrame:
    """Published values from sums: NULL means no data, never zero."""
    some = F.coalesce(F.col("samples"), F.lit(0)) > 0
    mean = F.when(some, round_dp(F.col("mids") / F.col("samples"), 8))
    vol = F.when(F.coalesce(F.col("trades"), F.lit(0)) > 0, F.col("volume"))
    out = df.withColumns({"samples": F.coalesce("samples", F.lit(0)), "trades": F.coalesce("trades", F.lit(0)), "trusted_ms": F.coalesce("trusted_ms", F.lit(0)), "mean": mean, "volume": vol})
    return out.withColumns(
        {
            "vwap": F.when(F.col("trades") > 0, round_dp(F.col("notional").cast("decimal(28,8)") / F.nullif(F.col("volume"), F.lit(0)), 8)),
            "change_bps": ratio_bps(F.col("last") - F.col("first"), "first"),
            "range_bps": ratio_bps(F.col("high") - F.col("low"), "mean"),
            "mean_spread_bps": ratio_bps("spreads", "mids"),
            "is_partial": F.col("trusted_ms") < F.col("span_ms"),
        }
    ).drop("mids", "spreads", "notional")


def readings(samples: DataFrame, trades: DataFrame, trusted: DataFrame, streams: DataFrame, spec: WindowSpec, end_idx: Column) -> DataFrame:
    """One row per stream and span, read when bucket ``end_idx`` is in progress: the k completed buckets before it.

    The spans are a handful of rows joined to the buckets on nothing but their number, by exploding each bucket
    into the spans that hold it.
    """
    res = max(1, spec.resolution_ms)
    k = spec.buckets
    back = end_idx - F.col("idx")
    spans = F.array(*(F.when((back >= 1) & (back <= n), F.lit(n * res)) for n in k))

    def into(df: DataFrame) -> DataFrame:
        kept = df.where((back >= 1) & (back <= max(k)) & (F.col("idx") >= 0))
        return kept.withColumn("span_ms", F.explode(F.array_compact(F.array_distinct(spans))))

    s = into(samples).groupBy(*STREAM, "span_ms").agg(F.sum("samples").alias("samples"), F.sum("mids").alias("mids"), F.sum("spreads").alias("spreads"), F.min_by("first", "idx").alias("first"), F.max_by("last", "idx").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.min("integrity").alias("integrity_floor"))
    t = into(trades).groupBy(*STREAM, "span_ms").agg(F.sum("trades").alias("trades"), F.sum("volume").alias("volume"), F.sum("notional").alias("notional"))
    c = into(trusted).groupBy(*STREAM, "span_ms").agg(F.sum("trusted_ms").alias("trusted_ms"))
    base = streams.select(*STREAM).distinct().withColumn("span_ms", F.explode(F.array_distinct(F.array(*(F.lit(n * res) for n in k)))))
    key = [*STREAM, "span_ms"]
    return finish(base.join(s, key, "left").join(t, key, "left").join(c, key, "left"))


def rolling(buckets: DataFrame, k: int) -> DataFrame:
    """Samples, high, low and mean over the k buckets before each bucket, for bucket rows of ``sample_buckets``."""
    w = Window.partitionBy(*STREAM).orderBy("idx").rangeBetween(-k, -1)
    out = buckets.select(*STREAM, "idx", *(F.sum(c).over(w).alias(c) for c in ("samples", "mids", "spreads")), F.first("first", ignorenulls=True).over(w).alias("first"), F.last("last", ignorenulls=True).over(w).alias("last"), F.max("high").over(w).alias("high"), F.min("low").over(w).alias("low"))
    return out.withColumn("mean", round_dp(F.col("mids") / F.nullif(F.col("samples"), F.lit(0)), 8))
