"""Audits: a book against a depth snapshot of its venue, and the trail of repeated disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .book import best_first
from .trust import STREAM, running

GUARD_BPS = 10
MAX_LEVELS = 500
MAX_FINDINGS = 64


def _worst(c: Column) -> Column:
    return F.when(F.col("side") == "bid", F.min(c)).otherwise(F.max(c))


def compared(ours: DataFrame, theirs: DataFrame, guard_bps: int = GUARD_BPS, max_levels: int = MAX_LEVELS, key: tuple[str, ...] = STREAM) -> DataFrame:
    """(key, side, price, ours, theirs, differs) of the levels that both sides can speak about.

    Levels inside the guard around our best price move too fast to compare. Beyond it each side's best
    ``max_levels`` are cut to the price range that both cover and compared by price.
    """
    best = ours.groupBy(*key, "side").agg(F.when(F.first("side") == "bid", F.max("price")).otherwise(F.min("price")).alias("best"))
    edge = F.col("best") * (F.lit(1) + F.when(F.col("side") == "bid", -1).otherwise(1) * F.lit(guard_bps).cast("decimal(10,0)") / F.lit(10000).cast("decimal(10,0)"))
    best = best.withColumn("edge", edge.cast("decimal(28,12)"))
    order = Window.partitionBy(*key, "side").orderBy(best_first())

    def part(df: DataFrame) -> DataFrame:
        beyond = df.where("qty > 0").join(best, [*key, "side"])
        beyond = beyond.where(F.when(F.col("side") == "bid", F.col("price") <= F.col("edge")).otherwise(F.col("price") >= F.col("edge")))
        return beyond.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_levels).select(*key, "side", "price", "qty")

    a, b = part(ours), part(theirs)
    span = lambda df, n: df.groupBy(*key, "side").agg(F.min("price").alias(f"{n}0"), F.max("price").alias(f"{n}1"))
    shared = span(a, "a").join(span(b, "b"), [*key, "side"]).select(*key, "side", F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))
    both = a.withColumnRenamed("qty", "ours").join(b.withColumnRenamed("qty", "theirs"), [*key, "side", "price"], "full").join(shared, [*key, "side"])
    return both.where("price BETWEEN lo AND hi").select(*key, "side", "price", "ours", "theirs", (~F.col("ours").eqNullSafe(F.col("theirs"))).alias("differs"))


def outcomes(levels: DataFrame, books: DataFrame, key: tuple[str, ...] = STREAM) -> DataFrame:
    """One row per audited book: match, mismatch or inconclusive, with at most 64 findings, bids first, by price."""
    finding = F.struct(F.when(F.col("side") == "bid", 0).otherwise(1).alias("s"), "price", "side", "ours", "theirs")
    got = levels.groupBy(*key).agg(F.count(F.lit(1)).alias("compared"), F.count_if("differs").alias("differences"), F.slice(F.array_sort(F.collect_list(F.when(F.col("differs"), finding))), 1, MAX_FINDINGS).alias("findings"))
    out = books.select(*key).distinct().join(got, list(key), "left")
    n = F.coalesce("compared", F.lit(0))
    return out.select(*key, n.alias("compared"), F.coalesce("differences", F.lit(0)).alias("differences"), "findings", F.when(F.col("differences") > 0, "mismatch").when(n == 0, "inconclusive").otherwise("match").alias("outcome"))


def profile(levels: DataFrame, best: DataFrame, key: tuple[str, ...] = STREAM) -> DataFrame:
    """Disagreement by distance from the best price, in bands of basis points."""
    j = levels.join(best, [*key, "side"]).withColumn("bps", F.abs(F.col("price") - F.col("best")) * 10000 / F.col("best"))
    band = F.when(F.col("bps") < 1, "0-1").when(F.col("bps") < 5, "1-5").when(F.col("bps") < 10, "5-10").when(F.col("bps") < 25, "10-25").otherwise("25+")
    return j.withColumn("band", band).groupBy("band").agg(F.count(F.lit(1)).alias("levels"), F.count_if("differs").alias("disagree")).withColumn("percent", F.bround(F.col("disagree") * 100.0 / F.col("levels"), 4))


def trail(audits: DataFrame, consecutive: int = 2, key: tuple[str, ...] = STREAM) -> DataFrame:
    """Folds the audits of each stream: audits, mismatches, suspects, current streak and the first desync, if any.

    audits: key, at_ns, outcome, prices (array). A streak keeps the prices that disagree every time; a match clears
    it, an inconclusive audit leaves it, an empty intersection starts anew at one. The first mismatch never desyncs.
    Runs between matches are folded by themselves and put together, so that no row holds a stream's whole history.
    """
    start = F.struct(F.lit(0).cast("long").alias("audits"), F.lit(0).cast("long").alias("mismatches"), F.lit(0).alias("streak"), F.expr("cast(array() AS array<decimal(18,8)>)").alias("suspects"), F.lit(None).cast("decimal(18,8)").alias("desync_price"), F.lit(None).cast("long").alias("desync_at"))

    def step(s: Column, a: Column) -> Column:
        mismatch, match = a["outcome"] == "mismatch", a["outcome"] == "match"
        left = F.array_intersect(s["suspects"], a["prices"])
        goes_on = mismatch & (s["streak"] > 0) & (F.size(left) > 0)
        streak = F.when(goes_on, s["streak"] + 1).when(mismatch, 1).when(match, 0).otherwise(s["streak"])
        suspects = F.when(goes_on, left).when(mismatch, a["prices"]).when(match, F.expr("cast(array() AS array<decimal(18,8)>)")).otherwise(s["suspects"])
        hit = goes_on & (s["streak"] + 1 >= consecutive) & s["desync_at"].isNull()
        return F.struct((s["audits"] + 1).alias("audits"), (s["mismatches"] + mismatch.cast("long")).alias("mismatches"), streak.alias("streak"), suspects.alias("suspects"), F.when(hit, F.array_min(left)).otherwise(s["desync_price"]).alias("desync_price"), F.when(hit, a["at_ns"]).otherwise(s["desync_at"]).alias("desync_at"))

    history = F.array_sort(F.collect_list(F.struct("at_ns", "outcome", F.col("prices").cast("array<decimal(18,8)>").alias("prices"))))
    runs = running(audits, (F.col("outcome") == "match").cast("long"), "at_ns", "run", F.sum, key).groupBy(*key, "run").agg(history.alias("h"))
    runs = runs.withColumn("s", F.aggregate("h", start, step)).select(*key, "run", "s.*")
    first = F.when(F.col("desync_at").isNotNull(), F.col("run"))
    return runs.groupBy(*key).agg(F.sum("audits").alias("audits"), F.sum("mismatches").alias("mismatches"), F.max_by("streak", "run").alias("streak"), F.max_by("suspects", "run").alias("suspects"), F.min_by("desync_price", first).alias("desync_price"), F.min_by("desync_at", first).alias("desync_at"))
