"""Merging several nodes' snapshots: inclusion, age adjustment, duplicates, channel totals; shards and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import ordered_weight
from .trust import running

MAX_LAG_MS = 3000


def nodes(reports: DataFrame, now_ms: Column, max_lag_ms: int = MAX_LAG_MS) -> DataFrame:
    """reports: node, received_ms (NULL: none yet). Adds lag_ms, included and why not."""
    lag = now_ms - F.col("received_ms")
    why = F.when(F.col("received_ms").isNull(), "no snapshot received yet").when(lag > max_lag_ms, F.concat(F.lit("no snapshot for "), lag.cast("string"), F.lit("ms")))
    return reports.withColumn("lag_ms", lag).withColumn("excluded", why).withColumn("included", F.col("excluded").isNull())


def aged(views: DataFrame, lag: str = "lag_ms") -> DataFrame:
    """Ages grow by the lag of their node (a missing age of a book stays infinite: it becomes the lag); totals and windows don't."""
    out = views
    for c in ("status_for_ms", "last_verified_ms", "last_trade_age_ms"):
        if c in views.columns:
            out = out.withColumn(c, F.col(c) + F.col(lag))
    return out.withColumn("age_ms", F.coalesce(F.col("age_ms"), F.lit(0)) + F.col(lag))


def winners(views: DataFrame) -> DataFrame:
    """views: node, venue, symbol, age_ms (effective). Of several nodes with a stream the freshest, then the first by name, wins."""
    w = Window.partitionBy("venue", "symbol").orderBy(F.col("age_ms").asc_nulls_last(), "node")
    return views.withColumn("place", F.row_number().over(w)).withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("venue", "symbol")))


def consolidated(views: DataFrame, reports: DataFrame, now_ms: Column, max_lag_ms: int = MAX_LAG_MS) -> DataFrame:
    """One view of each stream over the nodes whose snapshots are fresh enough: the freshest node's, its age and that of its
    windows (lag_ms) advanced by the lag. Touch and windows across venues are computed from these anew.

    views: node, venue, symbol, age_ns and others; reports: node, received_ms. Nodes are a handful.
    """
    fresh = nodes(reports, now_ms, max_lag_ms).where("included").select("node", "lag_ms")
    v = views.join(F.broadcast(fresh), "node").withColumn("age_ns", F.col("age_ns") + F.col("lag_ms") * 1_000_000)
    return winners(v.withColumn("age_ms", F.call_function("div", F.col("age_ns"), F.lit(1_000_000)))).where("place = 1").drop("place", "age_ms")


def duplicates(views: DataFrame) -> DataFrame:
    """Streams that more than one included node reports, with the winner and all reporters."""
    w = winners(views)
    return w.groupBy("venue", "symbol").agg(F.max("copies").alias("copies"), F.max(F.when(F.col("place") == 1, F.col("node"))).alias("winner"), F.array_sort(F.collect_list("node")).alias("reporters")).where("copies > 1")


def channel_totals(reports: DataFrame) -> DataFrame:
    return reports.where("included").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("len", "capacity", "dropped")))


def owners(streams: DataFrame, members: DataFrame) -> DataFrame:
    """Rendezvous owner of each stream; without members the owner is NULL. Members are a handful of nodes."""
    pairs = streams.select("venue", "symbol").distinct().withColumn("one", F.lit(1)).join(members.select("node").distinct().withColumn("one", F.lit(1)), "one", "left").drop("one")
    w = F.when(F.col("node").isNotNull(), ordered_weight(F.coalesce("node", F.lit("")), F.col("venue"), F.col("symbol")))
    best = pairs.withColumn("w", w).groupBy("venue", "symbol").agg(F.max("w").alias("m"), F.collect_list(F.struct("w", "node")).alias("all"))
    return best.select("venue", "symbol", F.array_min(F.transform(F.filter("all", lambda x: x["w"] == F.col("m")), lambda x: x["node"])).alias("owner"))


def live_members(leases: DataFrame, now_ms: Column) -> DataFrame:
    """Nodes whose lease hasn't run out (one written in the future is live)."""
    return leases.where(now_ms <= F.col("written_ms") + F.col("ttl_ms")).select("node").distinct()


def elsewhere(streams: DataFrame, owned: DataFrame) -> DataFrame:
    """Streams that some other node owns."""
    return streams.join(owned, ["venue", "symbol"], "left_anti")


def backoff(spark, base_ms: int, cap_ms: int, attempts: int) -> DataFrame:
    """Ceilings of the retry schedule: doubling, then flat; a wait lies between half of it and all of it."""
    ceiling = F.least(F.lit(cap_ms).cast("double"), F.lit(base_ms) * F.pow(F.lit(2.0), F.col("id"))).cast("long")
    return spark.range(attempts).select(F.col("id").alias("attempt"), ceiling.alias("ceiling_ms"), F.floor(ceiling / 2).cast("long").alias("least_ms"))


def attempts(sessions: DataFrame, reset_ms: int = 30_000) -> DataFrame:
    """Adds attempt: failed tries since the last session that lasted long enough to start the schedule anew (that one has 0).

    sessions: node, at_ms (when it ended), lasted_ms.
    """
    long = F.col("lasted_ms") >= reset_ms
    out = running(running(sessions, long.cast("long"), "at_ms", "resets", F.sum, ("node",), slice_ns=1 << 22), F.lit(1).cast("long"), "at_ms", "tries", F.sum, ("node",), slice_ns=1 << 22)
    start = out.where(long).groupBy(F.col("node").alias("n"), F.col("resets").alias("r")).agg(F.min("tries").alias("first"))
    out = out.join(start, (F.col("node") == F.col("n")) & (F.col("resets") == F.col("r")), "left")
    return out.withColumn("attempt", F.col("tries") - F.coalesce("first", F.lit(0))).drop("n", "r", "first", "resets", "tries")


def renewals(members: DataFrame, first_ms: int, last_ms: int, renew_ms: int = 3_000) -> DataFrame:
    """(node, at_ms): when each node renews its lease; it tries again after each renewal, whether that succeeded or not."""
    return members.select("node", F.explode(F.sequence(F.lit(first_ms).cast("long"), F.lit(last_ms).cast("long"), F.lit(renew_ms).cast("long"))).alias("at_ms"))


def lease_states(observations: DataFrame, ttl_ms: int = 15_000, guard_ms: int = 2_000) -> DataFrame:
    """Simulated lease of a node: renewals at at_ms that succeed or not. It holds up to ttl - guard after the last success and
    owns nothing before it has settled for ttl + guard; a stand-down starts settling anew."""
    w = Window.partitionBy("node").orderBy("at_ms").rowsBetween(Window.unboundedPreceding, 0)
    prev = Window.partitionBy("node").orderBy("at_ms")
    out = observations.withColumn("last_ok", F.last(F.when(F.col("ok"), F.col("at_ms")), ignorenulls=True).over(w)).withColumn("holds", F.coalesce(F.col("at_ms") - F.col("last_ok") <= ttl_ms - guard_ms, F.lit(False)))
    out = out.withColumn("joined", F.col("holds") & ~F.coalesce(F.lag("holds").over(prev), F.lit(False))).withColumn("since", F.last(F.when(F.col("joined"), F.col("at_ms")), ignorenulls=True).over(w))
    return out.withColumn("settled", F.col("holds") & (F.col("at_ms") - F.col("since") >= ttl_ms + guard_ms)).drop("joined")
