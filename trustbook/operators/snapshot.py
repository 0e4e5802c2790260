"""Snapshots on a tick, counters and rates, metric rows, and wire rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .trust import STREAM, neighbour

CLOCKS = ("ingest_monotonic", "node_monotonic+gateway_monotonic")


def ticks(first_ns: int, last_ns: int, every_ns: int, streams: DataFrame) -> DataFrame:
    """A row per tick and stream, seq from 1."""
    n = max(0, (last_ns - first_ns) // every_ns)
    seq = F.explode(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"))
    return streams.select(*STREAM).distinct().withColumn("seq", seq).select(F.col("seq").cast("long").alias("seq"), (F.lit(first_ns) + F.col("seq").cast("long") * every_ns).alias("tick_ns"), *STREAM)


def as_of(spine: DataFrame, timeline: DataFrame, value: Column, at: str = "at_ns", slice_ns: int = 86_400_000_000_000) -> DataFrame:
    """The last value at or before each tick: union, then the last one that isn't NULL. Two levels: slices first."""
    rows = spine.select(*STREAM, F.col("tick_ns").alias("at"), F.lit(1).alias("o"), "seq", F.lit(None).alias("v")).unionByName(timeline.select(*STREAM, F.col(at).alias("at"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("seq"), value.alias("v")))
    rows = rows.withColumn("slice", F.expr(f"at div {slice_ns}"))
    per = rows.groupBy(*STREAM, "slice").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("at"))).alias("b"))
    w = Window.partitionBy(*STREAM).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*STREAM, "slice", F.last("b", ignorenulls=True).over(w).alias("b0"))
    inner = Window.partitionBy(*STREAM, "slice").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(before, [*STREAM, "slice"]).withColumn("state", F.coalesce(F.last("v", ignorenulls=True).over(inner), F.col("b0")))
    return out.where("o = 1").select(*STREAM, "seq", F.col("at").alias("tick_ns"), "state")


def owned(snapshot: DataFrame, owners: DataFrame) -> DataFrame:
    """Only the streams that this node owns are published."""
    return snapshot.join(owners.select(*STREAM), list(STREAM), "left_semi")


def counters(messages: DataFrame) -> DataFrame:
    """Monotone counters of each stream, and as ROLLUP over venue and symbol an extension for dashboards."""
    kinds = ("snapshot", "delta", "trade", "session_ended")
    return messages.groupBy(*STREAM).agg(F.count(F.lit(1)).alias("messages"), *(F.count_if(F.col("kind") == k).alias(f"{k}s") for k in kinds), F.count_if((F.col("kind") == "delta") & F.col("live")).alias("applied"), F.count_if((F.col("kind") == "delta") & ~F.col("live")).alias("refused"))


def stream_counters(messages: DataFrame, timeline: DataFrame) -> DataFrame:
    """The monotone counters of each stream that a recording can show; those of failures that leave no message
    (connect_failures, idle_timeouts, dropped, rest_failures, audit_failures) are NULL.

    messages: what the state operator takes, in the order elapsed_ns; timeline: what it gives.
    """
    frame = F.col("input") != "session_ended"
    m = neighbour(messages.select(*STREAM, "elapsed_ns", "input", "source", F.octet_length("payload").alias("size")), "input", "elapsed_ns", "before")
    came = m.groupBy(*STREAM).agg(
        F.count_if(frame & (F.col("source") == "web_socket")).alias("frames"), F.coalesce(F.sum(F.when(frame, F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(frame & (F.col("before").isNull() | (F.col("before") == "session_ended"))).alias("connects"), F.count_if(~frame).alias("disconnects"),
        F.count_if(frame & (F.col("source") == "rest_snapshot")).alias("rest_fetches"), F.count_if(frame & (F.col("source") == "rest_audit")).alias("audit_fetches"),
    )
    events = lambda kind: F.sum(F.size(F.filter("events", lambda x: x["kind"] == kind))).alias(f"{kind}s")
    t = neighbour(timeline.select(*STREAM, "elapsed_ns", "status", "parse_error", "events"), "status", "elapsed_ns", "was")
    fell = (F.col("status") == "desynced") & (F.coalesce("was", F.lit("uninitialized")) != "desynced")
    did = t.groupBy(*STREAM).agg(F.count("parse_error").alias("parse_errors"), events("heartbeat"), events("trade"), F.count_if(fell).alias("desyncs"), F.count_if(F.size("events") > 0).alias("applied"))
    unseen = {c: F.lit(None).cast("long") for c in ("connect_failures", "idle_timeouts", "dropped", "rest_failures", "audit_failures")}
    return came.join(did, list(STREAM)).withColumns(unseen)


def rollup(messages: DataFrame) -> DataFrame:
    return messages.rollup("symbol", "venue").agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("kind") == "trade").alias("trades"))


def rates(series: DataFrame, columns: tuple[str, ...], tick_s: float, order: str = "tick", key: tuple[str, ...] = STREAM) -> DataFrame:
    """Per-second rates of monotone counters between ticks; a counter that fell counts as none, as does a tick of no length."""
    # ticks are few in a stream, so a slice is many of them
    out = neighbour(series.withColumn("now", F.struct(*columns)), "now", order, "was", key, slice_ns=4096)
    rate = {f"{c}_per_s": (F.greatest(F.col(c) - F.col(f"was.{c}"), F.lit(0)) / tick_s if tick_s > 0 else F.lit(0.0)) for c in columns}
    return out.withColumns({k: F.coalesce(v, F.lit(0.0)).cast("double") for k, v in rate.items()}).drop("now", "was")


def reconnects(connects: str = "connects") -> Column:
    return F.greatest(F.col(connects) - 1, F.lit(0))


def metric_rows(df: DataFrame, names: dict[str, str], labels: tuple[str, ...] = STREAM) -> DataFrame:
    """Long form (metric, labels, value): a missing value has no row."""
    pairs = ", ".join(f"'{metric}', cast(`{c}` AS double)" for c, metric in names.items())
    return df.selectExpr(*labels, f"stack({len(names)}, {pairs}) AS (metric, value)").where("value IS NOT NULL")


def exposition(rows: DataFrame, labels: tuple[str, ...] = STREAM) -> DataFrame:
    """Text lines of metric rows."""
    text = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.col(c), F.lit('"')) for c in labels))
    return rows.select(F.concat(F.col("metric"), F.lit("{"), text, F.lit("} "), F.col("value").cast("string")).alias("line"))


def wire(df: DataFrame, clock: str = CLOCKS[0]) -> DataFrame:
    """One JSON text per row; decimals leave as strings, durations name their clock."""
    cols = [F.col(f.name).cast("string").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols, F.lit(clock).alias("clock"))).alias("json"))


def published(top: DataFrame, touch: DataFrame, depth: DataFrame, seq: int, tick_ns: int) -> DataFrame:
    """The nested snapshot: one row, symbols in order of name, venues in order of rank, decimals as text.

    top: one row per stream; touch: what ``cross_touch`` gives; depth: ladder rows (level, side, price, qty).
    A snapshot holds a bounded number of streams and levels; it is what one node publishes.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    ladders = depth.groupBy(*STREAM).agg(F.array_sort(F.collect_list(F.struct("side", "level", text("price"), text("qty")))).alias("levels"))
    view = F.struct("venue_rank", "venue", "live", "integrity", text("bid"), text("ask"), "age_ns", "levels_held", F.coalesce("levels", F.expr("cast(array() AS array<struct<side:string,level:int,price:string,qty:string>>)")).alias("levels"))
    symbols = top.join(ladders, list(STREAM), "left").groupBy("symbol").agg(F.array_sort(F.collect_list(view)).alias("venues"))
    cross = touch.select("symbol", F.struct(text("bid"), text("ask"), "bid_venue", "ask_venue", text("spread"), text("spread_bps"), "crossed", "single_venue", "oldest_leg_ms", "integrity_floor", "excluded").alias("cross"))
    rows = symbols.join(cross, "symbol", "left").agg(F.array_sort(F.collect_list(F.struct("symbol", "venues", "cross"))).alias("symbols"))
    return rows.select(F.lit(seq).cast("long").alias("seq"), F.lit(tick_ns).cast("long").alias("tick_ns"), F.lit(CLOCKS[0]).alias("clock"), "symbols")


def last_queued(messages: DataFrame, drain: str, order: str, capacity: int = 1024) -> DataFrame:
    """What a bounded queue that drops its oldest would have kept of each drain, and how many it dropped before each row."""
    w = Window.partitionBy(drain).orderBy(F.desc(order))
    n = F.count(F.lit(1)).over(Window.partitionBy(drain))
    return messages.withColumn("place", F.row_number().over(w)).withColumn("dropped", F.greatest(n - capacity, F.lit(0))).where(F.col("place") <= capacity).drop("place")
