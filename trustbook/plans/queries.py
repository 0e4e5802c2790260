"""Registered queries over the driver's tables and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import partition_name, span_label
from ..functions.numbers import skew_ns
from ..operators import audit, book, cross, gateway, snapshot, trust, windows
from ..sources import driver

HOUR_MS = 3_600_000
SPANS = {"6h": 6 * HOUR_MS, "24h": 24 * HOUR_MS, "168h": 168 * HOUR_MS}
SPEC = windows.WindowSpec(HOUR_MS, tuple(SPANS.values()))
RES_NS = SPEC.resolution_ns
DAY_NS = driver.DAY_NS


def _d(c):
    return F.col(c).cast("double").alias(c) if isinstance(c, str) else c.cast("double")


class Market:
    """What the queries of one call share; every part is lazy but the two ends of the time line."""

    def __init__(self, spark: SparkSession, sf_dir: str, part: Column | None = None) -> None:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        self.raw = driver.messages(spark, sf_dir)
        if part is not None:
            events, self.raw = events.where(part), self.raw.where(part)
        # parquet statistics answer this without reading the column
        e = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(*((F.unix_micros(F.col(c).cast("timestamp")) * 1000).alias(c) for c in "ab")).first()
        self.first_ns, self.last_ns = e["a"] or 0, e["b"] or 0
        self.origin, self.now = F.lit(self.first_ns), F.lit(self.last_ns)
        self.end = (self.last_ns - self.first_ns) // RES_NS
        self.messages = driver.priced(trust.with_epochs(self.raw))
        self.levels = book.applied_levels(self.messages)

    def state(self, as_of=None) -> DataFrame:
        return book.current_epoch(self.raw, as_of)

    def book(self, as_of=None) -> DataFrame:
        return book.book_asof(self.levels, self.state(as_of), as_of)

    def top(self) -> DataFrame:
        return book.top_of_book(book.held_asof(self.levels, self.state()), self.state(), self.now)

    def touch(self) -> DataFrame:
        return book.touch_timeline(self.messages, self.levels)

    def trades(self) -> DataFrame:
        t = self.raw.where("kind = 'trade'")
        return t.select("venue", "symbol", "at_ns", (1000 + F.col("tv")).cast("decimal(18,8)").alias("price"), F.col("qty").cast("decimal(18,8)").alias("qty"))

    def status(self) -> DataFrame:
        return trust.changes(trust.boundaries(self.raw))

    def streams(self) -> DataFrame:
        return self.raw.select("venue", "venue_rank", "symbol").distinct()

    def readings(self) -> DataFrame:
        lowest = F.lit(max(0, self.end - max(SPEC.buckets)))
        start = F.lit(self.first_ns + max(0, self.end - max(SPEC.buckets)) * RES_NS)
        recent = lambda df: df.where(F.col("at_ns") >= start)
        return windows.readings(
            windows.sample_buckets(recent(self.touch()), self.origin, RES_NS), windows.trade_buckets(recent(self.trades()), self.origin, RES_NS),
            windows.trusted_buckets(self.status(), self.origin, self.now, RES_NS, lowest), self.streams(), SPEC, F.lit(self.end),
        )


def q_book_levels_asof(spark, sf_dir):
    return Market(spark, sf_dir).book().select("venue", "symbol", "side", _d("price"), _d("qty"))


def q_ladder_top5(spark, sf_dir):
    return book.ladder(Market(spark, sf_dir).book(), 5).select("venue", "symbol", "side", "level", _d("price"), _d("qty"))


def q_top_of_book(spark, sf_dir):
    return Market(spark, sf_dir).top().select("venue", "symbol", "live", *map(_d, ("bid", "ask", "bid_qty", "ask_qty", "spread", "mid")), "levels_held", "age_ns")


def q_trust_timeline(spark, sf_dir):
    return Market(spark, sf_dir).status().select("venue", "symbol", "live", "from_ns", "to_ns")


def q_desync_accounting(spark, sf_dir):
    m = Market(spark, sf_dir)
    return trust.desync_accounting(m.status(), m.now).select("venue", "symbol", "desyncs", "desynced_ns", "live", "status_since_ns")


def q_session_ids(spark, sf_dir):
    return Market(spark, sf_dir).messages.groupBy("venue", "symbol", "session_id").agg(F.count(F.lit(1)).alias("messages"), F.count_if("live").alias("live_messages"), F.max("epoch").alias("last_epoch"))


def q_window_buckets(spark, sf_dir):
    m = Market(spark, sf_dir)
    out = windows.sample_buckets(m.touch(), m.origin, RES_NS)
    return out.select("venue", "symbol", "idx", "samples", *map(_d, ("mids", "spreads", "first", "last", "high", "low")), "integrity")


def q_trade_buckets(spark, sf_dir):
    m = Market(spark, sf_dir)
    return windows.trade_buckets(m.trades(), m.origin, RES_NS).select("venue", "symbol", "idx", "trades", _d("volume"), _d("notional"))


def q_trust_coverage(spark, sf_dir):
    m = Market(spark, sf_dir)
    return windows.trusted_buckets(m.status(), m.origin, m.now, RES_NS)


READING = ("samples", "trades", "trusted_ms", "is_partial", "integrity_floor")
VALUES = ("mean", "first", "last", "high", "low", "volume", "vwap", "change_bps", "range_bps", "mean_spread_bps")


def _windows(name: str):
    def run(spark, sf_dir):
        r = Market(spark, sf_dir).readings().where(F.col("span_ms") == SPANS[name])
        return r.select("venue", "symbol", "span_ms", span_label("span_ms").alias("label"), *READING, *map(_d, VALUES))

    return run


def q_rolling(spark, sf_dir):
    m = Market(spark, sf_dir)
    r = windows.rolling(windows.sample_buckets(m.touch(), m.origin, RES_NS), 24)
    return r.select("venue", "symbol", "idx", "samples", *map(_d, ("mean", "first", "last", "high", "low")))


def q_trade_vwap(spark, sf_dir):
    p = driver.prints(spark, sf_dir)
    out = p.groupBy("venue", "symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum("qty").alias("volume"), F.sum((F.col("price") * F.col("qty")).cast("decimal(38,8)")).alias("notional"))
    return out.select("venue", "symbol", "trades", _d("volume"), _d("notional"), F.bround((F.col("notional") / F.col("volume")).cast("double"), 6).alias("vwap"))


def q_print_windows(spark, sf_dir):
    """Daily prints of lineitem: count, volume and range."""
    p = driver.prints(spark, sf_dir)
    b = p.groupBy("venue", "symbol", windows.index(F.col("at_ns"), F.lit(0), DAY_NS).alias("day")).agg(F.count(F.lit(1)).alias("trades"), F.sum("qty").alias("volume"), F.max("price").alias("high"), F.min("price").alias("low"))
    return b.select("venue", "symbol", "day", "trades", *map(_d, ("volume", "high", "low")))


MAX_AGE = 24 * driver.HOUR_NS


def q_cross_touch(spark, sf_dir):
    c = cross.cross_touch(Market(spark, sf_dir).top(), MAX_AGE)
    return c.select("symbol", *map(_d, ("bid", "ask", "spread", "mid", "spread_bps")), "bid_venue", "ask_venue", "venues_used", "integrity_floor", "oldest_leg_ms", "crossed", "single_venue", cross.reasons().alias("excluded"))


def q_cross_exclusions(spark, sf_dir):
    m = Market(spark, sf_dir)
    e = cross.eligibility(m.top(), 60_000_000_000)
    return e.select("venue", "symbol", "exclusion", "exclusion_text")


def q_weakest_integrity(spark, sf_dir):
    return cross.weakest_integrity(Market(spark, sf_dir).top())


def q_cross_windows(spark, sf_dir):
    m = Market(spark, sf_dir)
    c = cross.cross_windows(m.readings(), m.streams())
    return c.select("symbol", "span_ms", "venues_used", "samples", "trades", *map(_d, ("high", "low", "mean", "vwap", "volume", "range_bps")), "trusted_ms_floor", "integrity_floor", "max_lag_ms", cross.reasons().alias("excluded"))


def _theirs(ours: DataFrame) -> DataFrame:
    p = F.col("price").cast("long")
    return ours.where(p % 17 != 0).withColumn("qty", F.when(p % 19 == 0, F.col("qty") + 1).otherwise(F.col("qty")))


def _compared(m: Market) -> tuple[DataFrame, DataFrame]:
    everything = m.levels.groupBy("venue", "symbol", "side", "price").agg(F.max_by("qty", "at_ns").alias("qty")).where("qty > 0")
    return everything, audit.compared(everything, _theirs(everything))


def q_audit_levels(spark, sf_dir):
    _, c = _compared(Market(spark, sf_dir))
    return c.select("venue", "symbol", "side", *map(_d, ("price", "ours", "theirs")), "differs")


def q_audit_findings(spark, sf_dir):
    everything, c = _compared(Market(spark, sf_dir))
    o = audit.outcomes(c, everything)
    text = F.array_join(F.transform("findings", lambda f: F.concat(f["side"], F.lit(":"), f["price"].cast("long").cast("string"))), ",")
    return o.select("venue", "symbol", "compared", "differences", "outcome", F.coalesce(text, F.lit("")).alias("findings"))


def q_audit_bands(spark, sf_dir):
    everything, c = _compared(Market(spark, sf_dir))
    best = everything.groupBy("venue", "symbol", "side").agg(F.when(F.first("side") == "bid", F.max("price")).otherwise(F.min("price")).alias("best"))
    return audit.profile(c, best)


def q_audit_trail(spark, sf_dir):
    """One audit of every stream a week: its messages' error rows name the prices that disagree."""
    m = Market(spark, sf_dir)
    weekly = m.raw.withColumn("week", windows.index(F.col("at_ns"), m.origin, 7 * DAY_NS)).groupBy("venue", "symbol", "week").agg(F.max("at_ns").alias("at_ns"), F.array_sort(F.collect_set(F.when((F.col("kind") == "trade") & (F.col("qty") < 10), F.col("tv").cast("decimal(18,8)")))).alias("prices"))
    outcome = F.when(F.col("week") % 5 == 0, "match").when(F.size("prices") > 0, "mismatch").otherwise("inconclusive")
    t = audit.trail(weekly.withColumn("outcome", outcome))
    return t.select("venue", "symbol", "audits", "mismatches", "streak", F.size("suspects").alias("suspects"), _d("desync_price"), "desync_at")


def q_counters(spark, sf_dir):
    return snapshot.counters(Market(spark, sf_dir).messages)


def q_counters_rollup(spark, sf_dir):
    return snapshot.rollup(Market(spark, sf_dir).raw)


def _daily(m: Market) -> DataFrame:
    from pyspark.sql.window import Window

    d = m.raw.groupBy("venue", "symbol", windows.index(F.col("at_ns"), m.origin, DAY_NS).alias("tick")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "trade").alias("t"))
    w = Window.partitionBy("venue", "symbol").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("venue", "symbol", "tick", F.sum("n").over(w).alias("messages"), F.sum("t").over(w).alias("trades"))


def q_rates(spark, sf_dir):
    r = snapshot.rates(_daily(Market(spark, sf_dir)), ("messages", "trades"), 86400.0)
    return r.select("venue", "symbol", "tick", "messages", "trades", *(F.bround(c, 9).alias(c) for c in ("messages_per_s", "trades_per_s")))


def q_metrics_long(spark, sf_dir):
    top = Market(spark, sf_dir).top()
    names = {"bid": "book_best_bid", "ask": "book_best_ask", "spread": "book_spread", "levels_held": "book_levels", "age_ns": "book_age_ns", "integrity": "book_integrity"}
    return snapshot.metric_rows(top, names)


def q_tick_snapshot(spark, sf_dir):
    """Every day: the state of each stream as of the tick."""
    m = Market(spark, sf_dir)
    spine = snapshot.ticks(m.first_ns, m.last_ns, DAY_NS, m.streams())
    s = snapshot.as_of(spine, m.messages, F.struct("kind", "epoch", "live", "at_ns"))
    return s.select("venue", "symbol", "seq", "tick_ns", F.col("state.kind").alias("kind"), F.col("state.epoch").alias("epoch"), F.col("state.live").alias("live"), (F.col("tick_ns") - F.col("state.at_ns")).alias("age_ns"))


def q_last_trade(spark, sf_dir):
    m = Market(spark, sf_dir)
    return book.last_trade(driver.priced(m.raw), m.now)


def q_archive_roundtrip(spark, sf_dir):
    """Events through the partitioned archive and back: what comes out equals what went in."""
    import uuid

    from ..sources import archive

    m = Market(spark, sf_dir)
    path = f"{archive.shared_dir(spark)}/trustbook/archive-{uuid.uuid4().hex}"
    archive.write(driver_events(m), path)
    e = archive.assemble(archive.read(spark, [path]))
    return e.groupBy("venue", "symbol", "kind").agg(F.count(F.lit(1)).alias("events"), F.sum(F.size("bids")).alias("bids"), F.sum(F.size("asks")).alias("asks"), F.sum("event_seq").alias("seq_sum"))


def driver_events(m: Market) -> DataFrame:
    """The driver's messages as event rows (one row per level)."""
    x = m.raw.where("kind <> 'session_ended'")
    lvl = lambda side, p: F.struct(F.lit(side).alias("side"), p.cast("string").alias("price"), F.col("qty").cast("string").alias("qty"))
    bid, ask = lvl("bid", 999 - F.col("tv")), lvl("ask", 1001 + F.col("tv"))
    none = F.struct(F.lit(None).cast("string").alias("side"), (1000 + F.col("tv")).cast("string").alias("price"), F.col("qty").cast("string").alias("qty"))
    rows = F.when(F.col("kind") == "snapshot", F.array(bid, ask)).when(F.col("side") == "bid", F.array(bid)).when(F.col("side") == "ask", F.array(ask)).otherwise(F.array(none))
    x = x.withColumn("l", F.explode(rows))
    null = lambda t: F.lit(None).cast(t)
    return x.select(
        F.col("event_id").alias("event_seq"), "venue", "symbol", "kind", F.col("at_ns").alias("ingest_wall_unix_nanos"), (F.col("at_ns") - m.origin).alias("ingest_elapsed_nanos"), null("long").alias("venue_ts_unix_nanos"),
        F.col("l.side").alias("side"), F.col("l.price").alias("price"), F.col("l.qty").alias("qty"), F.when(F.col("l.side").isNotNull(), 0).alias("level_index"), null("long").alias("checksum"), null("long").alias("heartbeat_counter"),
        F.when(F.col("kind") == "trade", F.when(F.col("tv") % 2 == 0, "bid").otherwise("ask")).alias("taker_side"),
    )


def q_partition_hour(spark, sf_dir):
    m = Market(spark, sf_dir)
    ts = F.timestamp_micros(F.call_function("div", F.col("at_ns"), F.lit(1000)))
    return m.raw.groupBy(partition_name("symbol").alias("symbol_key"), F.date_format(ts, "yyyy-MM-dd").alias("date"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("messages"))


def q_clock_skew(spark, sf_dir):
    """Skew of a made-up venue clock (k milliseconds behind or ahead by parity)."""
    m = Market(spark, sf_dir)
    made_up = F.when(F.col("event_id") % 2 == 0, F.col("qty")).otherwise(-F.col("qty")) * 1_000_000
    s = m.raw.withColumn("venue_ts_ns", F.col("at_ns") + made_up).withColumn("skew_ns", skew_ns("venue_ts_ns", "at_ns"))
    return s.groupBy("venue", "symbol").agg(F.count_if(F.col("skew_ns") > 0).alias("ahead"), F.count_if(F.col("skew_ns") < 0).alias("behind"), F.min("skew_ns").alias("least_ns"), F.max("skew_ns").alias("most_ns"))


def _views(m: Market) -> DataFrame:
    """Two nodes, by the sixes of the user's number: the age of each stream as they see it."""
    v = m.raw.groupBy(F.concat(F.lit("n"), F.expr("(user_id div 6) % 2")).alias("node"), "venue", "symbol").agg(F.max("at_ns").alias("last"))
    return v.select("node", "venue", "symbol", F.call_function("div", m.now - F.col("last"), F.lit(1_000_000)).alias("age_ms"))


def q_gateway_merge(spark, sf_dir):
    m = Market(spark, sf_dir)
    lag = m.raw.groupBy(F.concat(F.lit("n"), F.col("user_id") % 7).alias("node")).agg(F.max("at_ns").alias("last"))
    r = lag.select("node", F.call_function("div", F.col("last"), F.lit(1_000_000)).alias("received_ms"))
    now = F.lit(m.last_ns // 1_000_000)
    return gateway.nodes(r, now, 600_000).select("node", "lag_ms", "included", "excluded")


def q_duplicates(spark, sf_dir):
    d = gateway.duplicates(_views(Market(spark, sf_dir)))
    return d.select("venue", "symbol", "copies", "winner", F.array_join("reporters", ",").alias("reporters"))


def q_live_members(spark, sf_dir):
    m = Market(spark, sf_dir)
    leases = m.raw.groupBy(F.concat(F.lit("u"), F.col("user_id") % 50).alias("node")).agg(F.max("at_ns").alias("w")).select("node", F.call_function("div", F.col("w"), F.lit(1_000_000)).alias("written_ms"), F.lit(6 * HOUR_MS).cast("long").alias("ttl_ms"))
    return gateway.live_members(leases, F.lit(m.last_ns // 1_000_000))


def q_gap_detect(spark, sf_dir):
    m = Market(spark, sf_dir)
    f = m.messages.withColumn("seq", F.col("event_id"))
    return trust.gaps(f.where("kind <> 'session_ended'"), "seq", "at_ns").select("event_id", "venue", "symbol", "expected", "missing")


def q_order_regressions(spark, sf_dir):
    m = Market(spark, sf_dir)
    f = m.messages.withColumn("micros", F.call_function("div", F.col("at_ns"), F.lit(1000)) - F.col("qty") * 10_000_000)
    return trust.regressions(f.where("kind = 'delta'"), "micros", "at_ns").select("event_id", "venue", "symbol", "micros", "latest")


def q_idle_gaps(spark, sf_dir):
    m = Market(spark, sf_dir)
    return trust.idle(m.raw, "at_ns", 2 * driver.HOUR_NS).select("event_id", "venue", "symbol", "idle_ns")


def q_sequence_missed(spark, sf_dir):
    m = Market(spark, sf_dir)
    return trust.missed(m.raw.where("kind = 'snapshot'"), "event_id", "at_ns", ("venue", "symbol")).select("event_id", "venue", "symbol", "missed")


def q_state_replay(spark, sf_dir):
    """The state operator over the same messages: final status and touch of each stream equal the set-based book's."""
    from ..streaming import replay

    m = Market(spark, sf_dir)
    out = replay.replay(replay.from_events(m.raw.where("kind = 'session_ended'").withColumnRenamed("event_id", "ord"), driver_events(m)), scripted=True)
    last = out.groupBy("venue", "symbol").agg(F.max_by(F.struct("status", "best_bid", "best_ask", "levels_held"), "ord").alias("s"))
    return last.select("venue", "symbol", (F.col("s.status") == "live").alias("live"), F.col("s.best_bid").cast("double").alias("bid"), F.col("s.best_ask").cast("double").alias("ask"))


def q_rendezvous(spark, sf_dir):
    m = Market(spark, sf_dir)
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    return gateway.owners(m.streams(), members)


QUERIES = {
    **{f.__name__: f for f in (q_cross_touch, q_book_levels_asof, q_ladder_top5, q_top_of_book, q_trust_timeline, q_desync_accounting, q_session_ids, q_window_buckets, q_trade_buckets, q_trust_coverage, q_rolling, q_trade_vwap, q_print_windows, q_cross_exclusions, q_weakest_integrity, q_cross_windows, q_audit_levels, q_audit_findings, q_audit_bands, q_audit_trail, q_counters, q_counters_rollup, q_rates, q_metrics_long, q_tick_snapshot, q_last_trade, q_archive_roundtrip, q_partition_hour, q_clock_skew, q_gateway_merge, q_duplicates, q_live_members, q_gap_detect, q_order_regressions, q_idle_gaps, q_sequence_missed, q_state_replay, q_rendezvous)},
    **{f"q_windows_{name}": _windows(name) for name in SPANS},
}
