"""Queries over what a node and a gateway publish: ladders on a tick, counters, window gauges, the merged touch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import span_label
from ..operators import book, cross, gateway, snapshot
from ..sources import driver
from ..streaming import replay
from . import wire_queries
from .oracles import BASE, ORACLES as PLAIN, _cross
from .queries import DAY_NS, MAX_AGE, Market

#: Metric names (fixed values, what readers of the metrics look for).
WINDOW_GAUGES = {"samples": "window_samples", "trades": "window_trades", "volume": "window_volume", "vwap": "window_vwap", "mean": "window_mid", "high": "window_high", "low": "window_low", "change_bps": "window_change_bps", "range_bps": "window_range_bps"}
CROSS_GAUGES = {"trusted_ms_floor": "cross_window_trusted_ms_floor", "max_lag_ms": "cross_window_max_lag_ms", "venues_used": "cross_window_venues_used", "high": "cross_window_high", "low": "cross_window_low", "range_bps": "cross_window_range_bps", "volume": "cross_window_volume"}
MAX_LAG_MS = 600_000


def q_metrics_windows(spark, sf_dir):
    r = Market(spark, sf_dir).readings().withColumn("span", span_label("span_ms"))
    return snapshot.metric_rows(r, WINDOW_GAUGES, ("venue", "symbol", "span"))


def q_metrics_cross_windows(spark, sf_dir):
    m = Market(spark, sf_dir)
    c = cross.cross_windows(m.readings(), m.streams()).withColumn("span", span_label("span_ms"))
    return snapshot.metric_rows(c, CROSS_GAUGES, ("symbol", "span"))


def q_tick_ladders(spark, sf_dir):
    """Every day: the ten best levels of each side of each book as of the tick."""
    m = Market(spark, sf_dir)
    out = book.ladders_at(m.messages, m.levels, m.first_ns, m.last_ns, DAY_NS)
    return out.select("venue", "symbol", "seq", "tick_ns", "side", "level", F.col("price").cast("double").alias("price"), F.col("qty").cast("double").alias("qty"))


def q_stream_counters(spark, sf_dir):
    """Counters over the frames that q_wire_bitstamp replays (bytes are left out, they are those of the spelling)."""
    messages = wire_queries.bitstamp_messages(spark, sf_dir)
    c = snapshot.stream_counters(messages, replay.replay(messages))
    return c.select("symbol", "frames", "connects", "disconnects", "rest_fetches", "audit_fetches", "parse_errors", "heartbeats", "trades", "desyncs", "applied")


def q_gateway_touch(spark, sf_dir):
    """Two nodes, each with the books of half of the users; the gateway takes each stream from the freshest and merges anew."""
    m = Market(spark, sf_dir)
    views = reports = None
    for n in (0, 1):
        node = Market(spark, sf_dir, F.expr(f"(user_id div 6) % 2 = {n}"))
        top = node.top().withColumn("node", F.lit(f"n{n}"))
        came = spark.createDataFrame([(f"n{n}", node.last_ns // 1_000_000)], "node string, received_ms long")
        views, reports = (top, came) if views is None else (views.unionByName(top), reports.unionAll(came))
    merged = gateway.consolidated(views, reports, F.lit(m.last_ns // 1_000_000), MAX_LAG_MS)
    c = cross.cross_touch(merged, MAX_AGE)
    return c.select("symbol", *(F.col(x).cast("double").alias(x) for x in ("bid", "ask", "spread", "mid", "spread_bps")), "bid_venue", "ask_venue", "venues_used", "integrity_floor", "oldest_leg_ms", "crossed", "single_venue", cross.reasons().alias("excluded"))


def _long(rows: str, names: dict[str, str], labels: str) -> str:
    """Metric rows of a subquery."""
    parts = " UNION ALL ".join(f"SELECT {labels}, span, '{metric}' AS metric, {c}::DOUBLE AS value FROM x" for c, metric in names.items())
    return f"WITH x AS (SELECT *, (span_ms // 1000) || 's' AS span FROM ({rows})) SELECT * FROM ({parts}) WHERE value IS NOT NULL"


_READINGS = " UNION ALL ".join(f"SELECT * FROM ({PLAIN[f'q_windows_{h}h']})" for h in (6, 24, 168))
_LADDERS = (
    BASE
    + f""", k AS (SELECT unnest(range(1, (last_ns - first_ns) // {DAY_NS} + 1)) AS seq, first_ns FROM ends),
es AS (SELECT venue, symbol, epoch, lead(at_ns) OVER (PARTITION BY venue, symbol ORDER BY at_ns) AS stop FROM m WHERE kind = 'snapshot'),
hl AS (SELECT lv.*, lead(at_ns) OVER (PARTITION BY venue, symbol, epoch, side, price ORDER BY at_ns) AS until_ns FROM lv),
tk AS (SELECT venue, symbol, seq, first_ns + seq * {DAY_NS} AS tick_ns, side, price, qty FROM k JOIN (SELECT * FROM hl JOIN es USING (venue, symbol, epoch) WHERE qty > 0) h
  ON h.at_ns <= first_ns + seq * {DAY_NS} AND (coalesce(until_ns, stop) IS NULL OR coalesce(until_ns, stop) > first_ns + seq * {DAY_NS}))
SELECT venue, symbol, seq, tick_ns, side, level::INTEGER AS level, price::DOUBLE AS price, qty::DOUBLE AS qty
FROM (SELECT *, row_number() OVER (PARTITION BY venue, symbol, seq, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS level FROM tk) WHERE level <= 10"""
)
_COUNTERS = (
    BASE
    + """, s AS (SELECT *, CASE WHEN live THEN 'live' WHEN count(*) FILTER (WHERE kind IN ('session_ended', 'delta')) OVER w > 0 THEN 'desynced' ELSE 'uninitialized' END AS status, lag(kind) OVER w AS before FROM m WINDOW w AS (PARTITION BY venue, symbol ORDER BY at_ns)),
c AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY venue, symbol ORDER BY at_ns), 'uninitialized') AS was FROM s)
SELECT upper(venue) || symbol || '-USD' AS symbol, count(*) FILTER (WHERE kind IN ('delta', 'trade')) AS frames, count(*) FILTER (WHERE kind <> 'session_ended' AND (before IS NULL OR before = 'session_ended')) AS connects,
  count(*) FILTER (WHERE kind = 'session_ended') AS disconnects, count(*) FILTER (WHERE kind = 'snapshot') AS rest_fetches, 0::BIGINT AS audit_fetches, 0::BIGINT AS parse_errors, 0::BIGINT AS heartbeats,
  count(*) FILTER (WHERE kind = 'trade') AS trades, count(*) FILTER (WHERE status = 'desynced' AND was <> 'desynced') AS desyncs, count(*) FILTER (WHERE kind IN ('trade', 'snapshot') OR (kind = 'delta' AND live)) AS applied
FROM c GROUP BY venue, symbol"""
)
_NODE = "(" + BASE.replace("FROM events", "FROM events WHERE (user_id // 6) % 2 = {0}", 1).replace("{0}", "§") + " SELECT 'n§' AS node, tp.*, (SELECT last_ns FROM ends) // 1000000 AS received FROM tp)"
_VIEWS = " UNION ALL ".join(f"SELECT * FROM {_NODE.replace('§', str(n))}" for n in (0, 1))
_GATEWAY = (
    f"""WITH vw AS ({_VIEWS}), fl AS (SELECT max(received) AS now_ms FROM vw),
lg AS (SELECT vw.* EXCLUDE (age_ns), age_ns + (now_ms - received) * 1000000 AS age_ns FROM vw, fl WHERE now_ms - received <= {MAX_LAG_MS}),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY age_ns // 1000000 NULLS LAST, node) AS place FROM lg) WHERE place = 1)"""
    + _cross(MAX_AGE)[len(BASE) :]
)

QUERIES = {f.__name__: f for f in (q_metrics_windows, q_metrics_cross_windows, q_tick_ladders, q_stream_counters, q_gateway_touch)}
ORACLES = {
    "q_metrics_windows": _long(_READINGS, WINDOW_GAUGES, "venue, symbol"),
    "q_metrics_cross_windows": _long(PLAIN["q_cross_windows"], CROSS_GAUGES, "symbol"),
    "q_tick_ladders": _LADDERS,
    "q_stream_counters": _COUNTERS,
    "q_gateway_touch": _GATEWAY,
}
