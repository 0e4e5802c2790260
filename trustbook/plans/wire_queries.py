"""Queries over venue wire text: the driver's events, spelled as each venue would send them, through its adapter.

Every stream of the driver becomes a symbol of one venue. The text is built natively; parsing, integrity checks, splicing
and the book are the state operator's. The SQL beside each query says what the book must be from the semantics alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import checksum
from ..operators import trust
from ..sources import archive, driver
from ..streaming import replay
from . import queries
from .oracles import BASE

#: A sequence number is skipped before every so many events; a checksum is wrong on every so many; REST depth is so old.
SKIP = 37
WRONG = 5
REST_LAG_NS = 2 * driver.HOUR_NS


def _lists(side: str, price: Column) -> Column:
    """The two strings of a level for messages that touch that side, else no level."""
    has = (F.col("kind") == "snapshot") | (F.col("side") == side)
    none = F.expr("cast(array() AS array<array<string>>)")
    return F.when(has, F.array(F.array(price.cast("string"), F.col("qty").cast("string")))).otherwise(none)


def _market(spark, sf_dir: str) -> DataFrame:
    m = driver.messages(spark, sf_dir)
    m = m.withColumn("market", F.concat(F.upper("venue"), "symbol"))
    return m.withColumns({"bids": _lists("bid", 999 - F.col("tv")), "asks": _lists("ask", 1001 + F.col("tv")), "print": (1000 + F.col("tv")).cast("string"), "size": F.col("qty").cast("string")})


def _messages(m: DataFrame, venue: str, payload: Column, source: Column | None = None) -> DataFrame:
    ended = F.col("kind") == "session_ended"
    return m.select(
        F.lit(venue).alias("venue"), F.concat("market", F.lit("-USD")).alias("symbol"), F.col("event_id").alias("ord"), F.col("at_ns").alias("elapsed_ns"), F.col("at_ns").alias("wall_ns"),
        F.when(ended, "session_ended").otherwise("frame").alias("input"), (F.lit("web_socket") if source is None else source).alias("source"), F.when(~ended, payload).alias("payload"),
    )


def _result(timeline: DataFrame) -> DataFrame:
    """Of each market: messages after which the book was live, resynchronisations asked for, parse errors, and the book at the end."""
    last = F.max_by(F.struct("status", "best_bid", "best_ask", "levels_held"), F.struct("elapsed_ns", "ord"))
    out = timeline.groupBy("symbol").agg(F.count_if(F.col("status") == "live").alias("live_messages"), F.count_if("resync").alias("resyncs"), F.count("parse_error").alias("parse_errors"), last.alias("s"))
    return out.select("symbol", "live_messages", "resyncs", "parse_errors", (F.col("s.status") == "live").alias("live"), F.col("s.best_bid").cast("double").alias("bid"), F.col("s.best_ask").cast("double").alias("ask"), F.col("s.levels_held").cast("long").alias("levels_held"))


def q_wire_coinbase(spark, sf_dir):
    """Numbers that count every message of the connection; a skipped one desyncs the book until the next snapshot."""
    m = _market(spark, sf_dir)
    m = trust.running(m, F.when(F.col("event_id") % SKIP == 0, 2).otherwise(1).cast("long"), "at_ns", "sequence", F.sum)
    product = F.concat("market", F.lit("-USD"))
    side = lambda levels, name: F.transform(levels, lambda x: F.struct(F.lit(name).alias("side"), x[0].alias("price_level"), x[1].alias("new_quantity")))
    book = F.struct(F.when(F.col("kind") == "snapshot", "snapshot").otherwise("update").alias("type"), product.alias("product_id"), F.concat(side(F.col("bids"), "bid"), side(F.col("asks"), "offer")).alias("updates"))
    trade = F.struct(F.lit("update").alias("type"), F.array(F.struct(product.alias("product_id"), F.col("print").alias("price"), "size", F.lit("BUY").alias("side"))).alias("trades"))
    frame = lambda channel, event: F.to_json(F.struct(F.lit(channel).alias("channel"), F.col("sequence").alias("sequence_num"), F.array(event).alias("events")))
    return _result(replay.replay(_messages(m, "coinbase", F.when(F.col("kind") == "trade", frame("market_trades", trade)).otherwise(frame("l2_data", book)))))


def q_wire_kraken(spark, sf_dir):
    """Snapshots carry the checksum of their ladder, some a wrong one, which desyncs; numbers are bare in the text."""
    m = _market(spark, sf_dir)
    market = F.concat("market", F.lit("/USD"))
    bare = lambda levels: F.transform(levels, lambda x: F.struct(x[0].cast("long").alias("price"), x[1].cast("long").alias("qty")))
    text = lambda levels: F.transform(levels, lambda x: F.struct(x[0].alias("price"), x[1].alias("qty")))
    # a level without quantity isn't in the ladder
    held = lambda levels: F.filter(text(levels), lambda x: x["qty"] != "0")
    crc = checksum(held(F.col("asks")), held(F.col("bids"))) + F.when(F.col("event_id") % WRONG == 0, 1).otherwise(0)
    data = F.struct(market.alias("symbol"), bare(F.col("bids")).alias("bids"), bare(F.col("asks")).alias("asks"), F.when(F.col("kind") == "snapshot", crc).alias("checksum"))
    book = F.to_json(F.struct(F.lit("book").alias("channel"), F.when(F.col("kind") == "snapshot", "snapshot").otherwise("update").alias("type"), F.array(data).alias("data")))
    print_ = F.struct(market.alias("symbol"), F.col("print").cast("long").alias("price"), F.col("qty"), F.lit("buy").alias("side"))
    trade = F.to_json(F.struct(F.lit("trade").alias("channel"), F.lit("update").alias("type"), F.array(print_).alias("data")))
    return _result(replay.replay(_messages(m, "kraken", F.when(F.col("kind") == "trade", trade).otherwise(book))))


def bitstamp_messages(spark, sf_dir) -> DataFrame:
    m = _market(spark, sf_dir)
    pair = F.lower(F.concat("market", F.lit("usd")))
    micros = lambda ns: F.call_function("div", ns, F.lit(1000)).cast("string")
    diff = F.struct(micros(F.col("at_ns")).alias("microtimestamp"), "bids", "asks")
    trade = F.struct(micros(F.col("at_ns")).alias("microtimestamp"), F.col("print").alias("price_str"), F.col("size").alias("amount_str"), F.lit("0").alias("type"))
    frame = lambda event, channel, data: F.to_json(F.struct(F.lit(event).alias("event"), F.concat(F.lit(channel), pair).alias("channel"), data.alias("data")))
    rest = F.to_json(F.struct(micros(F.col("at_ns") - REST_LAG_NS).alias("microtimestamp"), "bids", "asks"))
    payload = F.when(F.col("kind") == "snapshot", rest).when(F.col("kind") == "trade", frame("trade", "live_trades_", trade)).otherwise(frame("data", "diff_order_book_", diff))
    return _messages(m, "bitstamp", payload, F.when(F.col("kind") == "snapshot", "rest_snapshot").otherwise("web_socket"))


def q_wire_bitstamp(spark, sf_dir):
    """A book begins with a REST answer of some age; the diffs that were buffered since that age are spliced onto it."""
    return _result(replay.replay(bitstamp_messages(spark, sf_dir)))


def q_archive_replay(spark, sf_dir):
    """Two runs with offsets of their own, archived below two prefixes, merged on the wall clock and replayed."""
    m = queries.Market(spark, sf_dir)
    rows = queries.driver_events(m)
    base = f"{archive.shared_dir(spark)}/trustbook/runs-{uuid.uuid4().hex}"
    for n in (0, 1):
        own = rows.where(F.col("event_seq") % 2 == n)
        archive.write(own.withColumn("ingest_elapsed_nanos", F.col("ingest_elapsed_nanos") - n * driver.HOUR_NS), f"{base}/{n}")
    merged = archive.timeline(archive.read(spark, [f"{base}/0", f"{base}/1"]), 2)
    ends = m.raw.where("kind = 'session_ended'").withColumnRenamed("event_id", "ord")
    out = replay.replay(replay.from_events(ends, merged, at="at_ns"), scripted=True)
    last = out.groupBy("venue", "symbol").agg(F.count(F.lit(1)).alias("messages"), F.max_by(F.struct("status", "best_bid", "best_ask", "levels_held"), F.struct("elapsed_ns", "ord")).alias("s"))
    return last.select("venue", "symbol", "messages", (F.col("s.status") == "live").alias("live"), F.col("s.best_bid").cast("double").alias("bid"), F.col("s.best_ask").cast("double").alias("ask"), F.col("s.levels_held").cast("long").alias("levels_held"))


_KIND = "CASE event_type WHEN 'signup' THEN 'snapshot' WHEN 'view' THEN 'delta' WHEN 'click' THEN 'delta' WHEN 'purchase' THEN 'trade' ELSE 'session_ended' END AS kind"
_LIVE = "CASE WHEN kind IN ('snapshot', 'session_ended') THEN kind END"
_BOOK = """
SELECT upper(venue) || symbol || '-USD' AS symbol, live_messages, resyncs, 0::BIGINT AS parse_errors, live, bid::DOUBLE AS bid, ask::DOUBLE AS ask, levels_held
FROM tp JOIN (SELECT venue, symbol, count(*) FILTER (WHERE live) AS live_messages, count(*) FILTER (WHERE {resync}) AS resyncs FROM mm GROUP BY ALL) USING (venue, symbol)"""
_WAS = ", mm AS (SELECT *, lag(live) OVER w AS was, lag(kind) OVER w AS before, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY venue, symbol ORDER BY at_ns))"


def _base(kind: str = _KIND, live: str = _LIVE) -> str:
    assert _KIND in BASE and _LIVE in BASE
    return BASE.replace(_KIND, kind).replace(_LIVE, live)


_GAP = f"CASE WHEN event_id % {SKIP} = 0 AND event_type <> 'error' AND lag(event_type) OVER (PARTITION BY user_id % 3, (user_id // 3) % 2 ORDER BY ts) <> 'error' THEN 'gap' ELSE ({_KIND.removesuffix(' AS kind')}) END AS kind"
#: A stream that hasn't been live yet asks for a resynchronisation at a gap too, once.
_COINBASE = (
    _base(_GAP, "CASE WHEN kind IN ('snapshot', 'session_ended', 'gap') THEN kind END")
    + _WAS
    + _BOOK.format(resync="kind = 'gap' AND (was OR NOT EXISTS (SELECT 1 FROM m p WHERE p.venue = mm.venue AND p.symbol = mm.symbol AND p.at_ns < mm.at_ns AND p.kind IN ('gap', 'session_ended', 'snapshot')))")
)
_KRAKEN = _base(live=f"CASE WHEN kind = 'snapshot' AND event_id % {WRONG} = 0 THEN 'wrong' WHEN kind IN ('snapshot', 'session_ended') THEN kind END") + _WAS
_KRAKEN += _BOOK.format(resync=f"kind = 'snapshot' AND event_id % {WRONG} = 0 AND (was OR NOT EXISTS (SELECT 1 FROM m p WHERE p.venue = mm.venue AND p.symbol = mm.symbol AND p.at_ns < mm.at_ns AND p.kind IN ('session_ended', 'snapshot')))")
#: The first snapshot of a session takes the deltas since its age along; they belong to its epoch and come after it.
_SPLICED = f"""), fs AS (
  SELECT venue, symbol, session_id, min(at_ns) AS first_at, min(epoch) AS first_epoch FROM m WHERE kind = 'snapshot' GROUP BY ALL
), lv AS (
  SELECT m.venue, m.symbol, epoch, CASE WHEN at_ns = first_at THEN at_ns - {REST_LAG_NS} ELSE at_ns END AS at_ns, unnest(['bid', 'ask']) AS side, unnest([999 - tv, 1001 + tv]) AS price, qty
  FROM m JOIN fs USING (venue, symbol, session_id) WHERE kind = 'snapshot'
  UNION ALL
  SELECT m.venue, m.symbol, CASE WHEN at_ns < first_at THEN first_epoch ELSE epoch END, at_ns, side, CASE side WHEN 'bid' THEN 999 - tv ELSE 1001 + tv END, qty
  FROM m JOIN fs USING (venue, symbol, session_id) WHERE kind = 'delta' AND at_ns > first_at - {REST_LAG_NS}
), st AS ("""
_FROM, _TO = BASE.index("), ends AS"), BASE.index("), st AS (") + len("), st AS (")
_ENDS = BASE[_FROM : BASE.index(",\nlv AS (")]
_BITSTAMP = BASE[:_FROM] + _ENDS + _SPLICED[1:] + BASE[_TO:] + _WAS + _BOOK.format(resync="false")

#: FNV-1a over the three names, the SplitMix64 finaliser, the largest weight, the smaller name among equals.
_BYTES = "list_transform(range(1, len({0}) + 1), lambda i: ascii(substr({0}, i, 1)))"
_RENDEZVOUS = (
    BASE
    + f""", p AS (SELECT DISTINCT venue, symbol, node FROM t, (SELECT unnest(['a', 'b', 'c']) AS node)),
f AS (SELECT *, list_reduce(list_transform([14695981039346656037::UHUGEINT] || list_transform({_BYTES.format('node')} || [0] || {_BYTES.format('venue')} || [0] || {_BYTES.format('symbol')}, lambda b: b::UHUGEINT), lambda x: x),
  lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM p),
g AS (SELECT *, (xor(h, h // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS y FROM f),
z AS (SELECT *, (xor(y, y // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM g),
w AS (SELECT *, xor(x, x // 2147483648::UHUGEINT) AS weight FROM z)
SELECT venue, symbol, node AS owner FROM (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY weight DESC, node) AS n FROM w) WHERE n = 1"""
)
_TRAIL = (
    BASE.replace("WITH t AS", "WITH RECURSIVE t AS", 1)
    + """, wk AS (SELECT venue, symbol, (at_ns - first_ns) // (7 * 86400000000000) AS week, max(at_ns) AS at_ns, coalesce(list(DISTINCT tv) FILTER (WHERE kind = 'trade' AND qty < 10), []) AS prices FROM t, ends GROUP BY ALL),
hi AS (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY at_ns) AS i, CASE WHEN week % 5 = 0 THEN 'match' WHEN len(prices) > 0 THEN 'mismatch' ELSE 'inconclusive' END AS outcome FROM wk),
fo AS (
  SELECT DISTINCT venue, symbol, 0::BIGINT AS i, 0::BIGINT AS mismatches, 0 AS streak, []::BIGINT[] AS suspects, NULL::BIGINT AS desync_price, NULL::BIGINT AS desync_at FROM hi
  UNION ALL
  SELECT venue, symbol, i, mismatches + CASE WHEN outcome = 'mismatch' THEN 1 ELSE 0 END,
    CASE WHEN goes_on THEN streak + 1 WHEN outcome = 'mismatch' THEN 1 WHEN outcome = 'match' THEN 0 ELSE streak END,
    CASE WHEN goes_on THEN common WHEN outcome = 'mismatch' THEN prices WHEN outcome = 'match' THEN [] ELSE suspects END,
    CASE WHEN goes_on AND streak + 1 >= 2 AND desync_at IS NULL THEN list_min(common) ELSE desync_price END, CASE WHEN goes_on AND streak + 1 >= 2 AND desync_at IS NULL THEN at_ns ELSE desync_at END
  FROM (SELECT fo.* EXCLUDE (i), hi.i, hi.at_ns, hi.outcome, hi.prices, list_intersect(suspects, prices) AS common, hi.outcome = 'mismatch' AND streak > 0 AND len(list_intersect(suspects, prices)) > 0 AS goes_on
        FROM fo JOIN hi ON hi.venue = fo.venue AND hi.symbol = fo.symbol AND hi.i = fo.i + 1)
)
SELECT venue, symbol, i AS audits, mismatches, streak::INTEGER AS streak, len(suspects)::INTEGER AS suspects, desync_price::DOUBLE AS desync_price, desync_at
FROM (SELECT *, max(i) OVER (PARTITION BY venue, symbol) AS last FROM fo) WHERE i = last"""
)

QUERIES = {f.__name__: f for f in (q_wire_coinbase, q_wire_kraken, q_wire_bitstamp, q_archive_replay)}
ORACLES = {"q_wire_coinbase": _COINBASE, "q_wire_kraken": _KRAKEN, "q_wire_bitstamp": _BITSTAMP, "q_rendezvous": _RENDEZVOUS, "q_audit_trail": _TRAIL}
ORACLES["q_archive_replay"] = BASE + "SELECT venue, symbol, messages, live, bid::DOUBLE AS bid, ask::DOUBLE AS ask, levels_held FROM tp JOIN (SELECT venue, symbol, count(*) AS messages FROM t GROUP BY ALL) USING (venue, symbol)"
