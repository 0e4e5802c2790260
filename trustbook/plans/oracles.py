"""The same answers in DuckDB SQL, written from the semantics and not from the Spark plans."""

from __future__ import annotations

BASE = """
WITH t AS (
  SELECT event_id, user_id, epoch_us(ts) * 1000 AS at_ns, 'v' || (user_id % 3) AS venue, (user_id % 3)::INTEGER AS venue_rank,
         CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS integrity, 'S' || ((user_id // 3) % 2) AS symbol,
         CASE event_type WHEN 'signup' THEN 'snapshot' WHEN 'view' THEN 'delta' WHEN 'click' THEN 'delta' WHEN 'purchase' THEN 'trade' ELSE 'session_ended' END AS kind,
         CASE event_type WHEN 'view' THEN 'bid' WHEN 'click' THEN 'ask' END AS side,
         floor(value::DECIMAL(18,8))::BIGINT AS tv, json_extract_string(props, '$.k')::BIGINT AS qty
  FROM events
), m AS (
  SELECT *, count(*) FILTER (WHERE kind = 'snapshot') OVER w AS epoch, count(*) FILTER (WHERE kind = 'session_ended') OVER w AS session_id,
         coalesce(last_value(CASE WHEN kind IN ('snapshot', 'session_ended') THEN kind END IGNORE NULLS) OVER w = 'snapshot', false) AS live
  FROM t WINDOW w AS (PARTITION BY venue, symbol ORDER BY at_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), ends AS (SELECT min(at_ns) AS first_ns, max(at_ns) AS last_ns FROM t),
lv AS (
  SELECT venue, symbol, epoch, at_ns, 'bid' AS side, 999 - tv AS price, qty FROM m WHERE kind = 'snapshot'
  UNION ALL SELECT venue, symbol, epoch, at_ns, 'ask', 1001 + tv, qty FROM m WHERE kind = 'snapshot'
  UNION ALL SELECT venue, symbol, epoch, at_ns, side, CASE side WHEN 'bid' THEN 999 - tv ELSE 1001 + tv END, qty FROM m WHERE kind = 'delta' AND live
), st AS (
  SELECT venue, symbol, any_value(venue_rank) AS venue_rank, any_value(integrity) AS integrity, max(epoch) AS epoch, arg_max(live, at_ns) AS live,
         max(at_ns) FILTER (WHERE kind = 'snapshot' OR (kind = 'delta' AND live)) AS upd FROM m GROUP BY venue, symbol
), bk AS (
  SELECT venue, symbol, side, price, arg_max(qty, at_ns) AS qty FROM lv JOIN st USING (venue, symbol, epoch) GROUP BY ALL HAVING arg_max(qty, at_ns) > 0
), tp AS (
  SELECT st.*, b.bid, b.ask, b.bid_qty, b.ask_qty, coalesce(b.n, 0) AS levels_held, (SELECT last_ns FROM ends) - upd AS age_ns FROM st LEFT JOIN (
    SELECT venue, symbol, max(price) FILTER (WHERE side = 'bid') AS bid, min(price) FILTER (WHERE side = 'ask') AS ask,
           arg_max(qty, price) FILTER (WHERE side = 'bid') AS bid_qty, arg_min(qty, price) FILTER (WHERE side = 'ask') AS ask_qty, count(*) AS n FROM bk GROUP BY ALL
  ) b USING (venue, symbol)
), ch AS (
  SELECT venue, symbol, at_ns AS from_ns, live FROM (
    SELECT venue, symbol, at_ns, kind = 'snapshot' AS live, lag(kind = 'snapshot') OVER (PARTITION BY venue, symbol ORDER BY at_ns) AS was
    FROM t WHERE kind IN ('snapshot', 'session_ended')) WHERE was IS DISTINCT FROM live
), sp AS (SELECT *, lead(from_ns) OVER (PARTITION BY venue, symbol ORDER BY from_ns) AS to_ns FROM ch),
held AS (SELECT * FROM (SELECT *, lead(at_ns) OVER (PARTITION BY venue, symbol, epoch, side, price ORDER BY at_ns) AS until_ns FROM lv) WHERE qty > 0),
tl AS (
  SELECT m.venue, m.symbol, m.at_ns, any_value(m.integrity) AS integrity, max(h.price) FILTER (WHERE h.side = 'bid') AS bid, min(h.price) FILTER (WHERE h.side = 'ask') AS ask
  FROM m JOIN held h ON m.venue = h.venue AND m.symbol = h.symbol AND m.epoch = h.epoch AND h.at_ns <= m.at_ns AND (h.until_ns IS NULL OR h.until_ns > m.at_ns)
  WHERE m.live GROUP BY m.venue, m.symbol, m.at_ns
), sb AS (
  SELECT venue, symbol, (at_ns - first_ns) // 3600000000000 AS idx, count(*) AS samples, sum((bid + ask) / 2.0) AS mids, sum(ask - bid) AS spreads,
         arg_min((bid + ask) / 2.0, at_ns) AS first, arg_max((bid + ask) / 2.0, at_ns) AS last, max((bid + ask) / 2.0) AS high, min((bid + ask) / 2.0) AS low, min(integrity) AS integrity
  FROM tl, ends WHERE bid IS NOT NULL AND ask IS NOT NULL GROUP BY ALL
), tb AS (
  SELECT venue, symbol, (at_ns - first_ns) // 3600000000000 AS idx, count(*) AS trades, sum(qty) AS volume, sum(qty * (1000 + tv)) AS notional
  FROM t, ends WHERE kind = 'trade' GROUP BY ALL
), cv AS (
  SELECT venue, symbol, idx, sum(least(hi, first_ns + (idx + 1) * 3600000000000) - greatest(lo, first_ns + idx * 3600000000000)) // 1000000 AS trusted_ms FROM (
    SELECT venue, symbol, first_ns, from_ns AS lo, coalesce(to_ns, last_ns) AS hi, unnest(range((from_ns - first_ns) // 3600000000000, (coalesce(to_ns, last_ns) - 1 - first_ns) // 3600000000000 + 1)) AS idx
    FROM sp, ends WHERE live AND coalesce(to_ns, last_ns) > from_ns) GROUP BY ALL
), fr AS (SELECT (last_ns - first_ns) // 3600000000000 AS e FROM ends), spans AS (SELECT unnest([6, 24, 168]) AS k),
rd AS (
  SELECT s.venue, s.symbol, s.venue_rank, k * 3600000 AS span_ms,
    coalesce((SELECT sum(samples) FROM sb, fr WHERE sb.venue = s.venue AND sb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1), 0)::BIGINT AS samples,
    (SELECT sum(mids) FROM sb, fr WHERE sb.venue = s.venue AND sb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS mids,
    (SELECT sum(spreads) FROM sb, fr WHERE sb.venue = s.venue AND sb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS spreads,
    (SELECT arg_min(first, idx) FROM sb, fr WHERE sb.venue = s.venue AND sb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS first,
    (SELECT arg_max(last, idx) FROM sb, fr WHERE sb.venue = s.venue AND sb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS last,
    (SELECT max(high) FROM sb, fr WHERE sb.venue = s.venue AND sb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS high,
    (SELECT min(low) FROM sb, fr WHERE sb.venue = s.venue AND sb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS low,
    (SELECT min(integrity) FROM sb, fr WHERE sb.venue = s.venue AND sb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS integrity_floor,
    coalesce((SELECT sum(trades) FROM tb, fr WHERE tb.venue = s.venue AND tb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1), 0)::BIGINT AS trades,
    (SELECT sum(volume) FROM tb, fr WHERE tb.venue = s.venue AND tb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS volume,
    (SELECT sum(notional) FROM tb, fr WHERE tb.venue = s.venue AND tb.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1) AS notional,
    coalesce((SELECT sum(trusted_ms) FROM cv, fr WHERE cv.venue = s.venue AND cv.symbol = s.symbol AND idx BETWEEN greatest(0, e - k) AND e - 1), 0)::BIGINT AS trusted_ms
  FROM st s, spans
), rf AS (
  SELECT *, trusted_ms < span_ms AS is_partial, round_even(mids / nullif(samples, 0), 8) AS mean, round_even(notional::DOUBLE / nullif(volume, 0), 8) AS vwap FROM rd
)
"""
_AUDIT = """
, ev AS (SELECT venue, symbol, side, price, arg_max(qty, at_ns) AS qty FROM lv GROUP BY ALL HAVING arg_max(qty, at_ns) > 0),
th AS (SELECT venue, symbol, side, price, CASE WHEN price % 19 = 0 THEN qty + 1 ELSE qty END AS qty FROM ev WHERE price % 17 <> 0),
bst AS (SELECT venue, symbol, side, CASE WHEN side = 'bid' THEN max(price) ELSE min(price) END AS best FROM ev GROUP BY venue, symbol, side),
a AS (SELECT * FROM (SELECT ev.*, row_number() OVER (PARTITION BY venue, symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS n FROM ev JOIN bst USING (venue, symbol, side)
      WHERE CASE side WHEN 'bid' THEN price * 1000 <= best * 999 ELSE price * 1000 >= best * 1001 END) WHERE n <= 500),
b AS (SELECT * FROM (SELECT th.*, row_number() OVER (PARTITION BY venue, symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS n FROM th JOIN bst USING (venue, symbol, side)
      WHERE CASE side WHEN 'bid' THEN price * 1000 <= best * 999 ELSE price * 1000 >= best * 1001 END) WHERE n <= 500),
rg AS (SELECT venue, symbol, side, greatest(a0, b0) AS lo, least(a1, b1) AS hi FROM (SELECT venue, symbol, side, min(price) AS a0, max(price) AS a1 FROM a GROUP BY ALL) JOIN (SELECT venue, symbol, side, min(price) AS b0, max(price) AS b1 FROM b GROUP BY ALL) USING (venue, symbol, side)),
cmp AS (SELECT venue, symbol, side, price, a.qty AS ours, b.qty AS theirs, a.qty IS DISTINCT FROM b.qty AS differs FROM a FULL JOIN b USING (venue, symbol, side, price) JOIN rg USING (venue, symbol, side) WHERE price BETWEEN lo AND hi)
"""
_EXCLUSION = "CASE WHEN NOT live THEN 'untrusted' WHEN age_ns IS NULL OR age_ns > {age} THEN 'stale' WHEN bid IS NULL AND ask IS NULL THEN 'no_quote' END"


def _cross(age: int) -> str:
    return BASE + f"""
, el AS (SELECT *, {_EXCLUSION.format(age=age)} AS exclusion FROM tp),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bid DESC, venue_rank) AS n FROM el WHERE exclusion IS NULL AND bid IS NOT NULL) WHERE n = 1),
aa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ask, venue_rank) AS n FROM el WHERE exclusion IS NULL AND ask IS NOT NULL) WHERE n = 1),
g AS (SELECT symbol, count(*) FILTER (WHERE exclusion IS NULL) AS venues_used, coalesce(string_agg(venue || ':' || exclusion, ',' ORDER BY venue_rank) FILTER (WHERE exclusion IS NOT NULL), '') AS excluded FROM el GROUP BY symbol)
SELECT symbol, bb.bid::DOUBLE AS bid, aa.ask::DOUBLE AS ask, bb.venue AS bid_venue, aa.venue AS ask_venue, venues_used, excluded,
  least(bb.integrity, aa.integrity) AS integrity_floor, greatest(bb.age_ns, aa.age_ns) // 1000000 AS oldest_leg_ms,
  (aa.ask - bb.bid)::DOUBLE AS spread, (aa.ask + bb.bid) / 2.0::DOUBLE AS mid, round_even((aa.ask - bb.bid) * 10000.0::DOUBLE / ((aa.ask + bb.bid) / 2.0::DOUBLE), 4) AS spread_bps,
  coalesce(aa.ask - bb.bid <= 0, false) AS crossed, coalesce(aa.venue = bb.venue, false) AS single_venue
FROM g LEFT JOIN bb USING (symbol) LEFT JOIN aa USING (symbol)
"""


def _windows(hours: int) -> str:
    return BASE + f"""
SELECT venue, symbol, span_ms::INTEGER AS span_ms, (span_ms // 1000) || 's' AS label, samples, trades, trusted_ms, is_partial, integrity_floor, mean::DOUBLE AS mean, first::DOUBLE AS first, last::DOUBLE AS last, high::DOUBLE AS high, low::DOUBLE AS low,
  volume::DOUBLE AS volume, vwap, round_even((last - first)::DOUBLE * 10000 / first::DOUBLE, 4) AS change_bps, round_even((high - low)::DOUBLE * 10000 / mean, 4) AS range_bps, round_even(spreads::DOUBLE * 10000 / mids::DOUBLE, 4) AS mean_spread_bps
FROM rf WHERE span_ms = {hours} * 3600000
"""


_COUNTS = """count(*) AS messages, count(*) FILTER (WHERE kind = 'snapshot') AS snapshots, count(*) FILTER (WHERE kind = 'delta') AS deltas, count(*) FILTER (WHERE kind = 'trade') AS trades,
  count(*) FILTER (WHERE kind = 'session_ended') AS session_endeds, count(*) FILTER (WHERE kind = 'delta' AND live) AS applied, count(*) FILTER (WHERE kind = 'delta' AND NOT live) AS refused"""

ORACLES = {
    "q_book_levels_asof": BASE + "SELECT venue, symbol, side, price::DOUBLE AS price, qty::DOUBLE AS qty FROM bk",
    "q_ladder_top5": BASE + "SELECT venue, symbol, side, level::INTEGER AS level, price::DOUBLE AS price, qty::DOUBLE AS qty FROM (SELECT *, row_number() OVER (PARTITION BY venue, symbol, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS level FROM bk) WHERE level <= 5",
    "q_top_of_book": BASE + "SELECT venue, symbol, live, bid::DOUBLE AS bid, ask::DOUBLE AS ask, bid_qty::DOUBLE AS bid_qty, ask_qty::DOUBLE AS ask_qty, (ask - bid)::DOUBLE AS spread, ((ask + bid) / 2.0)::DOUBLE AS mid, levels_held, age_ns FROM tp",
    "q_trust_timeline": BASE + "SELECT venue, symbol, live, from_ns, to_ns FROM sp",
    "q_desync_accounting": BASE + "SELECT venue, symbol, count(*) FILTER (WHERE NOT live) AS desyncs, coalesce(sum(coalesce(to_ns, last_ns) - from_ns) FILTER (WHERE NOT live), 0)::BIGINT AS desynced_ns, arg_max(live, from_ns) AS live, max(from_ns) AS status_since_ns FROM sp, ends GROUP BY venue, symbol",
    "q_session_ids": BASE + "SELECT venue, symbol, session_id, count(*) AS messages, count(*) FILTER (WHERE live) AS live_messages, max(epoch) AS last_epoch FROM m GROUP BY ALL",
    "q_window_buckets": BASE + "SELECT venue, symbol, idx, samples, mids::DOUBLE AS mids, spreads::DOUBLE AS spreads, first::DOUBLE AS first, last::DOUBLE AS last, high::DOUBLE AS high, low::DOUBLE AS low, integrity FROM sb",
    "q_trade_buckets": BASE + "SELECT venue, symbol, idx, trades, volume::DOUBLE AS volume, notional::DOUBLE AS notional FROM tb",
    "q_trust_coverage": BASE + "SELECT venue, symbol, idx, trusted_ms::BIGINT AS trusted_ms FROM cv",
    "q_rolling": BASE + "SELECT venue, symbol, idx, (sum(samples) OVER w)::BIGINT AS samples, round_even((sum(mids) OVER w) / nullif(sum(samples) OVER w, 0), 8)::DOUBLE AS mean, (first_value(first) OVER w)::DOUBLE AS first, (last_value(last) OVER w)::DOUBLE AS last, (max(high) OVER w)::DOUBLE AS high, (min(low) OVER w)::DOUBLE AS low FROM sb WINDOW w AS (PARTITION BY venue, symbol ORDER BY idx RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)",
    "q_trade_vwap": "WITH p AS (SELECT l_returnflag AS venue, l_linestatus AS symbol, (floor(l_extendedprice / l_quantity * 10000)::BIGINT::DECIMAL(18,0) * 0.0001)::DECIMAL(28,8) AS price, l_quantity::DECIMAL(9,2) AS qty FROM lineitem) SELECT venue, symbol, count(*) AS trades, sum(qty)::DOUBLE AS volume, sum(price * qty)::DOUBLE AS notional, round_even(sum(price * qty)::DOUBLE / sum(qty)::DOUBLE, 6) AS vwap FROM p GROUP BY ALL",
    "q_print_windows": "SELECT l_returnflag AS venue, l_linestatus AS symbol, epoch_us(l_shipdate) // 86400000000 AS day, count(*) AS trades, sum(l_quantity)::DOUBLE AS volume, max(floor(l_extendedprice / l_quantity * 10000)::BIGINT) / 10000.0::DOUBLE AS high, min(floor(l_extendedprice / l_quantity * 10000)::BIGINT) / 10000.0::DOUBLE AS low FROM lineitem GROUP BY ALL",
    "q_cross_touch": _cross(24 * 3_600_000_000_000),
    "q_cross_exclusions": BASE + f", el AS (SELECT *, {_EXCLUSION.format(age=60_000_000_000)} AS exclusion FROM tp) SELECT venue, symbol, exclusion, CASE exclusion WHEN 'untrusted' THEN 'book is not trusted' WHEN 'stale' THEN 'no update for ' || coalesce((age_ns // 1000000)::VARCHAR, '?') || 'ms' WHEN 'no_quote' THEN 'book holds no levels' END AS exclusion_text FROM el",
    "q_weakest_integrity": BASE + "SELECT symbol, min(integrity) FILTER (WHERE live) AS weakest, count(*) FILTER (WHERE live) AS live_venues FROM tp GROUP BY symbol",
    "q_cross_windows": BASE + """
, u AS (SELECT *, CASE WHEN samples = 0 AND trades = 0 THEN 'no_data' END AS reason FROM rf)
SELECT symbol, span_ms::INTEGER AS span_ms, count(*) FILTER (WHERE reason IS NULL) AS venues_used, sum(samples)::BIGINT AS samples, sum(trades)::BIGINT AS trades, max(high)::DOUBLE AS high, min(low)::DOUBLE AS low,
  round_even(sum(mean * samples) / nullif(sum(samples), 0), 8) AS mean, round_even(sum(vwap * volume) / nullif(sum(volume) FILTER (WHERE vwap IS NOT NULL), 0), 8) AS vwap, sum(volume)::DOUBLE AS volume,
  round_even((max(high) - min(low))::DOUBLE * 10000 / round_even(sum(mean * samples) / nullif(sum(samples), 0), 8), 4) AS range_bps,
  coalesce(min(trusted_ms) FILTER (WHERE reason IS NULL), 0)::BIGINT AS trusted_ms_floor, min(integrity_floor) FILTER (WHERE samples > 0) AS integrity_floor, 0::BIGINT AS max_lag_ms,
  coalesce(string_agg(venue || ':' || reason, ',' ORDER BY venue_rank) FILTER (WHERE reason IS NOT NULL), '') AS excluded FROM u GROUP BY symbol, span_ms""",
    "q_audit_levels": BASE + _AUDIT + "SELECT venue, symbol, side, price::DOUBLE AS price, ours::DOUBLE AS ours, theirs::DOUBLE AS theirs, differs FROM cmp",
    "q_audit_findings": BASE + _AUDIT + """
, f AS (SELECT venue, symbol, count(*) AS compared, count(*) FILTER (WHERE differs) AS differences FROM cmp GROUP BY ALL),
x AS (SELECT venue, symbol, string_agg(side || ':' || price, ',' ORDER BY n) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY venue, symbol ORDER BY side DESC, price) AS n FROM cmp WHERE differs) WHERE n <= 64 GROUP BY ALL)
SELECT venue, symbol, coalesce(compared, 0) AS compared, coalesce(differences, 0) AS differences, CASE WHEN differences > 0 THEN 'mismatch' WHEN coalesce(compared, 0) = 0 THEN 'inconclusive' ELSE 'match' END AS outcome, coalesce(findings, '') AS findings
FROM (SELECT DISTINCT venue, symbol FROM ev) LEFT JOIN f USING (venue, symbol) LEFT JOIN x USING (venue, symbol)""",
    "q_audit_bands": BASE + _AUDIT + ", p AS (SELECT cmp.*, abs(price - best) * 10000.0 / best AS bps FROM cmp JOIN bst USING (venue, symbol, side)) SELECT CASE WHEN bps < 1 THEN '0-1' WHEN bps < 5 THEN '1-5' WHEN bps < 10 THEN '5-10' WHEN bps < 25 THEN '10-25' ELSE '25+' END AS band, count(*) AS levels, count(*) FILTER (WHERE differs) AS disagree, round_even(count(*) FILTER (WHERE differs) * 100.0::DOUBLE / count(*), 4) AS percent FROM p GROUP BY 1",
    "q_counters": BASE + f"SELECT venue, symbol, {_COUNTS} FROM m GROUP BY venue, symbol",
    "q_counters_rollup": BASE + "SELECT symbol, venue, count(*) AS messages, count(*) FILTER (WHERE kind = 'trade') AS trades FROM t GROUP BY ROLLUP (symbol, venue)",
    "q_rates": BASE + """
, d AS (SELECT venue, symbol, (at_ns - first_ns) // 86400000000000 AS tick, count(*) AS n, count(*) FILTER (WHERE kind = 'trade') AS p FROM t, ends GROUP BY ALL),
c AS (SELECT venue, symbol, tick, (sum(n) OVER w)::BIGINT AS messages, (sum(p) OVER w)::BIGINT AS trades FROM d WINDOW w AS (PARTITION BY venue, symbol ORDER BY tick))
SELECT *, round_even(coalesce(greatest(messages - lag(messages) OVER v, 0), 0) / 86400.0::DOUBLE, 9) AS messages_per_s, round_even(coalesce(greatest(trades - lag(trades) OVER v, 0), 0) / 86400.0::DOUBLE, 9) AS trades_per_s FROM c WINDOW v AS (PARTITION BY venue, symbol ORDER BY tick)""",
    "q_metrics_long": BASE + """
SELECT venue, symbol, metric, value FROM (
  SELECT venue, symbol, 'book_best_bid' AS metric, bid::DOUBLE AS value FROM tp UNION ALL SELECT venue, symbol, 'book_best_ask', ask::DOUBLE FROM tp UNION ALL SELECT venue, symbol, 'book_spread', (ask - bid)::DOUBLE FROM tp
  UNION ALL SELECT venue, symbol, 'book_levels', levels_held::DOUBLE FROM tp UNION ALL SELECT venue, symbol, 'book_age_ns', age_ns::DOUBLE FROM tp UNION ALL SELECT venue, symbol, 'book_integrity', integrity::DOUBLE FROM tp) WHERE value IS NOT NULL""",
    "q_tick_snapshot": BASE + """
, k AS (SELECT unnest(range(1, (last_ns - first_ns) // 86400000000000 + 1)) AS seq, first_ns FROM ends), g AS (SELECT seq, first_ns + seq * 86400000000000 AS tick_ns, venue, symbol FROM k, st)
SELECT g.venue, g.symbol, seq, tick_ns, m.kind, m.epoch, m.live, tick_ns - m.at_ns AS age_ns FROM g ASOF LEFT JOIN m ON g.venue = m.venue AND g.symbol = m.symbol AND g.tick_ns >= m.at_ns""",
    "q_last_trade": BASE + "SELECT venue, symbol, 1000 + arg_max(tv, at_ns) AS price, arg_max(qty, at_ns) AS qty, (SELECT last_ns FROM ends) - max(at_ns) AS age_ns FROM t WHERE kind = 'trade' GROUP BY venue, symbol",
    "q_archive_roundtrip": BASE + "SELECT venue, symbol, kind, count(*) AS events, sum(CASE WHEN kind = 'snapshot' OR side = 'bid' THEN 1 ELSE 0 END)::BIGINT AS bids, sum(CASE WHEN kind = 'snapshot' OR side = 'ask' THEN 1 ELSE 0 END)::BIGINT AS asks, sum(event_id)::BIGINT AS seq_sum FROM t WHERE kind <> 'session_ended' GROUP BY ALL",
    "q_partition_hour": BASE + "SELECT symbol AS symbol_key, strftime(make_timestamp(at_ns // 1000), '%Y-%m-%d') AS date, extract(hour FROM make_timestamp(at_ns // 1000))::INTEGER AS hour, count(*) AS messages FROM t GROUP BY ALL",
    "q_clock_skew": BASE + ", s AS (SELECT venue, symbol, (CASE WHEN event_id % 2 = 0 THEN qty ELSE -qty END) * 1000000 AS k FROM t) SELECT venue, symbol, count(*) FILTER (WHERE k > 0) AS ahead, count(*) FILTER (WHERE k < 0) AS behind, min(k) AS least_ns, max(k) AS most_ns FROM s GROUP BY ALL",
    "q_gateway_merge": BASE + ", n AS (SELECT 'n' || (user_id % 7) AS node, max(at_ns) // 1000000 AS r FROM t GROUP BY 1), l AS (SELECT node, last_ns // 1000000 - r AS lag_ms FROM n, ends) SELECT node, lag_ms, lag_ms <= 600000 AS included, CASE WHEN lag_ms > 600000 THEN 'no snapshot for ' || lag_ms || 'ms' END AS excluded FROM l",
    "q_duplicates": BASE + ", v AS (SELECT 'n' || ((user_id // 6) % 2) AS node, venue, symbol, (any_value(last_ns) - max(at_ns)) // 1000000 AS age FROM t, ends GROUP BY 1, 2, 3) SELECT venue, symbol, count(*) AS copies, first(node ORDER BY age, node) AS winner, string_agg(node, ',' ORDER BY node) AS reporters FROM v GROUP BY ALL HAVING count(*) > 1",
    "q_live_members": BASE + ", l AS (SELECT 'u' || (user_id % 50) AS node, max(at_ns) // 1000000 AS w FROM t GROUP BY 1) SELECT node FROM l, ends WHERE last_ns // 1000000 <= w + 21600000",
    "q_gap_detect": BASE + ", g AS (SELECT *, lag(event_id) OVER (PARTITION BY venue, symbol, session_id ORDER BY at_ns) + 1 AS expected FROM m WHERE kind <> 'session_ended') SELECT event_id, venue, symbol, expected, event_id - expected AS missing FROM g WHERE event_id <> expected",
    "q_order_regressions": BASE + ", g AS (SELECT *, at_ns // 1000 - qty * 10000000 AS micros FROM m WHERE kind = 'delta'), h AS (SELECT *, max(micros) OVER (PARTITION BY venue, symbol, session_id ORDER BY at_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM g) SELECT event_id, venue, symbol, micros, latest FROM h WHERE micros <= latest",
    "q_idle_gaps": BASE + ", g AS (SELECT *, at_ns - lag(at_ns) OVER (PARTITION BY venue, symbol ORDER BY at_ns) AS idle_ns FROM t) SELECT event_id, venue, symbol, idle_ns FROM g WHERE idle_ns > 7200000000000",
    "q_sequence_missed": BASE + "SELECT event_id, venue, symbol, greatest(coalesce(event_id - lag(event_id) OVER (PARTITION BY venue, symbol ORDER BY at_ns) - 1, 0), 0) AS missed FROM t WHERE kind = 'snapshot'",
    "q_state_replay": BASE + "SELECT venue, symbol, live, bid::DOUBLE AS bid, ask::DOUBLE AS ask FROM tp",
    "q_windows_6h": _windows(6),
    "q_windows_24h": _windows(24),
    "q_windows_168h": _windows(168),
}
