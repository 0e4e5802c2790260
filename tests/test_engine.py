"""Golden values, damage to scripted streams, round trips, plans, and batch against streaming."""

import json

import pytest
from pyspark.sql import functions as F

from trustbook.functions import hashing, names, numbers
from trustbook.operators import audit, book, cross, gateway, snapshot, trust, windows
from trustbook.schemas import EVENTS, TAPE
from trustbook.sources import archive, driver, scripted, tape, venues
from trustbook.streaming import replay
from trustbook.streaming.state import Stream, digits

MS = 1_000_000


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def run(stream, payloads, kind="frame", source="web_socket", start=0):
    return [stream.step(start + i, (start + i) * MS, None, kind, source, p) for i, p in enumerate(payloads)]


# numbers, names, clocks


@pytest.mark.parametrize("text,want", [("45000.10", 45000.1), ("1e-7", 1e-7), ("", None), ("NaN", None), ("null", None)])
def test_price_text(spark, text, want):
    got = one(spark, numbers.price("t"), "t string", (text,))
    assert (float(got) if got is not None else None) == want


def test_rounding_is_half_even(spark):
    assert str(one(spark, numbers.round_dp(F.expr("cast('2.00005' as decimal(18,8))"), 4))) == "2.0000"


@pytest.mark.parametrize("text,seconds", [("2026-08-09T12:34:56Z", 1786278896), ("2026-08-09T12:34:56+01:00", 1786278896 - 3600), ("2026-08-09T12:34:60Z", 1786278899), ("2026-08-09T12:34:56", 1786278896), ("yesterday", None)])
def test_rfc3339(spark, text, seconds):
    want = None if seconds is None else seconds * 1_000_000_000
    assert one(spark, names.rfc3339_ns("t"), "t string", (text,)) == want == venues.rfc3339_ns(text)


def test_rfc3339_fraction(spark):
    t = "2026-08-09T12:34:56.1234567891Z"
    assert one(spark, names.rfc3339_ns("t"), "t string", (t,)) == 1786278896123456789 == venues.rfc3339_ns(t)


def test_names(spark):
    df = spark.createDataFrame([("BTC-USD",), ("BTC",), ("a/b",), ("..",), ("",)], "s string")
    got = df.select(names.venue_symbol("s", F.lit("kraken")), names.venue_symbol("s", F.lit("bitstamp")), names.partition_name("s")).collect()
    assert [tuple(r) for r in got] == [("BTC/USD", "btcusd", "BTC-USD"), (None, None, "BTC"), (None, None, "a_b"), (None, None, "unknown"), (None, None, "unknown")]
    assert names.parse_spans("1s,250ms,10,2m") == [1000, 250, 10_000, 120_000]
    for bad in ("0s", "x", "-1"):
        with pytest.raises(ValueError):
            names.parse_spans(bad)
    with pytest.raises(ValueError):
        names.parse_symbols("BTC-USD,BTC-USD")
    assert names.parse_venues("kraken,coinbase") == ["coinbase", "kraken"]


def test_rendezvous_weights(spark):
    assert [hashing.weight(n, "coinbase", "BTC-USD") for n in "ab"] == [658005282954361, 4719291369574919490]
    streams = spark.createDataFrame([("coinbase", "BTC-USD"), ("kraken", "ETH-USD")], "venue string, symbol string")
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    got = {(r[0], r[1]): r[2] for r in gateway.owners(streams, nodes).collect()}
    assert got == {(v, s): max("ab", key=lambda n: hashing.weight(n, v, s)) for v, s in got}
    assert {r["owner"] for r in gateway.owners(streams, nodes.limit(0)).collect()} == {None}


# venues and the state operator

def kraken(kind, bids, asks, crc):
    lv = lambda xs: "[" + ",".join(f'{{"price":{p},"qty":{q}}}' for p, q in xs) + "]"
    return f'{{"channel":"book","type":"{kind}","data":[{{"symbol":"BTC/USD","bids":{lv(bids)},"asks":{lv(asks)},"checksum":{crc}}}]}}'


OPENING = kraken("snapshot", [("60000.00", "1.20000000"), ("59950.00", "0.50000000")], [("60010.00", "0.75000000"), ("60020.00", "2.00000000")], 1205813205)


def test_checksum_of_exact_digits():
    assert [digits(x) for x in ("0.00100000", "60000.00", "0", "0.0")] == ["100000", "6000000", "0", "0"]
    s = Stream("kraken", "BTC-USD")
    rows = run(s, [OPENING, kraken("update", [("60000.00", "0.90000000")], [("60010.00", "0.00000000")], 994251236)])
    assert [(r["status"], r["integrity"], r["last_verified_ns"]) for r in rows] == [("live", 2, 0), ("live", 2, MS)]
    assert rows[-1]["best_bid"] == "60000.00" and rows[-1]["best_ask"] == "60020.00"
    assert [e[0] for e in rows[0]["events"]] == ["snapshot"] * 4 + ["checksum"]


def test_bad_checksum_desyncs_and_asks_for_a_new_stream():
    s = Stream("kraken", "BTC-USD")
    last = run(s, [OPENING, kraken("update", [("60000.00", "0.90000000")], [("60010.00", "0.00000000")], 1)])[-1]
    assert (last["status"], last["reason"], last["resync"]) == ("desynced", "checksum_mismatch", True)
    after = run(s, [kraken("update", [("1.00", "1.0")], [], 5)], start=2)[0]
    assert after["status"] == "desynced" and [e[0] for e in after["events"]] == ["checksum"] and not after["resync"]


def coinbase(seq, kind="update", updates=(), channel="l2_data", product="BTC-USD"):
    return json.dumps({"channel": channel, "sequence_num": seq, "timestamp": "2026-08-09T12:34:56Z", "events": [{"type": kind, "product_id": product, "updates": [{"side": s, "price_level": p, "new_quantity": q} for s, p, q in updates]}]})


def test_coinbase_gap_discards_the_frame_and_moves_on():
    s = Stream("coinbase", "BTC-USD")
    rows = run(s, [coinbase(0, "snapshot", [("bid", "100", "1"), ("offer", "101", "2")]), coinbase(1, updates=[("bid", "99", "3")]), coinbase(3, updates=[("bid", "98", "1")]), coinbase(4, "snapshot", [("bid", "100", "1"), ("ask", "101", "2")]), coinbase(5, product="ETH-USD", updates=[("bid", "1", "1")])])
    assert [r["status"] for r in rows] == ["live", "live", "desynced", "live", "live"]
    assert rows[2]["reason_detail"] == "sequence gap: expected 2, got 3" and rows[2]["levels_held"] == 3
    assert rows[0]["venue_ts_ns"] == 1786278896 * 1_000_000_000 and rows[4]["levels_held"] == 2


def bitstamp(micros, bids=(), asks=(), channel="diff_order_book_btcusd"):
    return json.dumps({"event": "data", "channel": channel, "data": {"microtimestamp": str(micros), "bids": list(bids), "asks": list(asks)}})


def test_bitstamp_splice():
    s = Stream("bitstamp", "BTC-USD")
    rows = run(s, [bitstamp(10, [["90", "1"]]), bitstamp(30, [["99", "5"]])])
    assert [(r["status"], r["reason"], r["resync"]) for r in rows] == [("desynced", "awaiting_snapshot", False)] * 2
    rest = json.dumps({"microtimestamp": "20", "bids": [["100", "1"]], "asks": [["101", "1"]]})
    spliced = run(s, [rest], source="rest_snapshot", start=2)[0]
    assert spliced["status"] == "live" and [b[0] for b in spliced["bids"]] == ["100", "99"]
    rows = run(s, [bitstamp(20, [["1", "1"]]), bitstamp(31, [["98", "1"]]), bitstamp(31, [["97", "1"]]), bitstamp(40, channel="other")], start=3)
    assert [r["status"] for r in rows] == ["live", "live", "desynced", "desynced"]
    assert rows[2]["reason"] == "timestamp_regression" and rows[3]["parse_error"]


def test_crossed_book_and_equality():
    for p in ("101", "105"):
        s = Stream("coinbase", "BTC-USD")
        last = run(s, [coinbase(0, "snapshot", [("bid", "100", "1"), ("ask", "101", "1")]), coinbase(1, updates=[("bid", p, "1")])])[-1]
        assert last["reason"] == "crossed_book" and last["events"]
    s = Stream("coinbase", "BTC-USD")
    assert run(s, [coinbase(0, "snapshot", [("bid", "100", "1")])])[0]["status"] == "live"


def test_session_end_keeps_the_book_but_not_the_trust():
    s = Stream("coinbase", "BTC-USD")
    run(s, [coinbase(7, "snapshot", [("bid", "100", "1"), ("ask", "101", "1")])])
    end = s.step(1, MS, None, "session_ended", None, None)
    assert (end["status"], end["reason"], end["levels_held"], end["resync"]) == ("desynced", "connection_lost", 2, False)
    assert run(s, [coinbase(0, "snapshot", [("bid", "100", "1")])], start=2)[0]["status"] == "live"


def test_parse_errors_change_nothing():
    s = Stream("coinbase", "BTC-USD")
    run(s, [coinbase(0, "snapshot", [("bid", "100", "1")])])
    rows = run(s, ["nonsense", '{"channel":"l2_data"}', coinbase(1, updates=[("bid", "abc", "1")]), coinbase(1, updates=[("bid", "5", "-1")])], start=1)
    assert all(r["parse_error"] and r["status"] == "live" and r["levels_held"] == 1 for r in rows)


def script():
    s = scripted.Script().snapshot([("100", "1"), ("99", "2")], [("101", "1"), ("102", "3")]).checkpoint()
    for i in range(6):
        s.delta([(f"{98 - i}", f"{i + 1}")], [(f"{103 + i}", f"{2 * i + 1}")]).checkpoint()
    return s.out


DELTAS = [2, 4, 6]


@pytest.mark.parametrize("damage", ["none", "drop", "duplicate", "swap", "truncate"])
@pytest.mark.parametrize("integrity", [0, 1, 2])
def test_damage(damage, integrity):
    m = [x for x in script() if integrity == 2 or '"checksum"' not in x]
    at = 4 if integrity == 2 else 3
    m = {"none": lambda: m, "drop": lambda: scripted.drop(m, at), "duplicate": lambda: scripted.duplicate(m, at), "swap": lambda: scripted.swap(m, at, at + (2 if integrity == 2 else 1)), "truncate": lambda: scripted.truncate(m, at)}[damage]()
    s = Stream("fake", "A-B", integrity=integrity)
    rows = run(s, m)
    reasons = {r["reason"] for r in rows}
    if damage in ("none", "truncate"):
        assert rows[-1]["status"] == "live" and (integrity < 2 or rows[-1]["last_verified_ns"] is not None)
    elif integrity == 1:
        assert "sequence_gap" in reasons
    elif integrity == 0:
        assert ("timestamp_regression" in reasons) == (damage != "drop")  # a loss is not noticed
    else:
        assert ("checksum_mismatch" in reasons) == (damage != "duplicate")


# native books and trust


def driver_like(spark, rows):
    cols = "event_id long, user_id long, at_ns long, venue string, venue_rank int, integrity int, symbol string, kind string, side string, tv long, qty long"
    return spark.createDataFrame([(i, 0, at * MS, "v0", 0, 1, "S0", kind, side, tv, qty) for i, (at, kind, side, tv, qty) in enumerate(rows)], cols)


def priced(rows, width):
    return driver.priced(trust.with_epochs(rows, width))


def test_native_book_refuses_deltas_without_trust(spark):
    m = priced(driver_like(spark, [(1, "delta", "bid", 5, 9), (2, "snapshot", None, 1, 4), (3, "delta", "bid", 0, 7), (4, "session_ended", None, 0, 0), (5, "delta", "ask", 0, 7)]), 2 * MS)
    state = book.current_epoch(m)
    held = book.book_asof(book.applied_levels(m), state)
    assert {(r["side"], int(r["price"]), int(r["qty"])) for r in held.collect()} == {("bid", 998, 4), ("bid", 999, 7), ("ask", 1002, 4)}
    top = book.top_of_book(book.held_asof(book.applied_levels(m), state), state, F.lit(6 * MS)).first()
    assert (int(top["bid"]), int(top["ask"]), top["live"], top["age_ns"]) == (999, 1002, False, 3 * MS)


def test_touch_timeline_of_one_long_epoch(spark):
    """200,000 messages between two snapshots: against a sweep with a sorted book, and in seconds."""
    import random
    import time
    from bisect import bisect_left, insort

    random.seed(3)
    rows = [("snapshot", None, 5, 1)] + [("delta", random.choice(("bid", "ask")), random.randrange(400), random.randrange(3)) for _ in range(200_000)]
    cols = "event_id int, user_id int, at_ns long, venue string, venue_rank int, integrity int, symbol string, kind string, side string, tv long, qty long"
    df = spark.createDataFrame([(i, 0, i * MS, "v0", 0, 1, "S0", *r) for i, r in enumerate(rows)], cols)
    began = time.monotonic()
    m = priced(df, 10_000 * MS)
    got = {r["at_ns"]: (r["bid"], r["ask"]) for r in book.touch_timeline(m, book.applied_levels(m)).where("seq % 97 = 0 OR seq > 199900").select("at_ns", F.col("bid").cast("long").alias("bid"), F.col("ask").cast("long").alias("ask")).collect()}
    assert time.monotonic() - began < 60
    held, want = {"bid": [], "ask": []}, {}
    for i, (kind, side, tv, qty) in enumerate(rows):
        for s in ("bid", "ask") if kind == "snapshot" else (side,):
            p = 999 - tv if s == "bid" else 1001 + tv
            at = bisect_left(held[s], p)
            there = at < len(held[s]) and held[s][at] == p
            if qty and not there:
                insort(held[s], p)
            elif not qty and there:
                held[s].pop(at)
        if i % 97 == 0 or i > 199_900:
            want[i * MS] = (held["bid"][-1] if held["bid"] else None, held["ask"][0] if held["ask"] else None)
    assert got == want


def test_neighbours_cross_slices(spark):
    df = spark.createDataFrame([("v", "s", 0, t, t * t % 7) for t in (1, 5, 9, 10, 11, 30, 31)], "venue string, symbol string, session_id long, at_ns long, x long")
    for width in (1, 10, 1000):
        before = [r["b"] for r in trust.neighbour(df, "x", "at_ns", "b", slice_ns=width).orderBy("at_ns").collect()]
        after = [r["b"] for r in trust.neighbour(df, "x", "at_ns", "b", after=True, slice_ns=width).orderBy("at_ns").collect()]
        most = [r["b"] for r in trust.running(df, F.col("x"), "at_ns", "b", F.max, own=False, slice_ns=width).orderBy("at_ns").collect()]
        total = [r["b"] for r in trust.running(df, F.col("x"), "at_ns", "b", F.sum, slice_ns=width).orderBy("at_ns").collect()]
        x = [t * t % 7 for t in (1, 5, 9, 10, 11, 30, 31)]
        assert before == [None, *x[:-1]] and after == [*x[1:], None]
        assert most == [None, *(max(x[:i]) for i in range(1, 7))] and total == [sum(x[: i + 1]) for i in range(7)]


def test_touch_timeline_follows_the_state_operator(spark):
    import random

    random.seed(8)
    rows = [(i + 1, *random.choice([("snapshot", None), ("delta", "bid"), ("delta", "ask"), ("trade", None), ("session_ended", None)]), random.randrange(8), random.randrange(4)) for i in range(300)]
    m = priced(driver_like(spark, rows), 50 * MS)
    got = {r["at_ns"]: (r["bid"], r["ask"]) for r in book.touch_timeline(m, book.applied_levels(m)).collect()}
    s, want = Stream("v0", "S0", scripted=True), {}
    for at, kind, side, tv, qty in rows:
        if kind == "session_ended":
            r = s.step(at, at * MS, None, kind, None, None)
        else:
            bid, ask = [[str(999 - tv), str(qty)]], [[str(1001 + tv), str(qty)]]
            action = {"snapshot": ["snapshot", bid, ask], "trade": ["trade", "1", "1", None]}.get(kind) or ["delta", bid if side == "bid" else [], ask if side == "ask" else []]
            r = s.step(at, at * MS, None, "event", None, json.dumps({"action": action}))
        if r["status"] == "live":
            want[at * MS] = (r["best_bid"], r["best_ask"])
    assert {k: tuple(None if x is None else str(int(x)) for x in v) for k, v in got.items()} == want


# windows

SPEC = windows.WindowSpec(250, (1000,))


def reading(spark, samples=(), trades=(), status=(), at=500, spec=SPEC):
    s = spark.createDataFrame([("v", "S", a * MS, float(m), float(sp), 1) for a, m, sp in samples], "venue string, symbol string, at_ns long, mid double, spread double, integrity int").withColumn("mid", F.col("mid").cast("decimal(18,8)")).withColumn("spread", F.col("spread").cast("decimal(18,8)"))
    t = spark.createDataFrame([("v", "S", a * MS, float(p), float(q)) for a, p, q in trades], "venue string, symbol string, at_ns long, price double, qty double").withColumn("price", F.col("price").cast("decimal(18,8)")).withColumn("qty", F.col("qty").cast("decimal(18,8)"))
    st = spark.createDataFrame([("v", "S", a * MS, None if b is None else b * MS, x) for a, b, x in status], "venue string, symbol string, from_ns long, to_ns long, live boolean")
    o, res = F.lit(0), spec.resolution_ns
    streams = spark.createDataFrame([("v", "S")], "venue string, symbol string")
    return windows.readings(windows.sample_buckets(s, o, res), windows.trade_buckets(t, o, res), windows.trusted_buckets(st, o, F.lit(at * MS), res), streams, spec, F.lit(at * MS // res)).first()


def test_window_vwap(spark):
    r = reading(spark, trades=[(0, 100, 2), (0, 130, 1)])
    assert (r["trades"], float(r["volume"]), float(r["vwap"]), r["mean"], r["samples"]) == (2, 3, 110, None, 0)


def test_window_extremes_and_change(spark):
    r = reading(spark, samples=[(0, 101, 1), (1, 111, 1), (2, 101, 1)], at=300)
    assert (r["samples"], float(r["high"]), float(r["low"]), float(r["change_bps"])) == (3, 111, 101, 0)
    r = reading(spark, samples=[(0, 1000, 2), (300, 990, 2)], at=600)
    assert (float(r["change_bps"]), float(r["range_bps"])) == (-100, 100.5025)
    assert float(reading(spark, samples=[(0, 1000, 2), (1, 1000, 2)])["mean_spread_bps"]) == 20


def test_window_coverage(spark):
    r = reading(spark, samples=[(0, 100, 1)], status=[(0, 500, True), (500, None, False)], at=1000)
    assert (r["span_ms"], r["trusted_ms"], r["samples"], r["is_partial"]) == (1000, 500, 1, True)
    r = reading(spark, samples=[(0, 100, 1)], status=[(0, None, True)], at=2000)
    assert (r["trusted_ms"], r["samples"], r["high"], r["is_partial"]) == (1000, 0, None, False)
    assert reading(spark, status=[(0, None, True)], at=500)["trusted_ms"] == 500
    assert reading(spark, status=[(0, None, True)], at=3_600_000)["trusted_ms"] == 1000
    r = reading(spark, trades=[(0, 1, 1)], status=[(0, None, False)])
    assert (r["trades"], r["trusted_ms"], r["high"]) == (1, 0, None)
    assert reading(spark, at=500, spec=windows.WindowSpec(250, (10,)))["span_ms"] == 250


# across venues


def top(spark, rows):
    cols = "venue string, venue_rank int, symbol string, live boolean, integrity int, bid decimal(18,8), ask decimal(18,8), age_ns long"
    from decimal import Decimal

    return spark.createDataFrame([(f"v{i}", i, "S", live, i, None if b is None else Decimal(b), None if a is None else Decimal(a), None if age is None else age * MS) for i, (b, a, live, age) in enumerate(rows)], cols)


def test_cross_touch(spark):
    r = cross.cross_touch(top(spark, [("100", "102", True, 40), ("101", "103", True, 900), ("99", "101", True, 10)])).first()
    assert (float(r["bid"]), r["bid_venue"], float(r["ask"]), r["ask_venue"], float(r["spread"]), r["crossed"], r["oldest_leg_ms"]) == (101, "v1", 101, "v2", 0, True, 900)
    r = cross.cross_touch(top(spark, [("10010", "10020", True, 1), ("9990", "10000", True, 1)])).first()
    assert (float(r["spread"]), float(r["spread_bps"]), r["crossed"]) == (-10, -9.995, True)
    r = cross.cross_touch(top(spark, [("100", "101", True, 1), ("100", "101", True, 1)])).first()
    assert (r["bid_venue"], r["ask_venue"], r["single_venue"]) == ("v0", "v0", True)


def test_cross_exclusions(spark):
    r = cross.cross_touch(top(spark, [("99999", "100000", False, 1), ("100", "102", True, 5000), (None, None, True, 1), ("5", "6", True, None), ("7", None, True, 2000)])).first()
    assert [(x["venue"], x["reason"]) for x in r["excluded"]] == [("v0", "untrusted"), ("v1", "stale"), ("v2", "no_quote"), ("v3", "stale")]
    assert r["excluded"][1]["text"] == "no update for 5000ms"
    assert (float(r["bid"]), r["ask"], r["spread"], r["crossed"], r["venues_used"]) == (7, None, None, False, 1)


def test_cross_windows(spark):
    cols = "venue string, symbol string, span_ms long, samples long, trades long, mean decimal(38,8), high decimal(18,8), low decimal(18,8), volume decimal(28,8), vwap decimal(38,8), trusted_ms long, integrity_floor int, lag long"
    from decimal import Decimal as D

    r = spark.createDataFrame([("a", "S", 1000, 100, 0, D(100), D(110), D(90), None, None, 60000, 2, 0), ("b", "S", 1000, 300, 0, D(104), D(120), D(95), None, None, 40000, 1, 700), ("c", "S", 1000, 0, 0, None, None, None, None, None, 0, None, 900), ("a", "S", 2000, 0, 2, None, None, None, D(2), D(100), 10, None, 0), ("b", "S", 2000, 0, 1, None, None, None, D(1), D(106), 20, None, 0)], cols)
    streams = spark.createDataFrame([("a", 0, "S"), ("b", 1, "S"), ("c", 2, "S")], "venue string, venue_rank int, symbol string")
    a, b = cross.cross_windows(r, streams, F.col("lag")).orderBy("span_ms").collect()
    assert (float(a["mean"]), float(a["high"]), float(a["low"]), a["samples"], a["trusted_ms_floor"], a["integrity_floor"], a["max_lag_ms"]) == (103, 120, 90, 400, 40000, 1, 700)
    assert [(x["venue"], x["reason"]) for x in a["excluded"]] == [("c", "no_data")]
    assert (float(b["vwap"]), float(b["volume"]), b["mean"], b["trusted_ms_floor"]) == (102, 3, None, 10)
    assert [(x["venue"], x["reason"]) for x in b["excluded"]] == [("c", "span_not_published")]


# audits


def ladder_rows(spark, n=10, changes=()):
    rows = [("v", "S", "bid", 1000 - i, 1) for i in range(n)] + [("v", "S", "ask", 1001 + i, 1) for i in range(n)]
    rows = {(r[2], r[3]): r for r in rows}
    for side, price, qty in changes:
        rows[side, price] = ("v", "S", side, price, qty)
    return spark.createDataFrame(list(rows.values()), "venue string, symbol string, side string, price int, qty int").withColumn("price", F.col("price").cast("decimal(18,8)")).withColumn("qty", F.col("qty").cast("decimal(18,8)"))


def test_audit_finds_beyond_the_guard(spark):
    ours = ladder_rows(spark)
    out = audit.outcomes(audit.compared(ours, ladder_rows(spark, changes=[("bid", 996, 7)]), 20), ours).first()
    assert out["outcome"] == "mismatch" and [(f["side"], int(f["price"]), int(f["ours"]), int(f["theirs"])) for f in out["findings"]] == [("bid", 996, 1, 7)]
    out = audit.outcomes(audit.compared(ours, ladder_rows(spark, changes=[("bid", 1000, 7), ("bid", 999, 7)]), 20), ours).first()
    assert out["outcome"] == "match" and out["compared"] > 0
    few = ladder_rows(spark, 2)
    assert audit.outcomes(audit.compared(few, few, 20), few).first()["outcome"] == "inconclusive"


@pytest.mark.parametrize("history,want", [([("mismatch", [996]), ("mismatch", [996, 997])], (2, 2, 996)), ([("mismatch", [i]) for i in range(6)], (6, 1, None)), ([("mismatch", [1005]), ("inconclusive", []), ("mismatch", [1005])], (2, 2, 1005)), ([("mismatch", [5]), ("match", []), ("mismatch", [5])], (2, 1, None))])
def test_audit_trail(spark, history, want):
    df = spark.createDataFrame([("v", "S", i, o, p) for i, (o, p) in enumerate(history)], "venue string, symbol string, at_ns long, outcome string, prices array<int>")
    r = audit.trail(df).first()
    assert (r["mismatches"], r["streak"], None if r["desync_price"] is None else int(r["desync_price"])) == want


def test_audit_in_the_state_operator_needs_two_in_a_row():
    s = Stream("coinbase", "BTC-USD", guard_bps=20)
    run(s, [coinbase(0, "snapshot", [("bid", str(1000 - i), "1") for i in range(10)] + [("ask", str(1001 + i), "1") for i in range(10)])])
    rest = json.dumps({"pricebook": {"bids": [{"price": str(1000 - i), "size": "7" if i == 4 else "1"} for i in range(10)], "asks": [{"price": str(1001 + i), "size": "1"} for i in range(10)]}})
    rows = run(s, [rest, rest], source="rest_audit", start=1)
    assert [(r["audit"], r["status"], r["audit_desync"]) for r in rows] == [("mismatch", "live", None), ("mismatch", "desynced", "996")]


# archive, tape, replay


def sample_events(spark):
    rows = []
    for i in range(40):
        wall = 1_700_000_000_000_000_000 + i * 400 * 1_000_000_000
        sym = "BTC/USD" if i % 2 else "ETH-USD"
        base = lambda kind, **k: tuple({"event_seq": i, "venue": "kraken", "symbol": sym, "kind": kind, "ingest_wall_unix_nanos": wall, "ingest_elapsed_nanos": i * 400 * 1_000_000_000, **k}.get(f.name) for f in EVENTS.fields)  # noqa: B023, E731
        kind = i % 5
        if kind == 0:
            rows += [base("snapshot", side=s, price=p, qty="0.00100000", level_index=n) for s, n, p in (("bid", 0, "9.10"), ("bid", 1, "9.0"), ("ask", 0, "9.20"))]
        elif kind == 1:
            rows.append(base("delta"))
        elif kind == 2:
            rows.append(base("trade", price="9.15", qty="2.0", taker_side="bid"))
        elif kind == 3:
            rows.append(base("checksum", checksum=4_000_000_000))
        else:
            rows.append(base("heartbeat"))
    return spark.createDataFrame(rows, EVENTS)


def test_archive_round_trip(spark, tmp_path):
    e = sample_events(spark)
    archive.write(e, str(tmp_path / "x"), splits=2)
    back = archive.read(spark, [str(tmp_path / "x"), str(tmp_path / "x") + "/"])
    assert back.drop("file", "run").exceptAll(e).count() == 0 and back.count() == e.count()
    again = archive.flatten(archive.assemble(back)).select(*(f.name for f in EVENTS.fields))
    assert again.exceptAll(e).count() == 0 and again.count() == e.count()
    one_symbol = archive.read(spark, [str(tmp_path / "x")], symbols=["BTC_USD"])
    assert {r["symbol"] for r in one_symbol.select("symbol").distinct().collect()} == {"BTC/USD"}
    two = archive.timeline(back, 2).agg(F.min("at_ns"), F.max("at_ns")).first()
    assert tuple(two) == (0, 39 * 400 * 1_000_000_000)
    bad = back.withColumn("kind", F.when(F.col("event_seq") == 2, "riddle").otherwise(F.col("kind")))
    assert archive.quarantine(bad).count() == 1


def test_archive_events_survive_files_that_roll(spark, tmp_path):
    e = sample_events(spark)
    archive.write(e, str(tmp_path / "x"), max_records=2)
    back = archive.read(spark, [str(tmp_path / "x")])
    assert back.select("file").distinct().count() > back.count() // 3
    assert archive.assemble(back).count() == e.select("event_seq").distinct().count()
    assert archive.flatten(archive.assemble(back)).select(*(f.name for f in EVENTS.fields)).exceptAll(e).count() == 0


def test_archive_refuses_what_it_does_not_know(spark, tmp_path):
    e = sample_events(spark)
    archive.write(e, str(tmp_path / "x"))
    back = archive.read(spark, [str(tmp_path / "x")])
    venue = back.first()["venue"]
    assert archive.assemble(back, (venue,), strict=True).count() == archive.assemble(back).count()
    assert archive.assemble(back, ("elsewhere",)).count() == 0 and archive.quarantine(back, ("elsewhere",)).count() == back.count()
    with pytest.raises(Exception, match="unknown venue"):
        archive.assemble(back, ("elsewhere",), strict=True).collect()
    with pytest.raises(ValueError, match="unknown venue"):
        venues.adapter("elsewhere", "A-B")


def test_archive_reads_either_layout_by_path(spark, tmp_path):
    e = sample_events(spark)
    archive.write(e, str(tmp_path / "x"))
    (tmp_path / "x" / "symbol_key=BTC_USD").rename(tmp_path / "x" / "symbol=BTC_USD")
    assert archive.read(spark, [str(tmp_path / "x")], symbols=["BTC_USD"]).count() == e.where("symbol = 'BTC/USD'").count()


def test_runs_merge_on_the_wall_clock(spark, tmp_path):
    """Two runs with offsets of their own; the second one's clock steps back once."""
    e = sample_events(spark).where("event_seq < 8")
    later = e.withColumns({"ingest_wall_unix_nanos": F.col("ingest_wall_unix_nanos") + 10**15 - F.when(F.col("event_seq") == 5, 10**14).otherwise(0)})
    archive.write(e, str(tmp_path / "a"))
    archive.write(later, str(tmp_path / "b"))
    merged = archive.timeline(archive.read(spark, [str(tmp_path / "a"), str(tmp_path / "b")]), 2)
    rows = merged.select("run", "event_seq", "at_ns").distinct().orderBy("at_ns", "event_seq").collect()
    assert len({r["run"] for r in rows[:8]}) == 1 and len({r["run"] for r in rows[8:]}) == 1
    second = sorted((r["event_seq"], r["at_ns"]) for r in rows[8:])
    assert second[5][1] == second[4][1] and all(a[1] <= b[1] for a, b in zip(second, second[1:], strict=False))
    m = replay.from_events(None, merged, at="at_ns")
    assert m.count() == 16 and m.agg(F.max("elapsed_ns")).first()[0] == rows[-1]["at_ns"]


def frames(spark):
    m = [coinbase(0, "snapshot", [("bid", "100", "1"), ("ask", "101", "2")]), coinbase(1, updates=[("bid", "99", "3")]), coinbase(3, updates=[("bid", "98", "1")]), None, coinbase(0, "snapshot", [("bid", "100", "1")])]
    rows = [("coinbase", "BTC-USD", i * MS, i, p or "", "web_socket", "frame" if p else "session_ended") for i, p in enumerate(m)]
    rows += [("kraken", "BTC-USD", i * MS + 1, i, p, "web_socket", "frame") for i, p in enumerate([OPENING, "junk"])]
    return spark.createDataFrame(rows, TAPE)


def test_tape_replay_is_deterministic_and_equals_the_stream(spark, tmp_path):
    tape.write(frames(spark), str(tmp_path / "tape"))
    m = replay.from_frames(tape.read(spark, str(tmp_path / "tape")))
    flat = lambda df: sorted(tuple(r) for r in df.select("venue", "symbol", "elapsed_ns", "status", "reason", "best_bid", "best_ask", "levels_held").fillna("-").collect())
    a, b = flat(replay.replay(m)), flat(replay.replay(m))
    assert a == b and len(a) == 7
    assert [x[3] for x in a if x[0] == "coinbase"] == ["live", "live", "desynced", "desynced", "live"]
    live = replay.from_frames(tape.follow(spark, str(tmp_path / "tape")))
    q = replay.write_timeline(replay.follow(live), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert flat(spark.read.parquet(str(tmp_path / "out"))) == a


def test_stream_state_survives_a_restart():
    s = Stream("bitstamp", "BTC-USD")
    run(s, [bitstamp(10, [["90", "1"]]), bitstamp(30, [["99", "5"]])])
    t = Stream.restore(s.dump())
    rest = json.dumps({"microtimestamp": "20", "bids": [["100", "1"]], "asks": [["101", "1"]]})
    assert run(s, [rest], source="rest_snapshot", start=2) == run(t, [rest], source="rest_snapshot", start=2)


def test_fallback_symbol_and_malformed_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"venue":"kraken","elapsed_nanos":1,"recorded_wall_unix_nanos":2,"payload":"x"}\n\n')
    r = tape.read(spark, str(tmp_path / "t.json"), "BTC-USD").first()
    assert (r["symbol"], r["source"], r["kind"]) == ("BTC-USD", "web_socket", "frame")
    (tmp_path / "u.json").write_text("{nonsense\n")
    with pytest.raises(Exception):
        tape.read(spark, str(tmp_path / "u.json")).collect()


# gateway, snapshot


def test_gateway(spark):
    n = gateway.nodes(spark.createDataFrame([("a", 1000), ("b", 3999), ("c", None), ("d", 900)], "node string, received_ms long"), F.lit(4000)).collect()
    assert [(r["included"], r["excluded"]) for r in n] == [(True, None), (True, None), (False, "no snapshot received yet"), (False, "no snapshot for 3100ms")]
    v = spark.createDataFrame([("b", "v", "S", 5), ("a", "v", "S", 5), ("c", "v", "S", None), ("a", "w", "S", 1)], "node string, venue string, symbol string, age_ms long")
    d = gateway.duplicates(v).collect()
    assert [(r["venue"], r["copies"], r["winner"], r["reporters"]) for r in d] == [("v", 3, "a", ["a", "b", "c"])]
    assert gateway.aged(v.withColumn("lag_ms", F.lit(10))).where("node = 'c'").first()["age_ms"] == 10
    b = [r["ceiling_ms"] for r in gateway.backoff(spark, 100, 1000, 6).collect()]
    assert b == [100, 200, 400, 800, 1000, 1000]
    ok = spark.createDataFrame([("n", t, t < 30_000) for t in range(0, 60_000, 3_000)], "node string, at_ms long, ok boolean")
    s = {r["at_ms"]: (r["holds"], r["settled"]) for r in gateway.lease_states(ok).collect()}
    assert s[0] == (True, False) and s[18_000] == (True, True) and s[39_000] == (True, True) and s[42_000] == (False, False)


def test_rates_and_metrics(spark):
    df = spark.createDataFrame([("v", "S", 1, 100, 2), ("v", "S", 2, 160, 8), ("v", "S", 3, 10, 8)], "venue string, symbol string, tick long, frames long, dropped long")
    out = [(r["frames_per_s"], r["dropped_per_s"]) for r in snapshot.rates(df, ("frames", "dropped"), 2.0).orderBy("tick").collect()]
    assert out == [(0.0, 0.0), (30.0, 3.0), (0.0, 0.0)]
    rows = snapshot.metric_rows(df.withColumn("dropped", F.when(F.col("tick") == 1, F.col("dropped"))), {"frames": "f", "dropped": "d"})
    assert rows.count() == 4
    assert 'f{venue="v",symbol="S"} 100.0' in {r["line"] for r in snapshot.exposition(rows).collect()}
    j = json.loads(snapshot.wire(spark.createDataFrame([(1,)], "a int").withColumn("p", F.expr("cast('1.50' as decimal(18,2))"))).first()["json"])
    assert j == {"a": 1, "p": "1.50", "clock": "ingest_monotonic"}


# plans


def test_plans_have_no_nested_loops_and_prune_columns(spark):
    import re

    from trustbook.plans.queries import QUERIES

    for name in ("q_cross_touch", "q_windows_24h", "q_tick_snapshot", "q_audit_findings"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan), name
        assert all("props" not in s or "value" in s for s in re.findall(r"ReadSchema: (\S+)", plan))


def test_attempts_start_anew_after_a_long_session(spark):
    df = spark.createDataFrame([("n", t, d) for t, d in ((1, 5), (2, 29_999), (3, 30_000), (9_000_000, 1), (9_000_001, 2), (9_000_002, 60_000))], "node string, at_ms long, lasted_ms long")
    assert [r["attempt"] for r in gateway.attempts(df).orderBy("at_ms").collect()] == [1, 2, 0, 1, 2, 0]


def test_a_node_that_renews_in_time_settles(spark):
    times = gateway.renewals(spark.createDataFrame([("n",)], "node string"), 0, 30_000)
    out = gateway.lease_states(times.withColumn("ok", F.col("at_ms") != 9_000)).orderBy("at_ms").collect()
    assert [r["at_ms"] for r in out] == list(range(0, 30_001, 3_000))
    assert all(r["holds"] for r in out) and [r["at_ms"] for r in out if r["settled"]] == [18_000, 21_000, 24_000, 27_000, 30_000]


def test_the_gateway_takes_each_stream_from_the_freshest_node(spark):
    views = spark.createDataFrame([("a", "v", "s", 5_000_000, 1), ("b", "v", "s", 4_000_000, 2), ("a", "w", "s", 7_000_000, 3), ("c", "v", "s", 0, 4)], "node string, venue string, symbol string, age_ns long, bid int")
    reports = spark.createDataFrame([("a", 1000), ("b", 997), ("c", 10), ("d", None)], "node string, received_ms long")
    got = {(r["venue"], r["node"], r["bid"], r["age_ns"], r["lag_ms"]) for r in gateway.consolidated(views, reports, F.lit(1000), 100).collect()}
    assert got == {("v", "a", 1, 5_000_000, 0), ("w", "a", 3, 7_000_000, 0)}
