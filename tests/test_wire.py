"""Native parsing against the state operator's adapters, published snapshots, feeds and streaming buckets."""

import json

from pyspark.sql import functions as F

from trustbook.functions import wire
from trustbook.operators import snapshot
from trustbook.schemas import TAPE
from trustbook.sources import feed, venues
from trustbook.streaming import tumbling

from .test_engine import OPENING, bitstamp, coinbase, top


def tape(spark, rows):
    return spark.createDataFrame([(v, "BTC-USD", i, i, p, s, "frame") for i, (v, p, s) in enumerate(rows)], TAPE)


def test_levels_equal_the_adapters(spark):
    c = [coinbase(0, "snapshot", [("bid", "100.10", "1"), ("offer", "101", "2")]), coinbase(1, updates=[("bid", "99", "0")]), coinbase(2, product="ETH-USD", updates=[("bid", "1", "1")])]
    got = wire.coinbase_levels(tape(spark, [("coinbase", p, "web_socket") for p in c])).orderBy("elapsed_nanos", "level_index").collect()
    want, a = [], venues.Coinbase("BTC-USD")
    for p in c:
        for kind, bids, asks in a.parse(p)[0]:
            want += [(kind, "bid", *x) for x in bids] + [(kind, "ask", *x) for x in asks]
    assert [("snapshot" if r["type"] == "snapshot" else "delta", r["side"], r["price_text"], r["qty_text"]) for r in got] == want
    b = tape(spark, [("bitstamp", bitstamp(5, [["1.50", "2"]], [["3", "x"]]), "web_socket"), ("bitstamp", bitstamp(6, channel="other"), "web_socket")])
    rows = wire.bitstamp_levels(b).orderBy("side").collect()
    assert [(r["side"], r["price_text"], r["error"]) for r in rows] == [("ask", "3", "malformed quantity"), ("bid", "1.50", None)]
    assert wire.bitstamp_misrouted(b).count() == 1


def test_trades_and_rest(spark):
    k = '{"channel":"trade","type":"update","data":[{"symbol":"BTC/USD","side":"sell","price":1.10,"qty":0.00100000,"timestamp":"2026-08-09T12:34:56Z"},{"symbol":"ETH/USD","side":"buy","price":2,"qty":1,"timestamp":"x"}]}'
    r = wire.kraken_trades(tape(spark, [("kraken", k, "web_socket"), ("kraken", k.replace("update", "snapshot"), "web_socket")])).collect()
    assert [(x["price_text"], x["qty_text"], x["taker_side"], x["venue_ts_ns"]) for x in r] == [("1.10", "0.00100000", "ask", 1786278896 * 1_000_000_000)]
    c = json.dumps({"channel": "market_trades", "sequence_num": 1, "events": [{"type": "update", "trades": [{"product_id": "BTC-USD", "price": "5", "size": "1", "side": "BUY"}]}, {"type": "snapshot", "trades": [{"product_id": "BTC-USD", "price": "4", "size": "1", "side": "BUY"}]}]})
    assert [(x["price_text"], x["taker_side"]) for x in wire.coinbase_trades(tape(spark, [("coinbase", c, "web_socket")])).collect()] == [("5", "bid")]
    rest = tape(spark, [("coinbase", '{"pricebook":{"bids":[{"price":"1","size":"2"}],"asks":[]}}', "rest_audit"), ("bitstamp", '{"microtimestamp":"9","bids":[],"asks":[["3","4"]]}', "rest_snapshot")])
    assert sorted((x["venue"], x["as_of"], x["side"], x["price_text"]) for x in wire.rest_levels(rest).collect()) == [("bitstamp", 9, "ask", "3"), ("coinbase", 0, "bid", "1")]


def test_native_checksum(spark):
    lv = "array<struct<price:string,qty:string>>"
    df = spark.createDataFrame([([("60010.00", "0.75000000"), ("60020.00", "2.00000000")], [("60000.00", "1.20000000"), ("59950.00", "0.50000000")])], f"asks {lv}, bids {lv}")
    assert df.select(wire.checksum("asks", "bids").alias("c")).first()["c"] == 1205813205 == json.loads(OPENING)["data"][0]["checksum"]


def test_published_snapshot_is_ordered_and_textual(spark):
    from trustbook.operators import cross

    t = top(spark, [("100", "102", True, 40), ("101.50", None, True, 900)]).withColumn("levels_held", F.lit(3))
    depth = spark.createDataFrame([("v0", "S", "bid", 1, 100)], "venue string, symbol string, side string, level int, price int").withColumn("qty", F.lit(1))
    row = snapshot.wire(snapshot.published(t, cross.cross_touch(t), depth, 7, 99)).first()["json"]
    s = json.loads(row)
    assert (s["seq"], [v["venue"] for v in s["symbols"][0]["venues"]]) == (7, ["v0", "v1"])
    assert s["symbols"][0]["cross"]["bid"].startswith("101.5") and s["symbols"][0]["venues"][0]["levels"][0]["price"] == "100"


def test_feed_keeps_the_last_good_snapshot(spark, tmp_path):
    line = lambda node, ms, **v: json.dumps({"node": node, "received_ms": ms, "seq": ms, "symbols": [{"symbol": "S", "venues": [{"venue": "v", "status": "live", "age_ms": 5, **v}]}]})
    (tmp_path / "f.json").write_text("\n".join([line("a", 1), line("a", 3, integrity="verified"), "{broken", line("b", 2)]))
    rows = feed.views(feed.latest(feed.read(spark, str(tmp_path / "f.json")))).orderBy("node").collect()
    assert [(r["node"], r["received_ms"], r["integrity"]) for r in rows] == [("a", 3, "verified"), ("b", 2, "order_only")]


def test_queue_drops_its_oldest(spark):
    df = spark.range(10).select(F.lit(1).alias("drain"), F.col("id").alias("n"))
    out = snapshot.last_queued(df, "drain", "n", 4).collect()
    assert sorted(r["n"] for r in out) == [6, 7, 8, 9] and {r["dropped"] for r in out} == {6}


def test_streaming_buckets_equal_batch(spark, tmp_path):
    df = spark.range(200).select(F.lit("v").alias("venue"), F.lit("S").alias("symbol"), F.timestamp_millis(F.col("id") * 30).alias("wall_ts"), (F.col("id") % 7).cast("double").alias("mid"), F.lit(1.0).alias("spread"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tumbling.buckets(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), late="0 seconds")
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["from_ts"]: r["samples"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["from_ts"]: r["samples"] for r in tumbling.buckets(df).collect()}
    assert len(got) >= len(want) - 1 and all(want[k] == v for k, v in got.items())
