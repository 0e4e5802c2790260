"""Native parsing of venue messages where digits travel as text; whole-stage JSON functions, no Python.

Bare JSON numbers lose their digits in Spark's JSON functions, so book messages of the checksum venue
go through the state operator; its trades, which no checksum covers, are cut out by pattern here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import rfc3339_ns, venue_symbol
from .numbers import level_error, price, quantity

COINBASE = "channel string, sequence_num long, timestamp string, events array<struct<type:string,product_id:string,heartbeat_counter:string,updates:array<struct<side:string,price_level:string,new_quantity:string>>,trades:array<struct<product_id:string,price:string,size:string,side:string>>>>"
BITSTAMP = "event string, channel string, data struct<microtimestamp:string,bids:array<array<string>>,asks:array<array<string>>,price_str:string,amount_str:string,type:string>"
COINBASE_REST = "pricebook struct<bids:array<struct<price:string,size:string>>,asks:array<struct<price:string,size:string>>>"
BITSTAMP_REST = "microtimestamp string, bids array<array<string>>, asks array<array<string>>"
KEYS = ("venue", "symbol", "elapsed_nanos", "recorded_wall_unix_nanos")


def _priced(df: DataFrame) -> DataFrame:
    """Exact values beside the text, and why a level is malformed (such rows stay, with the reason)."""
    return df.withColumns({"price": price("price_text"), "qty": quantity("qty_text"), "error": level_error("price_text", "qty_text")})


def coinbase_frames(frames: DataFrame) -> DataFrame:
    return frames.where("venue = 'coinbase' AND kind = 'frame' AND source = 'web_socket'").select(*KEYS, F.from_json("payload", COINBASE).alias("m"))


def coinbase_levels(frames: DataFrame) -> DataFrame:
    """(keys, sequence_num, venue_ts_ns, type, side, price, qty, ...) of book messages of the stream's own product."""
    m = coinbase_frames(frames).where("m.channel = 'l2_data'").select(*KEYS, "m.sequence_num", rfc3339_ns("m.timestamp").alias("venue_ts_ns"), F.posexplode("m.events").alias("event", "e"))
    m = m.where(F.col("e.product_id") == venue_symbol("symbol", F.lit("coinbase"))).select(*KEYS, "sequence_num", "venue_ts_ns", "event", "e.type", F.posexplode_outer("e.updates").alias("level_index", "u"))
    side = F.when(F.col("u.side") == "bid", "bid").when(F.col("u.side").isin("ask", "offer"), "ask")
    return _priced(m.select(*KEYS, "sequence_num", "venue_ts_ns", "event", "type", "level_index", side.alias("side"), F.col("u.price_level").alias("price_text"), F.col("u.new_quantity").alias("qty_text")))


def coinbase_trades(frames: DataFrame) -> DataFrame:
    """Prints; the opening burst repeats the past and is left out."""
    m = coinbase_frames(frames).where("m.channel = 'market_trades'").select(*KEYS, rfc3339_ns("m.timestamp").alias("venue_ts_ns"), F.explode("m.events").alias("e")).where("e.type <> 'snapshot'")
    m = m.select(*KEYS, "venue_ts_ns", F.explode("e.trades").alias("t")).where(F.col("t.product_id") == venue_symbol("symbol", F.lit("coinbase")))
    taker = F.when(F.col("t.side") == "BUY", "bid").when(F.col("t.side") == "SELL", "ask")
    return _priced(m.select(*KEYS, "venue_ts_ns", F.col("t.price").alias("price_text"), F.col("t.size").alias("qty_text"), taker.alias("taker_side")))


def coinbase_heartbeats(frames: DataFrame) -> DataFrame:
    return coinbase_frames(frames).where("m.channel = 'heartbeats'").select(*KEYS, F.explode("m.events").alias("e")).select(*KEYS, F.col("e.heartbeat_counter").cast("long").alias("heartbeat_counter"))


def bitstamp_frames(frames: DataFrame) -> DataFrame:
    return frames.where("venue = 'bitstamp' AND kind = 'frame' AND source = 'web_socket'").select(*KEYS, F.from_json("payload", BITSTAMP).alias("m"))


def _both_sides(df: DataFrame, bids: str, asks: str, *keep: str) -> DataFrame:
    def side(column: str, name: str) -> Column:
        return F.transform(F.coalesce(column, F.expr("cast(array() AS array<array<string>>)")), lambda x, i: F.struct(F.lit(name).alias("side"), i.alias("level_index"), x[0].alias("p"), x[1].alias("q")))

    rows = df.select(*keep, F.explode(F.concat(side(bids, "bid"), side(asks, "ask"))).alias("l"))
    return _priced(rows.select(*(c.rsplit(".", 1)[-1] for c in keep), "l.side", "l.level_index", F.col("l.p").alias("price_text"), F.col("l.q").alias("qty_text")))


def bitstamp_levels(frames: DataFrame) -> DataFrame:
    """Diffs of the stream's own channel; those of another channel are in ``bitstamp_misrouted``."""
    m = bitstamp_frames(frames).where("m.event = 'data'").where(F.col("m.channel") == F.concat(F.lit("diff_order_book_"), venue_symbol("symbol", F.lit("bitstamp"))))
    return _both_sides(m.withColumn("micros", F.col("m.data.microtimestamp").try_cast("long")), "m.data.bids", "m.data.asks", *KEYS, "micros")


def bitstamp_misrouted(frames: DataFrame) -> DataFrame:
    pair = venue_symbol("symbol", F.lit("bitstamp"))
    return bitstamp_frames(frames).where("m.event IN ('data', 'trade')").where(~F.col("m.channel").isin("") & (F.col("m.channel") != F.concat(F.when(F.col("m.event") == "data", "diff_order_book_").otherwise("live_trades_"), pair)))


def bitstamp_trades(frames: DataFrame) -> DataFrame:
    m = bitstamp_frames(frames).where("m.event = 'trade'").where(F.col("m.channel") == F.concat(F.lit("live_trades_"), venue_symbol("symbol", F.lit("bitstamp"))))
    taker = F.when(F.col("m.data.type") == "0", "bid").when(F.col("m.data.type") == "1", "ask")
    return _priced(m.select(*KEYS, (F.col("m.data.microtimestamp").try_cast("long") * 1000).alias("venue_ts_ns"), F.col("m.data.price_str").alias("price_text"), F.col("m.data.amount_str").alias("qty_text"), taker.alias("taker_side")))


def kraken_trades(frames: DataFrame) -> DataFrame:
    """Prints with the digits that were sent, by pattern; the opening burst is left out."""
    rows = frames.where("venue = 'kraken' AND kind = 'frame' AND source = 'web_socket'").where(F.col("payload").rlike(r'"channel"\s*:\s*"trade"') & ~F.col("payload").rlike(r'"type"\s*:\s*"snapshot"'))
    items = rows.select(*KEYS, F.explode(F.regexp_extract_all("payload", F.lit(r'\{[^{}]*"symbol"[^{}]*\}'), F.lit(0))).alias("t"))
    text = lambda name: F.regexp_extract("t", rf'"{name}"\s*:\s*"([^"]*)"', 1)
    digits = lambda name: F.nullif(F.regexp_extract("t", rf'"{name}"\s*:\s*(-?[0-9.eE+-]+)', 1), F.lit(""))
    mine = items.where(text("symbol") == venue_symbol("symbol", F.lit("kraken")))
    taker = F.when(text("side") == "buy", "bid").when(text("side") == "sell", "ask")
    return _priced(mine.select(*KEYS, rfc3339_ns(text("timestamp")).alias("venue_ts_ns"), digits("price").alias("price_text"), digits("qty").alias("qty_text"), taker.alias("taker_side")))


def rest_levels(frames: DataFrame) -> DataFrame:
    """Levels of REST depth answers with the instant they are of (0 where the venue names none)."""
    r = frames.where("kind = 'frame' AND source IN ('rest_snapshot', 'rest_audit')")
    c = r.where("venue = 'coinbase'").select(*KEYS, "source", F.from_json("payload", COINBASE_REST).alias("m")).withColumn("as_of", F.lit(0).cast("long"))
    flat = lambda s: F.transform(f"m.pricebook.{s}", lambda x: F.array(x["price"], x["size"]))
    c = c.withColumns({"b": flat("bids"), "a": flat("asks")})
    b = r.where("venue = 'bitstamp'").select(*KEYS, "source", F.from_json("payload", BITSTAMP_REST).alias("m")).withColumns({"as_of": F.col("m.microtimestamp").try_cast("long"), "b": F.col("m.bids"), "a": F.col("m.asks")})
    return _both_sides(c.drop("m").unionByName(b.drop("m")), "b", "a", *KEYS, "source", "as_of")


def checksum(asks: str | Column, bids: str | Column) -> Column:
    """CRC-32 over the digits of the ten best levels of each side (arrays of price and qty text, best first), asks first."""
    bare = lambda x: F.when(F.ltrim(F.regexp_replace(x, r"\.", ""), F.lit("0")) == "", "0").otherwise(F.ltrim(F.regexp_replace(x, r"\.", ""), F.lit("0")))
    side = lambda c: F.array_join(F.transform(F.slice(c, 1, 10), lambda x: F.concat(bare(x["price"]), bare(x["qty"]))), "")
    return F.crc32(F.concat(side(asks), side(bids)).cast("binary"))
