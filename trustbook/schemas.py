"""Declared schemas: raw frames (bronze), normalised events (silver) and the book timeline."""

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 8)

#: One recorded frame or session boundary.
TAPE = T.StructType(
    [
        T.StructField("venue", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("elapsed_nanos", T.LongType()),
        T.StructField("recorded_wall_unix_nanos", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("kind", T.StringType()),
    ]
)
#: One level of an event, or the event itself where it has none.
EVENTS = T.StructType(
    [
        T.StructField("event_seq", T.LongType(), False),
        T.StructField("venue", T.StringType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("ingest_wall_unix_nanos", T.LongType(), False),
        T.StructField("ingest_elapsed_nanos", T.LongType(), False),
        T.StructField("venue_ts_unix_nanos", T.LongType()),
        T.StructField("side", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("qty", T.StringType()),
        T.StructField("level_index", T.IntegerType()),
        T.StructField("checksum", T.LongType()),
        T.StructField("heartbeat_counter", T.LongType()),
        T.StructField("taker_side", T.StringType()),
    ]
)
KINDS = ("snapshot", "delta", "trade", "checksum", "heartbeat")
#: Venue -> (rank for ties, integrity, recovery); integrity 0 order_only, 1 gap_detectable, 2 verified.
VENUES = {"coinbase": (0, 1, "resubscribe"), "kraken": (1, 2, "resubscribe"), "bitstamp": (2, 0, "rest"), "fake": (3, 2, "resubscribe")}
#: Venue -> (idle timeout in seconds, seconds between depth audits, depth that an audit asks for, depth of the live book; NULL: all) (fixed values).
ENDPOINTS = {"coinbase": (15, 60, 1000, None), "kraken": (15, 60, 1000, 10), "bitstamp": (30, 60, 1000, None)}
INTEGRITY = ("order_only", "gap_detectable", "verified")
#: A message as the state operator takes it: a frame, a boundary, or a stored event.
MESSAGE = "venue string, symbol string, ord long, elapsed_ns long, wall_ns long, input string, source string, payload string"
LEVELS = "array<struct<price:string,qty:string>>"
#: One row for each message, after it was applied.
TIMELINE = (
    "venue string, symbol string, ord long, elapsed_ns long, wall_ns long, venue_ts_ns long, input string, status string, integrity int, "
    "reason string, reason_detail string, since_ns long, last_verified_ns long, best_bid string, best_ask string, bid_qty string, ask_qty string, "
    f"levels_held int, bids {LEVELS}, asks {LEVELS}, last_update_ns long, parse_error string, resync boolean, audit string, audit_compared int, "
    "audit_findings array<struct<side:string,price:string,ours:string,theirs:string>>, audit_desync string, "
    "events array<struct<kind:string,side:string,price:string,qty:string,level_index:int,checksum:long,heartbeat_counter:long,taker_side:string,event:int>>"
)
