"""Batch and streaming wrappers around the state operator; both run the same step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import MESSAGE, TIMELINE
from .state import Stream

COLUMNS = ("venue", "symbol", "ord", "elapsed_ns", "wall_ns", "input", "source", "payload")


def from_frames(tape: DataFrame) -> DataFrame:
    """Messages of a raw-frame tape; frames of the same instant keep their order in the file (a stream has only the instant)."""
    ord_ = F.col("elapsed_nanos") if tape.isStreaming else F.monotonically_increasing_id()
    return tape.select("venue", "symbol", ord_.alias("ord"), F.col("elapsed_nanos").alias("elapsed_ns"), F.col("recorded_wall_unix_nanos").alias("wall_ns"), F.coalesce("kind", F.lit("frame")).alias("input"), F.coalesce("source", F.lit("web_socket")).alias("source"), "payload")


def from_events(boundaries: DataFrame | None, rows: DataFrame, at: str = "ingest_elapsed_nanos") -> DataFrame:
    """Messages of event rows (one per level); an archive has no boundaries (venue, symbol, ord, at_ns), so they are optional.

    Rows of several runs come with their ``run`` and are put on one time line first (``archive.timeline``, at="at_ns").
    """
    lvl = lambda side: F.transform(F.filter("l", lambda x: x["side"] == side), lambda x: F.array(x["price"], x["qty"]))
    one = F.col("l")[0]
    key = ["venue", "symbol", "event_seq", "kind", at, *(c for c in ("ingest_wall_unix_nanos", "run") if c in rows.columns)]
    e = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("level_index", "side", "price", "qty", "checksum", "heartbeat_counter", "taker_side"))).alias("l"), F.first("venue_ts_unix_nanos").alias("ts"))
    body = (
        F.when(F.col("kind").isin("snapshot", "delta"), F.concat_ws(",", F.to_json(lvl("bid")), F.to_json(lvl("ask"))))
        .when(F.col("kind") == "trade", F.concat_ws(",", F.expr("'\"' || l[0].price || '\"'"), F.expr("'\"' || l[0].qty || '\"'"), F.coalesce(F.expr("'\"' || l[0].taker_side || '\"'"), F.lit("null"))))
        .when(F.col("kind") == "checksum", one["checksum"].cast("string"))
        .otherwise(F.coalesce(one["heartbeat_counter"].cast("string"), F.lit("null")))
    )
    text = F.concat(F.lit('{"action":["'), F.col("kind"), F.lit('",'), body, F.lit('],"venue_ts":'), F.coalesce(F.col("ts").cast("string"), F.lit("null")), F.lit("}"))
    out = e.select("venue", "symbol", F.col("event_seq").alias("ord"), F.col(at).alias("elapsed_ns"), F.col("ingest_wall_unix_nanos").alias("wall_ns"), F.lit("event").alias("input"), F.lit(None).cast("string").alias("source"), text.alias("payload"))
    if boundaries is None:
        return out
    first = F.broadcast(rows.agg(F.min(F.col("ingest_wall_unix_nanos") - F.col(at)).alias("o")))
    ends = boundaries.join(first).select("venue", "symbol", "ord", (F.col("at_ns") - F.col("o")).alias("elapsed_ns"), F.col("at_ns").alias("wall_ns"), F.lit("session_ended").alias("input"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("payload"))
    return out.unionByName(ends)


def _rows(stream: Stream, rows) -> Iterator[dict]:
    for r in rows:
        yield stream.step(r["ord"], r["elapsed_ns"], r["wall_ns"], r["input"], r["source"], r["payload"])


def replay(messages: DataFrame, partitions: int | None = None, **policy) -> DataFrame:
    """The timeline of recorded messages. One shuffle on the stream, sorted by (elapsed, ord) inside partitions.

    Rows are worked off as they come: memory is the state of one stream and one Arrow batch, whatever
    a stream's length; nothing gathers a stream.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = messages.sparkSession
    schema = spark.createDataFrame([], TIMELINE).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        key, stream = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["venue"], r["symbol"]) != key:
                    key = (r["venue"], r["symbol"])
                    stream = Stream(*key, **policy)
                out += _rows(stream, (r,))
                if len(out) >= 2000:
                    yield _arrow(out, arrow)
                    out = []
            if out:
                yield _arrow(out, arrow)

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = messages.select(*COLUMNS).repartition(n, "venue", "symbol").sortWithinPartitions("venue", "symbol", "elapsed_ns", "ord")
    return dealt.mapInArrow(run, schema)


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    cols = []
    for f in schema:
        vals = [r[f.name] for r in rows]
        if pa.types.is_list(f.type) and pa.types.is_struct(f.type.value_type):
            names = [f.type.value_type.field(i).name for i in range(f.type.value_type.num_fields)]
            vals = [None if v is None else [dict(zip(names, x, strict=True)) for x in v] for v in vals]
        cols.append(pa.array(vals, f.type))
    return pa.RecordBatch.from_arrays(cols, schema=schema)


class Processor(StatefulProcessor):
    """Keeps a stream's state between micro-batches (no time to live: a live book never expires)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("stream", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stream = Stream.restore(self.state.get()[0]) if self.state.exists() else Stream(*key)
        got = pd.concat(list(rows)).sort_values(["elapsed_ns", "ord"], kind="stable")
        out = list(_rows(stream, got.to_dict("records")))
        self.state.update((stream.dump(),))
        flat = [{k: r[k] for k in FLAT} for r in out]
        yield pd.DataFrame(flat, columns=list(FLAT)).astype({"ord": "int64", "elapsed_ns": "int64", "levels_held": "int32"})

    def close(self) -> None:
        pass


FLAT = ("venue", "symbol", "ord", "elapsed_ns", "input", "status", "reason", "best_bid", "best_ask", "levels_held", "parse_error")
FLAT_SCHEMA = "venue string, symbol string, ord long, elapsed_ns long, input string, status string, reason string, best_bid string, best_ask string, levels_held int, parse_error string"


def follow(messages: DataFrame) -> DataFrame:
    """The same over a streaming DataFrame of messages: status and touch after each message."""
    return messages.select(*COLUMNS).groupBy("venue", "symbol").transformWithStateInPandas(statefulProcessor=Processor(), outputStructType=FLAT_SCHEMA, outputMode="append", timeMode="none")


def write_timeline(timeline: DataFrame, path: str, checkpoint: str, every: str = "250 milliseconds", once: bool = False):
    """Start a query that appends the timeline as Parquet."""
    w = timeline.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


__all__ = ["MESSAGE", "follow", "from_events", "from_frames", "replay", "write_timeline"]
