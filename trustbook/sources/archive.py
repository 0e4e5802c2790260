"""The event archive: Hive-partitioned Parquet, one row per level, and events put together again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import partition_name
from ..operators.trust import running
from ..schemas import EVENTS, KINDS

COLUMNS = [f.name for f in EVENTS.fields]


def utc(ns: str | Column) -> Column:
    c = F.col(ns) if isinstance(ns, str) else ns
    return F.timestamp_micros(F.call_function("div", c, F.lit(1000)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/trustbook-{spark.sparkContext.applicationId}"
    return found.rstrip("/")


def write(events: DataFrame, path: str, splits: int = 1, max_records: int = 0, run: str | None = None) -> None:
    """Append event rows under symbol_key=/date=/hour= (UTC of the ingest wall clock). The true symbol stays in the file.

    An event is known by its run and number, so that its rows may lie in several files (hour borders, ``max_records``).
    ``splits`` spreads the hours of a busy symbol over several tasks.
    """
    ts = utc("ingest_wall_unix_nanos")
    e = events.select(*COLUMNS).withColumns({"run": F.lit(run or uuid.uuid4().hex), "symbol_key": partition_name("symbol"), "date": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "HH")})
    e = e.withColumn("split", F.pmod(F.xxhash64("venue", "event_seq"), F.lit(splits))).repartition("symbol_key", "date", "hour", "split")
    e = e.sortWithinPartitions("symbol_key", "date", "hour", "ingest_elapsed_nanos", "event_seq", "side", "level_index").drop("split")
    w = e.write.mode("append").option("compression", "zstd").partitionBy("symbol_key", "date", "hour")
    (w.option("maxRecordsPerFile", max_records) if max_records else w).parquet(path)


def read(spark: SparkSession, prefixes: list[str], symbols: list[str] | None = None, dates: list[str] | None = None) -> DataFrame:
    """Event rows below the prefixes (each read once), with the columns of the file, not of the path, and their run (the
    file itself where none was written).

    symbols and dates prune by path, whether its first level is called symbol_key or symbol; without them both layouts and
    one without a symbol level are read.
    """
    paths = list(dict.fromkeys(p.rstrip("/") for p in prefixes))
    if symbols or dates:
        paths = [f"{p}/{{symbol_key,symbol}}={s}/date={d}" for p in paths for s in (symbols or ["*"]) for d in (dates or ["*"])]
    out = spark.read.schema(T.StructType([*EVENTS.fields, T.StructField("run", T.StringType())])).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*paths)
    return out.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), F.coalesce("run", F.col("_metadata.file_path")).alias("run"))


def invalid(venues: tuple[str, ...] | None = None) -> Column:
    """Why a row can't be part of an event, or NULL. venues: those that are known, if the reader is to refuse others."""
    k = F.col("kind")
    unknown = F.lit(False) if venues is None else ~F.col("venue").isin(*venues)
    return (
        F.when(unknown, F.concat(F.lit("unknown venue "), F.col("venue")))
        .when(~k.isin(*KINDS), F.concat(F.lit("unknown kind "), k))
        .when(F.col("side").isNotNull() & ~F.col("side").isin("bid", "ask"), F.concat(F.lit("unknown side "), F.col("side")))
        .when((k == "checksum") & F.col("checksum").isNull(), "checksum without a value")
        .when((k == "trade") & (F.col("price").isNull() | F.col("qty").isNull()), "trade without price or quantity")
    )


def assemble(rows: DataFrame, venues: tuple[str, ...] | None = None, strict: bool = False) -> DataFrame:
    """One row per event, by run and number; rows that don't make sense are left out (see ``quarantine``) or, if strict, raise."""
    why = invalid(venues)
    good = rows.where(F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("event "), F.col("event_seq").cast("string"), F.lit(": "), why)).cast("boolean")).otherwise(True) if strict else why.isNull())
    side = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("level_index", "price", "qty")))), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    first = ("ingest_wall_unix_nanos", "ingest_elapsed_nanos", "venue_ts_unix_nanos", "checksum", "heartbeat_counter", "taker_side")
    trade = lambda c: F.max(F.when(F.col("kind") == "trade", F.col(c)))
    return good.groupBy("run", "event_seq", "venue", "symbol", "kind").agg(*(F.first(c, ignorenulls=True).alias(c) for c in first), side("bid").alias("bids"), side("ask").alias("asks"), trade("price").alias("price"), trade("qty").alias("qty"))


def quarantine(rows: DataFrame, venues: tuple[str, ...] | None = None) -> DataFrame:
    return rows.withColumn("why", invalid(venues)).where("why IS NOT NULL")


def flatten(events: DataFrame) -> DataFrame:
    """Event rows of assembled events; an event without levels keeps one row."""

    def side(column: str, name: str) -> Column:
        return F.transform(column, lambda x, i: F.struct(F.lit(name).alias("side"), x["price"].alias("p"), x["qty"].alias("q"), i.alias("level_index")))

    tagged = F.concat(side("bids", "bid"), side("asks", "ask"))
    x = events.withColumn("x", F.explode_outer(tagged))
    return x.select("event_seq", "venue", "symbol", "kind", "ingest_wall_unix_nanos", "ingest_elapsed_nanos", "venue_ts_unix_nanos", F.col("x.side").alias("side"), F.coalesce("x.p", "price").alias("price"), F.coalesce("x.q", "qty").alias("qty"), F.col("x.level_index").alias("level_index"), "checksum", "heartbeat_counter", "taker_side")


def timeline(rows: DataFrame, prefixes: int) -> DataFrame:
    """Adds at_ns: one run's own offsets, or, over several runs, the wall clock from its first instant.

    A run's wall clock may step back; its events then keep the latest instant that the run had reached.
    """
    if prefixes <= 1:
        return rows.withColumn("at_ns", F.col("ingest_elapsed_nanos"))
    first = rows.agg(F.min("ingest_wall_unix_nanos").alias("first_ns"))
    walls = running(rows.select("run", "event_seq", "ingest_wall_unix_nanos").distinct(), F.col("ingest_wall_unix_nanos"), "event_seq", "reached", F.max, ("run",), slice_ns=1 << 16)
    return rows.join(walls.drop("ingest_wall_unix_nanos"), ["run", "event_seq"]).join(F.broadcast(first)).withColumn("at_ns", F.col("reached") - F.col("first_ns")).drop("first_ns", "reached")


def counters(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("file").alias("files"))
