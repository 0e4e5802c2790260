"""Order books by set operations, for streams whose books can't cross (else see streaming.state).

A level is what an applied message says about (stream, epoch, side, price); the latest one counts,
zero deletes. Everything is keyed by (stream, epoch, ...), so that a long stream is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .trust import STREAM, neighbour

KEY = (*STREAM, "epoch")


def applied_levels(messages: DataFrame) -> DataFrame:
    """Level rows of the messages that apply: a snapshot's, and a delta's if the book is live.

    messages: what ``with_epochs`` gives, with levels: array of (side, price, qty).
    """
    m = messages.where((F.col("kind") == "snapshot") | ((F.col("kind") == "delta") & F.col("live")))
    return m.select(*KEY, *(c for c in ("seq",) if c in m.columns), "at_ns", F.inline("levels"))


def current_epoch(messages: DataFrame, as_of: Column | None = None) -> DataFrame:
    """State of each stream as of an instant: its epoch and whether it is live. Needs no running state, so raw messages will do."""
    m = messages if as_of is None else messages.where(F.col("at_ns") <= as_of)
    mark = F.when(F.col("kind") == "snapshot", 1).when(F.col("kind") == "session_ended", 0)
    last = F.max_by(mark, F.when(mark.isNotNull(), F.col("at_ns")))
    return m.groupBy(*STREAM).agg(F.count_if(F.col("kind") == "snapshot").alias("epoch"), (F.coalesce(last, F.lit(0)) == 1).alias("live"), F.max_by("integrity", "at_ns").alias("integrity"), F.max_by("venue_rank", "at_ns").alias("venue_rank"))


def held_asof(levels: DataFrame, state: DataFrame, as_of: Column | None = None) -> DataFrame:
    """What was last said about each price of the current epoch: qty (zero: deleted) and updated_ns."""
    rows = levels if as_of is None else levels.where(F.col("at_ns") <= as_of)
    return rows.join(state.select(*KEY), list(KEY)).groupBy(*STREAM, "side", "price").agg(F.max_by("qty", "at_ns").alias("qty"), F.max("at_ns").alias("updated_ns"))


def book_asof(levels: DataFrame, state: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(venue, symbol, side, price, qty) that the books hold."""
    return held_asof(levels, state, as_of).where("qty > 0").drop("updated_ns")


def best_first() -> Column:
    """Orders bids from the highest, asks from the lowest."""
    return F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))


def ladder(book: DataFrame, depth: int) -> DataFrame:
    """The best ``depth`` levels of each side, numbered from 1."""
    w = Window.partitionBy(*STREAM, "side").orderBy(best_first())
    return book.withColumn("level", F.row_number().over(w)).where(F.col("level") <= depth)


def top_of_book(held: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """One row per stream: best prices, spread and mid (NULL unless both sides are there), trust and age.

    held: what ``held_asof`` gives; a deleted level still counts as an update.
    """
    full = F.col("qty") > 0
    bid, ask = full & (F.col("side") == "bid"), full & (F.col("side") == "ask")
    best = held.groupBy(*STREAM).agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"),
        F.min(F.when(ask, F.col("price"))).alias("ask"),
        F.max_by(F.when(bid, F.col("qty")), F.when(bid, F.col("price"))).alias("bid_qty"),
        F.min_by(F.when(ask, F.col("qty")), F.when(ask, F.col("price"))).alias("ask_qty"),
        F.count_if(full).alias("levels_held"),
        F.max("updated_ns").alias("last_update_ns"),
    )
    out = state.join(best, list(STREAM), "left")
    return out.withColumns({"spread": F.col("ask") - F.col("bid"), "mid": ((F.col("bid") + F.col("ask")) / 2).cast("decimal(18,8)"), "age_ns": as_of - F.col("last_update_ns"), "levels_held": F.coalesce("levels_held", F.lit(0))})


def crossed(top: DataFrame) -> DataFrame:
    """Books whose best bid reaches the best ask; equality counts, one-sided books never cross."""
    return top.where(F.col("bid") >= F.col("ask"))


#: Levels of the tree over a stream's messages: a node of the top level stands for 2 ** TOP messages.
TOP = 12
#: Nodes (number * 16 + level) whose messages make up the places from a up to b, each message once.
_NODES = f"""flatten(transform(sequence(0, {TOP}), k -> CASE WHEN shiftright(a + shiftleft(1L, k) - 1, k) >= shiftright(b, k) THEN cast(array() AS array<bigint>)
    WHEN k = {TOP} THEN transform(sequence(shiftright(a + shiftleft(1L, k) - 1, k), shiftright(b, k) - 1), x -> x * 16 + k)
    ELSE filter(array(CASE WHEN shiftright(a + shiftleft(1L, k) - 1, k) % 2 = 1 THEN shiftright(a + shiftleft(1L, k) - 1, k) * 16 + k ELSE -1L END,
        CASE WHEN shiftright(b, k) % 2 = 1 THEN (shiftright(b, k) - 1) * 16 + k ELSE -1L END), x -> x >= 0) END))"""


def touch_timeline(messages: DataFrame, levels: DataFrame) -> DataFrame:
    """Best bid and ask after every message of a live stream: a level holds from its message to the next one on its price.

    The places at which a level holds are an interval of its epoch. It is written to the few nodes of a binary tree over
    the stream's messages that make it up, a node keeps its best prices, and a message reads the nodes above it: n log n
    rows whatever an epoch's length, and no key with more than 2 ** TOP messages.
    """
    w = Window.partitionBy(*KEY, "side", "price").orderBy("seq")
    ends = messages.groupBy(*KEY).agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("stop"))
    held = levels.select(*KEY, "side", "price", "qty", F.col("seq").alias("a"), F.lead("seq").over(w).alias("next")).where("qty > 0")
    held = held.join(ends, list(KEY)).withColumn("b", F.coalesce("next", "stop"))
    nodes = held.select(*STREAM, F.when(F.col("side") == "bid", F.col("price")).alias("bid"), F.when(F.col("side") == "ask", F.col("price")).alias("ask"), F.explode(F.expr(_NODES)).alias("node"))
    nodes = nodes.groupBy(*STREAM, "node").agg(F.max("bid").alias("bid"), F.min("ask").alias("ask"))
    live = messages.where("live").select(*KEY, "seq", "at_ns", "kind", "integrity").join(ends, list(KEY))
    up = live.withColumn("node", F.explode(F.expr(f"transform(sequence(0, least({TOP}, cast(floor(log2(stop - start)) AS int))), k -> shiftright(seq, k) * 16 + k)")))
    out = up.join(nodes, [*STREAM, "node"], "left").groupBy(*KEY, "seq", "at_ns", "kind", "integrity").agg(F.max("bid").alias("bid"), F.min("ask").alias("ask"))
    return out.withColumn("mid", ((F.col("bid") + F.col("ask")) / 2).cast("decimal(18,8)")).withColumn("spread", (F.col("ask") - F.col("bid")).cast("decimal(18,8)"))


def ladders_at(messages: DataFrame, levels: DataFrame, first_ns: int, last_ns: int, every_ns: int, depth: int = 10) -> DataFrame:
    """The best ``depth`` levels of each side as of every tick: (venue, symbol, seq, tick_ns, side, level, price, qty), seq from 1.

    A level holds from its message to the next one on its price, or to the snapshot that ends its epoch (a book that isn't
    live any more is still held). It is written to the ticks that it spans, so rows are those of the books at the ticks.
    """
    n = max(0, (last_ns - first_ns) // every_ns)
    starts = neighbour(messages.where("kind = 'snapshot'").select(*KEY, "at_ns"), "at_ns", "at_ns", "stop", after=True).drop("at_ns")
    w = Window.partitionBy(*KEY, "side", "price").orderBy("at_ns")
    held = levels.withColumn("next", F.lead("at_ns").over(w)).where("qty > 0").join(starts, list(KEY))
    to_tick = lambda at: F.call_function("div", at - first_ns + every_ns - 1, F.lit(every_ns))
    held = held.withColumns({"a": F.greatest(to_tick(F.col("at_ns")), F.lit(1)), "b": F.coalesce(F.least(to_tick(F.coalesce("next", "stop")) - 1, F.lit(n)), F.lit(n))}).where("b >= a")
    rows = held.select(*STREAM, F.explode(F.sequence("a", "b")).alias("seq"), "side", "price", "qty")
    best = Window.partitionBy(*STREAM, "seq", "side").orderBy(best_first())
    return rows.withColumn("level", F.row_number().over(best)).where(F.col("level") <= depth).withColumn("tick_ns", F.lit(first_ns) + F.col("seq") * every_ns)


def last_trade(messages: DataFrame, as_of: Column) -> DataFrame:
    """The latest print (price, qty) of each stream and its age."""
    t = messages.where(F.col("kind") == "trade").groupBy(*STREAM).agg(F.max_by(F.struct("price", "qty", "at_ns"), "at_ns").alias("t"))
    return t.select(*STREAM, F.col("t.price").alias("price"), F.col("t.qty").alias("qty"), (as_of - F.col("t.at_ns")).alias("age_ns"))
