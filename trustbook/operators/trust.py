"""Trust by set operations: epochs, live intervals, desync accounting, sessions, gaps.

Running state over a stream is computed in two levels, so that a hot stream is not one task:
time slices are aggregated first, prefix state is taken over slices, and rows are only ordered
inside a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STREAM = ("venue", "symbol")
SLICE_NS = 86_400_000_000_000
UNTRUSTED = "untrusted"


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def with_epochs(messages: DataFrame, slice_ns: int = SLICE_NS, order: str = "at_ns") -> DataFrame:
    """Adds seq (place in the stream, from 0), epoch (snapshots so far), session_id (boundaries so far) and live (the last
    boundary was a snapshot). ``order`` must be unique in a stream, or equal rows come in any order.

    Boundaries travel as numbers, so that every aggregate here has a fixed-width buffer and stays a hash aggregate.
    """
    m = messages.withColumn("slice", F.expr(f"{order} div {slice_ns}"))
    mark = F.when(F.col("kind") == "snapshot", 1).when(F.col("kind") == "session_ended", 0)
    per = m.groupBy(*STREAM, "slice").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("kind") == "snapshot").alias("n"), F.count_if(F.col("kind") == "session_ended").alias("d"), F.max_by(mark, F.when(mark.isNotNull(), F.col(order))).alias("b"))
    w = Window.partitionBy(*STREAM).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(*STREAM, "slice", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0") for c in "cnd"), F.last("b", ignorenulls=True).over(w).alias("b0"))
    inner = Window.partitionBy(*STREAM, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = m.join(before, [*STREAM, "slice"])
    return (
        out.withColumn("seq", F.col("c0") + F.count(F.lit(1)).over(inner) - 1)
        .withColumn("epoch", F.col("n0") + F.count_if(F.col("kind") == "snapshot").over(inner))
        .withColumn("session_id", F.col("d0") + F.count_if(F.col("kind") == "session_ended").over(inner))
        .withColumn("live", F.coalesce(F.last(mark, ignorenulls=True).over(inner), F.col("b0"), F.lit(0)) == 1)
        .drop("slice", "c0", "n0", "d0", "b0")
    )


def neighbour(rows: DataFrame, value: str, order: str, name: str, partition: tuple[str, ...] = STREAM, after: bool = False, slice_ns: int = SLICE_NS) -> DataFrame:
    """Adds ``name``: the value of the row before (or after) in its partition, NULL where there is none."""
    key = [*partition, "slice"]
    m = rows.withColumn("slice", F.expr(f"`{order}` div {slice_ns}"))
    edge, near = (F.min_by, F.lead) if after else (F.max_by, F.lag)
    per = m.groupBy(*key).agg(edge(value, order).alias("edge"))
    beyond = per.select(*key, near("edge").over(Window.partitionBy(*partition).orderBy("slice")).alias("beyond"))
    inner = Window.partitionBy(*key).orderBy(order)
    own = F.when(near(F.lit(1)).over(inner).isNull(), F.col("beyond")).otherwise(near(value).over(inner))
    return m.join(beyond, key).withColumn(name, own).drop("slice", "beyond")


def running(rows: DataFrame, value: Column, order: str, name: str, total, partition: tuple[str, ...] = STREAM, own: bool = True, slice_ns: int = SLICE_NS) -> DataFrame:
    """Adds ``name``: ``total`` (F.sum or F.max) of a value over the partition's rows up to this one, or before it."""
    key = [*partition, "slice"]
    m = rows.withColumn("slice", F.expr(f"`{order}` div {slice_ns}")).withColumn(name, value)
    w = Window.partitionBy(*partition).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = m.groupBy(*key).agg(total(name).alias("all")).select(*key, total("all").over(w).alias("beyond"))
    inner = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    both = F.array_compact(F.array("beyond", total(name).over(inner)))
    whole = F.array_max(both) if total is F.max else F.when(F.size(both) > 0, F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x))
    return m.join(before, key).withColumn(name, whole).drop("slice", "beyond")


def changes(timeline: DataFrame, order: str = "at_ns") -> DataFrame:
    """Status changes of each stream: (venue, symbol, from_ns, to_ns, live); the last is open (to_ns NULL).

    timeline: venue, symbol, ``order``, live. Only rows at which the status changes are kept before the next step.
    """
    moved = neighbour(timeline.select(*STREAM, order, "live"), "live", order, "was").where(~_same("was", "live")).select(*STREAM, F.col(order).alias("from_ns"), "live")
    return neighbour(moved, "from_ns", "from_ns", "to_ns", after=True)


def boundaries(messages: DataFrame, order: str = "at_ns") -> DataFrame:
    """The rows that can change the status of a stream that can't cross: (venue, symbol, order, live)."""
    return messages.where(F.col("kind").isin("snapshot", "session_ended")).select(*STREAM, order, (F.col("kind") == "snapshot").alias("live"))


def desync_accounting(status: DataFrame, as_of: Column) -> DataFrame:
    """status: what ``changes`` gives. One row per stream: desyncs and their total time, an open one up to ``as_of``.

    A desync begins when a stream that was live stops being so; time before the first status is none.
    """
    end = F.coalesce(F.col("to_ns"), as_of)
    down = ~F.col("live")
    return status.groupBy(*STREAM).agg(F.count_if(down).alias("desyncs"), F.coalesce(F.sum(F.when(down, end - F.col("from_ns"))), F.lit(0)).alias("desynced_ns"), F.max_by("live", "from_ns").alias("live"), F.max("from_ns").alias("status_since_ns"))


def gaps(frames: DataFrame, sequence: str, order: str, partition: tuple[str, ...] = (*STREAM, "session_id")) -> DataFrame:
    """Contiguity: the rows whose number isn't the last one plus one, with how many are missing (negative: it went back)."""
    out = neighbour(frames, sequence, order, "expected", partition).withColumn("expected", F.col("expected") + 1)
    return out.where(F.col(sequence) != F.col("expected")).withColumn("missing", F.col(sequence) - F.col("expected"))


def regressions(frames: DataFrame, micros: str, order: str, partition: tuple[str, ...] = (*STREAM, "session_id")) -> DataFrame:
    """Monotony: the rows that don't come after the latest accepted one."""
    return running(frames, F.col(micros), order, "latest", F.max, partition, own=False).where(F.col(micros) <= F.col("latest"))


def idle(frames: DataFrame, order: str, limit_ns: int, partition: tuple[str, ...] = STREAM) -> DataFrame:
    """Silences longer than the limit: the row that ends each, and its length."""
    out = neighbour(frames, order, order, "before", partition)
    return out.withColumn("idle_ns", F.col(order) - F.col("before")).drop("before").where(F.col("idle_ns") > limit_ns)


def missed(snapshots: DataFrame, sequence: str, order: str, partition: tuple[str, ...]) -> DataFrame:
    """Snapshots that a reader skipped before each one it got."""
    out = neighbour(snapshots, sequence, order, "before", partition)
    return out.withColumn("missed", F.greatest(F.coalesce(F.col(sequence) - F.col("before") - 1, F.lit(0)), F.lit(0))).drop("before")
