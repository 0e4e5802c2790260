"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources get their targets by water-filling (shares by weight, none above ``max_epochs`` times its
size). Every document draws an exponential key whose rate is its quality weight; keys, sorted
within the source, are prefix-summed against what the target leaves after complete epochs. The
prefix sum is spread: sizes are summed by (source, key slice), only the slice in which the
budget ends is sorted row by row, so a hot source never meets in one task.

Defined cases: null text has size 0, a null source is a source of its own (sorted last);
a null id is one like any other; ties go by key, id, size; repeated rows are documents
of their own; sources of size 0 take nothing; an empty table gives none. The draw depends on the
seed and the row alone, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, WS, bounded, fresh, materialize, table, text_of

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
SLICES = 4096
SEED = 20240229
#: Sources up to this many are broadcast; with more of them the join is a shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), WS, ""))


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 2, by the share of characters that are neither digits nor marks."""
    odd = F.length(text) - F.length(F.translate(text, "0123456789#$%&*!|<>{}[]=_~^\\", ""))
    return F.lit(0.5) + F.lit(1.5) * F.pow(F.lit(1.0) - odd / F.greatest(F.length(text), F.lit(1)), 2)


def draw(weight: Column, *row: Column, seed: int = SEED) -> Column:
    """An exponential variate of rate ``weight``, from a hash of the row."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also weight and target. Each round shares what is open by weight among the
    sources that are not full; sources that would exceed their cap become full. Ends when none is new."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    src = materialize(sizes.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(max_epochs)), "sources")
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # a source is full at a water level at which its share reaches its cap
        is_full = (F.col("weight") * F.lit(level) >= F.col("cap")) if full >= 0 else F.lit(False)
        n, held, open_weight = src.agg(F.count_if(is_full), F.coalesce(F.sum(F.when(is_full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not open_weight:
            break
        full, level = n, max(level, (share * total - held) / open_weight)
    return src.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def mixed(rows: DataFrame, whole: bool, slices: int = SLICES, **policy) -> DataFrame:
    """rows: doc_id, source, size, key (and others). Adds source_size, target, taken and copies.

    whole: the document at which a source's budget ends is taken whole or left, whichever is nearer
    the target; else only as many of its words as the budget leaves are taken.
    """
    part = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * slices), F.lit(slices - 1)).cast("int")
    rows = rows.withColumn("slice", part)
    by_slice = materialize(rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    src = targets(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), **policy)
    epochs = F.floor(F.col("target") / F.col("source_size"))
    src = src.withColumn("epochs", F.when(F.col("source_size") > 0, epochs).otherwise(0)).withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    w = Window.partitionBy("source").orderBy("slice")
    before = by_slice.withColumn("before", F.sum("slice_size").over(w) - F.col("slice_size")).withColumnRenamed("source", "s")
    ends = (
        src.join(before, src["source"].eqNullSafe(before["s"]) & (before["before"] < src["budget"]), "left")
        .groupBy(src["source"], "source_size", "target", "epochs", "budget")
        .agg(F.max_by(F.struct("slice", "before"), "slice").alias("last"))
        .select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget", F.coalesce(F.col("last.slice"), F.lit(-1)).alias("last"), F.coalesce(F.col("last.before"), F.lit(0)).alias("before"))
    )
    ends = bounded(materialize(ends, "ends"), BROADCAST_SOURCES)
    out = rows.join(ends, rows["source"].eqNullSafe(ends["s"]))
    inner = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    clear = out.where(F.col("slice") != F.col("last")).withColumn("part", F.when(F.col("slice") < F.col("last"), F.col("size")).otherwise(0))
    left = F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(inner), F.lit(0))
    if whole:
        edge = F.when(2 * F.col("left") >= F.col("size"), F.col("size")).otherwise(0)
    else:
        edge = F.greatest(F.lit(0), F.least(F.col("left"), F.col("size")))
    edged = out.where(F.col("slice") == F.col("last")).withColumn("left", left).withColumn("part", F.when(F.col("left") > 0, edge).otherwise(0)).drop("left")
    both = clear.unionByName(edged)
    return both.withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long")).withColumn("copies", (F.col("epochs") + (F.col("part") > 0).cast("long")).cast("int"))


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """doc_id, source, size and key of each document, without its text."""
    t = text_of(F.col(f"`{text_col}`"))
    doc = F.col(f"`{id_col}`").cast("long")
    return docs.select(doc.alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(t).cast("long").alias("size"), draw(quality_weight(t), doc, F.xxhash64(t), seed=seed).alias("key"))


def mix_plan(docs: DataFrame, whole: bool = False, **columns) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source."""
    out = mixed(materialize(drawn(docs, **columns), "drawn"), whole)
    return out.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "copies", "source")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: whole documents, each as often as it is taken, with all their columns.

    The number of copies is joined back by id, source and key (a hash of id and text), so that the text
    moves at most once and documents that share an id stay apart. Repeated rows are taken alike.
    """
    plan = mixed(materialize(drawn(docs, id_col, text_col, source_col), "drawn"), True).where("copies > 0").groupBy("doc_id", "source", "key").agg(F.max("copies").alias("copies"))
    id_, source, key, own, copies, copy = (fresh(docs, k) for k in ("mix_id", "mix_source", "mix_key", "mix_own", "mix_copies", "mix_copy"))
    t, doc = text_of(F.col(f"`{text_col}`")), F.col(f"`{id_col}`").cast("long")
    plan = plan.select(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("key").alias(key), F.col("copies").alias(copies))
    full = docs.withColumn(own, draw(quality_weight(t), doc, F.xxhash64(t)))
    out = full.join(plan, doc.eqNullSafe(F.col(id_)) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(source)) & (F.col(own) == F.col(key)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))
