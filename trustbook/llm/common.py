"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and the master is local (tests) a local folder is made, one for an application.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = f"file://{tempfile.mkdtemp(prefix='trustbook-')}"
        found = _OWN[app]
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it below the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trustbook/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trustbook_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote; only for tables that nothing reads any more."""
    path = getattr(df, "_trustbook_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of ``df`` (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def keyed(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that others can't clash."""
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in cols.items()))


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def with_fields(schema: T.StructType, *extra: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *extra])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by five; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def bounded(df: DataFrame, limit: int, width: Column | None = None, most: int = 0) -> DataFrame:
    """``F.broadcast(df)`` if it is counted to have at most ``limit`` rows (and ``most`` bytes, where ``width`` gives
    the bytes of a row), else ``df``, which is then shuffled.

    For tables that ``materialize`` wrote: their count reads no column.
    """
    if width is None:
        return F.broadcast(df) if df.count() <= limit else df
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most else df


#: Rows of a table of keys (two or three longs) that is broadcast.
BROADCAST_KEYS = 500_000


def one_of_each(docs: DataFrame, id_col: str, node: Column, roots: DataFrame) -> DataFrame:
    """One row of each class of ``docs``, whole: that with the smallest id (without an id only where no row has one).

    node: a long that rows of equal content share; roots(node, root) names the class of the nodes that aren't their own.
    Only ids and nodes are shuffled; whole rows are read past the rows that go.
    """
    doc = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(doc.alias("d"), node.alias("t")).groupBy("d", "t").agg(F.count(F.lit(1)).alias("m"))
    rows = materialize(rows.join(roots, F.col("t") == F.col("node"), "left").select("d", "t", "m", F.coalesce("root", "t").alias("root")), "classes")
    best = rows.groupBy(F.col("root").alias("r")).agg(F.min(F.struct(F.isnull("d"), "d", "t")).alias("b")).select("r", F.col("b.d").alias("bd"), F.col("b.t").alias("bt"))
    held = rows.join(best, F.col("root") == F.col("r"))
    stays = F.col("d").eqNullSafe(F.col("bd")) & (F.col("t") == F.col("bt"))
    names = {k: fresh(docs, k) for k in ("d", "t")}
    keys = materialize(held.where(~stays | (F.col("m") > 1)).select(F.col("d").alias(names["d"]), F.col("t").alias(names["t"]), stays.alias("stays")), "class-keys")
    on = doc.eqNullSafe(F.col(names["d"])) & (node == F.col(names["t"]))
    out = docs.join(bounded(keys.drop("stays"), BROADCAST_KEYS), on, "left_anti")
    repeated = keys.where("stays").drop("stays")
    if not repeated.limit(1).count():
        return out
    again = docs.join(bounded(repeated, BROADCAST_KEYS), on).dropDuplicates(list(names.values())).drop(*names.values())
    return out.unionByName(again)
