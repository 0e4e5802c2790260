"""Line deduplication with a log-template tree of fixed depth.

A line's tokens are masked (those with a digit, an at sign or an address become a wildcard); the
tree's first level is the number of tokens, the next ones are the LEAD leading tokens. Below such a
leaf a line belongs to its own masked form. A masked form recurs if it occurs in at least MIN_DOCS
documents, or, where LONG words or more of it aren't masked, as soon as two different texts have
it: a passage needs no third document.

What is left of a leaf that MIN_DOCS documents share is generalised. A token is fixed at its place
if at least a share of SHARE of the leaf's documents have it there (so a place has few fixed tokens,
and a leaf few templates); all other tokens are variable fields. A line's template keeps its fixed
tokens; it recurs if FIXED of its tokens are fixed and both MIN_DOCS and SHARE of the leaf's
documents have it. Fixed tokens and templates are found by aggregates over (leaf, place, token) and
(leaf, template), so no leaf is ever in one task. Fields among the leading tokens split a leaf.

All lines of recurring forms and templates are dropped. Counting sums one row per document and form
(after a map-side sum).

Defined cases: null and empty texts have no lines; blank lines are kept and belong to no template;
copies of a document count as documents (deduplicate documents first), but not as the two texts of a
long line, or a document's copy would empty it; repeated rows and null ids are documents of their
own (rows with equal id and text count once where a leaf is generalised); other columns are ignored
or passed through; an empty table gives none.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh, materialize, table

LEAD = 2
LONG = 8
MIN_DOCS = 5
SHARE = 1 / 3
FIXED = 0.6
BROADCAST_TEMPLATES = 500_000
VARIABLE = re.compile(r"[0-9@]")
WILD = "\x00"


def masked(line: str) -> list[str]:
    tokens = line.split()
    if VARIABLE.search(line) or "://" in line:
        tokens = [WILD if VARIABLE.search(t) or "://" in t else t for t in tokens]
    return tokens


def _hash(text: str, seed: int) -> int:
    x = xxhash.xxh64_intdigest(text, seed)
    return x - (1 << 64) if x >> 63 else x


def leaf(tokens: list[str]) -> int:
    """The tree's node for a number of tokens and the leading ones."""
    return _hash(f"{len(tokens)}\x01" + " ".join(tokens[:LEAD]), 0)


def form(tokens: list[str]) -> int:
    """The masked form, below its leaf."""
    return _hash(f"{len(tokens)}\x01" + " ".join(tokens), 1)


def _counted(batches):
    """Each masked form and each leaf with room for fields once for each document, with the text's hash and whether it is
    the form of a long line."""
    for b in batches:
        keys: list[int] = []
        ths: list[int] = []
        long: list[bool] = []
        for t, th in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own: dict[int, bool] = {}
            for line in set(t.split("\n")) if t else ():
                if tokens := masked(line):
                    own[form(tokens)] = len(tokens) - tokens.count(WILD) >= LONG
                    if len(tokens) > LEAD:
                        own.setdefault(leaf(tokens), False)
            keys.extend(own)
            long.extend(own.values())
            ths.extend([th] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ths, pa.int64()), pa.array(long, pa.bool_())], names=["key", "th", "long"])


LINE = "doc_id long, th long, line long, form long, leaf long, text string"


def _listed(batches):
    """Every line that isn't blank."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for doc, th, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for i, line in enumerate(t.split("\n") if t else ()):
                if tokens := masked(line):
                    for col, x in zip(out, (doc, th, i, form(tokens), leaf(tokens) if len(tokens) > LEAD else None, line), strict=True):
                        col.append(x)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.string())], names=["doc_id", "th", "line", "form", "leaf", "text"])


def _placed(batches):
    """(doc_id, th, leaf, token): the tokens of a line, named by place and token."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for doc, th, node, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for i, t in enumerate(masked(text)):
                if t != WILD:
                    for col, x in zip(out, (doc, th, node, _hash(t, i)), strict=True):
                        col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "th", "leaf", "token"])


def _generalised(batches):
    """(doc_id, th, line, leaf, template): lines enough of whose tokens are fixed, under a template that keeps those."""
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, th, line, node, text, fixed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            known, tokens = set(fixed), masked(text)
            kept = [t if t != WILD and _hash(t, i) in known else WILD for i, t in enumerate(tokens)]
            if len(kept) - kept.count(WILD) >= FIXED * len(kept):
                for col, x in zip(out, (doc, th, line, node, _hash(f"{node}\x01" + " ".join(kept), 2)), strict=True):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "th", "line", "leaf", "template"])


def counted(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(k, recurs) of the masked forms and leaves of at least ``min_docs`` documents, and of the forms of long lines that
    two texts have. Forms and leaves are hashed apart, so a name is one or the other."""
    text = F.col(f"`{text_col}`").cast("string")
    keys = docs.select(text.alias("text"), F.xxhash64(text).alias("th")).mapInArrow(_counted, "key long, th long, long boolean")
    sums = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("first"), F.max("th").alias("last"), F.max("long").alias("long"))
    return sums.where((F.col("n") >= min_docs) | (F.col("long") & (F.col("first") < F.col("last")))).select(F.col("key").alias("k"))


def generalised(rest: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, th, line) of the lines (doc_id, th, line, leaf, text) that recur under a generalised template."""
    docs = rest.select("leaf", "doc_id", "th").distinct().groupBy(F.col("leaf").alias("l")).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    docs = materialize(docs, "leaves")
    enough = F.col("n") >= F.greatest(F.lit(min_docs).cast("double"), F.col("docs") * SHARE)
    tokens = rest.select("doc_id", "th", "leaf", "text").mapInArrow(_placed, "doc_id long, th long, leaf long, token long").distinct().groupBy("leaf", "token").agg(F.count(F.lit(1)).alias("n"))
    # a leaf has at most 1 / SHARE fixed tokens a place
    fixed = tokens.join(docs, F.col("leaf") == F.col("l")).where(enough).groupBy(F.col("leaf").alias("k")).agg(F.collect_list("token").alias("fixed"))
    lines = rest.join(fixed, F.col("leaf") == F.col("k")).select("doc_id", "th", "line", "leaf", "text", "fixed")
    named = materialize(lines.mapInArrow(_generalised, "doc_id long, th long, line long, leaf long, template long"), "generalised")
    sums = named.select("template", "leaf", "doc_id", "th").distinct().groupBy("template", "leaf").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.join(docs, F.col("leaf") == F.col("l")).where(enough).select(F.col("template").alias("k"))
    return named.join(sums, F.col("template") == F.col("k"), "left_semi").select("doc_id", "th", "line")


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per document: doc_id, th (a hash of its text), n_lines, dropped (line numbers from 0)."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    known = bounded(materialize(counted(docs, text_col, min_docs), "templates"), BROADCAST_TEMPLATES)
    # lines of forms that recur, and those of shared leaves that don't
    lines = rows.mapInArrow(_listed, LINE).join(known, F.col("form") == F.col("k"), "left").withColumnRenamed("k", "recurs")
    lines = lines.join(known, F.col("leaf") == F.col("k"), "left").where("recurs IS NOT NULL OR k IS NOT NULL")
    short = F.when(F.col("recurs").isNull(), F.col("text"))
    lines = materialize(lines.select("doc_id", "th", "line", F.col("recurs").isNotNull().alias("recurs"), "leaf", short.alias("text")), "lines")
    again = generalised(lines.where("NOT recurs").select("doc_id", "th", "line", "leaf", "text"), min_docs)
    gone = lines.where("recurs").select("doc_id", "th", "line").unionAll(again)
    drop = gone.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.sort_array(F.collect_set(F.col("line").cast("int"))).alias("dropped"))
    size = F.when(F.octet_length("text") > 0, F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    out = rows.select("doc_id", "th", F.coalesce(size, F.lit(0)).cast("long").alias("n_lines")).join(drop, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    return out.select("doc_id", "th", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def _without(text_at: int, dropped_at: int):
    def run(batches):
        for b in batches:
            texts = []
            for t, d in zip(b.column(text_at).to_pylist(), b.column(dropped_at).to_pylist(), strict=True):
                gone = set(d or ())
                texts.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if t and gone else t)
            cols = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(b.columns) if i != dropped_at]
            yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    return run


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of the text."""
    names = {k: fresh(docs, k) for k in ("d", "t", "dropped")}
    m = marked(docs, id_col, text_col, min_docs).where(F.size("dropped") > 0).select(F.col("doc_id").alias(names["d"]), F.col("th").alias(names["t"]), F.col("dropped").alias(names["dropped"])).dropDuplicates([names["d"], names["t"]])
    on = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(names["d"])) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(names["t"]))
    both = docs.join(m, on, "left").select(*(F.col(f"`{c}`") for c in docs.columns), F.col(names["dropped"]))
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in docs.schema.fields])
    return both.mapInArrow(_without(docs.columns.index(text_col), len(docs.columns)), schema)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = marked(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"))
