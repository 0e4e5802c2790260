"""Quality: a document classifier's evidence, combined with host and path posteriors by empirical Bayes.

Each document gets a probability from a logistic model over plain text statistics, fitted in
numpy on a bounded labelled sample. Grouped aggregates over all documents give each host
(``source``) and each path below it (``source`` and ``lang``) a count and a sum of evidence; a
path's posterior shrinks to its host's, a host's to the global prior, with strengths estimated
from the spread between sites (method of moments). A document's own evidence is left out of the
sums that judge it. The score adds the site's log odds, beyond the global ones, to the document's.

Defined cases: null text counts as empty; a null source or lang is a site of its own; null ids and
repeated rows are documents of their own; without labels of both kinds all evidence is 0.5;
other columns are ignored or, in ``keep_good``, passed through; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh, held_out, materialize, table

MAX_LABELLED = 6000
SITE_WEIGHT = 0.5
THRESHOLD = 0.5
BROADCAST_SITES = 50_000
SEED = 5
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")
#: Marks that are rare in prose (fixed values).
ODD = "#$%&*|<>{}[]=_~^\\!@"
NAMES = ("words", "word_length", "odd", "upper", "digits", "unique", "lines", "repeated_lines", "top_word", "short_lines", "ends", "letters")


def features(text: str | None) -> list[float]:
    t = text or ""
    n = max(1, len(t))
    words = t.split()
    w = max(1, len(words))
    lines = [x for x in t.split("\n") if x.strip()]
    m = max(1, len(lines))
    counts = Counter(words)
    odd = sum(map(t.count, ODD))
    return [
        float(np.log1p(len(words))),
        min(30.0, sum(map(len, words)) / w),
        odd / n,
        len(UPPER.findall(t)) / n,
        len(DIGIT.findall(t)) / n,
        len(counts) / w,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / m,
        max(counts.values(), default=0) / w,
        sum(len(x) < 30 for x in lines) / m,
        (t.count(".") + t.count("?")) / w,
        min(20.0, n / w),
    ]


def expand(x: np.ndarray) -> np.ndarray:
    """Statistics, their squares and products with the two that matter most in themselves."""
    return np.concatenate([x, x * x, x[:, :1] * x, x[:, 2:3] * x], axis=1)


def train(texts: list[str], labels: list[int], rounds: int = 400) -> dict | None:
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        return None
    raw = np.array([features(t) for t in texts])
    mean, std = raw.mean(0), raw.std(0) + 1e-6
    x = expand(np.clip((raw - mean) / std, -5, 5))
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * weight) / len(y) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return {"mean": mean, "std": std, "w": w}


def evidence(model: dict | None, texts: list) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    x = expand(np.clip((np.array([features(t) for t in texts]) - model["mean"]) / model["std"], -5, 5))
    return 1 / (1 + np.exp(-np.clip(x @ model["w"][:-1] + model["w"][-1], -12, 12)))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict | None:
    lab = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IN (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64(F.lit(SEED), "id")
    some = lab.where(~held_out(F.col("id"))).orderBy(order, "id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "id").orderBy(order, "id", "text").toLocalIterator()
    texts, y, size = [], [], 0
    for r in rows:
        texts.append(r["text"] or "")
        y.append(r["quality"])
        size += len(texts[-1])
        if size > 4000 * most:
            break
    return train(texts, y)


def _scorer(at: int, model: dict | None):
    def run(batches):
        for b in batches:
            p = evidence(model, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(p, pa.float64())], names=[f"c{i}" for i in range(b.num_columns)])

    return run


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5))
    return F.log(q / (1 - q))


def _strength() -> Column:
    """Pseudo-counts of the prior, over sites (n, total, squares, prior): within-site variance over between-site variance."""
    within = F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    between = F.sum(F.col("n") * F.pow(F.col("total") / F.col("n") - F.col("prior"), 2)) / F.sum("n") - within * F.count(F.lit(1)) / F.sum("n")
    return F.least(F.greatest(within / F.greatest(between, F.lit(1e-6)), F.lit(1.0)), F.lit(1e4))


def posteriors(rows: DataFrame, weight: float = SITE_WEIGHT) -> DataFrame:
    """rows: doc_id, host, path, evidence. Adds host_posterior, path_posterior and score."""
    spark = rows.sparkSession
    paths = materialize(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("total"), F.sum(F.col("evidence") * F.col("evidence")).alias("squares")), "paths")
    hosts = materialize(paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares"))), "hosts")
    whole = hosts.agg(F.sum("total") / F.sum("n")).first()[0]
    if whole is None:
        return spark.createDataFrame([], T.StructType([*rows.schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("host_posterior", "path_posterior", "score"))]))
    k_host = hosts.withColumn("prior", F.lit(whole)).agg(_strength()).first()[0]
    host = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("total").alias("ht"))
    sites = paths.join(host, F.col("host").eqNullSafe(F.col("h")))
    k_path = sites.withColumn("prior", (F.col("ht") + k_host * whole) / (F.col("hn") + k_host)).agg(_strength()).first()[0]
    site = bounded(materialize(sites.select("h", F.col("path").alias("p"), F.col("n").alias("pn"), F.col("total").alias("pt"), "hn", "ht"), "sites"), BROADCAST_SITES)
    both = rows.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    e = F.col("evidence")
    host_post = (F.col("ht") - e + k_host * whole) / (F.col("hn") - 1 + k_host)
    both = both.withColumn("host_posterior", host_post).withColumn("path_posterior", (F.col("pt") - e + k_path * F.col("host_posterior")) / (F.col("pn") - 1 + k_path))
    z = logit(e) + F.lit(weight) * (logit(F.col("path_posterior")) - logit(F.lit(whole)))
    return both.withColumn("score", 1 / (1 + F.exp(-z))).select(*rows.columns, "host_posterior", "path_posterior", "score")


def assess(docs: DataFrame, model: dict | None, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """One row per document: doc_id, host, path, evidence, host_posterior, path_posterior, score, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("source") if host is None else host).cast("string").alias("host"), (F.col("lang") if path is None else path).cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    scored = materialize(rows.mapInArrow(_scorer(3, model), "doc_id long, host string, path string, evidence double"), "evidence")
    return posteriors(scored).withColumn("kept", F.col("score") >= THRESHOLD)


def keep_good(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with their own columns. Rows without an id stay."""
    name = fresh(docs, "id")
    bad = assess(docs, model).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id") == F.col(name), "left_anti")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assess(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", F.col("evidence"), "host_posterior", "path_posterior", "score", "kept")
