"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (its letters, lower case) and its prefixes hash to rows of an embedding, whose sum is the
word's vector; filters of several widths run
over the sequence, each filter's maximum over the whole text goes to a logistic layer. Because a
filter is a sum over its offsets, each (offset, filter) product is a table by word, and
scoring a text is a gather, an add and a maximum. The decision threshold is calibrated for each
language, which is guessed from the text's own function words and never from a column, and is
folded into the score, so that 0.5 is the threshold for every text.

Training rows are bounded: at most MAX_POSITIVE and MAX_NEGATIVE labelled documents (by a hash of
their id) and MAX_WORDS words of whole texts; everything else covers all rows.

Defined cases: null and empty texts get the score of a text without any word; null ids are held
out; a null label is none, and of several labels for an id the highest counts; without labels of
both kinds every score is 0; repeated rows score alike; other columns are ignored or, in
``drop_toxic``, passed through; an empty table gives none.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held_out, table, with_fields

MARKS = re.compile(r"[\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7)
BUCKETS = 1 << 15
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
EPOCHS = 6
MAX_POSITIVE = 1500
MAX_NEGATIVE = 2500
MAX_WORDS = 2_000_000
SEED = 7
#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "in", "that", "is", "was", "for", "it", "with", "on", "are", "this", "from"),
    "de": ("der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "nicht", "ein", "eine", "des", "dem", "sich"),
    "fr": ("le", "les", "et", "des", "du", "une", "est", "pour", "qui", "dans", "sur", "pas", "par", "au", "avec"),
    "es": ("el", "los", "que", "las", "por", "con", "se", "del", "su", "para", "al", "lo", "como", "y", "es"),
}


class Words(dict):
    """Lower-case token -> row. A row's features are the hashed word (letters only) and its hashed prefixes, so that
    a word never seen still shares rows with its stem; row 0 is the padding and stands for tokens without letters."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[list[int]] = []
        self.rows = 1

    def __missing__(self, token: str) -> int:
        w = MARKS.sub("", token)
        if not w:
            self[token] = 0
            return 0
        self.new.append(features(w))
        at = self[token] = self.rows
        self.rows += 1
        return at

    def encode(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else ()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def features(word: str) -> list[int]:
    """Buckets from 1 on, 0 where a word is too short for a prefix."""
    out = [1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)]
    for k in PREFIXES:
        out.append(1 + zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), k) % (BUCKETS - 1) if len(word) > k else 0)
    return out


def language_table() -> np.ndarray:
    """Bucket -> number of its language, 0 for none."""
    out = np.zeros(BUCKETS, np.int8)
    for i, words in enumerate(FUNCTION_WORDS.values(), 1):
        out[[features(w)[0] for w in words]] = i
    return out


@dataclass
class Model:
    table: np.ndarray  # what a bucket adds to each (width, offset, filter)
    bias: list[np.ndarray]  # by width
    out: np.ndarray
    out_bias: float
    shift: np.ndarray  # by guessed language
    languages: np.ndarray


class Scorer:
    """A model with the rows of the words met so far; forgets them when there are many."""

    def __init__(self, model: Model, most: int = 200_000) -> None:
        self.model, self.most = model, most
        self.reset()

    def reset(self) -> None:
        self.words = Words()
        self.rows = np.zeros((4096, self.model.table.shape[1]), np.float32)
        self.langs = np.zeros(4096, np.int8)

    def ids(self, text: str | None) -> np.ndarray:
        if self.words.rows > self.most:
            self.reset()
        ids = self.words.encode(text)
        if self.words.new:
            n, f = self.words.rows, np.asarray(self.words.new, np.int32)
            while n > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.langs = np.concatenate([self.langs, np.zeros_like(self.langs)])
            for at in range(0, len(f), 8192):
                part = f[at : at + 8192]
                lo = n - len(f) + at
                self.rows[lo : lo + len(part)] = self.model.table[part].sum(1)
                self.langs[lo : lo + len(part)] = self.model.languages[part[:, 0]]
            self.words.new = []
        return ids

    def raw(self, ids: np.ndarray) -> float:
        """The logit of a text; long texts go through in pieces that overlap by the widest filter."""
        m, n, step = self.model, len(ids), 8192
        best = None
        for at in range(0, n, step):
            piece = ids[at : at + step + len(WIDTHS) - 1]
            size = min(step, n - at)
            if len(piece) < size + len(WIDTHS) - 1:
                piece = np.concatenate([piece, np.zeros(size + len(WIDTHS) - 1 - len(piece), np.int32)])
            x, col, parts = self.rows.take(piece, axis=0), 0, []
            for k in WIDTHS:
                acc = x[:size, col : col + FILTERS]
                for j in range(1, k):
                    acc = acc + x[j : j + size, col + j * FILTERS : col + (j + 1) * FILTERS]
                parts.append(acc.max(0))
                col += k * FILTERS
            now = np.concatenate(parts)
            best = now if best is None else np.maximum(best, now)
        if best is None:
            return float(m.out_bias)
        return float(np.maximum(best + np.concatenate(m.bias), 0) @ m.out + m.out_bias)

    def language(self, ids: np.ndarray) -> int:
        votes = np.bincount(self.langs[ids], minlength=len(FUNCTION_WORDS) + 1)[1:]
        return int(votes.argmax()) + 1 if votes.any() else 0

    def score(self, text: str | None) -> float:
        ids = self.ids(text)
        z = self.raw(ids) - self.model.shift[self.language(ids)]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], labels: list[int], seed: int = SEED, epochs: int = EPOCHS, informed: bool = True) -> Model | None:
    """informed: the first embedding coordinate starts from log odds and half of the filters on it (else all at random)."""
    y = np.asarray(labels, np.float32)
    if len(set(labels)) < 2:
        return None
    rng, words = np.random.default_rng(seed), Words()
    docs = [words.encode(t) for t in texts]
    feats = np.concatenate([np.zeros((1, 1 + len(PREFIXES)), np.int32), np.asarray(words.new, np.int32).reshape(-1, 1 + len(PREFIXES))])
    fold = rng.random(len(docs)) < 0.2
    fit = np.flatnonzero(~fold)
    if len(set(y[fit])) < 2:
        fit = np.arange(len(docs))
    # first embedding coordinate: smoothed log odds of a bucket between both classes of the fitted rows
    df = np.zeros((2, BUCKETS))
    for i in fit:
        df[int(y[i]), np.unique(feats[docs[i]])] += 1
    n = np.array([(y[fit] == 0).sum(), (y[fit] == 1).sum()])
    odds = np.log((df[1] + 0.3) / (n[1] + 0.6)) - np.log((df[0] + 0.3) / (n[0] + 0.6))
    trust = df.sum(0) / (df.sum(0) + 4)
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    if informed:
        emb[:, 0] = np.clip(odds * trust, -1, 4) / 2
    emb[0] = 0
    w = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    for x in w if informed else ():
        x[:, 0, : FILTERS // 2] += 0.8 / len(x)
    bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
    b0 = np.float32(-1.0)
    moments: dict[str, list] = {}

    def adam(name: str, p: np.ndarray, g: np.ndarray, step: int, rate: float) -> None:
        m = moments.setdefault(name, [np.zeros_like(p), np.zeros_like(p)])
        m[0] += 0.1 * (g - m[0])
        m[1] += 0.01 * (g * g - m[1])
        p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)

    g2 = np.full((BUCKETS, 1), 1e-2, np.float32)
    weight = np.where(y == 1, len(fit) / (2 * max(1, n[1])), len(fit) / (2 * max(1, n[0]))).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), 32):
            batch = [i for i in order[at : at + 32] if len(docs[i])]
            if not batch:
                continue
            step += 1
            gw, gb, go, g0 = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in bias], np.zeros_like(out), 0.0
            rows, grads = [], []
            for i in batch:
                ids = np.concatenate([docs[i], np.zeros(len(WIDTHS) - 1, np.int32)])
                m = len(docs[i])
                e = emb[feats[ids]].sum(1)
                best, where = [], []
                for k, x in enumerate(w):
                    acc = e[:m] @ x[0]
                    for j in range(1, len(x)):
                        acc += e[j : j + m] @ x[j]
                    a = acc.argmax(0)
                    where.append(a)
                    best.append(acc[a, np.arange(FILTERS)] + bias[k])
                pre = np.concatenate(best)
                h = np.maximum(pre, 0)
                z = h @ out + b0
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(batch)
                go += d * h
                g0 += d
                dh = d * out * (pre > 0)
                for k, x in enumerate(w):
                    dk = dh[k * FILTERS : (k + 1) * FILTERS]
                    gb[k] += dk
                    for j in range(len(x)):
                        pos = where[k] + j
                        gw[k][j] += (e[pos] * dk[:, None]).T
                        f = feats[ids[pos]]
                        rows.append(f.ravel())
                        grads.append(np.repeat((x[j] * dk).T, f.shape[1], axis=0))
            for k in range(len(w)):
                adam(f"w{k}", w[k], gw[k], step, 0.01)
                adam(f"b{k}", bias[k], gb[k], step, 0.01)
            adam("o", out, go + 1e-4 * out, step, 0.01)
            b0 -= 0.2 * g0
            r, g = np.concatenate(rows), np.concatenate(grads)
            u, inv = np.unique(r, return_inverse=True)
            acc = np.zeros((len(u), DIM), np.float32)
            np.add.at(acc, inv, g)
            g2[u] += (acc * acc).mean(1, keepdims=True)
            emb[u] -= 0.05 * acc / np.sqrt(g2[u])
            emb[0] = 0
    table_ = np.concatenate([emb @ x[j] for x in w for j in range(len(x))], axis=1)
    model = Model(table_, bias, out, float(b0), np.zeros(len(FUNCTION_WORDS) + 1), language_table())
    scorer = Scorer(model)
    cal = np.flatnonzero(fold) if len(set(y[fold])) > 1 else np.arange(len(docs))
    raw, langs = np.zeros(len(cal)), np.zeros(len(cal), int)
    for n_, i in enumerate(cal):
        one = scorer.ids(texts[i])
        raw[n_], langs[n_] = scorer.raw(one), scorer.language(one)
    whole = best_cut(raw, y[cal])
    for g in range(len(model.shift)):
        own = langs == g
        pos = int((y[cal][own] == 1).sum())
        lean = pos / (pos + 20)  # a language with few rows leans on the cut of all
        model.shift[g] = lean * best_cut(raw[own], y[cal][own]) + (1 - lean) * whole if pos and pos < own.sum() else whole
    return model


def best_cut(raw: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest stretch of thresholds that make the fewest weighted errors; a clean text called toxic counts double."""
    order = np.argsort(raw)
    r, t = raw[order], y[order]
    miss = np.concatenate([[0], np.cumsum(t)])
    false = (1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)])
    cost = miss + 2 * false
    at = np.flatnonzero(cost == cost.min())
    edges = np.concatenate([[r[0] - 1], r, [r[-1] + 1]])
    widths = edges[at + 1] - edges[at]
    i = at[int(widths.argmax())]
    return float((edges[i] + edges[i + 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, max_positive: int, max_negative: int) -> tuple[list[str], list[int]]:
    lab = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    lab = lab.where(~held_out(F.col("id")))
    order = F.xxhash64(F.lit(SEED), "id")
    some = lab.where("toxic = 1").orderBy(order, "id").limit(max_positive).unionByName(lab.where("toxic = 0").orderBy(order, "id").limit(max_negative))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), "id").orderBy(order, "id", "text").toLocalIterator()
    texts, y, words = [], [], 0
    for r in rows:
        texts.append(r["text"] or "")
        y.append(r["toxic"])
        words += len(texts[-1]) // 6
        if words > MAX_WORDS:
            break
    return texts, y


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Model | None:
    return train(*training_rows(docs, labels, max_positive, max_negative))


def _scorer(at: int, model: Model | None):
    def run(batches):
        scorer = Scorer(model) if model else None
        for batch in batches:
            scores = [scorer.score(t) if scorer else 0.0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*(f"c{i}" for i in range(batch.num_columns)), "score"])

    return run


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", name: str | None = None) -> DataFrame:
    """docs with one more column, the score."""
    schema = with_fields(docs.schema, T.StructField(name or fresh(docs, "score"), T.DoubleType()))
    return docs.mapInArrow(_scorer(docs.columns.index(text_col), model), schema)


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    name = fresh(docs, "score")
    return scored(docs, model, name=name).where(F.col(name) < threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model, name="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
