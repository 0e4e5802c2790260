"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints of word shingles are linked at few differing bits. Different fingerprints are dealt
by masked bit patterns: of four blocks of 16 bits, two must agree if at most two bits differ, so
each fingerprint goes to the six buckets of its block pairs. A bucket is sorted by Gray rank; a
tree over that order factors shared bit patterns into its upper nodes, and pairs of nodes are
expanded downwards while their accumulated differences stay within the limit. Whole groups are
pruned by those sums, or because all their members are in one component already. A bucket
emits a spanning forest (a link to the smallest member for each fingerprint), never all pairs.

Copies meet before any of this: equal fingerprints are one row, aggregated on the map side.
Documents get their component on (fingerprint, salt), the salt being made from their id, so that
a fingerprint that a third of all documents share is spread over many tasks.

Defined cases: null and empty texts have fingerprint zero, which links like any other; null ids
never name a component unless all of its ids are null; repeated rows are documents of their own;
other columns are ignored or, in ``near_kept``, passed through; an empty table gives none.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, one_of_each, shuffles, table
from .components import components

BITS = 64
BLOCKS = 4
MAX_DIFF = 2
SHINGLE = 3
SEED = 42
SALTS = 64
#: Leading bits of a node, by level of the tree.
LEVELS = tuple(range(0, BITS + 1, 8))
#: Pairs of nodes or members that are expanded at once.
FRONTIER = 1 << 20


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if over half of the shingles' hashes have it."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    n = max(1, len(tokens) - words + 1)
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), "<u8", n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 32768):
        counts += np.unpackbits(h[at : at + 32768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a signed long."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the Gray sequence (each neighbour differs in one bit)."""
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def bit_count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class GrayIndex:
    """Tree over different fingerprints in Gray order; a node is a run that shares its leading bits."""

    def __init__(self, fps: np.ndarray, merged: bool = True, levels: tuple[int, ...] = LEVELS, frontier: int = FRONTIER) -> None:
        """merged: equal fingerprints are one component from the start; levels: only what agrees in the first number of
        leading bits meets, and bits beyond the last aren't looked at; frontier: pairs that are expanded at once."""
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.levels, self.frontier = levels, frontier
        n = len(self.fps)
        self.starts: list[np.ndarray] = []
        for bits in levels:
            head = self.fps >> np.uint64(BITS - bits) if bits else np.zeros(n, np.uint64)
            self.starts.append(np.concatenate([[0], np.flatnonzero(head[1:] != head[:-1]) + 1]).astype(np.int64) if n else np.zeros(0, np.int64))
        runs = self.starts[-1]
        self.label = np.repeat(runs, np.diff(np.append(runs, n))) if merged else np.arange(n)

    def apart(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes have members that aren't all in one component yet."""
        s = self.starts[level]
        low, high = np.minimum.reduceat(self.label, s), np.maximum.reduceat(self.label, s)
        return ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))

    def members(self, a: np.ndarray, b: np.ndarray):
        """Pairs of the members of each pair of leaves that aren't in one component yet, in batches; what a batch merges
        spares the next ones."""
        s = np.append(self.starts[-1], len(self.fps))
        while len(a):
            n = s[b + 1] - s[b]
            size = (s[a + 1] - s[a]) * n
            if size[0] > self.frontier:
                cut, ys = 1, np.arange(s[b[0]], s[b[0] + 1])
                step = max(1, self.frontier // len(ys))
                for r in range(s[a[0]], s[a[0] + 1], step):
                    xs, of = np.arange(r, min(r + step, s[a[0] + 1])), self.label[ys]
                    xs = xs[self.label[xs] != of[0]] if (of == of[0]).all() else xs
                    yield self._open(np.repeat(xs, len(ys)), np.tile(ys, len(xs)))
            else:
                cut = int(np.searchsorted(np.cumsum(size), self.frontier, "right"))
                at = np.repeat(np.arange(cut), size[:cut])
                nth = np.arange(len(at)) - np.repeat(np.cumsum(size[:cut]) - size[:cut], size[:cut])
                yield self._open(s[a[at]] + nth // n[at], s[b[at]] + nth % n[at])
            a, b = a[cut:], b[cut:]
            if len(a):
                on = self.apart(-1, a, b)
                a, b = a[on], b[on]

    def _open(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (x < y) & (self.label[x] != self.label[y])
        return x[ok], y[ok]

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children, by node of a level."""
        down = self.starts[level + 1]
        first = np.searchsorted(down, self.starts[level])
        return first, np.diff(np.append(first, len(down)))

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the components of each pair: hook roots to smaller ones and shorten paths until nothing moves."""
        while True:
            x, y = self.label[a], self.label[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            if (lo == hi).all():
                return
            np.minimum.at(self.label, hi, lo)
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up

    def link(self, most: int, confirm=None) -> np.ndarray:
        """Label of each fingerprint's component at ``most`` differing bits, in Gray order.

        confirm(a, b): which pairs of places are linked, where the bits alone don't decide.
        """
        if len(self.fps) < 2:
            return self.label
        own = np.arange(len(self.starts[0]))
        todo = [(0, own, own, np.zeros(len(own), np.int64))]
        depth = len(self.starts) - 1
        kids = [self.children(i) for i in range(depth)]
        while todo:
            level, a, b, diff = todo.pop()
            # prune groups whose members all have one label already
            open_ = self.apart(level, a, b)
            a, b, diff = a[open_], b[open_], diff[open_]
            if not len(a):
                continue
            if level == depth:
                if confirm is None:
                    self.merge(self.starts[level][a], self.starts[level][b])
                    continue
                for x, y in self.members(a, b):
                    ok = confirm(x, y)
                    self.merge(x[ok], y[ok])
                continue
            first, n = kids[level]
            size = n[a] * n[b]
            if size.sum() > self.frontier and len(a) > 1:
                cut = min(max(1, int(np.searchsorted(np.cumsum(size), self.frontier))), len(a) - 1)
                todo.append((level, a[cut:], b[cut:], diff[cut:]))
                a, b, diff, size = a[:cut], b[:cut], diff[:cut], size[:cut]
            at = np.repeat(np.arange(len(a)), size)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
            x, y = first[a[at]] + nth // n[b[at]], first[b[at]] + nth % n[b[at]]
            down = self.starts[level + 1]
            shift, width = BITS - self.levels[level + 1], self.levels[level + 1] - self.levels[level]
            step = bit_count(((self.fps[down[x]] ^ self.fps[down[y]]) >> np.uint64(shift)) & np.uint64((1 << width) - 1))
            total = diff[at] + step
            ok = (total <= most) & (x <= y)
            if ok.any():
                todo.append((level + 1, x[ok], y[ok], total[ok]))
        return self.label


def _linker(most: int):
    """Rows by key: a spanning forest of each key's fingerprints."""

    def forest(fps: np.ndarray):
        index = GrayIndex(fps)
        label = index.link(most)
        signed = index.fps.view(np.int64)
        own = np.arange(len(signed))
        on = label != own
        return signed[on], signed[label[on]]

    def run(batches):
        key, parts = None, []
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            fps = b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            out_u, out_v = [], []
            bounds = [0, *cuts.tolist(), len(keys)]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if s == e:
                    continue
                if keys[s] == key:
                    parts.append(fps[s:e])
                    continue
                if key is not None and sum(map(len, parts)) > 1:
                    u, v = forest(np.unique(np.concatenate(parts)).view(np.uint64))
                    out_u.append(u)
                    out_v.append(v)
                key, parts = keys[s], [fps[s:e]]
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u), pa.int64()), pa.array(np.concatenate(out_v), pa.int64())], names=["u", "v"])
        if key is not None and sum(map(len, parts)) > 1:
            u, v = forest(np.unique(np.concatenate(parts)).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def links(distinct: DataFrame, most: int = MAX_DIFF) -> DataFrame:
    """(u, v): links that span every component of the fingerprints in column fp.

    With ``most`` = 2 and four blocks, at least two blocks of a linked pair agree.
    """
    if most > BLOCKS - 2:
        raise ValueError(f"at most {BLOCKS - 2} differing bits")
    width = BITS // BLOCKS
    pick = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i)]
    keys = F.array(*(F.lit(n << (2 * width)) + pick[i] * F.lit(1 << width) + pick[j] for n, (i, j) in enumerate(pairs)))
    rows = distinct.select(F.explode(keys).alias("key"), "fp").repartition(shuffles(distinct.sparkSession), "key").sortWithinPartitions("key")
    return rows.mapInArrow(_linker(most), "u long, v long")


def near_components(fps: DataFrame, most: int = MAX_DIFF) -> DataFrame:
    """fps: (doc_id, fp). One row per document: doc_id, fp, component_id."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    docs = fps.select("doc_id", "fp", salt)
    by_salt = materialize(docs.groupBy("fp", "salt").agg(F.min("doc_id").alias("least")), "fingerprints")
    by_fp = by_salt.groupBy("fp").agg(F.min("least").alias("least"))
    roots = components(links(by_fp.select("fp"), most)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    named = by_fp.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    by_name = materialize(named.join(least, F.col("root") == F.col("r")).select("fp", "component_id"), "components")
    spread = by_salt.select("fp", "salt").join(by_name, "fp")
    return docs.join(spread, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def near_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, most: int = MAX_DIFF) -> DataFrame:
    """The documents that stay, with all their columns: one row of each component, that with the smallest id (a row
    without an id only where none has one). Texts are the nodes, so rows that share an id stay apart."""
    text = F.col(f"`{text_col}`").cast("string")
    th = F.xxhash64(F.coalesce(text, F.lit("")))
    fps = materialize(fingerprints(docs.select(th.alias("th"), text.alias("text")), "th", "text", words), "fps")
    roots = near_components(fps, most).select(F.col("doc_id").alias("node"), F.col("component_id").alias("root")).distinct()
    return one_of_each(docs, id_col, th, roots)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = materialize(fingerprints(table(spark, sf_dir, "documents")), "fps")
    return near_components(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
