"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors are dealt by descending length and packed into blocks of rows of like length. A block
scores a block of queries by the leading rotated coordinates first; a candidate goes on to the
full, exact integer product only if that partial sum plus the product of both residual lengths
(Cauchy-Schwarz) can reach the query's k-th best score. The rotation comes from the Gram matrix,
which is summed by partition, so that it covers all vectors and has the size of one matrix.

A first pass over the block of the longest vectors gives every query a floor: the k-th best score
there. Queries are packed into blocks by floor over length, which is the length that a candidate
needs at least; a block of candidates is sent to no query block whose needs are all above its
longest vector, so what is sent grows with the pairs that survive the bound. A query block's
candidate blocks are salted over tasks of GROUP blocks, each of which works from the longest on and
raises the floors as it goes; at most k rows for a query and task come out.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
those without components or with a null id; a vector is compared with those of its own length only;
repeated rows of an id are queries and candidates of their own, and only the query's own row is left
out; ties go to the smaller id; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shuffles, table

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Bytes of a block's components as doubles; rows of a block of queries; blocks of candidates of a task.
BLOCK_BYTES = 2 << 20
QUERY_BLOCK = 4096
GROUP = 32
#: Candidates that are scored at once.
STEP = 512
#: Summed Gram matrices that the driver gets at most.
GRAM_PARTS = 16
SLACK = 1e-6
BLOB = "bid long, kind string, ids binary, vectors binary, asks binary, top double"
ASKED = "rid long, query_id long, v binary, least double, need double"
ASKED_BLOB = "qid long, rids binary, ids binary, vectors binary, floors binary, need double"
FOUND = "rid long, query_id long, vec_id long, score long"


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<double>, norm2) of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    out = rows.where(F.coalesce(ok, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _gram(dim: int):
    def run(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim)
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

    return run


def _matrix(col, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all rows, by falling singular value (from the summed Gram matrix)."""
    # partial matrices are added in the cluster first; the driver gets at most GRAM_PARTS of them
    parts = vectors.select("v").mapInArrow(_gram(dim), "g binary").repartition(GRAM_PARTS).mapInArrow(_add(dim), "g binary")
    total = np.zeros((dim, dim))
    for row in parts.collect():
        total += np.frombuffer(row[0]).reshape(dim, dim)
    return np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])


def _add(dim: int):
    def run(batches):
        g = np.zeros((dim, dim))
        for b in batches:
            for x in b.column(0).to_pylist():
                g += np.frombuffer(x).reshape(dim, dim)
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

    return run


def _own_id(n: int) -> int:
    """A number for the n-th block of this task; blocks are written before anything refers to them."""
    return (TaskContext.get().partitionId() << 24) + n


def _kind(m: np.ndarray) -> str:
    """The smallest type that holds the (whole) components."""
    most = np.abs(m).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def _chunks(batches, rows: int, columns) -> Iterable[list[np.ndarray]]:
    """Columns of the batches (as arrays) in chunks of ``rows`` rows."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append(columns(b))
        n += b.num_rows
        if n >= rows:
            now = [np.concatenate(c) for c in zip(*held, strict=True)]
            for at in range(0, n - rows + 1, rows):
                yield [c[at : at + rows] for c in now]
            held, n = [[c[n - n % rows :] for c in now]], n % rows
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _pack(dim: int, rows: int):
    """Blocks of the partition's rows, which come by falling length."""

    def run(batches):
        columns = lambda b: [np.asarray(b.column(0).to_numpy(zero_copy_only=False), np.int64), _matrix(b.column(1), dim), np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)]
        for n, (ids, m, asks) in enumerate(_chunks(batches, rows, columns)):
            kind = _kind(m)
            values = [_own_id(n)], [kind], [ids.tobytes()], [m.astype(kind).tobytes()], [asks.tobytes()], [float(np.sqrt((m * m).sum(1).max()))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["bid", "kind", "ids", "vectors", "asks", "top"])

    return run


def _block(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, row numbers and ids of a packed block."""
    ids = np.frombuffer(row["ids"], np.int64)
    return np.frombuffer(row["vectors"], row["kind"]).reshape(-1, dim).astype(np.float64), (row["bid"] << 24) + np.arange(len(ids)), ids


class Search:
    """The k best of the candidates seen so far for some queries."""

    def __init__(self, q: np.ndarray, rids: np.ndarray, floor: np.ndarray, rot: np.ndarray, k: int) -> None:
        self.q, self.rids, self.best, self.rot, self.k = q, rids, floor.copy(), rot, k
        dim = rot.shape[0]
        self.cuts = sorted({max(1, dim // 8), max(1, dim // 3)})
        self.turned = q @ rot
        self.length = np.sqrt((q * q).sum(1))
        self.rest = [np.sqrt((self.turned[:, h:] ** 2).sum(1)) for h in self.cuts]
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, id, score

    def add(self, c: np.ndarray, rids: np.ndarray, ids: np.ndarray) -> None:
        length = np.sqrt((c * c).sum(1))
        order = np.argsort(-length, kind="stable")
        c, rids, ids, length = c[order], rids[order], ids[order], length[order]
        if not self._live(length[0]).any():
            return
        turned = c @ self.rot
        rest = [np.sqrt((turned[:, h:] ** 2).sum(1)) for h in self.cuts]
        for at in range(0, len(c), STEP):
            live = np.flatnonzero(self._live(length[at]))
            if not len(live):
                return  # all that follow are shorter
            part = slice(at, at + STEP)
            self._score(live, c[part], turned[part], rids[part], ids[part], length[part], [r[part] for r in rest])

    def _live(self, length: float) -> np.ndarray:
        return self.length * length * (1 + SLACK) + SLACK >= self.best

    def _score(self, live, c, turned, rids, ids, length, rest) -> None:
        partial, lo = 0.0, 0
        room = SLACK * (1 + np.outer(self.length[live], length))
        cols = np.arange(len(c))
        for h, q_rest, c_rest in zip(self.cuts, self.rest, rest, strict=True):
            partial = partial + self.turned[live, lo:h] @ turned[cols, lo:h].T
            ok = partial + np.outer(q_rest[live], c_rest[cols]) + room >= self.best[live, None]
            rows, some = ok.any(1), ok.any(0)
            live, cols, partial, room, lo = live[rows], cols[some], partial[rows][:, some], room[rows][:, some], h
            ok = ok[rows][:, some]
            if not len(live):
                return
        # whole products of whole numbers: exact in doubles
        score = self.q[live] @ c[cols].T
        ok &= (score >= self.best[live, None]) & (rids[cols] != self.rids[live, None])
        if ok.sum() > 4 * self.k * len(live) and len(cols) > self.k:
            # only what is among the k best of this part, ties included
            own = np.where(ok, score, -np.inf)
            ok &= score >= np.partition(own, -self.k, axis=1)[:, -self.k, None]
        at, j = np.nonzero(ok)
        if len(at):
            self._keep(live[at], ids[cols[j]], score[at, j])

    def _keep(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        at, ids, score = (np.concatenate(x) for x in zip(self.found, (at, ids, score), strict=True))
        rank = np.lexsort((ids, -score, at))
        at, ids, score = at[rank], ids[rank], score[rank]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        nth = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        kth = nth == self.k - 1
        self.best[at[kth]] = np.maximum(self.best[at[kth]], score[kth])
        self.found = tuple(x[nth < self.k] for x in (at, ids, score))


def _floors(dim: int, rot: np.ndarray, k: int, longest: dict):
    """A row for each query of a block: its vector, its k-th best score in the block of the longest vectors, and the
    length that a candidate needs."""
    first = _block(longest, dim)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                q, rids, ids = _block(row, dim)
                at = np.flatnonzero(np.frombuffer(row["asks"], bool))
                if not len(at):
                    continue
                search = Search(q[at], rids[at], np.full(len(at), -np.inf), rot, k)
                search.add(*first)
                known = np.bincount(search.found[0], minlength=len(at)) >= k
                least = np.where(known, search.best, -np.inf)
                need = np.where(least > 0, least / np.maximum(search.length, 1e-300), -np.inf)
                cols = [pa.array(rids[at]), pa.array(ids[at]), pa.array([x.tobytes() for x in q[at]], pa.binary()), pa.array(least), pa.array(need)]
                yield pa.RecordBatch.from_arrays(cols, names=["rid", "query_id", "v", "least", "need"])

    return run


def _pack_queries(dim: int, rows: int):
    def run(batches):
        columns = lambda b: [np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1)] + [np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(-1, dim)] + [np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in (3, 4)]
        for n, (rids, ids, v, floors, need) in enumerate(_chunks(batches, rows, columns)):
            yield pa.RecordBatch.from_arrays([pa.array([_own_id(n)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (rids, ids, v, floors)), pa.array([float(need.min())])], names=["qid", "rids", "ids", "vectors", "floors", "need"])

    return run


def _meet(dim: int, rot: np.ndarray, k: int):
    """A block of queries and the candidate blocks of a task, the longest first."""

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if asked.num_rows and blocks.num_rows:
            one = asked.to_pylist()[0]
            rids, ids = (np.frombuffer(one[c], np.int64) for c in ("rids", "ids"))
            search = Search(np.frombuffer(one["vectors"]).reshape(-1, dim), rids, np.frombuffer(one["floors"]), rot, k)
            order = np.argsort(-blocks.column("top").to_numpy(), kind="stable")
            for i in order.tolist():
                search.add(*_block(blocks.slice(i, 1).to_pylist()[0], dim))
            at, found, score = search.found
            out = [rids[at], ids[at], found, score.astype(np.int64)]
        return pa.table(dict(zip(("rid", "query_id", "vec_id", "score"), out, strict=True)))

    return run


def top_k(rows: DataFrame, query: Callable[[Column], Column], k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", block: int | None = None, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query: a condition on the id column that names the queries. Returns query_id, rank, vec_id, score.

    The search runs once for each length of vectors that occurs.
    """
    spark = rows.sparkSession
    vectors = quantised(rows, id_col, vector_col, scale)
    dims = sorted(r["dim"] for r in vectors.select(F.size("v").alias("dim")).where("dim > 0").distinct().collect())
    found = [_found(vectors.where(F.size("v") == dim), query, k, dim, block or max(64, BLOCK_BYTES // (8 * dim)), query_block) for dim in dims]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionAll(more)
    w = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _found(vectors: DataFrame, query: Callable[[Column], Column], k: int, dim: int, block: int, query_block: int) -> DataFrame:
    """The k best rows that each task found for a query, of vectors of one length."""
    spark = vectors.sparkSession
    parts = shuffles(spark)
    by_length = vectors.repartitionByRange(parts, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    asks = F.coalesce(query(F.col("vec_id")), F.lit(False))
    blocks = materialize(by_length.select("vec_id", "v", asks.alias("asks")).mapInArrow(_pack(dim, block), BLOB), "blocks")
    rot = rotation(vectors, dim)
    longest = blocks.orderBy(F.desc("top"), "bid").first().asDict()  # one block
    asked = materialize(blocks.mapInArrow(_floors(dim, rot, k, longest), ASKED), "queries")
    n = asked.count()
    by_need = asked.repartitionByRange(max(1, -(-n // query_block)), "need", "rid").sortWithinPartitions("need", "rid")
    packed = materialize(by_need.mapInArrow(_pack_queries(dim, query_block), ASKED_BLOB), "query-blocks")
    # two numbers for each block of queries, by rising need: a block of candidates goes to the first ones
    needs = sorted((r["need"], r["qid"]) for r in packed.select("need", "qid").collect())
    salts = max(1, -(-blocks.count() // GROUP))
    reach = F.size(F.filter(F.array(*(F.lit(x) for x, _ in needs)), lambda x: x <= F.col("top") * (1 + SLACK) + SLACK)) if needs else F.lit(0)
    dealt = blocks.withColumn("q", F.explode(F.slice(F.array(*(F.lit(q) for _, q in needs)).cast("array<long>"), F.lit(1), reach))).withColumn("s", F.pmod(F.xxhash64("bid"), F.lit(salts)))
    salted = packed.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("s", F.col("s").cast("long")).withColumnRenamed("qid", "q")
    left, right = salted.select("q", "s", "rids", "ids", "vectors", "floors"), dealt.select("q", "s", "bid", "kind", "ids", "vectors", "top")
    return left.groupBy("q", "s").cogroup(right.groupBy("q", "s")).applyInArrow(_meet(dim, rot, k), FOUND)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % QUERY_EVERY == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
