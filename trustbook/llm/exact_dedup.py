"""Exact deduplication by Grace hashing.

A map step joins equal texts inside each Arrow batch (so a hot text costs one row for a batch
and not one for a document), the shuffle deals what is left by content hash, and each reduce
task runs a recursive Grace hash over spill files: contents go into an open-addressing table
that compares them whole; what does not fit is dealt to files by a hash of the level and every
file is worked off the same way. A text's class is then joined back to its documents on
(digest, salt), where the salt comes from the document's id, so that a hot text is spread.

Defined cases: null text counts as empty, empty texts form one class; a null id sorts after all
others; of rows with the same id and equal text exactly one stays; other columns pass untouched
and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, fresh, shuffles, table, text_of, with_fields

SPACE = re.compile(WS)
SALTS = 64
TABLE_BYTES = 96 << 20
FANOUT = 16


def normalise(text: str | None) -> str:
    return SPACE.sub(" ", text) if text else ""


class OpenTable:
    """Open addressing with linear probing; a hit needs equal content, not only an equal hash."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list[list] = []
        self.size = 0

    def find(self, h: int, content: bytes) -> int:
        """The entry's index, or -1 - (the free slot)."""
        slots, mask = self.slots, len(self.slots) - 1
        at = h & mask
        while (i := slots[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                return i
            at = (at + 1) & mask
        return -1 - at

    def put(self, slot: int, h: int, content: bytes, value: list, size: int) -> None:
        self.slots[slot] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.size += size
        if 3 * len(self.hashes) > 2 * len(self.slots):
            slots = [-1] * (4 * len(self.slots))
            mask = len(slots) - 1
            for i, x in enumerate(self.hashes):
                at = x & mask
                while slots[at] >= 0:
                    at = (at + 1) & mask
                slots[at] = i
            self.slots = slots


def level_hash(content: bytes, level: int) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8, salt=level.to_bytes(4, "little")).digest(), "little")


def grace(records: Iterable[tuple[bytes, list]], merge, limit: int = TABLE_BYTES, level: int = 0, folder: str | None = None) -> Iterator[tuple[bytes, list]]:
    """(content, merged value) for each different content, with about ``limit`` bytes of memory.

    merge(kept, other) changes ``kept``. Once the table is full only contents that it holds are
    merged; all others are dealt to FANOUT files and each file is worked off by itself.
    """
    with tempfile.TemporaryDirectory(prefix="grace-", dir=folder) as own:
        held, files = OpenTable(), {}
        for content, value in records:
            h = level_hash(content, level)
            at = held.find(h, content)
            if at >= 0:
                merge(held.values[at], value)
            elif held.size < limit:
                held.put(-1 - at, h, content, value, 2 * len(content) + 600)
            else:
                part = h >> 60
                if part not in files:
                    files[part] = open(os.path.join(own, f"{part}"), "wb", buffering=1 << 16)  # noqa: SIM115
                pickle.dump((content, value), files[part], protocol=5)
        for f in files.values():
            f.close()
        yield from zip(held.contents, held.values, strict=True)
        del held
        for part in sorted(files):
            yield from grace(_records(os.path.join(own, f"{part}")), merge, limit, level + 1, own)


def _records(path: str) -> Iterator[tuple[bytes, list]]:
    with open(path, "rb") as f:
        os.unlink(path)
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _first(doc_id) -> tuple:
    return (doc_id is None, doc_id if doc_id is not None else 0)


def _combiner(id_at: int, text_at: int, salt_at: int):
    """Per batch: the row of the smallest id of each different text, with count and salts."""

    def run(batches):
        for batch in batches:
            ids, texts, salts = (batch.column(i).to_pylist() for i in (id_at, text_at, salt_at))
            seen: dict[str, list] = {}
            for i, (doc, text, salt) in enumerate(zip(ids, texts, salts, strict=True)):
                e = seen.setdefault(normalise(text), [i, 0, set()])
                e[1] += 1
                e[2].add(salt)
                if _first(doc) < _first(ids[e[0]]):
                    e[0] = i
            if not seen:
                continue
            hashes = [int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little", signed=True) for t in seen]
            rows = batch.take(pa.array([e[0] for e in seen.values()], pa.int64()))
            cols = [rows.column(i) for i in range(rows.num_columns) if i != salt_at]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array([e[1] for e in seen.values()], pa.int64()), pa.array([sorted(e[2]) for e in seen.values()], pa.list_(pa.int32())), pa.array(hashes, pa.int64())],
                names=[f"c{i}" for i in range(len(cols) + 3)],
            )

    return run


def _merge(a: list, b: list) -> None:
    """Values are [id, count, salts, row]; the row of the smaller id stays."""
    if _first(b[0]) < _first(a[0]):
        a[0], a[3] = b[0], b[3]
    a[1] += b[1]
    a[2] = a[2] | b[2]


def _stream(batches, id_at: int, text_at: int, rows: bool):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            cols = [part.column(k).to_pylist() for k in range(part.num_columns)]
            for r in zip(*cols, strict=True):
                yield normalise(r[text_at]).encode(), [r[id_at], r[-3], frozenset(r[-2]), r[:-3] if rows else None]


def _classes(id_at: int, text_at: int, limit: int):
    def run(batches):
        out: list[tuple] = []
        for content, (keep, n, salts, _) in grace(_stream(batches, id_at, text_at, False), _merge, limit):
            sha = hashlib.sha256(content).digest()
            out += [(sha, s, keep, n) for s in sorted(salts)]
            if len(out) >= 8192:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["sha", "salt", "keep_id", "group_size"])


def _kept(id_at: int, text_at: int, limit: int, schema: pa.Schema):
    def run(batches):
        out: list[tuple] = []
        size = 0
        for content, value in grace(_stream(batches, id_at, text_at, True), _merge, limit):
            out.append(value[3])
            size += len(content)
            if size > 8 << 20 or len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Combined rows dealt by content hash: the columns of ``docs``, then count, salts and hash."""
    salt = fresh(docs, "salt")
    schema = with_fields(docs.schema, T.StructField(fresh(docs, "n"), T.LongType()), T.StructField(fresh(docs, "salts"), T.ArrayType(T.IntegerType())), T.StructField(h := fresh(docs, "h"), T.LongType()))
    at = [c for c in docs.columns]
    i, t = at.index(id_col), at.index(text_col)
    rows = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int"))
    return rows.mapInArrow(_combiner(i, t, len(at)), schema).repartition(shuffles(docs.sparkSession), F.col(f"`{h}`")), i, t


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(sha, salt, keep_id, group_size) for each different normalised text and each salt of its documents."""
    rows, i, t = _dealt(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), "doc_id", "text")
    return rows.mapInArrow(_classes(i, t, table_bytes), "sha binary, salt int, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    classes = exact_classes(docs, id_col, text_col, table_bytes)
    norm = F.regexp_replace(text_of(F.col(f"`{text_col}`")), WS, " ")
    members = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("sha"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .groupBy("doc_id", "sha", "salt")
        .agg(F.count(F.lit(1)).alias("m"))
    )
    out = members.join(classes, ["sha", "salt"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows that stay, whole and with all their columns: of each class the one with the smallest id."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows, i, t = _dealt(docs, id_col, text_col)
    return rows.mapInArrow(_kept(i, t, table_bytes, to_arrow_schema(docs.schema)), docs.schema)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
