"""Packing token sequences: best-fit decreasing with a segment tree over remaining capacity.

Each document is tokenised once, ended by an end id and cut into full windows and one remainder;
a piece's checksum is taken there, so ids never go through a shuffle. Pieces are dealt by hash
and each task packs its remainders, longest first, into the tightest open window that can hold
them. Tasks are few enough for their windows to fill well.

Defined cases: null or empty text is the end id alone; repeated rows and null ids are documents
of their own; ties go by id, then checksum; any other column is ignored; an empty table gives none.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize, shuffles, table

WINDOW = 2048
END_ID = 1
#: Pieces that one packing task gets, on average, at least (fewer tasks fill windows better).
PIECES_PER_TASK = 50_000
SPECIAL = "<|endoftext|>"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=2)
def _coders(vocabulary: str):
    """(fast coder, reference coder) for a byte-level vocabulary file; the fast one reads the same ranks."""
    slow = Tokenizer.from_file(vocabulary)
    ranks_file = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_file):
        return None, slow
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), slow


def token_ids(text: str, vocabulary: str) -> np.ndarray:
    """The tokenizer's ids. The rank-based coder gives the same ids some four times as fast; texts that hold
    a special token's own string, or that its pattern engine refuses, go to the reference coder."""
    fast, slow = _coders(vocabulary)
    if fast is not None and SPECIAL not in text:
        try:
            return fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as e:  # the engine panics on some very long runs, which is no Exception and has no public name
            if type(e).__name__ != "PanicException":
                raise
    return np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _pieces(vocabulary: str, window: int, end_id: int):
    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text or "", vocabulary).astype("<u4", copy=False), np.uint32(end_id)).astype("<u4", copy=False)
                n = len(ids)
                for s in range(0, n, window):
                    e = min(n, s + window)
                    for col, x in zip(out, (doc, s, e - s, zlib.crc32(ids[s:e].tobytes()), n), strict=True):
                        col.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class CapacityTree:
    """Segment tree over remaining capacities 0..window: which of them have open windows."""

    def __init__(self, window: int) -> None:
        self.base = 1 << (window).bit_length()
        self.has = [False] * (2 * self.base)
        self.open: list[list] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, item) -> None:
        self.open[capacity].append(item)
        at = self.base + capacity
        while at and not self.has[at]:
            self.has[at] = True
            at >>= 1

    def take(self, size: int):
        """(capacity, item) of the tightest open window with room for ``size``, or None."""
        at = self.base + size
        if not self.has[at]:
            while at > 1 and not (at & 1 == 0 and self.has[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if self.has[2 * at] else 2 * at + 1
        capacity = at - self.base
        item = self.open[capacity].pop()
        if not self.open[capacity]:
            self.has[at] = False
            while at > 1:
                at >>= 1
                self.has[at] = self.has[2 * at] or self.has[2 * at + 1]
        return capacity, item


def best_fit(lengths, window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """Sequence and offset of each piece, given longest first, and the number of sequences."""
    tree, seqs, offsets, n = CapacityTree(window), [], [], 0
    for size in lengths:
        if found := tree.take(size):
            room, seq = found
        else:
            room, seq, n = window, n, n + 1
        seqs.append(seq)
        offsets.append(window - room)
        if room > size:
            tree.add(room - size, seq)
    return seqs, offsets, n


def _packer(window: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        tree, n = CapacityTree(window), 0
        for batch in batches:
            seqs, offsets = [], []
            for size in batch.column(2).to_pylist():
                if found := tree.take(size):
                    room, seq = found
                else:
                    room, seq, n = window, n, n + 1
                seqs.append((task << 40) | seq)
                offsets.append(window - room)
                if room > size:
                    tree.add(room - size, seq)
            cols = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(vocabulary, window, end_id), PIECE), "pieces")
    tasks = max(1, min(shuffles(spark), pieces.count() // pieces_per_task))
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "doc_tokens", "ids_crc32", "start")).sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.mapInArrow(_packer(window), f"{PIECE}, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
