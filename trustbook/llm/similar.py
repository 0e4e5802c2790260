"""Near-duplicates at a Jaccard similarity of word shingles, for the pipeline's stage.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at
least 0.8. At 0.8 SimHash fingerprints differ in about 15 of 100 bits, too far for one table of
agreeing blocks, so fingerprints are long: FACE bits that every row carries, and a piece of PIECE
bits for each of TABLES tables. Two texts meet in a table if the first KEY bits of their pieces
agree, at most NEAR of the others differ, and at most FAR of the FACE bits. The Gray-order index of
``simhash`` finds that for all buckets of a table, as the levels of its tree begin at KEY bits. A
pair at 0.8 meets in no table with a chance of 3 in 100,000, a closer pair less often; unlike
texts meet twice in 10^9 pairs. Fingerprints of four shingles against five differ most (19 bits of
100), so texts of fewer than FEW shingles have MORE tables, in which MORE_FAR bits may differ.

What the index links makes a candidate group, and a second index finds the links inside it:
fingerprints differing in more than WIDE of 64 bits are pruned by whole subtrees, what is in one
component already isn't looked at again, and every link is confirmed on the shingles themselves.

A group of more than BLOCK texts (or BLOCK_BYTES of text) is dealt to blocks. Its leader, the text
with the most companions in tables, goes to every block, so that all that is like it gathers in one
component. The texts outside that component are then held against all blocks of their group, in
blocks of their own; nothing is left out. Tasks give links that span what they see, never all pairs.

Defined cases: a text of fewer words than a shingle is one shingle; texts without words are copies
of each other; equal texts are one node, named by a 64-bit hash; null ids and repeated rows are
documents like others; an empty table gives none.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, one_of_each, shuffles, text_of
from .components import components
from .simhash import BITS, GrayIndex, bit_count

SHINGLE = 5
SIMILAR = 0.8
FACE = 128
FAR = 38
PIECE = 24
KEY = 10
NEAR = 2
TABLES = 80
#: Below that number of shingles no two texts of an even number are similar unless their shingles are equal.
FEW = 8
MORE = 160
MORE_FAR = 46
WIDE = 28
SEED = 42
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, (FACE + MORE * PIECE) // BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, len(_A), dtype=np.uint64)
_C = np.uint64(0xD6E8FEB86659FD93)
#: A piece, its table's number in front, is at the front of an indexed word; the tree branches every four bits.
PLACE = 32
LEVELS = (*range(PLACE - PIECE + KEY, PLACE, 4), PLACE)
#: What a table holds of a text. Rows travel in packets, one for each slice of buckets that DEALT rows make;
#: TEXTS are read at once.
ROW = np.dtype([("word", "<i4"), ("a", "<u8"), ("b", "<u8"), ("th", "<i8")])
SLICE = 6
DEALT = 1 << 17
TEXTS = 512
#: Rows that are indexed together, if not one slice has more, and pairs that their index expands at once.
ROWS = 1 << 14
FRONTIER = 1 << 17
#: Shingles that are worked on at once.
STEP = 2048
#: Shingles whose bits are counted in a byte each.
COUNTED = 255
#: Texts, and bytes of text, of a block.
BLOCK = 1024
BLOCK_BYTES = 4 << 20
BROADCAST_ROWS = 500_000


def hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles, in order."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    found = [b" ".join(tokens)] if len(tokens) < words else list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), found), "<u8", len(found)))


def fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of shingles: a bit is set if over half of them have it."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), STEP):
        counts += np.unpackbits(h[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def _bits(h: np.ndarray, words: int) -> np.ndarray:
    """Rows of bits, a byte each, that hashes of each hash give."""
    x = h[:, None] * _A[:words] + _B[:words]
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")


def signature(h: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Bytes of a long SimHash: the FACE bits, then a piece for each table. Every 64 bits come from a hash of their own of
    a shingle's hash. Where half of few shingles have a bit, a hash of them all decides: else bits would be rare in texts
    of two or four shingles, which would look alike. From eight on rarity is slight, and ties that near copies share agree."""
    words = (FACE + tables * PIECE) // BITS
    counts = np.zeros(words * BITS, np.int64)
    for at in range(0, len(h), COUNTED):
        counts += _bits(h[at : at + COUNTED], words).view(np.uint64).sum(0).view(np.uint8)
    on = 2 * counts > len(h)
    if 0 < len(h) < FEW:
        whole = np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=SEED)], np.uint64)
        on |= (2 * counts == len(h)) & (_bits(whole, words)[0] > 0)
    return np.packbits(on, bitorder="little")


def pieces(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two words of a text's FACE, and the piece of each table with the table's number in front."""
    tables = MORE if 0 < len(h) < FEW else TABLES
    found = signature(h, tables)
    parts = found[FACE // 8 :].reshape(tables, PIECE // 8).astype(np.uint32)
    word = np.arange(tables, dtype=np.uint32) << np.uint32(PIECE)
    for i in range(PIECE // 8):
        word |= parts[:, i] << np.uint32(8 * i)
    return found[: FACE // 8].view(np.uint64), word.view(np.int32)


def _pieces(words: int):
    """(slice, rows): the rows of the different texts of a batch, in packets."""

    def packets(held):
        rows = np.concatenate(held)
        of = rows["word"].view(np.uint32) >> np.uint32(PIECE - SLICE)
        order = np.argsort(of, kind="stable")
        of, data = of[order], rows[order]
        cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)]])
        ends = pa.py_buffer((cuts * ROW.itemsize).astype(np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, ends, pa.py_buffer(data.view(np.uint8))])
        return pa.RecordBatch.from_arrays([pa.array(of[cuts[:-1]].astype(np.int32)), packed], names=["slice", "rows"])

    def run(batches):
        held, n = [], 0
        for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            for th, text in dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)).items():
                face, word = pieces(hashes(text, words))
                rows = np.empty(len(word), ROW)
                rows["word"], rows["a"], rows["b"], rows["th"] = word, face[0], face[1], th
                held.append(rows)
                n += len(rows)
                if n >= DEALT:
                    yield packets(held)
                    held, n = [], 0
        if held:
            yield packets(held)

    return run


def companions(rows: np.ndarray) -> tuple:
    """(u, v, n) for rows that meet others in their buckets: the text, the smallest of its component (so that tables name
    the same one where they can) and the component's size."""
    word = np.ascontiguousarray(rows["word"]).view(np.uint32)
    index = GrayIndex(word.astype(np.uint64) << np.uint64(BITS - PLACE), merged=False, levels=LEVELS, frontier=FRONTIER)
    a, b, th = (rows[c][index.order] for c in ("a", "b", "th"))
    far = np.where(word[index.order] >> np.uint32(PIECE) < TABLES, FAR, MORE_FAR)
    label = index.link(NEAR, lambda x, y: bit_count(a[x] ^ a[y]) + bit_count(b[x] ^ b[y]) <= far[x])
    size = np.bincount(label, minlength=len(label))[label]
    least = th.copy()
    np.minimum.at(least, label, th)
    on = size > 1
    return th[on], least[label[on]], size[on]


def _companions(batches):
    """Packets in order of their slices to ``companions``, by whole slices."""

    def give():
        found = companions(np.frombuffer(b"".join(held), ROW))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v", "n"])

    now, held, n = None, [], 0
    for batch in batches:
        for of, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if of != now and n >= ROWS:
                yield give()
                held, n = [], 0
            now = of
            held.append(rows)
            n += len(rows) // ROW.itemsize
    if held:
        yield give()


def _grouped(act, keys: int, names: list[str]):
    """Batches sorted by their first ``keys`` columns to what ``act`` makes of the other columns of each key's rows."""

    def run(batches):
        now, parts = None, []
        for b in batches:
            head = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[:keys]], axis=1)
            cuts = np.flatnonzero((head[1:] != head[:-1]).any(1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(head)], strict=True):
                if s == e:
                    continue
                if parts and tuple(head[s]) != now:
                    yield from give(parts)
                    parts = []
                now = tuple(head[s])
                parts.append(pa.Table.from_arrays([c.slice(s, e - s) for c in b.columns[keys:]], names=b.schema.names[keys:]))
        if parts:
            yield from give(parts)

    def give(parts):
        out = act(pa.concat_tables(parts))
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return run


class Shingles:
    """Which of some texts have a shingle, and so how many a text shares with each of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        own = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.known, place = np.unique(own, return_inverse=True)
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(place, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.known)))]).astype(np.int64)

    def similar(self, h: np.ndarray, least: float) -> np.ndarray:
        """Which texts have at least that Jaccard similarity with the shingles ``h``."""
        if not len(h):
            return self.sizes == 0
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        at = at[self.known[at] == h] if len(self.known) else at[:0]
        n = self.first[at + 1] - self.first[at]
        flat = np.arange(n.sum()) + np.repeat(self.first[at] - (np.cumsum(n) - n), n)
        both = np.bincount(self.holders[flat], minlength=len(self.sizes))
        return both >= least * (self.sizes + len(h) - both)


def _forest(words: int, least: float):
    """Links that span the components of a block, whose leader (if it has one) comes marked."""

    def act(rows: pa.Table) -> tuple:
        th = rows.column("th").to_numpy()
        sets = [hashes(t, words) for t in rows.column("text").to_pylist()]
        found = Shingles(sets)
        index = GrayIndex(np.array([fingerprint(s) for s in sets], np.uint64), merged=False)
        order = index.order
        lead = int(np.flatnonzero(rows.column("lead").to_numpy(zero_copy_only=False)[order])[0])
        near = np.flatnonzero(found.similar(sets[order[lead]], least)[order])
        index.merge(np.full(len(near), lead), near)

        def confirm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = np.zeros(len(a), bool)
            by = np.argsort(a, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(a[by])) + 1):
                ok[part] = found.similar(sets[order[a[part[0]]]], least)[order[b[part]]]
            return ok

        label = index.link(WIDE, confirm)
        on = label != np.arange(len(label))
        return th[order][on], th[order][label[on]]

    return act


def _across(words: int, least: float):
    """Links of a block's texts outside the leader's component (asked) to others: one for each text and component."""

    def act(rows: pa.Table) -> tuple:
        asked = rows.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        th, label = rows.column("th").to_numpy(), rows.column("label").to_numpy()
        sets = [hashes(t, words) for t in rows.column("text").to_pylist()]
        fps = np.array([fingerprint(s) for s in sets], np.uint64)
        rest = np.flatnonzero(~asked)
        found = Shingles([sets[i] for i in rest])
        u, v = [], []
        for i in np.flatnonzero(asked):
            ok = found.similar(sets[i], least) & (label[rest] != label[i]) & (bit_count(fps[rest] ^ fps[i]) <= WIDE)
            _, one = np.unique(label[rest[ok]], return_index=True)
            u.extend([th[i]] * len(one))
            v.extend(th[rest[ok][one]])
        return u, v

    return act


def _asking(rows: DataFrame, keys: list[str], act) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    dealt = rows.select(*keys, *rest).repartition(shuffles(rows.sparkSession), *keys).sortWithinPartitions(*keys, "th")
    return dealt.mapInArrow(_grouped(act, len(keys), ["u", "v"]), "u long, v long")


def _blocks(n: str, size: str):
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_BYTES)).cast("int")


def _number(blocks: str):
    return F.pmod(F.xxhash64("th", F.lit(SEED)), F.col(blocks)).cast("int")


def similar_links(texts: DataFrame, words: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """(u, v): links that span every component of texts (th, text)."""
    spark = texts.sparkSession
    rows = texts.mapInArrow(_pieces(words), "slice int, rows binary").repartition(shuffles(spark), "slice").sortWithinPartitions("slice")
    mates = rows.mapInArrow(_companions, "u long, v long, n long")
    # a text has at most one name a table, and the texts of a group few names: these are linked to their least, and so is the text
    named = materialize(mates.groupBy("u").agg(F.sum("n").alias("company"), F.array_sort(F.collect_set("v")).alias("names")), "mates")
    roots = components(named.select(F.explode(F.array_append("names", F.col("u"))).alias("u"), F.col("names")[0].alias("v")))
    roots = roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
    members = named.select(F.col("u").alias("member"), "company").join(roots, F.col("member") == F.col("node"), "left")
    members = materialize(members.select("member", "company", F.coalesce("root", "member").alias("root")), "members")
    # the texts that have companions, each once
    own = texts.join(bounded(members, BROADCAST_ROWS), F.col("th") == F.col("member")).select("th", "text", "root", "company").dropDuplicates(["th"])
    own = materialize(own, "near-texts")
    groups = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"), F.max(F.struct("company", "th"))["th"].alias("leader"))
    groups = groups.select(F.col("root").alias("r"), "leader", _blocks("n", "size").alias("blocks"))
    groups = materialize(groups, "near-groups")
    many = groups.where("blocks > 1")
    hot = bool(many.limit(1).count())
    dealt = own.join(bounded(groups, BROADCAST_ROWS), F.col("root") == F.col("r")).withColumn("lead", F.col("th") == F.col("leader"))
    dealt = dealt.withColumn("block", F.explode(F.when(F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_number("blocks")))))
    links = materialize(_asking(dealt.select("root", "block", "th", "text", "lead"), ["root", "block"], _forest(words, least)), "near-links")
    if not hot:
        return links
    # groups of several blocks: what isn't in the leader's component meets all of its group
    label = components(links).select(F.col("u").alias("node"), F.col("v").alias("label"))
    rows = own.join(bounded(many, BROADCAST_ROWS), F.col("root") == F.col("r")).join(label, F.col("th") == F.col("node"), "left")
    rows = materialize(rows.select("root", "blocks", "leader", "th", "text", F.coalesce("label", "th").alias("label")), "near-hot")
    led = rows.where("th = leader").select(F.col("root").alias("r"), F.col("label").alias("led"))
    rows = rows.join(bounded(materialize(led, "near-led"), BROADCAST_ROWS), F.col("root") == F.col("r")).drop("r")
    outside = rows.where("label <> led").groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    rows = rows.join(bounded(materialize(outside.select("r", _blocks("n", "size").alias("parts")), "near-outside"), BROADCAST_ROWS), F.col("root") == F.col("r"))
    sides = [rows.withColumn("asked", F.lit(False)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("block", _number("blocks"))]
    sides.append(rows.where("label <> led").withColumn("asked", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", _number("parts")))
    cols = ["root", "part", "block", "th", "text", "label", "asked"]
    met = sides[0].select(*cols).unionAll(sides[1].select(*cols))
    return links.unionAll(materialize(_asking(met, cols[:3], _across(words, least)), "near-links"))


def similar_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """The documents that stay, with all their columns: one row of each component, that with the smallest id (a row
    without an id only where none has one)."""
    text = text_of(F.col(f"`{text_col}`"))
    th = F.xxhash64(text)
    roots = components(similar_links(docs.select(th.alias("th"), text.alias("text")), words, least))
    return one_of_each(docs, id_col, th, roots.select(F.col("u").alias("node"), F.col("v").alias("root")))
