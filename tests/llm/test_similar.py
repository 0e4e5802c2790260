"""The pipeline's near-dedup against brute force over all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from trustbook.llm import similar

from .data import edge_rows, frame


def brute_kept(rows):
    """Smallest id of each component of pairs whose five-word shingles have a Jaccard similarity of 0.8."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r[1] or "").encode().lower().split()) else set() for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if not (sets[a] | sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if z == y else z for z in label]
    groups = {}
    for r, c in zip(rows, label, strict=True):
        groups.setdefault(c, []).append(r[0])
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)


def edited_rows():
    random.seed(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(50):
        base = [random.choice(words) for _ in range(200)]
        for c, edits in enumerate((0, 1, 2, 4, 6, 10)):
            text = list(base)
            for _ in range(edits):
                text[random.randrange(200)] = random.choice(words)
            rows.append((1000 + 10 * i + c, " ".join(text), "en", "s", 0))
    return rows


def test_stage_matches_brute_force(spark):
    rows = edge_rows() + edited_rows()
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == brute_kept(rows)


def test_stage_matches_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == brute_kept(rows)


def test_groups_of_many_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 12)
    random.seed(9)
    words = [f"w{i}" for i in range(300)]
    base = [random.choice(words) for _ in range(80)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(random.randrange(7)):
            text[random.randrange(80)] = random.choice(words)
        rows.append((i, " ".join(text[: 80 - random.randrange(12)]), "en", "s", 0))
    rows += [(200 + i, " ".join([*base, *(random.choice(words) for _ in range(8 * i))]), "en", "s", 0) for i in range(10)]
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")
    want = brute_kept(rows)
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want) and len(want) > 5


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(1, "one text of its own kind here", "en", "s", 0), (1, "quite another text about something else", "en", "s", 0), (None, text, "en", "s", 0), (None, f"{text} v60", "en", "s", 0), (None, "a third one that nobody shares", "en", "s", 0)]
    out = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] for r in out), key=str) == [1, 1, None, None]


def test_empty_table(spark):
    assert similar.similar_kept(frame(spark, edge_rows()).limit(0)).count() == 0


def packets(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["th", "text"])
    return list(similar._pieces(5)([batch]))


def unpacked(batches):
    return np.frombuffer(b"".join(x for b in batches for x in b.column(1).to_pylist()), similar.ROW)


def brute_companions(rows):
    """(text, smallest of its component, size) of every bucket, over all pairs of its rows."""
    out, buckets = [], {}
    for r in rows:
        buckets.setdefault(int(np.uint32(r["word"])) >> 14, []).append((int(r["th"]), int(np.uint32(r["word"])), int(r["a"]) | int(r["b"]) << 64))
    for key, members in buckets.items():
        far = 38 if key >> 10 < 80 else 46
        label = {th: th for th, _, _ in members}
        for i, (t, w, f) in enumerate(members):
            for u, x, g in members[:i]:
                if (w ^ x).bit_count() <= 2 and (f ^ g).bit_count() <= far:
                    lo, hi = sorted((label[t], label[u]))
                    label = {k: lo if c == hi else c for k, c in label.items()}
        sizes = Counter(label.values())
        out += [(k, c, sizes[c]) for k, c in label.items() if sizes[c] > 1]
    return sorted(out)


def test_candidates_are_what_the_index_finds_in_fingerprints(monkeypatch):
    """Candidates are held against all pairs of the rows of a bucket, in small packets, slices and batches of pairs."""
    texts = ["", " "] + [r[1] for r in edited_rows()] + [f"a b c d e f g {i % 9}" for i in range(40)]
    texts += [f"{r[1]} tail" for r in edited_rows()[:60:6]]
    rows = unpacked(packets(texts))
    want = brute_companions(rows)
    assert len({u for u, _, _ in want}) > 300
    assert sorted(zip(*(x.tolist() for x in similar.companions(rows)), strict=True)) == want
    for name, value in (("DEALT", 700), ("TEXTS", 7), ("ROWS", 50), ("FRONTIER", 9)):
        monkeypatch.setattr(similar, name, value)
    small = packets(texts)
    whole = pa.Table.from_batches(small).sort_by("slice")
    found = [r for b in similar._companions(whole.to_batches(max_chunksize=3)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(small) > 20 and sorted(found) == want


@pytest.mark.parametrize(("one", "other", "both"), [(4, 5, 4), (5, 6, 5), (9, 9, 8), (8, 10, 8), (18, 18, 16), (90, 90, 80), (800, 1000, 800)])
def test_pairs_at_the_threshold_are_candidates(one, other, both):
    rng, found = np.random.default_rng(3), 0
    for _ in range(200):
        h = rng.integers(0, 1 << 63, one + other - both, dtype=np.uint64)
        rows = []
        for th, s in enumerate((np.sort(h[:one]), np.sort(h[one - both :]))):
            face, word = similar.pieces(s)
            rows.append(np.array([(w, *face, th) for w in word], similar.ROW))
        found += len(similar.companions(np.concatenate(rows))[0]) > 0
    assert found == 200


def test_unlike_texts_of_few_shingles_are_no_candidates():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 6, 8):
        rows = []
        for th in range(500):
            face, word = similar.pieces(np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)))
            rows.append(np.array([(w, *face, th) for w in word], similar.ROW))
        assert len(set(similar.companions(np.concatenate(rows))[0].tolist())) <= 6
