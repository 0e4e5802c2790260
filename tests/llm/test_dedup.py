"""Exact dedup, SimHash and line dedup against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from trustbook.llm import exact_dedup, lines, simhash
from trustbook.llm.components import components

from .data import SCHEMA, edge_rows, frame


def test_exact_dedup_matches_brute_force(spark):
    rows = edge_rows() + [(100 + i, f"copy  \t {i % 3}\n end", "en", "s", 5) for i in range(40)]
    got = sorted(map(tuple, exact_dedup.exact_dedup(frame(spark, rows)).collect()), key=str)
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        taken = False
        for i in sorted(ids, key=lambda x: (x is None, x or 0)):
            want.append((i, keep, len(ids), i == keep and not taken, hashlib.sha256(text.encode()).hexdigest()))
            taken = taken or i == keep
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("limit", [1, 2000, 1 << 30])
def test_grace_spills_and_merges(limit, tmp_path):
    random.seed(3)
    keys = [f"text {random.randint(0, 300)}".encode() for _ in range(3000)]

    def merge(a, b):
        a[0] += b[0]

    out = {}
    for content, value in exact_dedup.grace(((k, [1]) for k in keys), merge, limit=limit, folder=str(tmp_path)):
        assert content not in out
        out[content] = value[0]
    assert out == {k: keys.count(k) for k in set(keys)}
    assert not list(tmp_path.iterdir())


def test_open_table_compares_content_on_equal_hashes():
    t = exact_dedup.OpenTable()
    for i in range(2000):
        at = t.find(7, str(i).encode())
        assert at < 0
        t.put(-1 - at, 7, str(i).encode(), [i], 1)
        if i == 40:
            break
    assert all(t.values[t.find(7, str(i).encode())] == [i] for i in range(41))


def test_exact_kept_keeps_rows_whole(spark):
    rows = edge_rows()
    docs = frame(spark, rows)
    out = exact_dedup.exact_kept(docs)
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in out.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, most=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    random.seed(5)
    words = [f"Word{i}" for i in range(400)]
    rows = edge_rows()
    for i in range(60):
        base = [random.choice(words) for _ in range(300)]
        for c in range(3):
            text = list(base)
            for _ in range(c):
                text[random.randrange(300)] = random.choice(words)
            rows.append((1000 + 10 * i + c, " ".join(text), "en", "s", 0))
    got = sorted(map(tuple, simhash.near_components(simhash.fingerprints(frame(spark, rows))).collect()), key=str)
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components([r[0] for r in rows], fps)
    assert got == sorted(((r[0], f - (1 << 64) if f >> 63 else f, c) for r, f, c in zip(rows, fps, comp, strict=True)), key=str)
    assert len(set(comp)) < len(rows) - 30


@pytest.mark.parametrize("seed", range(6))
def test_gray_index_links_all_that_brute_force_links(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size=8, dtype=np.uint64)
    fps = []
    for _ in range(200):
        x = int(base[rng.integers(8)])
        for _ in range(int(rng.integers(0, 5))):
            x ^= 1 << int(rng.integers(64))
        fps.append(x)
    index = simhash.GrayIndex(np.unique(np.array(fps, np.uint64)))
    label = index.link(2)
    assert brute_components(list(range(len(index.fps))), [int(x) for x in index.fps]) == label.tolist()


def test_gray_neighbours_differ_in_one_bit():
    x = np.arange(4096, dtype=np.uint64)
    order = np.argsort(simhash.gray_rank(x))
    assert (simhash.bit_count(x[order][1:] ^ x[order][:-1]) == 1).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    random.seed(1)
    random.shuffle(edges)
    out = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(1, 61)}, 101: 100}


def brute_pairs(fps, linked):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    groups = {}
    for i, c in enumerate(label):
        groups.setdefault(c, []).append(i)
    return sorted(groups.values())


def test_near_kept_keeps_one_of_each_group(spark):
    rows = edge_rows()
    docs = frame(spark, rows)
    out = simhash.near_kept(docs).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == sorted({c for c in brute_components([r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]) if c is not None})
    # of the rows without an id one has a text of its own; the other is empty like rows 1 to 3
    assert [r["text"] for r in out if r["doc_id"] is None] == ["no id here"]


def test_near_kept_tells_texts_of_one_id_apart(spark):
    a, b = "the first text that shares an id with others", "an altogether different body of words under that id"
    for rows in ([(3, a), (5, b), (5, a)], [(5, a), (5, b), (3, a)]):
        out = simhash.near_kept(frame(spark, [(*r, "en", "s", 0) for r in rows])).collect()
        assert sorted((r["doc_id"], r["text"]) for r in out) == [(3, a), (5, b)]


def test_gray_index_confirms_links():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base, base ^ np.uint64(1), base ^ np.uint64(6)])
    odd = rng.integers(0, 2, len(fps)).astype(bool)
    index = simhash.GrayIndex(fps, merged=False)
    label = index.link(2, lambda a, b: odd[index.order[a]] == odd[index.order[b]])
    want = brute_pairs(fps, lambda i, j: bin(int(fps[i]) ^ int(fps[j])).count("1") <= 2 and odd[i] == odd[j])
    got = {}
    for place, own in zip(index.order.tolist(), label.tolist(), strict=True):
        got.setdefault(own, set()).add(place)
    assert sorted(map(sorted, got.values())) == want


def test_lines_of_recurring_templates_go(spark):
    own = ["Rain fell on the hills all night", "Nobody knew where the keys had gone", "Her brother sold maps and old clocks", "A train leaves for the coast today", "Three ships lay outside the harbour", "Bread costs more than it used to"]
    rows = [(i, f"{own[i]}\nPosted by user{i} on 2024-01-0{i} at page\n\nSent from {chr(97 + i)}rn and signed\nend {chr(97 + i)}", "en", "s", 0) for i in range(6)] + [(50, "Unique sentence of its own", "en", "s", 0), (51, None, "en", "s", 0)]
    out = {r["doc_id"]: (r["n_lines"], r["dropped"]) for r in lines.marked(frame(spark, rows)).collect()}
    assert all(out[i] == (5, [1, 3]) for i in range(6))
    assert out[50] == (1, []) and out[51] == (0, [])
    cleaned = {r["doc_id"]: r["text"] for r in lines.clean(frame(spark, rows)).collect()}
    assert cleaned[0] == f"{own[0]}\n\nend a"


def brute_lines(rows, min_docs=5):
    """The operator's rules over dictionaries of whole strings, without its code or its hashes."""
    mask = lambda w: "*" if re.search(r"[0-9@]", w) or "://" in w else w
    split = {r[0]: [tuple(mask(w) for w in x.split()) for x in (r[1] or "").split("\n")] for r in rows}
    text = {r[0]: r[1] for r in rows}
    have = {}
    for d, forms in split.items():
        for f in set(forms) - {()}:
            have.setdefault(f, set()).add(d)
    recurs = {f for f, ds in have.items() if len(ds) >= min_docs or (sum(w != "*" for w in f) >= 8 and len({text[d] for d in ds}) > 1)}
    shared = {}
    for f, ds in have.items():
        shared.setdefault((len(f), f[:2]), set()).update(ds)
    leaves = {}
    for f, ds in have.items():
        if f not in recurs and len(f) > 2 and len(shared[len(f), f[:2]]) >= min_docs:
            leaves.setdefault((len(f), f[:2]), {})[f] = ds
    dropped = set(recurs)
    for forms in leaves.values():
        docs = set().union(*forms.values())
        enough = max(min_docs, len(docs) / 3)
        places = {}
        for f, ds in forms.items():
            for i, w in enumerate(f):
                if w != "*":
                    places.setdefault((i, w), set()).update(ds)
        made = {}
        for f in forms:
            t = tuple(w if len(places.get((i, w), ())) >= enough else "*" for i, w in enumerate(f))
            if sum(w != "*" for w in t) >= 0.6 * len(t):
                made.setdefault(t, []).append(f)
        if len(docs) >= min_docs:
            for fs in made.values():
                if len(set().union(*(forms[f] for f in fs))) >= enough:
                    dropped.update(fs)
    return {d: [i for i, f in enumerate(forms) if f in dropped] for d, forms in split.items()}


def test_lines_against_brute_force(spark):
    random.seed(2)
    names = [f"name{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]
    pool = [lambda: f"the {random.choice(['red', 'blue'])} page was seen {random.randrange(4)} times by all who came", lambda: "short line", lambda: "x", lambda: f"Posted by {random.choice(names)} in {random.choice(names)}", lambda: f"Filed under {random.choice(names)} by {random.choice(names)} and friends", lambda: f"Filed under {random.choice(names)} on a {random.choice(names)} day", lambda: " ".join(["It was", *random.choices(names, k=3)]), lambda: "", lambda: f"see http://a/{random.random()} now"]
    rows = [(i, "\n".join(random.choice(pool)() for _ in range(5)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(3)]
    got = {r["doc_id"]: r["dropped"] for r in lines.marked(frame(spark, rows)).collect()}
    want = brute_lines(rows)
    assert got == want
    kind = lambda start: [(i in want[r[0]]) for r in rows for i, x in enumerate(r[1].split("\n")) if x.startswith(start)]
    assert all(kind("Posted by")) and all(kind("Filed under")) and not any(kind("It was")) and all(kind("the "))


def test_lines_against_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["dropped"] for r in lines.marked(docs).collect()} == brute_lines(rows)


def test_long_lines_of_two_different_texts_go(spark):
    passage = " ".join(f"{chr(97 + i % 26)}word{chr(97 + i // 26)}" for i in range(60))
    sentence = "a sentence with eight words or a few more"
    rows = [(1, f"own first\n{passage}", "en", "s", 0), (2, f"{passage}\nown second", "en", "s", 0), (3, f"{sentence}\nx", "en", "s", 0), (4, f"y\n{sentence}", "en", "s", 0)]
    rows += [(5, "short line here\nv", "en", "s", 0), (6, "short line here\nw", "en", "s", 0), (7, "1 2 3 4 5 6 7 8 9\np", "en", "s", 0), (8, "9 8 7 6 5 4 3 2 1\nq", "en", "s", 0)]
    rows += [(i, "this whole text has a copy and stays so as it is", "en", "s", 0) for i in (9, 10)]
    out = {r["doc_id"]: r["dropped"] for r in lines.marked(frame(spark, rows)).collect()}
    assert out == {1: [1], 2: [0], 3: [0], 4: [1], **{i: [] for i in range(5, 11)}}


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, exact_dedup.exact_kept, lambda d: simhash.near_components(simhash.fingerprints(d)), simhash.near_kept, lines.marked, lines.clean])
def test_empty_tables_and_clashing_columns(spark, run):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run(frame(spark, edge_rows())).count() > 0
