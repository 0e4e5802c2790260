"""Top-k search, packing, mixing and HTML extraction."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trustbook.llm import html, mixing, packing, topk

from .data import SCHEMA, edge_rows, frame

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def brute_top(rows, every, k):
    ok = [(n, i, np.floor(256 * np.array(v, np.float64))) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, q, qv in ok:
        if q % every == 0:
            best = sorted((-int(qv @ v), i) for m, i, v in ok if m != n and len(v) == len(qv))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block,query_block", [(64, 8), (16, 3), (None, 2048)])
def test_top_k_matches_brute_force(spark, block, query_block):
    rng = np.random.default_rng(1)
    vs = rng.normal(0, 1, (600, 16)) * rng.exponential(1, (600, 1))
    vs[100:300] = vs[100]  # a common vector, so ties
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vs)] + [(700, None), (750, [float("nan")] * 16), (None, [1.0] * 16), (800, [None] + [1.0] * 15), (850, [0.0] * 16), (900, [])]
    rows += [(0, rows[0][1]), (0, rows[7][1]), (50, rows[100][1])]  # repeated ids are rows of their own
    rows += [(100, [300.0, -300.0]), (101, [1e6, 1.0]), (150, [0.5, 0.5])]  # vectors of another length
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_k(df, lambda c: c % 50 == 0, block=block, query_block=query_block)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 50, 5)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>, v int, norm2 int, q int"
    assert topk.top_k(spark.createDataFrame([], schema), lambda c: c % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 1, 1), (1, [0.5, 0.5], 1, 1, 1)], schema)
    assert [tuple(r) for r in topk.top_k(few, lambda c: c % 50 == 0).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(few, lambda c: c < 0).count() == 0


def test_pruning_loses_nothing():
    rng = np.random.default_rng(2)
    q, c = np.floor(rng.normal(0, 100, (40, 32))), np.floor(rng.normal(0, 100, (900, 32)) * rng.exponential(1, (900, 1)))
    rot = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    s = q @ c.T
    search = topk.Search(q, -np.arange(1, 41), np.full(40, -np.inf), np.ascontiguousarray(rot), 5)
    for part in np.array_split(np.arange(900), 7):
        search.add(c[part], part, part)
    at, ids, scores = search.found
    for i in range(40):
        want = sorted(zip(-s[i], range(900), strict=True))[:5]
        assert sorted(zip(-scores[at == i], ids[at == i], strict=True)) == want


def test_queries_that_only_long_vectors_can_answer(spark):
    """Blocks of short vectors are sent to no query here."""
    rng = np.random.default_rng(4)
    long, short = rng.normal(0, 10, (64, 8)), rng.normal(0, 0.01, (2000, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([long, short]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, lambda c: c < 64, block=64, query_block=16).collect())) == sorted(r for r in brute_top(rows, 1, 5) if r[0] < 64)


def unpack(rows, window):
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return seqs, docs


def test_packing_round_trip(spark):
    rows = edge_rows() + [(100 + i, "some words to pack " * (7 * i), "en", "s", 0) for i in range(120)]
    out = packing.pack(frame(spark, rows), VOCABULARY).collect()
    seqs, docs = unpack(out, 2048)
    tok = Tokenizer.from_file(VOCABULARY)
    coded = {}
    for doc, text, *_ in rows:
        coded.setdefault(doc, []).append([*tok.encode(text or "", add_special_tokens=False).ids, 1])
    for doc, texts in coded.items():
        # every id of every row lies in exactly one piece; repeated rows have pieces of their own
        for ids in texts:
            pieces = docs[doc, len(ids)]
            alike = sum(len(x) == len(ids) for x in texts)
            covered = np.zeros(len(ids), int)
            for start, length, crc in pieces:
                covered[start : start + length] += 1
                assert any(len(x) == len(ids) and zlib.crc32(np.array(x[start : start + length], "<u4").tobytes()) == crc for x in texts)
            assert (covered == alike).all()
    assert sum(len(p) for p in docs.values()) == len(out)
    total = sum(n for p in seqs.values() for _, n in p)
    assert len(seqs) * 2048 - total < 0.03 * total + 2048


def test_fast_and_reference_tokenizer_agree():
    tok = Tokenizer.from_file(VOCABULARY)
    for text in ("", "Hello  world\n\n x", "<|endoftext|> in text", "naïve \U0001f600\U0001f600 ñandú", "\t \n  ", "a" * 5000, "1234567890" * 30, "it's they'll WE'VE"):
        assert packing.token_ids(text, VOCABULARY).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_best_fit_finds_the_tightest_window():
    rng = np.random.default_rng(3)
    sizes = sorted((int(x) for x in rng.integers(1, 2049, 400)), reverse=True)
    seqs, offsets, n = packing.best_fit(sizes)
    room, want = [], []
    for s in sizes:
        fit = [(r, -i) for i, r in enumerate(room) if r >= s]
        want.append(min(fit)[0] - s if fit else 2048 - s)
        if fit:
            room[-min(fit)[1]] -= s
        else:
            room.append(2048 - s)
    assert [2048 - o - s for o, s in zip(offsets, sizes, strict=True)] == want and n == len(room)


def test_packing_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


def water(sizes, weights, share=1.5, cap=2.0):
    total, full = share * sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        w = sum(weights[i] for i in open_)
        t = {i: left * weights[i] / w for i in open_}
        new = {i for i in open_ if t[i] >= cap * sizes[i]}
        if not new:
            return [cap * sizes[i] if i in full else t[i] for i in range(len(sizes))]
        full |= new


def mix_rows():
    return [(i, "word " * (1 + (i * 7) % 50), "en", "abcdefg"[min(6, i % 11)], 0) for i in range(500)] + edge_rows()


def test_each_document_is_taken_as_a_plain_walk_takes_it(spark):
    """The words taken of every document: sources in order of their keys, whole epochs, then until the budget ends."""
    docs = frame(spark, mix_rows())
    got = sorted(((r["source"] or "", str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix_plan(docs).collect()))
    by = {}
    for r in mixing.drawn(docs).collect():
        by.setdefault(r["source"], []).append((r["key"], r["doc_id"] is None, r["doc_id"] or 0, r["size"]))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    totals = [sum(x[3] for x in by[s]) for s in order]
    want = []
    for source, total, target in zip(order, totals, water(totals, [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True):
        epochs = int(target // total) if total else 0
        left = int(target) - epochs * total if total else 0
        for _, null, doc, size in sorted(by[source]):
            part = max(0, min(left, size))
            left -= part
            want.append((source or "", "None" if null else str(doc), size, epochs * size + part))
    assert got == sorted(want)


def test_mixing_meets_its_targets(spark):
    rows = mix_rows()
    out = mixing.mix_plan(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, water([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken = {}
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["target"] >= r["source_size"] > 0:
            assert r["taken"] >= r["size"]  # complete epochs come first
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in taken)
    again = mixing.mix_plan(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_prefers_heavier_weights(spark):
    import pyspark.sql.functions as F

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"), mixing.draw(F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.5), F.col("id")).alias("key"))
    out = mixing.mixed(rows, True, share=0.4).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum("copies")).collect()
    got = {r[0]: r[1] for r in out}
    assert got[0] > 2 * got[1] and got[0] + got[1] == 1600


def test_mixed_documents_are_whole(spark):
    docs = frame(spark, list(dict.fromkeys(mix_rows())))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    plan = mixing.mix_plan(docs, whole=True)
    assert out.count() == sum(r["copies"] for r in plan.collect())
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix_plan(spark.createDataFrame([], SCHEMA)).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><div class="site-header">Name</div><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="layout"><div class="sidebar">Side</div><div class="content"><article class="post post-%d"><h2>Title &amp; more</h2><p>First  <b>bold</b>text, long
enough to count as a body of words.<p>Second para<ul><li>one<li>two</ul><form><input>Form</form><div class="advert">AD</div><p>In <span class="ad">x <span>y</span> z</span>line</article>
<section id="comments"><p>A very long comment of a reader that is longer than the article itself, so that it would win if its class did not say what it is. And more, and more of it.</section></div></div><footer>foot</footer></body></html>"""
TEXT = "Title & more First boldtext, long enough to count as a body of words. Second para one two In line"


def test_html_leaves_out_what_is_not_article(spark):
    pages = [(i, f"http://h{i % 2}.example/{i}", PAGE % i) for i in range(6)] + [(10, None, PAGE % 1), (11, "http://h0.example/x", None), (12, "nonsense", ""), (13, "http://h3.example/", "plain &lt;text&gt;  only")]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i] == TEXT for i in (0, 1, 2, 3, 4, 5, 10))
    assert out[11] == out[12] == "" and out[13] == "plain <text> only"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_consensus_overrules_a_page(spark):
    body = "<body><div class='story'><p>%s</p></div><div class='list'><p>%s</p></div></body>"
    pages = [(i, "http://a.example/p", body % (f"Story number {i} is told here at some length.", "short")) for i in range(8)] + [(9, "http://a.example/p", body % ("A short story.", "This other block is far longer on just this one page, but the host says where stories are."))]
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[9] == "A short story."
