"""The pipeline's stages, one after the other, against their own input."""

import corpus_pipeline
from trustbook.llm import exact_dedup, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns, name
        seen.append(spark.createDataFrame(out.collect(), docs.schema))
    raw, clean, exact, near, mix = seen
    scores = toxicity.scored(raw, toxicity.fit(raw, spark.read.parquet(f"{SF}/labels.parquet")), name="p").where("p < 0.5")
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in scores.collect())
    kept = exact_dedup.exact_dedup(clean).where("kept").collect()
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(r["doc_id"] for r in kept)
    fps = {r["doc_id"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(near).collect()}
    ids = sorted(fps)
    assert all(bin(fps[a] ^ fps[b]).count("1") > 2 for i, a in enumerate(ids) for b in ids[:i])
    assert mix.count() > 0 and {r["doc_id"] for r in mix.select("doc_id").distinct().collect()} <= set(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, mix, SF)
    assert packed.where("start = 0").count() == mix.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Repeated and null ids, null and empty texts and clashing columns go through every stage; rows aren't mixed up."""
    from .data import SCHEMA, edge_rows, frame

    spark.createDataFrame([(4, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    shared = [(20, "first text under one id, of some length", "en", "a", 0), (20, "quite another text under the same id here", "en", "a", 0), (20, "first text under one id, of some length", "en", "b", 0)]
    docs = frame(spark, edge_rows() + shared)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
        assert docs.columns == before.columns and docs.count() > 0, name
        assert docs.exceptAll(before).count() == 0 or name == "mixing", name
        if name in ("exact_dedup", "simhash_dedup"):
            texts = [r["text"] for r in docs.where("doc_id = 20").collect()]
            assert sorted(texts) == sorted({shared[0][1], shared[1][1]}), name
            assert [r["doc_id"] for r in docs.where("text LIKE 'long words%'").collect()] == [6]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    from .data import SCHEMA

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
