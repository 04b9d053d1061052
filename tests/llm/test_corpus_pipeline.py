"""The pipeline's decisions, stage by stage, against plain versions."""

import corpus_pipeline
from corpus_fixtures import SF, nothing, tricky
from pyspark.sql import functions as F
from test_corpus_results import plain_components

from sphereframe.llm import secrets
from sphereframe.llm.common import documents, written

import __spark_entry__


def test_stages(spark):
    docs = documents(spark, SF)
    stages = [f for _, f in corpus_pipeline.STAGES]
    clean = written(stages[0](spark, docs, SF))
    rated = __spark_entry__.queries()["op9_toxicity"](spark, SF)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in rated.filter("score < 0.3").collect()}

    single = written(stages[1](spark, clean, SF))
    rows = {r.doc_id: r.text or "" for r in clean.collect()}
    best = {}
    for i, t in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        best.setdefault("".join(t.split(" ")).translate({c: None for c in (9, 10, 11, 12, 13, 32)}), i)
    assert {r.doc_id for r in single.collect()} == set(best.values())

    near = written(stages[2](spark, single, SF))
    left = {i: rows[i] for i in best.values()}
    assert {r.doc_id for r in near.collect()} == set(plain_components(left, 5, 80)[1].values())

    masked = written(stages[3](spark, near, SF))
    assert masked.columns == docs.columns and masked.count() == near.count()
    changed = 0
    for r in masked.collect():
        assert secrets.base_spans(r.text) == [] and r.n_chars == len(r.text)
        changed += r.text != rows[r.doc_id]
    assert changed == sum(bool(secrets.base_spans(rows[r.doc_id])) for r in near.select("doc_id").collect())

    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in masked.select("doc_id").collect()}


def test_entry_lists_everything(spark):
    names = [n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")]
    assert {f"op{i}" for i in range(1, 11)} <= set(names) and "pipeline" in __spark_entry__.queries()


def test_empty_documents(spark, tmp_path):
    nothing(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert __spark_entry__.queries()["op3_quality"](spark, str(tmp_path)).filter(F.col("score") > 0).count() == 0


def test_tricky_documents(spark, tmp_path):
    """Nulls, blanks, copies, repeated and null ids go through all stages; no label is toxic, so nothing is rejected as that."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    tricky(spark).select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns and docs.count() <= before.count()
    kept = docs.collect()
    assert len({"".join((r.text or "").split()) for r in kept}) == len(kept)  # one row of each text
    assert sum(r.text is not None and len(r.text) > 100_000 for r in kept) == 1
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len({r.doc_id for r in kept})
