"""Every operator on tricky rows and on an empty table."""

import public_tokenizers
import pytest
from corpus_fixtures import labels, nothing, tricky, tricky_rows
from pyspark.sql import functions as F

from sphereframe.llm import ann, bpe, exact_dedup, langid, licenses, near_dedup, packing, quality, secrets, toxicity

RANKS, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
LABELS = [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None)]

OPERATORS = {
    "secrets": lambda d: secrets.scan(d, secrets.train(d)),
    "redact": lambda d: secrets.redact(d, secrets.train(d)),
    "exact": lambda d: exact_dedup.mark_duplicates(d, runs=8),
    "quality": lambda d: quality.score(d, quality.fit(d, labels(d.sparkSession, LABELS), F.lit(True))),
    "licenses": lambda d: licenses.scan(d),
    "near": lambda d: near_dedup.near_duplicates(d),
    "langid": lambda d: langid.predict(d, langid.fit(d, F.lit(True))),
    "bpe": lambda d: bpe.encode_documents(d, RANKS, public_tokenizers.PATTERN),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels(d.sparkSession, LABELS), F.lit(True))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, name):
    got = OPERATORS[name](tricky(spark)).collect()
    assert len(got) == len(tricky_rows())
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in tricky_rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](nothing(spark)).collect() == []


def test_packing_edges(spark):
    assert packing.pack(nothing(spark), PIECES).count() == 0
    got = packing.pack(tricky(spark), PIECES).toPandas()
    lengths = {}
    for r in got.itertuples():
        lengths.setdefault((r.sequence_id), []).append((r.offset, r.length))
    for parts in lengths.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or at & (at - 1) == 0
    # null, empty and blank texts are the end id alone
    assert (got.doc_tokens == 1).sum() == 4
    assert got.length.sum() == got[got.start == 0].doc_tokens.sum()


def test_filters_keep_columns(spark):
    docs = tricky(spark)
    assert exact_dedup.distinct_texts(docs).columns == docs.columns
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IS NULL").count() == 2
    clean = toxicity.keep_clean(docs, toxicity.fit(docs, labels(spark), F.lit(True)))
    assert clean.columns == docs.columns and clean.count() == docs.count()


def test_vectors_edges(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1e200, 1e200]), (8, [1e-200, 0.0]),
            (None, [1.0, 1.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, v string")
    got = ann.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 100), (0, 2, 8), (0, 3, 7), (100, 1, 0), (100, 2, 8), (100, 3, 7)]
    assert got[0].score == 0.0 and ann.search(df.limit(0), F.lit(True)).count() == 0
