"""The corpus operators as registered queries over whole tables, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, bpe, exact_dedup, langid, licenses, mtree, near_dedup, packing, periodicity, quality, resampling, secrets, toxicity
from .common import documents, fold, held_out, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.digest(secrets.scan(docs, secrets.train(docs)))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rated = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), fold("_id", 3) != 1))
    return rated.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs, fold("_id", 3) != 1))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, window=2048)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rated = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("_id", 4) != 2))
    return rated.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


def op13_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicity.digest(periodicity.collapse(documents(spark, sf_dir), rewrite=periodicity.planted))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_exact_dedup, op3_quality, op4_licenses, op5_near_dedup, op6_langid, op7_byte_bpe, op8_packing, op9_toxicity, op10_ann, op11_mtree, op12_resampling, op13_periodicity, pipeline)}
ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": exact_dedup.SQL, "op4_licenses": licenses.sql(), "op11_mtree": mtree.SQL}
