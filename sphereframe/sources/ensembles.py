"""Stored ensembles: one folder a member, so members are added and replaced without touching the others."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import concat_members


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def stored_members(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the members in a store, from its folders."""
    stored = _stored(spark, path)
    return [] if stored is None else sorted(r["member"] for r in stored.select("member").distinct().collect())


def write_members(runs: Mapping[int, DataFrame], path: str, replace: bool = False) -> None:
    """Add the runs of some members to a store, or start one.

    All runs, and the members stored before, must have the same columns and types.  A member that is there already is an error unless ``replace``
    is set; then its folder, and no other, is overwritten.  The check comes before any write.  Rows are written by the tasks that make them, without an
    exchange: each partition of a run becomes a file of its member.
    """
    if not runs:
        raise ValueError("no runs given")
    spark = next(iter(runs.values())).sparkSession
    stored = _stored(spark, path)
    shape = {f.name: f.dataType for f in (stored.drop("member") if stored is not None else next(iter(runs.values()))).schema.fields}
    for m, df in runs.items():
        own = {f.name: f.dataType for f in df.schema.fields}
        if own != shape:
            differ = sorted(c for c in {*own, *shape} if own.get(c) != shape.get(c))
            raise ValueError(f"member {m} does not fit the stored ensemble in {differ}")
    present = set(stored_members(spark, path)) & {int(m) for m in runs} if stored is not None else set()
    if present and not replace:
        raise ValueError(f"members {sorted(present)} are stored already")
    rows = concat_members(runs).select(*shape, "member")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("member").parquet(path))


def read_members(spark: SparkSession, path: str, members: list[int] | None = None) -> DataFrame:
    """A stored ensemble, or some of its members; asking for one that is not there is an error."""
    df = spark.read.parquet(path)
    if members is None:
        return df
    absent = sorted({int(m) for m in members} - set(stored_members(spark, path)))
    if absent:
        raise ValueError(f"members {absent} are not stored")
    return df.where(F.col("member").isin([int(m) for m in members]))
