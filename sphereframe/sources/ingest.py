"""Ingest of raw batches into a store that only ever shows whole, gap-free batches.

A store is a folder with ``data/batch=<id>/year=/month=`` and ``manifest/version=<n>``.  A batch is written to its own data folder first, where
no reader looks, checked there, and published by one small write: the next version of the manifest, which lists for every month the folders that
make it up.  Readers follow the newest version, so a batch appears as a whole or not at all; a batch that was published before has no effect.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import missing_timesteps
from ..operators.reshape import rename_drop
from .stores import _time_range, with_partition_columns

MANIFEST = "year int, month int, path string, rows long, last timestamp_ntz, batch string"


@dataclass(frozen=True)
class Ingested:
    """What became of a batch: ``published``, ``known`` (published before), ``empty`` or ``refused``, with its gaps (gap_start, gap_end, missing)."""

    status: str
    batch: str | None
    gaps: DataFrame


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """Newest version of the list of a store's months; no rows for a store that does not exist yet."""
    try:
        versions = spark.read.schema(f"{MANIFEST}, version int").parquet(f"{store}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{MANIFEST}, version int")
    return versions.where(F.col("version") == versions.agg(F.max("version")).scalar())


def read_store(spark: SparkSession, store: str, schema, start=None, end=None) -> DataFrame:
    """Rows of the newest version in an inclusive time range.  Months outside are never listed: the manifest, a few rows a month, prunes them."""
    months = manifest(spark, store)
    number = F.col("year") * 12 + F.col("month")
    if start is not None:
        begin = F.lit(str(start)).cast("timestamp_ntz")
        months = months.where(number >= F.year(begin) * 12 + F.month(begin))
    if end is not None:
        stop = F.lit(str(end)).cast("timestamp_ntz")
        months = months.where(number <= F.year(stop) * 12 + F.month(stop))
    paths = [f"{store}/{r['path']}" for r in months.orderBy("path").collect()]
    df = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return _time_range(df, start, end)


def batch_gaps(times: DataFrame, step_hours: int, last=None) -> DataFrame:
    """(gap_start, gap_end, missing) in the time axis of a batch, counted from the last step of the store if there is one."""
    axis = times.select("time").distinct()
    if last is not None:
        axis = axis.where(F.col("time") > F.lit(last)).unionByName(axis.sparkSession.createDataFrame([(last,)], "time timestamp_ntz"))
    return missing_timesteps(axis.withColumn("node", F.lit(0)), step_hours).drop("node")


def ingest(raw: DataFrame, store: str, *, step_hours: int, var_dict: Mapping[str, str], drops: Sequence[str] = (), start=None, end=None,
           repair: Callable[[DataFrame], DataFrame] | None = None, reshape: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """Repair, cut to the period, rename, reshape and append a batch of raw rows, or refuse it if its time axis has a gap.

    Steps in order: ``repair``, the inclusive time range, renaming and dropping (``time`` and ``node`` have to come out), the check that no step is
    missing inside the batch or between the store and the batch, ``reshape``, one write to the batch's own folder, a check of what was written, and
    the manifest.  The batch's name is a digest of its rows, so the same rows always are the same batch.  Rows are digested and checked before any
    data is written.  A store has one writer at a time: a version of the manifest that exists already is an error.
    """
    spark = raw.sparkSession
    time = next((old for old, new in var_dict.items() if new == "time"), "time")
    clean = rename_drop(_time_range(repair(raw) if repair else raw, start, end, time), var_dict, drops)
    rows = clean.select(F.xxhash64(*[F.col(c) for c in sorted(clean.columns)]).alias("_h"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(_h)").alias("x"), F.sum(F.col("_h").cast("decimal(38,0)")).alias("s")).first()
    none = spark.createDataFrame([], "gap_start timestamp_ntz, gap_end timestamp_ntz, missing long")
    if not seen["n"]:
        return Ingested("empty", None, none)
    batch = f"{seen['n']}-{seen['x'] & (1 << 64) - 1:016x}-{int(seen['s']) & (1 << 64) - 1:016x}"

    known = manifest(spark, store)
    state = known.agg(F.max("last").alias("last"), F.max("version").alias("version"), F.max(F.col("batch") == batch).alias("known")).first()
    if state["known"]:
        return Ingested("known", batch, none)
    found = batch_gaps(clean, step_hours, state["last"])
    if not found.isEmpty():
        return Ingested("refused", batch, found)

    out = with_partition_columns(reshape(clean) if reshape else clean)
    folder = f"data/batch={batch}"
    out.hint("rebalance", "year", "month").write.mode("overwrite").partitionBy("year", "month").parquet(f"{store}/{folder}")
    written = spark.read.schema(out.schema).parquet(f"{store}/{folder}")
    missing = clean.select("time").distinct().exceptAll(written.select("time").distinct())
    if not missing.isEmpty():
        raise RuntimeError(f"batch {batch}: steps were lost between staging and publication")
    path = F.concat(F.lit(f"{folder}/year="), F.col("year").cast("string"), F.lit("/month="), F.col("month").cast("string"))
    months = written.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"), F.max("time").alias("last")).select("year", "month", path.alias("path"), "rows", "last", F.lit(batch).alias("batch"))
    whole = known.drop("version").unionByName(months)
    version = (state["version"] or 0) + 1
    whole.coalesce(1).write.mode("error").parquet(f"{store}/manifest/version={version}")  # a few rows a month
    return Ingested("published", batch, none)

