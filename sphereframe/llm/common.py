"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: needed only where it is neither installed nor on their path."""
    known = {str(Path(p).resolve()) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if str(ROOT) in known or "site-packages" in str(ROOT):
        return
    name = Path(__file__).resolve().parents[1].name
    if not any(name in f for f in spark.sparkContext.listFiles):
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", ROOT, name)
        spark.sparkContext.addPyFile(archive)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder all executors reach.

    Without that setting (tests) the warehouse takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/corpus/{name}-{uuid.uuid4().hex}"


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here and lost executors only re-read files."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` whose last reader has run, and let Spark drop the shuffle files of what has run.

    Spark deletes shuffle files when the objects of their query are collected on the driver, so it is asked to collect.
    """
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def fold(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(folds)


def held_out(id_col: Column | str, folds: int, remainder: int) -> Column:
    """True for rows of the held-out fold; a null id belongs to no fold."""
    return F.coalesce(fold(id_col, folds) == F.lit(remainder), F.lit(False))


def bounded_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same rows on every run.

    Only for fitting models; ``rows`` is the documented bound.
    """
    return df.orderBy(F.xxhash64(*[F.col(k) for k in key]), *key).limit(rows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that a worker holds the Python objects of few texts at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def map_texts(df: DataFrame, schema: str, work: Callable[[list, list], dict], *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Run ``work(ids, texts) -> {column: values}`` over Arrow batches; null texts arrive as empty strings."""
    ship_package(df.sparkSession)
    out = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    target = pa_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = work(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in target], schema=target)

    return out.mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
          "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def pa_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat ``name type, ...`` declaration."""
    return pa.schema([pa.field(n, _TYPES[t]) for n, t in (part.split() for part in ddl.split(","))])
