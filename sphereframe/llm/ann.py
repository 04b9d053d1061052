"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors pseudo-randomly (three rounds of random signs and a fast Hadamard transform) and files a vector under its
nearest signed axis, the coordinate of largest absolute value.  A query probes its nearest axes in every table.  Buckets are cut into blocks
of bounded size; each block meets the queries that probe it and hands on the nearest of each by exact distance on the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, written


@dataclass(frozen=True)
class Tables:
    """``tables`` rotations, ``probes`` axes looked up in each, buckets in blocks of about ``block`` vectors."""

    tables: int = 8
    probes: int = 14
    block: int = 2000
    seed: int = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(dim: int, spec: Tables) -> np.ndarray:
    width = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng(spec.seed).choice(np.array([-1.0, 1.0]), (spec.tables, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Unit vectors along the rows of ``x``, padded with zeros and rotated."""
    out = np.zeros((len(x), signs.shape[1]))
    out[:, :x.shape[1]] = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest component, so that squares neither overflow nor vanish
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    for s in signs:
        out = hadamard(out * s)
    return out


def nearest_axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: axis i is 2 i, its opposite 2 i + 1."""
    both = np.stack([rotated, -rotated], axis=2).reshape(len(rotated), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :min(probes, both.shape[1])]


def sound(df: DataFrame, vec: str, key: str) -> DataFrame:
    """(vec_id, v): vectors that take part: an id, no null or non-finite component, not all zero, and of the most frequent length."""
    v = F.col(vec).cast("array<double>")
    out = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out.filter(finite & F.exists("v", lambda c: c != 0))


def _filed(vectors: DataFrame, dim: int, spec: Tables, probes: int) -> DataFrame:
    """(vec_id, table, axis, v binary): each vector under its ``probes`` nearest axes in every table."""
    signs = rotations(dim, spec)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column(1).flatten()).reshape(n, dim)
            axes = np.stack([nearest_axes(rotate(x, s), probes) for s in signs], axis=1)  # n x tables x probes
            each = axes.shape[1] * axes.shape[2]
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), each)), pa.array(np.tile(np.repeat(np.arange(axes.shape[1], dtype=np.int32), axes.shape[2]), n)),
                pa.array(axes.reshape(-1).astype(np.int32)), pa.array(raw, pa.binary()).take(pa.array(np.repeat(np.arange(n), each)))], names=["vec_id", "table", "axis", "v"])

    return vectors.mapInArrow(run, "vec_id long, table int, axis int, v binary")


def nearest(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of ``x`` for every query: a matrix product picks candidates with a margin, exact distances decide."""
    out = []
    square = (x * x).sum(axis=1)
    for lo in range(0, len(q), 256):
        part = q[lo:lo + 256]
        rough = square[None, :] + (part * part).sum(axis=1)[:, None] - 2 * part @ x.T
        for i, own in enumerate(qids[lo:lo + 256]):
            row = np.where(ids == own, np.inf, rough[i])
            limit = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            margin = 1e-9 * (float(square.max()) + float(part[i] @ part[i]))
            at = np.flatnonzero((row <= limit + margin) & (ids != own))
            exact = np.sqrt(((x[at] - part[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[at], exact))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": ids[at][order], "score": exact[order]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _met(queries: DataFrame, rows: DataFrame, by: list[str], dim: int, k: int) -> DataFrame:
    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        q, x = (np.frombuffer(b"".join(f["v"]), np.float64).reshape(len(f), dim) for f in (left, right))
        return nearest(left["vec_id"].to_numpy(), q, right["vec_id"].to_numpy(), x, k).astype({"query_id": "int64", "vec_id": "int64"})

    return queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(work, "query_id long, vec_id long, score double")


def search(df: DataFrame, is_query, *, k: int = 10, spec: Tables | None = None, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for every row where ``is_query`` (a condition on ``vec_id``) holds.

    A query's own id is no candidate.  Ties go to the smaller id; a repeated row counts once.  Unsound vectors (`sound`) neither ask nor answer.  Queries
    that find fewer than ``k`` rows by hashing, as in small tables, are answered exactly over all blocks.  An empty table gives no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    spec = spec or Tables()
    vectors = sound(df, vec, key)
    sizes = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = sizes[0]["dim"], sizes[0]["count"]
    vectors = vectors.filter(F.size("v") == dim)
    index = written(_filed(vectors, dim, spec, 1), "index")
    # one row per bucket: at most tables * 2 * width rows, whatever the number of vectors
    blocks = index.groupBy("table", "axis").agg(F.ceil(F.count(F.lit(1)) / spec.block).cast("int").alias("blocks"))
    rows = index.join(F.broadcast(blocks), ["table", "axis"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")))
    asked = (_filed(vectors.filter(is_query), dim, spec, spec.probes).join(F.broadcast(blocks), ["table", "axis"])
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))))
    by = ["table", "axis", "block"]
    found = written(_met(asked.select(*by, "vec_id", "v"), rows.select(*by, "vec_id", "v"), by, dim, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "found")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k)
    asked_all = vectors.filter(is_query).select("vec_id").distinct().count()
    short = enough.count() < asked_all
    plain = _filed(vectors, dim, Tables(tables=1, seed=spec.seed), 1).select("vec_id", "v")
    whole = found
    if short:
        few = plain.filter(is_query).join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        parts = max(1, -(-count // spec.block))
        few = written(few, "few").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        rest = _met(few, plain.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts).cast("long"))), ["block"], dim, k)
        whole = found.unionByName(rest).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # a query's rows: at most k for each block it probes
    return whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
