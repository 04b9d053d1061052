"""Exact ranks, quantiles and numbering that never put one group into one task.

The recipe is always the same: cut the ordered domain of a group into buckets
with *approximate* splitters, count the buckets *exactly*, turn counts into
offsets, and only order rows inside a bucket.  Splitters decide balance, never
the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

SPLITTERS = 256


def _bucket_values(counts: DataFrame, by: Sequence[str], value: str, splitters: int) -> DataFrame:
    """Add ``_bucket`` (order preserving) to a table of distinct (by, value) rows.

    Groups small enough for one task keep a single bucket; splitters are made
    for the crowded ones only, by a sketch of bounded size that merges map-side.
    """
    crowded = 16 * splitters
    cuts = [i / splitters for i in range(1, splitters)]
    marks = F.array_distinct(F.percentile_approx(value, cuts, 4 * splitters)).alias("_marks")
    if by:
        hot = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("_distinct")).where(F.col("_distinct") > crowded)
        marked = counts.join(hot.select(*by), list(by), "left_semi").groupBy(*by).agg(marks)
        joined = counts.join(marked, list(by), "left")
    else:
        joined = counts.withColumn("_marks", counts.agg(F.when(F.count(F.lit(1)) > crowded, marks)).scalar())
    # Number of marks below the value; marks are ascending.
    below = F.size(F.filter("_marks", lambda m: m < F.col(value)))
    return joined.withColumn("_bucket", F.when(F.col("_marks").isNull(), F.lit(0)).otherwise(below)).drop("_marks")


def value_ranks(df: DataFrame, by: Sequence[str], value: str, splitters: int = SPLITTERS,
                weight: str | None = None) -> DataFrame:
    """One row per distinct (by, value): ``n`` rows, ``below`` rows smaller in the group, group ``size``.

    The pre-aggregated counts are written once; every later step reads them
    instead of running the input again.  ``weight`` says how many rows a row stands for.
    """
    by = list(by)
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(rows.alias("n")))
    bucketed = _bucket_values(counts, by, value, splitters)
    totals = bucketed.groupBy(*by, "_bucket").agg(F.sum("n").alias("_in_bucket"))
    # One row per bucket: at most `splitters` rows of a group reach these windows.
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_in_bucket").over(W.partitionBy(*by)).alias("size"))
    inside = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return bucketed.join(offsets, [*by, "_bucket"]).select(*by, value, "n", below.alias("below"), "size")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float],
                    splitters: int = SPLITTERS) -> DataFrame:
    """Linear-interpolation quantiles per group, one output column per entry of ``probs``."""
    by = list(by)
    ranked = value_ranks(df, by, value, splitters)
    aggs: list[Column] = []
    for name, p in probs.items():
        position = (F.col("size") - 1).cast("double") * F.lit(float(p))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
    agg = ranked.groupBy(*by).agg(F.max("size").alias("size"), *aggs)
    cols = []
    for name, p in probs.items():
        position = (F.col("size") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return agg.select(*by, *cols)


def average_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct (by, value) with the average rank ties share."""
    return value_ranks(df, by, value, weight=weight).select(
        *by, value, (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))


def centred_ranks(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Average ranks less their mean over the group, so they sum to zero."""
    return value_ranks(df, by, value, weight=weight).select(
        *by, value, (F.col("below") + (F.col("n") - F.col("size")) / F.lit(2.0)).alias("rank"))


def numbered_by_hash(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Add ``position`` 0..n-1 in a seeded pseudo-random order, without a global sort.

    The order is that of the MD5 digest of the keys and the seed, so every
    engine can reproduce it.  Its first three hex digits make 4096 even buckets.
    """
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(int(seed))))
    hashed = df.withColumn("_h", F.md5(text)).withColumn("_bucket", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 4096 rows reach this window and the broadcast.
    offsets = counts.select("_bucket", F.coalesce(
        F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_bucket").orderBy("_h", *keys)
    return (hashed.join(F.broadcast(offsets), "_bucket")
            .withColumn("position", (F.col("_offset") + F.row_number().over(inside) - 1).cast("long"))
            .drop("_h", "_bucket", "_offset"))
