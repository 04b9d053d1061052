"""Checks on series and comparisons of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TimeGroups
from ..functions.series import HOUR_US, epoch_micros, with_previous
from .scalers import anomaly_transform


def missing_timesteps(df: DataFrame, step_hours: int, node: str = "node", time: str = "time") -> DataFrame:
    """Gaps of a regular series: last step before, first step after, steps missing between."""
    prev = with_previous(df.select(node, time), [node], time, [time])
    gap = (epoch_micros(time) - epoch_micros(f"prev_{time}")) / HOUR_US
    return (prev.where(gap > step_hours)
            .select(node, F.col(f"prev_{time}").alias("gap_start"), F.col(time).alias("gap_end"),
                    (F.floor(gap / step_hours) - 1).cast("long").alias("missing")))


def allclose(a: DataFrame, b: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("node", "time"),
             rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Per variable: rows outside ``atol + rtol*|b|`` (or present on one side only), rows compared, largest difference."""
    left = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in variables])
    right = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in variables])
    both = left.join(right, list(keys), "full")
    aggs = []
    for v in variables:
        x, y = F.col(f"_a_{v}"), F.col(f"_b_{v}")
        same = (x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y), F.lit(False))
        aggs.append(F.struct(F.lit(v).alias("variable"), F.sum((~same).cast("long")).alias("mismatches"),
                             F.count(F.lit(1)).alias("compared"), F.max(F.abs(x - y)).alias("max_abs_diff")).alias(v))
    row = both.agg(*aggs)
    return reduce(DataFrame.unionByName, [row.select(f"{v}.*") for v in variables]) if len(variables) == 1 else (
        row.select(F.explode(F.array(*[F.col(v) for v in variables])).alias("_r")).select("_r.*"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outliers(df: DataFrame, stats: DataFrame, variable: str, groups: TimeGroups, limit: float = 8.0) -> DataFrame:
    """Rows whose standardised anomaly exceeds ``limit``."""
    anomalies = anomaly_transform(df.withColumn("anomaly", F.col(variable)),
                                  stats.withColumnsRenamed({f"mean_{variable}": "mean_anomaly",
                                                            f"std_{variable}": "std_anomaly"}), ["anomaly"], groups)
    return anomalies.where(F.abs(F.col("anomaly")) > limit).select("node", "time", variable, "anomaly")
