"""Scalers, anomalies and climatologies.

A fitted scaler is a DataFrame: one row for global statistics, one row per
(node, time group) for anomalies.  Global rows enter later plans as scalar
subqueries; grouped ones through an equi join that AQE broadcasts when the
table turns out small and splits when one node is heavy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TimeGroups, clip, safe_div, time_keys
from . import align
from .select import time_slice


def _row(stats: DataFrame) -> Column:
    """The single row of a statistics table as a struct-valued scalar subquery."""
    return stats.select(F.struct("*")).scalar()


# --- global scalers ---------------------------------------------------------------------------


def standard_fit(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row with ``mean_<v>``, ``std_<v>`` over all times and nodes."""
    aggs = []
    for v in variables:
        aggs += [F.avg(v).alias(f"mean_{v}"), F.stddev_pop(v).alias(f"std_{v}")]
    return df.agg(*aggs)


def standard_transform(df: DataFrame, stats: DataFrame, variables: Sequence[str]) -> DataFrame:
    s = _row(stats)
    return df.withColumns({v: safe_div(F.col(v) - s[f"mean_{v}"], s[f"std_{v}"]) for v in variables})


def standard_inverse(df: DataFrame, stats: DataFrame, variables: Sequence[str]) -> DataFrame:
    s = _row(stats)
    return df.withColumns({v: F.col(v) * s[f"std_{v}"] + s[f"mean_{v}"] for v in variables})


def minmax_fit(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row with ``min_<v>``, ``max_<v>``."""
    aggs = []
    for v in variables:
        aggs += [F.min(v).alias(f"min_{v}"), F.max(v).alias(f"max_{v}")]
    return df.agg(*aggs)


def minmax_transform(df: DataFrame, stats: DataFrame, variables: Sequence[str]) -> DataFrame:
    s = _row(stats)
    return df.withColumns({v: safe_div(F.col(v) - s[f"min_{v}"], s[f"max_{v}"] - s[f"min_{v}"]) for v in variables})


def minmax_inverse(df: DataFrame, stats: DataFrame, variables: Sequence[str]) -> DataFrame:
    s = _row(stats)
    return df.withColumns({v: F.col(v) * (s[f"max_{v}"] - s[f"min_{v}"]) + s[f"min_{v}"] for v in variables})


def feature_extrema(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(feature, max) over every other dimension; wide scan, long result."""
    wide = df.agg(*[F.max(v).alias(v) for v in variables])
    return wide.unpivot([], list(variables), "feature", "max")


# --- statistics per node and time group -------------------------------------------------------


def grouped_stats(df: DataFrame, variables: Sequence[str], groups: TimeGroups,
                  period: tuple = (None, None), node: str = "node") -> DataFrame:
    """``mean_<v>``, ``std_<v>`` per (node, time group) within an inclusive reference period."""
    keys = time_keys(groups)
    aggs = []
    for v in variables:
        aggs += [F.avg(v).alias(f"mean_{v}"), F.stddev_pop(v).alias(f"std_{v}")]
    return time_slice(df, *period).withColumns(keys).groupBy(node, *keys).agg(*aggs)


def anomaly_fit(df: DataFrame, variables: Sequence[str], groups: TimeGroups, period: tuple = (None, None),
                node: str = "node") -> DataFrame:
    return grouped_stats(df, variables, groups, period, node)


def climatology(df: DataFrame, variables: Sequence[str], groups: TimeGroups, period: tuple = (None, None),
                node: str = "node") -> DataFrame:
    """Mean and variability of each time group; same statistics as an anomaly scaler."""
    return grouped_stats(df, variables, groups, period, node)


def _with_stats(df: DataFrame, stats: DataFrame, groups: TimeGroups, time: str, node: str) -> tuple[DataFrame, list[str]]:
    """Rows with the statistics of their node and time group, NULL where the reference period has none: no row is lost."""
    keys = {f"_g_{k}": c for k, c in time_keys(groups, time).items()}
    lookup = stats.withColumnsRenamed({k[3:]: k for k in keys})
    return df.withColumns(keys).join(lookup, [node, *keys], "left"), list(keys)


def anomaly_transform(df: DataFrame, stats: DataFrame, variables: Sequence[str], groups: TimeGroups,
                      standardized: bool = True, time: str = "time", node: str = "node") -> DataFrame:
    """Subtract the mean of the row's time group, optionally divide by its spread."""
    joined, keys = _with_stats(df, stats, groups, time, node)
    out = {}
    for v in variables:
        anomaly = F.col(v) - F.col(f"mean_{v}")
        out[v] = safe_div(anomaly, F.col(f"std_{v}")) if standardized else anomaly
    return joined.withColumns(out).select(*df.columns)


def anomaly_inverse(df: DataFrame, stats: DataFrame, variables: Sequence[str], groups: TimeGroups,
                    standardized: bool = True, time: str = "time", node: str = "node") -> DataFrame:
    joined, keys = _with_stats(df, stats, groups, time, node)
    out = {v: (F.col(v) * F.col(f"std_{v}") if standardized else F.col(v)) + F.col(f"mean_{v}") for v in variables}
    return joined.withColumns(out).select(*df.columns)


def clipped_anomaly_minmax(df: DataFrame, stats: DataFrame, variables: Sequence[str], groups: TimeGroups,
                           limit: float = 8.0) -> DataFrame:
    """Min/max of standardised anomalies after clipping them to +-limit."""
    anomalies = anomaly_transform(df, stats, variables, groups)
    return minmax_fit(anomalies.withColumns({v: clip(v, -limit, limit) for v in variables}), variables)


def forecast_anomaly_error(fcst: DataFrame, obs: DataFrame, stats: DataFrame, variables: Sequence[str],
                           groups: TimeGroups, standardized: bool = True) -> DataFrame:
    """Forecast error in anomaly space.

    Both sides use the statistics of the same (node, valid time group), so one
    lookup after the alignment serves both.
    """
    joined, keys = _with_stats(align.forecast_error(fcst, obs, variables), stats, groups, "time", "node")
    columns = [c for c in joined.columns if c not in keys and c not in stats.columns or c in ("node", "time")]
    for v in variables:
        for side in ("pred", "obs"):
            anomaly = F.col(f"{v}_{side}") - F.col(f"mean_{v}")
            joined = joined.withColumn(f"{v}_{side}", safe_div(anomaly, F.col(f"std_{v}")) if standardized else anomaly)
        joined = joined.withColumn(f"{v}_err", F.col(f"{v}_pred") - F.col(f"{v}_obs"))
    return joined.select(*columns)


# --- chains and mergeable moments -------------------------------------------------------------

Step = tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]


class SequentialScaler:
    """Scalers applied in order, undone in reverse order.

    A step is a pair (transform, inverse) of ``DataFrame -> DataFrame``
    callables, each touching only the variables it knows.
    """

    def __init__(self, *steps: Step):
        self.steps = steps

    def transform(self, df: DataFrame) -> DataFrame:
        for forward, _ in self.steps:
            df = df.transform(forward)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        for _, backward in reversed(self.steps):
            df = df.transform(backward)
        return df


def standard_step(stats: DataFrame, variables: Sequence[str]) -> Step:
    return (lambda df: standard_transform(df, stats, variables), lambda df: standard_inverse(df, stats, variables))


def minmax_step(stats: DataFrame, variables: Sequence[str]) -> Step:
    return (lambda df: minmax_transform(df, stats, variables), lambda df: minmax_inverse(df, stats, variables))


def anomaly_step(stats: DataFrame, variables: Sequence[str], groups: TimeGroups, standardized: bool = True) -> Step:
    return (lambda df: anomaly_transform(df, stats, variables, groups, standardized),
            lambda df: anomaly_inverse(df, stats, variables, groups, standardized))


def moment_columns(variables: Sequence[str]) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in variables:
        aggs += [F.count(v).alias(f"n_{v}"), F.avg(v).alias(f"mean_{v}"), (F.var_pop(v) * F.count(v)).alias(f"m2_{v}")]
    return aggs


def partial_moments(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Mergeable (rows, and per variable values, mean and summed squared deviations) per key; NULLs are no values."""
    return df.groupBy(*keys).agg(*moment_columns(variables))


def merge_moments(partials: DataFrame, keys: Sequence[str], variables: Sequence[str],
                  min_var: float = 1e-30) -> DataFrame:
    """Add partial tables up and finish mean and variance (never below ``min_var``).

    Deviations of the partial means are taken from the overall mean, so large offsets cancel nothing.
    """
    centres = [safe_div(F.sum(F.col(f"n_{v}") * F.col(f"mean_{v}")), F.sum(f"n_{v}")).alias(f"_c_{v}") for v in variables]
    if keys:  # sums are combined before they travel, here and below
        means = partials.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*centres)
        same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        centred = partials.join(means, reduce(lambda a, b: a & b, same)).drop(*[f"_k_{k}" for k in keys])
    else:
        one = partials.agg(F.struct(*centres)).scalar()
        centred = partials.withColumns({f"_c_{v}": one[f"_c_{v}"] for v in variables})
    aggs = [F.sum("n").alias("n")]
    for v in variables:
        off = F.col(f"mean_{v}") - F.col(f"_c_{v}")
        total = F.sum(F.col(f"m2_{v}") + F.col(f"n_{v}") * off * off)
        aggs += [F.first(f"_c_{v}", ignorenulls=True).alias(f"mean_{v}"), F.greatest(safe_div(total, F.sum(f"n_{v}")), F.when(F.sum(f"n_{v}") > 0, F.lit(float(min_var)))).alias(f"var_{v}")]
    return centred.groupBy(*keys).agg(*aggs)
