"""Row selection: time ranges, splits, file repairs, first-n and top-k."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles


def _ntz(t) -> Column:
    return t if isinstance(t, Column) else F.lit(str(t)).cast("timestamp_ntz")


def until(time: Column, end) -> Column:
    """Not after ``end``; a label without time of day (2020-01-31) holds the whole day."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(end)) and not isinstance(end, Column):
        return time < F.lit(str(date.fromisoformat(str(end)) + timedelta(days=1))).cast("timestamp_ntz")
    return time <= _ntz(end)


def time_slice(df: DataFrame, start=None, end=None, time: str = "time") -> DataFrame:
    """Rows of an inclusive period; either end may be open."""
    if start is not None:
        df = df.where(F.col(time) >= _ntz(start))
    if end is not None:
        df = df.where(until(F.col(time), end))
    return df


def split_periods(df: DataFrame, periods: Mapping[str, tuple], time: str = "time", label: str = "split") -> DataFrame:
    """Label rows with the (inclusive, disjoint) period they fall in; rows in none are dropped."""
    expr = None
    inside = None
    for name, (start, end) in periods.items():
        hit = (F.col(time) >= _ntz(start)) & until(F.col(time), end)
        expr = F.when(hit, F.lit(name)) if expr is None else expr.when(hit, F.lit(name))
        inside = hit if inside is None else inside | hit
    if expr is None:
        raise ValueError("no periods given")
    return df.where(inside).withColumn(label, expr)


def fix_file_month(df: DataFrame, file_name: str, time: str = "time",
                   pattern: str = r"_(\d{4})_(\d{2})") -> DataFrame:
    """Keep rows whose month is the month in the name of their file."""
    in_name = F.regexp_extract(F.col(file_name), pattern, 2).cast("int")
    return df.where(F.month(time) == in_name)


def fix_file_upper_bound(df: DataFrame, file_year: str | Column, time: str = "time", cutoff=(3, 1, 6),
                         start: str | None = None) -> DataFrame:
    """Per-file upper bound ``<year>-03-01T06`` and an optional lower bound for the whole table."""
    month, day, hour = cutoff
    year = F.col(file_year) if isinstance(file_year, str) else file_year
    bound = F.make_timestamp_ntz(year.cast("int"), F.lit(month), F.lit(day), F.lit(hour), F.lit(0), F.lit(0))
    df = df.where(F.col(time) <= bound)
    return df.where(F.col(time) >= _ntz(start)) if start is not None else df


def select_times(df: DataFrame, times: DataFrame, time: str = "time") -> DataFrame:
    """Rows at exactly the listed time stamps (the plan broadcasts the list when it is small)."""
    return df.join(times.select(time), time, "left_semi")


def _first_distinct(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n smallest distinct values: a distributed take-ordered, at most n rows."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)


def first_n_leadtimes(df: DataFrame, n: int, leadtime: str = "leadtime") -> DataFrame:
    """Rows of the n shortest lead times."""
    return df.join(F.broadcast(_first_distinct(df, leadtime, n)), leadtime, "left_semi")


def head_timesteps(df: DataFrame, k: int, time: str = "time") -> DataFrame:
    """Rows of the first k distinct time steps of the table."""
    return df.join(F.broadcast(_first_distinct(df, time, k)), time, "left_semi")


def first_per_month(df: DataFrame, months: Sequence[int], time: str = "time") -> DataFrame:
    """First time stamp in each of the chosen months, over all years."""
    month = F.month(time).cast("long")
    return (df.where(F.month(time).isin([int(m) for m in months]))
            .groupBy(month.alias("month")).agg(F.min(time).alias(time)))


def topk_by_median(df: DataFrame, group: Sequence[str], metric: str, k: int, ascending: bool = True) -> DataFrame:
    """The k groups with the best median of a metric; ties by group key."""
    medians = exact_quantiles(df, group, metric, {"median": 0.5})
    order = F.col("median").asc() if ascending else F.col("median").desc()
    return medians.orderBy(order, *group).limit(k)
