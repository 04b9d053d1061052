"""Previous/next row of a series, chunked in time so one long series spreads over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


HOUR_US = 3_600_000_000


def epoch_micros(t: str | Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(t) if isinstance(t, str) else t)


def chunk_index(t: str | Column, hours: int) -> Column:
    """Number of the ``hours``-long stretch of time a time stamp lies in; never decreases with time."""
    return F.floor(epoch_micros(t) / (HOUR_US * hours))


def with_previous(df: DataFrame, keys: Sequence[str], time: str, carry: Sequence[str],
                  chunk: Column | None = None) -> DataFrame:
    """Add ``prev_<c>`` for each column of ``carry``: its value one row earlier in the series.

    ``chunk`` is a non-decreasing function of ``time`` (default: calendar
    month).  Rows are ordered inside (keys, chunk); only the last row of every
    chunk travels to the next chunk.
    """
    keys = list(keys)
    chunk = F.trunc(F.col(time).cast("date"), "month") if chunk is None else chunk
    chunked = df.withColumn("_chunk", chunk)
    row = F.struct(F.col(time).alias("_t"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    last = chunked.groupBy(*keys, "_chunk").agg(F.max_by(row, F.col(time)).alias("_row"))
    handed = last.select(*keys, "_chunk", F.lag("_row").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_handed"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(time)
    first = F.row_number().over(inside) == 1
    joined = chunked.join(handed, [*keys, "_chunk"], "left")
    out = joined
    for c in carry:
        out = out.withColumn(f"prev_{c}", F.when(first, F.col("_handed").getField(f"_c_{c}"))
                             .otherwise(F.lag(c).over(inside)))
    return out.drop("_chunk", "_handed")
