"""Parquet stores of fields keyed by (node, time)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..operators.select import until

KEYS = ("node", "time")


def _ntz(t: str | datetime) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def _time_range(df: DataFrame, start, end, time: str = "time") -> DataFrame:
    """Inclusive time range; also states it on ``year``/``month`` so partitions prune."""
    partitioned = {"year", "month"} <= set(df.columns)
    for bound, is_start in ((start, True), (end, False)):
        if bound is None:
            continue
        t = _ntz(bound)
        df = df.where(F.col(time) >= t if is_start else until(F.col(time), bound))
        if partitioned:
            stamp = datetime.fromisoformat(str(bound))
            month_no = F.col("year") * 12 + F.col("month")
            edge = stamp.year * 12 + stamp.month
            df = df.where(F.col("year") >= stamp.year if is_start else F.col("year") <= stamp.year)
            df = df.where(month_no >= edge if is_start else month_no <= edge)
    return df


def read_grid(source: DataFrame | str, columns: Sequence[str] | None = None, start=None, end=None,
              spark: SparkSession | None = None) -> DataFrame:
    """Open a store lazily, keep the wanted features and an inclusive time range.

    ``source`` is a path, or a table already opened from another format.
    """
    df = source if isinstance(source, DataFrame) else (spark or SparkSession.active()).read.parquet(source)
    df = _time_range(df, start, end) if "time" in df.columns else df
    if columns is None:
        return df
    keys = [k for k in KEYS if k in df.columns]
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not in store; it has {df.columns}")
    return df.select(*keys, *[c for c in columns if c not in keys])


def read_raw(spark: SparkSession, glob: str, name_pattern: str, time: str = "time",
             start=None, end=None) -> DataFrame:
    """All raw files a glob matches, tagged with the part of their path that names them.

    Files without rows in the range simply contribute none; row-group
    statistics let the scan skip them.
    """
    df = spark.read.parquet(glob)
    df = df.select("*", F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 0).alias("file_name"))
    return _time_range(df, start, end, time)


def with_partition_columns(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumn("year", F.year(time)).withColumn("month", F.month(time))


def write_grid(df: DataFrame, path: str, mode: str = "error", time: str = "time") -> None:
    """Write a store partitioned by year and month.

    ``mode``: ``error`` (default), ``force`` (replace everything), ``append``,
    or ``update`` (replace only the months present in ``df``).  A REBALANCE
    before the write keeps files even: small months merge, heavy ones split.
    """
    modes = {"error": "error", "force": "overwrite", "append": "append", "update": "overwrite"}
    if mode not in modes:
        raise ValueError(f"mode {mode!r} not in {sorted(modes)}")
    parts = ["year", "month"]
    out = with_partition_columns(df, time).hint("rebalance", *parts)
    writer = out.write.mode(modes[mode]).partitionBy(*parts)
    overwrite = "dynamic" if mode == "update" else "static"
    writer.option("partitionOverwriteMode", overwrite).parquet(path)


def relayout(df: DataFrame, by: str, time: str = "time", node: str = "node",
             partitions: int | None = None) -> DataFrame:
    """Reorder a store time-contiguously (``by='time'``) or node-contiguously (``by='node'``).

    Both keys take part in the range split, so a node (or step) with very many
    rows is cut over several partitions.
    """
    order = {"time": [time, node], "node": [node, time]}.get(by)
    if order is None:
        raise ValueError("by must be 'time' or 'node'")
    keys = [F.col(c) for c in order]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*order)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, mode: str = "error", node: str = "node", time: str = "time") -> None:
    """Node-contiguous layout: a catalogue table bucketed by ``node`` and sorted by (node, time) inside, one file a bucket.

    Grouping the table by ``node``, alone or with further keys, needs no exchange any more, and neither do windows over a node.  The write pays
    that shuffle once.  ``mode`` is ``error`` (default) or ``force`` (replace the table).  A node's whole series lies in one file: this layout is
    for nodes of comparable length, :func:`relayout` cuts longer ones.
    """
    modes = {"error": "error", "force": "overwrite"}
    if mode not in modes:
        raise ValueError(f"mode {mode!r} not in {sorted(modes)}")
    spread = df.repartition(buckets, node).sortWithinPartitions(node, time)
    spread.write.mode(modes[mode]).option("path", path).bucketBy(buckets, node).sortBy(node, time).saveAsTable(table)


def read_bucketed(spark: SparkSession, table: str, columns: Sequence[str] | None = None, start=None, end=None) -> DataFrame:
    """Open a node-contiguous table; a time range is pushed to the scan and does not touch the layout."""
    return read_grid(spark.table(table), columns, start, end)


def save_stats(stats: DataFrame, path: str) -> None:
    """Persist a scaler or climatology table."""
    stats.write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_skills(tables: Mapping[str, DataFrame], rename: Mapping[str, str] | None = None,
                scale: Mapping[str, float] | None = None, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Stack the skill tables of several experiments, tagged by ``forecast``.

    ``rename``, ``scale`` (per column factor) and ``defaults`` (columns to add
    where absent) adapt foreign tables.
    """
    if not tables:
        raise ValueError("no skill tables given")
    parts = []
    for name, df in tables.items():
        if rename:
            df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
        for c, factor in (scale or {}).items():
            if c in df.columns:
                df = df.withColumn(c, F.col(c) * F.lit(float(factor)))
        for c, value in (defaults or {}).items():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(value))
        parts.append(df.withColumn("forecast", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_static(tables: Sequence[DataFrame], on: str = "node", drops: Sequence[str] = (),
                 renames: Mapping[str, str] | None = None) -> DataFrame:
    """Join static single-variable tables on the node and clean their columns."""
    merged = reduce(lambda a, b: a.join(b, on), tables)
    return merged.drop(*drops).withColumnsRenamed(dict(renames or {}))


def extract_toy(stores: Mapping[str, DataFrame], start, end, time: str = "time") -> dict[str, DataFrame]:
    """Cut the time-dependent stores to a period; static ones pass unchanged."""
    return {name: _time_range(df, start, end, time) if time in df.columns else df for name, df in stores.items()}


def round_on_write(df: DataFrame, digits: int | Mapping[str, int], columns: Sequence[str] | None = None) -> DataFrame:
    """Round value columns, by one number of digits or a dict per column."""
    if isinstance(digits, int):
        keys = {"node", "time", "frt", "leadtime", "member"}
        names = columns or [f.name for f in df.schema.fields
                            if f.name not in keys and f.dataType.typeName() in ("double", "float")]
        digits = {c: digits for c in names}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def pending_files(src: DataFrame, done: DataFrame, path: str, done_path: str, src_root: str, dst_root: str,
                  src_ext: str, dst_ext: str) -> DataFrame:
    """Inputs whose output (same relative path, other root and extension) does not exist yet."""
    relative = F.regexp_replace(col(path), f"^{re.escape(src_root)}", _literal(dst_root))
    planned = src.withColumn("target", F.regexp_replace(relative, f"{re.escape(src_ext)}$", _literal(dst_ext)))
    finished = done.select(F.col(done_path).alias("target"))
    return planned.join(finished, "target", "left_anti")
