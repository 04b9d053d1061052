"""Projection and reshaping of fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import sphere


def rename_drop(df: DataFrame, var_dict: Mapping[str, str], drops: Sequence[str] = ()) -> DataFrame:
    """Rename raw variable codes and drop bounds columns."""
    if not isinstance(var_dict, Mapping):
        raise TypeError("var_dict must map raw names to new names")
    return df.drop(*drops).withColumnsRenamed(dict(var_dict))


def unstack_levels(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("node", "time"), var: str = "var",
                   plev: str = "plev", value: str = "value", agg=F.first) -> DataFrame:
    """(var, plev in Pa) -> one column ``<var><hPa>``; ``names`` fixes the columns and saves a pass."""
    label = F.concat(F.col(var), (F.col(plev) / 100).cast("int").cast("string"))
    return df.withColumn("_label", label).groupBy(*keys).pivot("_label", list(names)).agg(agg(value))


def stack_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("node", "time"),
                   feature: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(list(keys), list(features), feature, value)


def unstack_features(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("node", "time"),
                     feature: str = "feature", value: str = "value") -> DataFrame:
    """Long -> wide."""
    return df.groupBy(*keys).pivot(feature, list(features)).agg(F.first(value))


def select_common_vars(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("node", "time"),
                       wanted: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the variables they share (and that are wanted)."""
    shared = [c for c in a.columns if c in b.columns and c not in keys and (wanted is None or c in wanted)]
    if not shared:
        raise ValueError("the tables have no variable in common")
    return a.select(*keys, *shared), b.select(*keys, *shared)


def merge_vars(tables: Sequence[DataFrame], keys: Sequence[str] = ("node", "time")) -> DataFrame:
    """Combine tables of different variables on their coordinates, keeping every coordinate.

    Coordinates are unique per table, so a union and one aggregation do what a
    chain of full outer joins would, with a single exchange.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    variables = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.first(v, ignorenulls=True).alias(v) for v in variables])


def one_hot(df: DataFrame, column: str, categories: Sequence, prefix: str | None = None) -> DataFrame:
    """Indicator column per category."""
    prefix = prefix or column
    return df.withColumns({
        f"{prefix}_{c}": F.when(F.col(column).isNotNull(), (F.col(column) == F.lit(c)).cast("long")) for c in categories
    })


def clamp_lower(df: DataFrame, column: str, lo: float = 0.0) -> DataFrame:
    return df.withColumn(column, fc.floor_at(column, lo))


def scale_by_max(df: DataFrame, column: str, output: str | None = None) -> DataFrame:
    """Divide a column by its maximum over the whole table."""
    top = df.agg(F.max(column)).scalar()
    return df.withColumn(output or column, fc.safe_div(F.col(column), top))


def coord_features(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """sin(lat), sin(lon), cos(lon) of coordinates in degrees."""
    return df.withColumns({
        "sin_latitude": F.sin(F.radians(lat)),
        "sin_longitude": F.sin(F.radians(lon)),
        "cos_longitude": F.cos(F.radians(lon)),
    })


def lonlat_xyz(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    x, y, z = sphere.lonlat_to_xyz(lon, lat)
    return df.withColumns({"x": x, "y": y, "z": z})


def xyz_lonlat(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    lon, lat = sphere.xyz_to_lonlat(x, y, z)
    return df.withColumns({"lon": lon, "lat": lat})


def clip(df: DataFrame, columns: Sequence[str], lo: float, hi: float) -> DataFrame:
    return df.withColumns({c: fc.clip(c, lo, hi) for c in columns})
