"""Hovmoller diagrams: zonal or meridional means over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TimeGroups, time_keys, value_bin


def hovmoller(df: DataFrame, nodes: DataFrame, variables: Sequence[str], dim: str = "lat", bin_width: float = 5.0,
              groups: TimeGroups = None, average_first: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each variable per time group and latitude or longitude bin.

    With ``average_first`` every node is averaged over its time group before
    nodes are averaged in the bin, so nodes weigh equally however often they
    report; otherwise rows weigh equally.
    """
    keys = time_keys(groups)
    band = f"{dim}_bin"
    rows = df.withColumns(keys)
    if average_first and groups is not None:
        rows = rows.groupBy("node", *by, *keys).agg(*[F.avg(v).alias(v) for v in variables])
    banded = rows.join(nodes.select("node", value_bin(dim, bin_width).alias(band)), "node")
    return banded.groupBy(*by, *keys, band).agg(*[F.avg(v).alias(v) for v in variables])


def hovmoller_diff(pairs: DataFrame, nodes: DataFrame, variables: Sequence[str], dim: str = "lat",
                   bin_width: float = 5.0, groups: TimeGroups = None, average_first: bool = True,
                   by: Sequence[str] = ()) -> DataFrame:
    """Prediction and observation diagrams, their difference, the diagram of errors and the residual.

    The diagrams share their grouping, so one pass over aligned pairs makes all three.
    """
    errors = {f"{v}_err": F.col(f"{v}_pred") - F.col(f"{v}_obs") for v in variables}
    columns = [f"{v}_{s}" for v in variables for s in ("pred", "obs", "err")]
    diagram = hovmoller(pairs.withColumns(errors), nodes, columns, dim, bin_width, groups, average_first, by)
    for v in variables:
        diagram = diagram.withColumn(f"{v}_diff", F.col(f"{v}_pred") - F.col(f"{v}_obs"))
        diagram = diagram.withColumn(f"{v}_residual", F.col(f"{v}_diff") - F.col(f"{v}_err"))
    return diagram
