"""Joins between observations, forecasts, climatologies and side tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import TimeGroups, shift_hours, time_keys
from ..functions.series import HOUR_US, chunk_index, epoch_micros


def align(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("node", "time")) -> DataFrame:
    """Inner alignment on shared coordinates; Catalyst picks the join."""
    return a.join(b, list(keys))


def align_many(tables: Sequence[DataFrame], keys: Sequence[str] = ("node", "time")) -> DataFrame:
    """n-way inner alignment; equal keys mean every input is exchanged at most once."""
    return reduce(lambda a, b: align(a, b, keys), tables)


def to_valid_time(fcst: DataFrame, frt: str = "frt", leadtime: str = "leadtime", keep_frt: bool = True) -> DataFrame:
    """Add ``time = frt + leadtime`` (hours).  Without ``keep_frt`` the reference time is
    dropped, which is an error if there are several: valid times would repeat."""
    out = fcst.withColumn("time", shift_hours(frt, F.col(leadtime)))
    if keep_frt:
        return out
    first, last = fcst.agg(F.min(frt), F.max(frt)).first()
    if first != last:
        raise ValueError("several reference times; keep them or select one")
    return out.drop(frt)


def forecast_error(fcst: DataFrame, obs: DataFrame, variables: Sequence[str], frt: str = "frt",
                   leadtime: str = "leadtime") -> DataFrame:
    """Prediction, observation and error of each variable at valid times."""
    valid = to_valid_time(fcst, frt, leadtime)
    pred = valid.withColumnsRenamed({v: f"{v}_pred" for v in variables})
    truth = obs.select("node", "time", *[F.col(v).alias(f"{v}_obs") for v in variables])
    joined = align(pred, truth)
    return joined.withColumns({f"{v}_err": F.col(f"{v}_pred") - F.col(f"{v}_obs") for v in variables})


def persistence_forecast(obs: DataFrame, leads: Sequence[int], variables: Sequence[str]) -> DataFrame:
    """Value at t as forecast for t + lead (hours), paired with the observation there.

    Fanning every row out to its leads before the join would shuffle the table
    once per lead.  Instead time is cut into chunks as long as the longest lead:
    a row travels to the one or two chunks its valid times lie in, meets the
    observations of that (node, chunk), and the lead follows from the pair.  All
    leads are multiples of their greatest common divisor, so the remainder of the
    clock joins the key: finer series than the leads meet only rows that fit.
    """
    leads = sorted({int(h) for h in leads})
    chunk = max(leads[-1], 1)
    remainder = HOUR_US * max(gcd(*leads), 1)
    fcst = obs.select("node", F.col("time").alias("frt"), *[F.col(v).alias(f"{v}_pred") for v in variables])
    fcst = fcst.withColumn("_chunk", F.explode(F.sequence(
        chunk_index(shift_hours("frt", leads[0]), chunk), chunk_index(shift_hours("frt", leads[-1]), chunk))))
    fcst = fcst.withColumn("_rest", F.pmod(epoch_micros("frt"), F.lit(remainder)))
    truth = obs.select("node", "time", chunk_index("time", chunk).alias("_chunk"),
                       F.pmod(epoch_micros("time"), F.lit(remainder)).alias("_rest"),
                       *[F.col(v).alias(f"{v}_obs") for v in variables])
    apart = epoch_micros("time") - epoch_micros("frt")
    pairs = fcst.join(truth, ["node", "_chunk", "_rest"]).where(apart.isin([HOUR_US * h for h in leads]))
    return pairs.withColumn("leadtime", (apart / HOUR_US).cast("int")).drop("_chunk", "_rest")


def climatology_forecast(times: DataFrame, clim: DataFrame, groups: TimeGroups, node: str = "node") -> DataFrame:
    """Look the climatology of each row's node and time group up; NULL where there is none."""
    keys = time_keys(groups)
    return times.withColumns(keys).join(clim, [node, *keys], "left")


def attach_static_bc(dynamic: DataFrame, static: DataFrame, bc: DataFrame, static_vars: Sequence[str],
                     bc_vars: Sequence[str], dynamic_vars: Sequence[str]) -> DataFrame:
    """Static features by node and boundary conditions by (node, time), NULL where there are none; columns in feature order.

    Every row of ``dynamic`` stays.
    """
    joined = dynamic.join(bc, ["node", "time"], "left").join(static, "node", "left")
    return joined.select("node", "time", *static_vars, *bc_vars, *dynamic_vars)


def concat_members(runs: Mapping[int, DataFrame]) -> DataFrame:
    """Stack runs of a model along ``member``."""
    if not runs:
        raise ValueError("no runs given")
    tagged = [df.withColumn("member", F.lit(int(m))) for m, df in runs.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)
