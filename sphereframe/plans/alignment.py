"""Queries over joins and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as ops
from ..operators import scalers
from .registry import query
from .views import EVENT_TYPES, MEMBERS, PERSISTENCE_LEADS, Tables, hours


@query("D1", "SELECT a.node, a.time, z, tisr FROM v_obs a JOIN v_bc b ON a.node = b.node AND a.time = b.time")
def align(t: Tables):
    return ops.align(t.obs, t.bc)


@query("D2", """
SELECT a.node, a.time, a.z AS click, b.z AS view, c.z AS purchase FROM v_obsv a
JOIN v_obsv b ON a.node = b.node AND a.time = b.time AND b.variable = 'view'
JOIN v_obsv c ON a.node = c.node AND a.time = c.time AND c.variable = 'purchase' WHERE a.variable = 'click'""")
def align_many(t: Tables):
    one = {e: t.obsv.where(F.col("variable") == e).select("node", "time", F.col("z").alias(e)) for e in EVENT_TYPES}
    return ops.align_many([one["click"], one["view"], one["purchase"]])


@query("D3", f"SELECT frt, leadtime, node, z, frt + {hours('leadtime')} AS time FROM v_fcst")
def to_valid_time(t: Tables):
    return ops.to_valid_time(t.fcst)


@query("D4", "SELECT frt, leadtime, node, time, z_pred, z_obs, z_pred - z_obs AS z_err FROM v_pairs")
def forecast_error(t: Tables):
    return ops.forecast_error(t.fcst, t.obs, ["z"])


@query("D5", f"""
WITH s AS (SELECT node, hour(time) AS h, avg(z) AS mu, stddev_pop(z) AS sd FROM v_obs GROUP BY 1, 2)
SELECT p.frt, p.leadtime, p.node, p.time, (z_pred - mu) / nullif(sd, 0) AS z_pred, (z_obs - mu) / nullif(sd, 0) AS z_obs,
       (z_pred - mu) / nullif(sd, 0) - (z_obs - mu) / nullif(sd, 0) AS z_err
FROM v_pairs p JOIN s ON p.node = s.node AND hour(p.time) = s.h""")
def forecast_anom_error(t: Tables):
    stats = scalers.anomaly_fit(t.obs, ["z"], "hour")
    return scalers.forecast_anomaly_error(t.fcst, t.obs, stats, ["z"], "hour")


@query("D6", f"""
SELECT a.node, a.time AS frt, CAST(l AS INTEGER) AS leadtime, b.time, a.z AS z_pred, b.z AS z_obs
FROM v_obs a, (SELECT unnest(range(6, 235, 6)) AS l), v_obs b
WHERE b.node = a.node AND b.time = a.time + {hours('l')}""")
def persistence_forecast(t: Tables):
    return ops.persistence_forecast(t.obs, PERSISTENCE_LEADS, ["z"])


@query("D7", """
WITH c AS (SELECT node, week(time) AS w, avg(qty) AS mean_qty, avg(price) AS mean_price FROM v_clim
           WHERE time <= TIMESTAMP '1999-12-31' GROUP BY 1, 2)
SELECT v.node, v.time, week(v.time) AS weekofyear, mean_qty, mean_price FROM v_clim v LEFT JOIN c ON c.node = v.node AND week(v.time) = w
WHERE v.time >= TIMESTAMP '2000-01-01'""")
def climatology_forecast(t: Tables):
    clim = scalers.climatology(t.clim, ["qty", "price"], "weekofyear", period=(None, "1999-12-31"))
    test = t.clim.where(F.col("time") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("node", "time")
    return ops.climatology_forecast(test, clim, "weekofyear").select(
        "node", "time", "weekofyear", "mean_qty", "mean_price")


@query("D7", """
WITH c AS (SELECT node, dayofyear(time) AS d, avg(qty) AS mean_qty FROM v_clim WHERE time <= TIMESTAMP '1999-12-31' GROUP BY 1, 2)
SELECT v.node, v.time, dayofyear(v.time) AS dayofyear, mean_qty FROM v_clim v LEFT JOIN c ON c.node = v.node AND dayofyear(v.time) = d
WHERE v.time >= TIMESTAMP '2000-01-01'""")
def climatology_forecast_dayofyear(t: Tables):
    """Most days of a node have no earlier value: they stay, without a forecast."""
    clim = scalers.climatology(t.clim, ["qty"], "dayofyear", period=(None, "1999-12-31"))
    test = t.clim.where(F.col("time") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("node", "time")
    return ops.climatology_forecast(test, clim, "dayofyear").select("node", "time", "dayofyear", "mean_qty")


@query("D8", """
SELECT o.node, o.time, slt, orog_raw, tisr, z FROM v_obs o LEFT JOIN v_bc b ON o.node = b.node AND o.time = b.time
LEFT JOIN v_static s ON s.node = o.node""")
def attach_static_bc(t: Tables):
    return ops.attach_static_bc(t.obs, t.static, t.bc, ["slt", "orog_raw"], ["tisr"], ["z"])


@query("D9", "SELECT member, leadtime, node, avg(z) AS z, count(*) AS n FROM v_ens GROUP BY 1, 2, 3")
def concat_members(t: Tables):
    """Five runs stacked along member, then summarised per member."""
    def run(m: int):
        shift = F.pmod(F.lit(3) * F.col("node") + F.lit(5 * m) + F.col("leadtime"), F.lit(7)) - F.lit(3)
        return t.fcst.withColumn("z", F.col("z") + F.lit(0.25) * shift)

    stacked = ops.concat_members({m: run(m) for m in MEMBERS})
    return stacked.groupBy("member", "leadtime", "node").agg(F.avg("z").alias("z"), F.count(F.lit(1)).alias("n"))
