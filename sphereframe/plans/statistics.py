"""Queries over scalers, anomalies, climatologies and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, scalers
from .registry import query
from .views import Tables

VARS = ["qty", "price", "disc"]
REF = (None, "1999-12-31")


def _fit_sql(view: str, variables, groups: dict[str, str], where: str = "") -> str:
    keys = ", ".join(f"{e} AS {k}" for k, e in groups.items())
    aggs = ", ".join(f"avg({v}) AS mean_{v}, stddev_pop({v}) AS std_{v}" for v in variables)
    n = len(groups) + 1
    return f"SELECT node, {keys}, {aggs} FROM {view} {where} GROUP BY {', '.join(map(str, range(1, n + 1)))}"


@query("E1", "SELECT " + ", ".join(f"avg({v}) AS mean_{v}, stddev_pop({v}) AS std_{v}" for v in VARS) + " FROM v_clim")
def global_standard_fit(t: Tables):
    return scalers.standard_fit(t.clim, VARS)


@query("E2", """
WITH s AS (SELECT avg(qty) AS mq, stddev_pop(qty) AS sq, avg(price) AS mp, stddev_pop(price) AS sp FROM v_clim)
SELECT node, time, (qty - mq) / sq AS qty, (price - mp) / sp AS price FROM v_clim, s""")
def global_standard_transform(t: Tables):
    stats = scalers.standard_fit(t.clim, ["qty", "price"])
    return scalers.standard_transform(t.clim, stats, ["qty", "price"]).select("node", "time", "qty", "price")


@query("E2", "SELECT node, time, qty, price, disc FROM v_clim")
def global_standard_inverse(t: Tables):
    """Round trip."""
    stats = scalers.standard_fit(t.clim, VARS)
    return scalers.standard_inverse(scalers.standard_transform(t.clim, stats, VARS), stats, VARS)


@query("E3", "SELECT " + ", ".join(f"min({v}) AS min_{v}, max({v}) AS max_{v}" for v in VARS) + " FROM v_clim")
def global_minmax_fit(t: Tables):
    return scalers.minmax_fit(t.clim, VARS)


@query("E3", """
WITH s AS (SELECT min(qty) AS lq, max(qty) AS hq, min(disc) AS ld, max(disc) AS hd FROM v_clim)
SELECT node, time, (qty - lq) / (hq - lq) AS qty, (disc - ld) / (hd - ld) AS disc FROM v_clim, s""")
def global_minmax_transform(t: Tables):
    stats = scalers.minmax_fit(t.clim, ["qty", "disc"])
    return scalers.minmax_transform(t.clim, stats, ["qty", "disc"]).select("node", "time", "qty", "disc")


@query("E3", "SELECT node, time, qty, price, disc FROM v_clim")
def global_minmax_inverse(t: Tables):
    """Round trip."""
    stats = scalers.minmax_fit(t.clim, VARS)
    return scalers.minmax_inverse(scalers.minmax_transform(t.clim, stats, VARS), stats, VARS)


def _register_fit(survey_id: str, name: str, view: str, variables, groups, sql_groups: dict[str, str], period, fit):
    where = f"WHERE time <= TIMESTAMP '{period[1]}'" if period[1] else ""

    def build(t: Tables):
        return fit(getattr(t, view), variables, groups, period)

    query(survey_id, _fit_sql(f"v_{view}", variables, sql_groups, where), name)(build)


_MONTH = {"month": "month(time)"}
_WEEK = {"weekofyear": "week(time)"}
_DOY = {"dayofyear": "dayofyear(time)"}
_register_fit("E4", "anomaly_fit_month", "clim", VARS, "month", _MONTH, REF, scalers.anomaly_fit)
_register_fit("E4", "anomaly_fit_week", "clim", VARS, "weekofyear", _WEEK, REF, scalers.anomaly_fit)
_register_fit("E4", "anomaly_fit_week_hour", "obs", ["z"], ["weekofyear", "hour"],
              {**_WEEK, "hour": "hour(time)"}, ("2024-01-01", "2024-01-25T18:00:00"), scalers.anomaly_fit)
_register_fit("E5", "climatology_month", "clim", VARS, "month", _MONTH, REF, scalers.climatology)
_register_fit("E5", "climatology_week", "clim", VARS, "weekofyear", _WEEK, REF, scalers.climatology)
_register_fit("E5", "climatology_dayofyear", "clim", VARS, "dayofyear", _DOY, REF, scalers.climatology)
_register_fit("E5", "climatology_hour_month", "obs", ["z"], ["hour", "month"],
              {"hour": "hour(time)", **_MONTH}, (None, None), scalers.climatology)
_register_fit("E5", "climatology_hour_week", "obs", ["z"], ["hour", "weekofyear"],
              {"hour": "hour(time)", **_WEEK}, (None, None), scalers.climatology)

_ANOM = """
WITH s AS (SELECT node, month(time) AS m, avg(qty) AS mq, stddev_pop(qty) AS sq, avg(price) AS mp,
           stddev_pop(price) AS sp FROM v_clim WHERE time <= TIMESTAMP '1999-12-31' GROUP BY 1, 2)
SELECT c.node, c.time, {cols} FROM v_clim c LEFT JOIN s ON s.node = c.node AND s.m = month(c.time)"""


@query("E6", _ANOM.format(cols="(qty - mq) / nullif(sq, 0) AS qty, (price - mp) / nullif(sp, 0) AS price"))
def anomaly_transform_standardized(t: Tables):
    stats = scalers.anomaly_fit(t.clim, ["qty", "price"], "month", REF)
    return scalers.anomaly_transform(t.clim, stats, ["qty", "price"], "month").drop("disc")


@query("E6", _ANOM.format(cols="qty - mq AS qty, price - mp AS price"))
def anomaly_transform_plain(t: Tables):
    stats = scalers.anomaly_fit(t.clim, ["qty", "price"], "month", REF)
    return scalers.anomaly_transform(t.clim, stats, ["qty", "price"], "month", standardized=False).drop("disc")


@query("E7", _ANOM.format(cols="CASE WHEN sq > 0 THEN qty END AS qty, CASE WHEN sp > 0 THEN price END AS price"))
def anomaly_inverse(t: Tables):
    """Round trip through standardised anomalies."""
    stats = scalers.anomaly_fit(t.clim, ["qty", "price"], "month", REF)
    anomalies = scalers.anomaly_transform(t.clim, stats, ["qty", "price"], "month")
    return scalers.anomaly_inverse(anomalies, stats, ["qty", "price"], "month").drop("disc")


@query("E8", """
WITH s AS (SELECT node, week(time) AS w, avg(price) AS mu, stddev_pop(price) AS sd FROM v_clim GROUP BY 1, 2),
a AS (SELECT (price - mu) / nullif(sd, 0) AS x FROM v_clim c JOIN s ON s.node = c.node AND s.w = week(c.time))
SELECT min(greatest(least(x, 8.0::DOUBLE), -8.0::DOUBLE)) AS min_price,
       max(greatest(least(x, 8.0::DOUBLE), -8.0::DOUBLE)) AS max_price FROM a WHERE x IS NOT NULL""")
def clipped_anomaly_minmax(t: Tables):
    stats = scalers.anomaly_fit(t.clim, ["price"], "weekofyear")
    return scalers.clipped_anomaly_minmax(t.clim, stats, ["price"], "weekofyear")


@query("E9", _ANOM.replace("SELECT c.node", ", g AS (SELECT min(disc) AS ld, max(disc) AS hd FROM v_clim) "
                           "SELECT c.node", 1).format(
    cols="(qty - mq) / nullif(sq, 0) AS qty, price - mp AS price, (disc - ld) / (hd - ld) AS disc") .replace(
    "FROM v_clim c LEFT JOIN s", "FROM g CROSS JOIN v_clim c LEFT JOIN s"))
def sequential_scaler(t: Tables):
    """Three scalers in a row, each for its own variable."""
    qty = scalers.anomaly_fit(t.clim, ["qty"], "month", REF)
    price = scalers.anomaly_fit(t.clim, ["price"], "month", REF)
    disc = scalers.minmax_fit(t.clim, ["disc"])
    chain = scalers.SequentialScaler(
        scalers.anomaly_step(qty, ["qty"], "month"),
        scalers.anomaly_step(price, ["price"], "month", standardized=False),
        scalers.minmax_step(disc, ["disc"]))
    return chain.transform(t.clim)


@query("E9", "SELECT node, time, qty, price, disc FROM v_clim")
def sequential_scaler_inverse(t: Tables):
    """Forward in order, back in reverse order."""
    chain = scalers.SequentialScaler(
        scalers.standard_step(scalers.standard_fit(t.clim, ["qty", "price"]), ["qty", "price"]),
        scalers.minmax_step(scalers.minmax_fit(t.clim, ["price", "disc"]), ["price", "disc"]))
    return chain.inverse(chain.transform(t.clim))


@query("E10", " UNION ALL ".join(f"SELECT '{v}' AS feature, max({v}) AS max FROM v_clim" for v in VARS))
def feature_extrema(t: Tables):
    return scalers.feature_extrema(t.clim, VARS)


@query("E11", "SELECT node, count(*) AS n, avg(qty) AS mean_qty, greatest(var_pop(qty), 1e-30::DOUBLE) AS var_qty, "
              "avg(disc) AS mean_disc, greatest(var_pop(disc), 1e-30::DOUBLE) AS var_disc FROM v_clim GROUP BY node")
def mergeable_moments(t: Tables):
    """Partial moments per year, merged over years."""
    by_year = scalers.partial_moments(t.clim.withColumn("year", F.year("time")), ["node", "year"], ["qty", "disc"])
    return scalers.merge_moments(by_year, ["node"], ["qty", "disc"])


_ODD = "CASE WHEN (node + hour(time)) % 5 <> 0 THEN z END"


@query("E11", f"SELECT node, count(*) AS n, round(avg(y) + 50000.0::DOUBLE, 6) AS mean_y, round(var_pop(y), 6) AS var_y FROM (SELECT node, {_ODD} AS y FROM v_obs) GROUP BY node "
              "HAVING count(y) > 0 AND var_pop(y) > 0")
def mergeable_moments_nulls(t: Tables):
    """Missing values and a large offset: moments count values only and lose no digits."""
    field = t.obs.withColumn("y", F.when((F.col("node") + F.hour("time")) % 5 != 0, F.col("z") + F.lit(50000.0))).withColumn("day", F.to_date("time"))
    merged = scalers.merge_moments(scalers.partial_moments(field, ["node", "day"], ["y"]), ["node"], ["y"])
    return merged.where(F.col("var_y") > 1e-20).select("node", "n", F.round("mean_y", 6).alias("mean_y"), F.round("var_y", 6).alias("var_y"))


# --- data quality ----------------------------------------------------------------------------


@query("L1", """
SELECT node, prev AS gap_start, time AS gap_end, CAST(epoch(time - prev) / 21600 - 1 AS BIGINT) AS missing FROM
(SELECT node, time, lag(time) OVER (PARTITION BY node ORDER BY time) AS prev FROM v_obs)
WHERE time - prev > INTERVAL 6 HOUR""")
def missing_timesteps(t: Tables):
    return quality.missing_timesteps(t.obs, 6)


@query("L2", """
SELECT variable, sum(CAST(NOT within AS BIGINT))::BIGINT AS mismatches, count(*) AS compared, max(diff) AS max_abs_diff FROM (
SELECT 'qty' AS variable, abs(a - b) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(b) AS within, abs(a - b) AS diff FROM
(SELECT qty AS a, qty * (1.0::DOUBLE + (node % 3) * 0.0000078125::DOUBLE) AS b FROM v_clim)) GROUP BY 1""")
def allclose(t: Tables):
    nudge = F.lit(1.0) + F.pmod(F.col("node"), F.lit(3)).cast("double") * F.lit(0.0000078125)
    return quality.allclose(t.clim, t.clim.withColumn("qty", F.col("qty") * nudge), ["qty"])


@query("L3", "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(t: Tables):
    hourly = t.table("events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return quality.duplicates(hourly, ["user_id", "hour"])


@query("L4", """
WITH s AS (SELECT node, month(time) AS m, avg(price) AS mu, stddev_pop(price) AS sd FROM v_clim GROUP BY 1, 2)
SELECT c.node, c.time, price, (price - mu) / sd AS anomaly FROM v_clim c
JOIN s ON s.node = c.node AND s.m = month(c.time) WHERE sd > 0 AND abs((price - mu) / sd) > 2""")
def outliers(t: Tables):
    stats = scalers.anomaly_fit(t.clim, ["price"], "month")
    return quality.outliers(t.clim, stats, "price", "month", 2.0)
