"""Queries over projection, reshaping and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reshape, select
from .registry import query
from .views import EVENT_TYPES, Tables

LEVEL_NAMES = [f"{e}{p}" for e in EVENT_TYPES for p in (500, 850, 1000)]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("B1", "SELECT user_id AS node, ts AS time, value AS z, event_type AS t FROM events")
def rename_drop(t: Tables):
    return reshape.rename_drop(t.table("events"), {"user_id": "node", "ts": "time", "value": "z", "event_type": "t"},
                               ["event_id", "props"])


@query("B2", "SELECT node, time, " + ", ".join(
    f"max(CASE WHEN var = '{e}' AND plev = {p}00 THEN value END) AS {e}{p}"
    for e in EVENT_TYPES for p in (500, 850, 1000)) + " FROM v_lev GROUP BY node, time")
def unstack_levels(t: Tables):
    return reshape.unstack_levels(t.lev, LEVEL_NAMES, agg=F.max)


@query("B3", """
SELECT node, time, 'qty' AS feature, qty AS value FROM v_clim
UNION ALL SELECT node, time, 'price', price FROM v_clim UNION ALL SELECT node, time, 'disc', disc FROM v_clim""")
def stack_features(t: Tables):
    return reshape.stack_features(t.clim, ["qty", "price", "disc"])


@query("B4", "SELECT node, time, " + ", ".join(
    f"max(CASE WHEN variable = '{e}' THEN z END) AS {e}" for e in EVENT_TYPES) + " FROM v_obsv GROUP BY 1, 2")
def unstack_features(t: Tables):
    return reshape.unstack_features(t.obsv, EVENT_TYPES, feature="variable", value="z")


@query("B5", """
SELECT a.node, a.time, a.click AS click_a, b.click AS click_b FROM
(SELECT node, time, max(CASE WHEN variable = 'click' THEN z END) AS click FROM v_obsv GROUP BY 1, 2) a
JOIN (SELECT node, time, max(CASE WHEN variable = 'click' THEN z * 2 END) AS click FROM v_obsv GROUP BY 1, 2) b
ON a.node = b.node AND a.time = b.time""")
def select_common_vars(t: Tables):
    wide = reshape.unstack_features(t.obsv, EVENT_TYPES, feature="variable", value="z")
    other = wide.select("node", "time", (F.col("click") * 2).alias("click"), F.col("view").alias("scroll"))
    a, b = reshape.select_common_vars(wide, other, wanted=["click", "error", "view"])
    return (a.withColumnRenamed("click", "click_a")
            .join(b.withColumnRenamed("click", "click_b"), ["node", "time"]))


@query("B6", "SELECT node, time, " + ", ".join(
    f"max(CASE WHEN variable = '{e}' THEN z END) AS {e}" for e in EVENT_TYPES) + " FROM v_obsv GROUP BY 1, 2")
def merge_vars(t: Tables):
    singles = [t.obsv.where(F.col("variable") == e).select("node", "time", F.col("z").alias(e)) for e in EVENT_TYPES]
    return reshape.merge_vars(singles)


@query("B7", "SELECT c_custkey AS node, " + ", ".join(
    f"CAST(r_name = '{r}' AS BIGINT) AS \"soil_{r}\"" for r in REGIONS) +
    " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def one_hot(t: Tables):
    soil = (t.table("customer").join(t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("node"), F.col("r_name").alias("soil")))
    return reshape.one_hot(soil, "soil", REGIONS).drop("soil")


@query("B8", "SELECT node, slt, CASE WHEN orog_raw < 0 THEN 0.0::DOUBLE ELSE orog_raw END AS orog_raw FROM v_static")
def clamp_lower(t: Tables):
    return reshape.clamp_lower(t.static, "orog_raw")


@query("B9", "SELECT node, orog_raw / (SELECT max(orog_raw) FROM v_static) AS orog FROM v_static")
def scale_by_max(t: Tables):
    return reshape.scale_by_max(t.static, "orog_raw", "orog").select("node", "orog")


@query("B10", "SELECT node, sin(radians(lat)) AS sin_latitude, sin(radians(lon)) AS sin_longitude, "
              "cos(radians(lon)) AS cos_longitude FROM v_nodes")
def coord_features(t: Tables):
    return reshape.coord_features(t.nodes).select("node", "sin_latitude", "sin_longitude", "cos_longitude")


@query("B11", "SELECT node, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, "
              "sin(radians(lat)) AS z FROM v_nodes")
def lonlat_xyz(t: Tables):
    return reshape.lonlat_xyz(t.nodes).select("node", "x", "y", "z")


@query("B11", "SELECT node, degrees(atan2(y, x)) AS lon, degrees(asin(z)) AS lat FROM v_points")
def xyz_lonlat(t: Tables):
    return reshape.xyz_lonlat(t.points).select("node", "lon", "lat")


@query("B12", """
WITH s AS (SELECT node, month(time) AS m, avg(price) AS mu, stddev_pop(price) AS sd FROM v_clim GROUP BY 1, 2)
SELECT c.node, c.time, greatest(least((price - mu) / sd, 1.5::DOUBLE), -1.5::DOUBLE) AS price
FROM v_clim c JOIN s ON c.node = s.node AND month(c.time) = s.m WHERE sd > 0
UNION ALL SELECT c.node, c.time, NULL FROM v_clim c JOIN s ON c.node = s.node AND month(c.time) = s.m WHERE sd = 0""")
def clip(t: Tables):
    from ..operators import scalers

    stats = scalers.anomaly_fit(t.clim, ["price"], "month")
    anom = scalers.anomaly_transform(t.clim, stats, ["price"], "month", standardized=True)
    return reshape.clip(anom, ["price"], -1.5, 1.5).select("node", "time", "price")


# --- row selection ---------------------------------------------------------------------------


@query("C1", "SELECT * FROM v_obs WHERE time >= TIMESTAMP '2024-01-10 06:00:00'")
def time_slice(t: Tables):
    return select.time_slice(t.obs, "2024-01-10T06:00:00")


@query("C2", """
SELECT node, time, qty, CASE WHEN year(time) <= 1998 THEN 'train' WHEN year(time) = 1999 THEN 'validation'
ELSE 'test' END AS split FROM v_clim WHERE year(time) <= 2000""")
def split_train_valid_test(t: Tables):
    periods = {"train": ("1990-01-01", "1998-12-31"), "validation": ("1999-01-01", "1999-12-31"),
               "test": ("2000-01-01", "2000-12-31")}
    return select.split_periods(t.clim, periods).select("node", "time", "qty", "split")


@query("C2", """
SELECT node, time, z, CASE WHEN time < TIMESTAMP '2024-01-11' THEN 'train' WHEN time < TIMESTAMP '2024-01-16' THEN 'validation' ELSE 'test' END AS split
FROM v_obs WHERE time >= TIMESTAMP '2024-01-01' AND time < TIMESTAMP '2024-02-01'""")
def split_train_valid_test_hourly(t: Tables):
    """Labels of days hold the whole day."""
    periods = {"train": ("2024-01-01", "2024-01-10"), "validation": ("2024-01-11", "2024-01-15"), "test": ("2024-01-16", "2024-01-31")}
    return select.split_periods(t.obs, periods).select("node", "time", "z", "split")


@query("C3", """
SELECT l_orderkey, l_linenumber, l_shipdate AS time FROM lineitem
WHERE month(l_shipdate) = month(l_shipdate + INTERVAL 2 DAY)""")
def fix_file_month(t: Tables):
    """Files hold two days of the month before, as if cut at the wrong hour."""
    moved = F.col("time") + F.expr("INTERVAL 2 DAYS")
    raw = t.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("time"))
    named = raw.withColumn("file_name", F.concat(F.lit("pl_"), F.date_format(moved, "yyyy_MM")))
    return select.fix_file_month(named, "file_name").drop("file_name")


@query("C4", """
SELECT l_orderkey, l_linenumber, l_shipdate AS time FROM lineitem
WHERE l_shipdate <= make_timestamp(year(l_shipdate), 3, 1, 6, 0, 0) AND l_shipdate >= TIMESTAMP '1995-02-01 07:00:00'""")
def fix_file_upper_bound(t: Tables):
    raw = t.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("time"))
    return select.fix_file_upper_bound(raw, F.year("time"), start="1995-02-01T07:00:00")


@query("C5", """
SELECT node, time, z FROM v_obs WHERE time IN
(SELECT date_trunc('day', o_orderdate) + (TIMESTAMP '2024-01-01' - TIMESTAMP '1998-01-01') FROM orders
 WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-01-31')""")
def select_times(t: Tables):
    """Observations at midnight of the days some order was placed on, 26 years later."""
    orders = t.table("orders").where(F.col("o_orderdate").between(
        F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-01-30").cast("timestamp_ntz")))
    days = F.datediff(F.lit("2024-01-01").cast("date"), F.lit("1998-01-01").cast("date"))
    times = orders.select(F.date_add(F.col("o_orderdate").cast("date"), days).cast("timestamp_ntz").alias("time"))
    return select.select_times(t.obs, times).select("node", "time", "z")


@query("C6", "SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY leadtime) AS r FROM v_fcst) WHERE r <= 4"
       .replace("SELECT * FROM (", "SELECT frt, leadtime, node, z FROM (", 1))
def first_n_leadtimes(t: Tables):
    return select.first_n_leadtimes(t.fcst, 4).select("frt", "leadtime", "node", "z")


@query("C7", "SELECT month(o_orderdate) AS month, min(o_orderdate) AS frt FROM orders "
             "WHERE month(o_orderdate) IN (1, 4, 7, 10) GROUP BY 1")
def first_per_month(t: Tables):
    return select.first_per_month(t.table("orders").select(F.col("o_orderdate").alias("frt")), [1, 4, 7, 10], "frt")


@query("C8", "SELECT node, time, z FROM (SELECT *, dense_rank() OVER (ORDER BY time) AS r FROM v_obs) WHERE r <= 10")
def head_timesteps(t: Tables):
    return select.head_timesteps(t.obs, 10).select("node", "time", "z")


@query("C9", "SELECT node, quantile_cont(price, 0.5) AS median FROM v_clim GROUP BY node ORDER BY median, node LIMIT 15")
def topk_by_median(t: Tables):
    return select.topk_by_median(t.clim, ["node"], "price", 15)
