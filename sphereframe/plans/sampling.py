"""Queries over autoregressive sample tables and the user-function surface."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import skill as sk
from ..functions.columns import shift_hours, truncate_hours
from ..operators import samples
from .registry import query
from .verification import wide_sql
from .views import Tables

STEP = 6
INPUT_K = [-3, -2, -1]
LAGS = [samples.lag_name("z", k * STEP) for k in INPUT_K]

_LAGS_SQL = """SELECT a.node, a.time + INTERVAL 18 HOUR AS time, a.z AS z_m18, b.z AS z_m12, c.z AS z_m6 FROM v_obs a
JOIN v_obs b ON b.node = a.node AND b.time = a.time + INTERVAL 6 HOUR
JOIN v_obs c ON c.node = a.node AND c.time = a.time + INTERVAL 12 HOUR"""


@query("H1", _LAGS_SQL)
def lag_features(t: Tables):
    return samples.lag_features(t.obs, ["z"], INPUT_K, STEP)


@query("H1", f"SELECT l.node, l.time, z_m18, z_m12, z_m6, o.z AS z_p0 FROM ({_LAGS_SQL}) l "
             "JOIN v_obs o ON o.node = l.node AND o.time = l.time")
def lag_features_current(t: Tables):
    return samples.lag_features(t.obs, ["z"], INPUT_K, STEP, with_current=True)


@query("H2", f"""
SELECT l.node, l.time, CAST(i AS INTEGER) AS iteration, CAST(0 AS INTEGER) AS k, o.z FROM ({_LAGS_SQL}) l,
(SELECT unnest(range(0, 7)) AS i), v_obs o WHERE o.node = l.node AND o.time = l.time + to_hours(CAST(6 * i AS BIGINT))""")
def targets(t: Tables):
    """Targets of seven iterations for every reference time with complete inputs."""
    inputs = samples.lag_features(t.obs, ["z"], INPUT_K, STEP).select("node", "time")
    return samples.targets(t.obs, ["z"], [0], 1, 6, STEP).join(inputs, ["node", "time"], "left_semi")


_AR_SQL = """
WITH i AS (SELECT unnest(range(0, 4)) AS iteration), k AS (SELECT unnest([-3, -2, -1]) AS k),
x AS (SELECT iteration, k, iteration + k AS off FROM i, k)
SELECT o.node, o.time, CAST(iteration AS INTEGER) AS iteration, CAST(k AS INTEGER) AS k,
       CASE WHEN off < 0 THEN 'observation' ELSE 'prediction' END AS source,
       CASE WHEN off < 0 THEN v.z ELSE v.z + {made} * 0.25::DOUBLE END AS z
FROM v_obs o, x, v_obs v WHERE v.node = o.node AND v.time = o.time + to_hours(CAST(6 * off AS BIGINT))"""


def _ar(t: Tables, most_recent: bool):
    plan = samples.ar_plan(INPUT_K, [0, 1], 1, 3, most_recent)
    made = samples.targets(t.obs, ["z"], [0, 1], 1, 3, STEP)
    made = made.withColumn("z", F.col("z") + F.col("iteration") * F.lit(0.25))
    return samples.assemble_inputs(t.obs, t.obs, made, plan, "z", STEP)


@query("H3", _AR_SQL.format(made="least(off, iteration - 1)"))
def ar_inputs(t: Tables):
    """Two outputs per iteration, so most steps are predicted twice; the newest counts."""
    return _ar(t, True)


@query("H3", _AR_SQL.format(made="greatest(off - 1, 0)"))
def ar_inputs_oldest(t: Tables):
    return _ar(t, False)


@query("H4", """
WITH s AS (SELECT DISTINCT date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6) AS BIGINT)) AS time FROM events),
b AS (SELECT min(time) AS first, max(time) AS last FROM s),
r AS (SELECT time, count(*) AS requests FROM (SELECT o_orderdate + (TIMESTAMP '2024-01-02' - TIMESTAMP '1998-01-01') AS time
      FROM orders WHERE o_orderdate >= TIMESTAMP '1997-12-15' AND o_orderdate < TIMESTAMP '1998-02-15'
      UNION ALL SELECT time + INTERVAL 6 HOUR FROM s) GROUP BY 1),
c AS (SELECT time FROM (SELECT time - to_hours(CAST(h AS BIGINT)) AS time FROM s, (SELECT unnest(range(-18, 37, 6)) AS h))
      GROUP BY 1 HAVING count(*) = 10)
SELECT r.time, requests, CASE WHEN r.time - INTERVAL 18 HOUR < first THEN 'past' WHEN r.time + INTERVAL 36 HOUR > last
THEN 'future' WHEN requests > 1 THEN 'duplicate' WHEN c.time IS NULL THEN 'gap' ELSE 'ok' END AS status
FROM r CROSS JOIN b LEFT JOIN c ON c.time = r.time""")
def valid_reference_times(t: Tables):
    """Requests around, inside and twice inside the stored period."""
    days = F.datediff(F.lit("2024-01-02").cast("date"), F.lit("1998-01-01").cast("date"))
    orders = t.table("orders").where(
        (F.col("o_orderdate") >= F.lit("1997-12-15").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1998-02-15").cast("timestamp_ntz")))
    moved = orders.select(F.date_add(F.col("o_orderdate").cast("date"), days).cast("timestamp_ntz").alias("time"))
    stored = t.obs.select("time").distinct()
    requested = moved.unionByName(stored.select(shift_hours("time", 6).alias("time")))
    return samples.valid_reference_times(t.obs, requested, range(-18, 37, 6))


@query("H5", f"""
SELECT l.node, l.time, unnest([0, 1, 2, 3, 4, 5]) AS position, unnest([CAST(slt AS DOUBLE), orog_raw, tisr, z_m18, z_m12, z_m6]) AS value
FROM ({_LAGS_SQL}) l LEFT JOIN v_bc b ON b.node = l.node AND b.time = l.time LEFT JOIN v_static s ON s.node = l.node""")
def sample_vectors(t: Tables):
    """Feature order: static, boundary, dynamic lags (oldest first)."""
    lags = samples.lag_features(t.obs, ["z"], INPUT_K, STEP)
    rows = lags.join(t.bc, ["node", "time"], "left").join(t.static, "node", "left")
    vectors = samples.sample_vectors(rows, ["slt", "orog_raw", "tisr", *LAGS])
    return vectors.select("node", "time", F.posexplode("x").alias("position", "value"))


_SHUFFLED = """
WITH r AS (SELECT node, time, row_number() OVER (ORDER BY md5(node || ':' || strftime(time, '%Y-%m-%d %H:%M:%S') || ':17'), node, time) - 1
           AS position FROM v_obs)
SELECT node, time, position, position // 64 AS batch FROM r"""


@query("H6", _SHUFFLED + " WHERE position // 64 < (SELECT count(*) // 64 FROM v_obs)")
def batches(t: Tables):
    return samples.batches(t.obs.select("node", "time"), ["node", "time"], 64, 17)


@query("H6", _SHUFFLED)
def batches_keep_last(t: Tables):
    return samples.batches(t.obs.select("node", "time"), ["node", "time"], 64, 17, drop_last=False)


_INC = ("SELECT a.node, a.time, b.z AS z_last, a.z - b.z AS z FROM v_obs a JOIN v_obs b "
        "ON b.node = a.node AND b.time = a.time - INTERVAL 6 HOUR")


@query("H7", _INC)
def increment(t: Tables):
    return samples.increment(t.obs, ["z"], STEP)


@query("H7", f"SELECT node, time, z_last + z AS z FROM ({_INC})")
def integrate(t: Tables):
    return samples.integrate(samples.increment(t.obs, ["z"], STEP), ["z"])


def damped(state, iteration):
    """Weighted mean of the last three states."""
    return 0.5 * state[:, 2] + 0.25 * state[:, 1] + 0.25 * state[:, 0]


_ROLL_SQL = f"""
WITH s0 AS ({_LAGS_SQL}),
r1 AS (SELECT *, 0.5::DOUBLE * z_m6 + 0.25::DOUBLE * z_m12 + 0.25::DOUBLE * z_m18 AS p0 FROM s0),
r2 AS (SELECT *, 0.5::DOUBLE * p0 + 0.25::DOUBLE * z_m6 + 0.25::DOUBLE * z_m12 AS p1 FROM r1),
r3 AS (SELECT *, 0.5::DOUBLE * p1 + 0.25::DOUBLE * p0 + 0.25::DOUBLE * z_m6 AS p2 FROM r2),
r4 AS (SELECT *, 0.5::DOUBLE * p2 + 0.25::DOUBLE * p1 + 0.25::DOUBLE * p0 AS p3 FROM r3)
SELECT node, time, CAST(unnest(range(0, 4)) AS INTEGER) AS iteration, unnest([p0, p1, p2, p3]) AS z,
       CAST(unnest(range(6, 25, 6)) AS INTEGER) AS leadtime FROM r4"""


@query("H8", _ROLL_SQL)
def rollout(t: Tables):
    return samples.rollout(samples.lag_features(t.obs, ["z"], INPUT_K, STEP), damped, LAGS, 4, STEP)


@query("H8", _ROLL_SQL)
def rollout_blocks(t: Tables):
    """The same run in two blocks with a checkpoint between."""
    return samples.rollout(samples.lag_features(t.obs, ["z"], INPUT_K, STEP), damped, LAGS, 4, STEP, block=2)


@query("H8", """
WITH m AS (SELECT time, max(z) AS m FROM v_obs GROUP BY 1)
SELECT o.node, o.time, m + (z - m) * pow(0.5::DOUBLE, i) AS z, CAST(6 * i AS INTEGER) AS leadtime
FROM v_obs o JOIN m ON m.time = o.time, (SELECT unnest(range(1, 5)) AS i)""")
def rollout_fields(t: Tables):
    """A scorer that mixes nodes: every step moves half way to the maximum of the field."""
    def step(state):
        top = state.groupBy("time").agg(F.max("z").alias("_m"))
        return state.join(top, "time").select("node", "time", ((F.col("z") + F.col("_m")) / 2.0).alias("z"))

    return samples.rollout_fields(t.obs, step, 4, STEP, block=2)


def coupled(state, bc, static, iteration):
    """Mean and peak relax towards their past and towards each other, driven by radiation and the height of the ground."""
    z, peak = state[:, :, 0], state[:, :, 1]
    sun, ground = np.nan_to_num(bc[:, 0]), np.nan_to_num(static[:, 0]) / 1024.0
    return np.column_stack([0.5 * z[:, 2] + 0.25 * z[:, 1] + 0.125 * peak[:, 0] + sun + ground, 0.5 * peak[:, 2] + 0.25 * z[:, 2] + 0.25 * iteration * sun])


def _both(t: Tables):
    """(node, time, z, peak): average and greatest value of each step."""
    e = t.table("events").select(F.col("user_id").alias("node"), truncate_hours("ts", 6).alias("time"), "value")
    return t.obs.join(e.groupBy("node", "time").agg(F.max("value").alias("peak")), ["node", "time"])


def _coupled_sql(iterations: int = 4) -> str:
    """The closed form of the iterations, radiation looked up at the time each of them predicts."""
    slot = "date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6) AS BIGINT))"
    join = " ".join(f"JOIN o l{i} ON l{i}.node = t.node AND l{i}.time = t.time - INTERVAL {h} HOUR" for i, h in enumerate((18, 12, 6)))
    ctes = [f"p AS (SELECT user_id AS node, {slot} AS time, max(value) AS peak FROM events GROUP BY 1, 2)", "o AS (SELECT node, time, z, peak FROM v_obs JOIN p USING (node, time))",
            "times AS (SELECT DISTINCT node, time + INTERVAL 6 HOUR AS time FROM o)",
            f"r0 AS (SELECT t.node, t.time, l0.z AS za, l1.z AS zb, l2.z AS zc, l0.peak AS pa, l1.peak AS pb, l2.peak AS pc, coalesce(s.orog_raw, 0) / 1024.0::DOUBLE AS g FROM times t {join} LEFT JOIN v_static s ON s.node = t.node)"]
    for i in range(iterations):
        sun = "coalesce(b.tisr, 0)"
        ctes.append(f"r{i + 1} AS (SELECT r.node, r.time, g, zb AS za, zc AS zb, 0.5::DOUBLE * zc + 0.25::DOUBLE * zb + 0.125::DOUBLE * pa + {sun} + g AS zc, pb AS pa, pc AS pb, "
                    f"0.5::DOUBLE * pc + 0.25::DOUBLE * zc + 0.25::DOUBLE * {i} * {sun} AS pc FROM r{i} r LEFT JOIN v_bc b ON b.node = r.node AND b.time = r.time + INTERVAL {6 * i} HOUR)")
    out = " UNION ALL ".join(f"SELECT node, time, CAST({i} AS INTEGER) AS iteration, zc AS z, pc AS peak, CAST({6 * (i + 1)} AS INTEGER) AS leadtime FROM r{i + 1}" for i in range(iterations))
    return "WITH " + ", ".join(ctes) + " " + out


def _coupled(t: Tables, block: int | None = None):
    lags = samples.lag_features(_both(t), ["z", "peak"], INPUT_K, STEP)
    dynamic = {v: [samples.lag_name(v, k * STEP) for k in INPUT_K] for v in ("z", "peak")}
    return samples.rollout_state(lags, coupled, dynamic, 4, STEP, boundary=t.bc, boundary_vars=["tisr"], static=t.static, static_vars=["orog_raw"], block=block)


@query("H8", _coupled_sql())
def rollout_state(t: Tables):
    """Two variables predicted together, with radiation at the predicted times and the height of the ground."""
    return _coupled(t)


@query("O2", _coupled_sql())
def rollout_state_blocks(t: Tables):
    """The same run in blocks of three iterations, future radiation looked up anew for each block."""
    return _coupled(t, 3)


@query("O1", f"SELECT node, time, 0.5::DOUBLE * z_m6 + 0.5::DOUBLE * z_m18 AS z FROM ({_LAGS_SQL})")
def scorer_hook(t: Tables):
    def model(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": batch["node"], "time": batch["time"], "z": 0.5 * batch["z_m6"] + 0.5 * batch["z_m18"]})

    return samples.score(samples.lag_features(t.obs, ["z"], INPUT_K, STEP), model,
                         "node long, time timestamp_ntz, z double")


@query("O2", "SELECT node, time, z, sin(radians(15.0::DOUBLE * hour(time) + (node * 53) % 360)) AS tisr FROM v_obs")
def boundary_hook(t: Tables):
    """Boundary conditions made on the fly: a daily cycle by local hour angle."""
    def sun(keys):
        angle = F.lit(15.0) * F.hour("time") + F.pmod(F.col("node") * 53, F.lit(360))
        return keys.withColumn("tisr", F.sin(F.radians(angle)))

    return samples.with_boundary(t.obs, sun)


@query("O3", wide_sql("v_clim", "qty", "disc", "node", ["MAE", "rSD", "pearson_R", "NSE"]))
def custom_aggregate(t: Tables):
    """The score aggregate over columns that have nothing to do with forecasts."""
    return sk.skill_columns(t.clim, "qty", "disc", ["node"], ["MAE", "rSD", "pearson_R", "NSE"])
