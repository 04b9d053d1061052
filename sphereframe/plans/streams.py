"""Streaming queries, run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..operators.align import to_valid_time
from ..session import cut_lineage, scratch_path
from .registry import query
from .views import Tables


def _events(t: Tables):
    schema = t.table("events").schema
    return streaming.read_files(t.spark, t.sf_dir, schema, "events.parquet")


def _staged(t: Tables, df, name: str):
    """A view written out as arriving files and read back as a stream."""
    path = scratch_path(t.spark, name)
    df.write.parquet(path)
    return streaming.read_files(t.spark, path, df.schema)


@query("N1", "SELECT user_id AS node, ts AS time, event_type AS var, value AS z FROM events")
def stream_append(t: Tables):
    out = scratch_path(t.spark, "append")
    streaming.stream_append(_events(t), {"user_id": "node", "ts": "time", "event_type": "var", "value": "z"},
                            ["event_id", "props"], out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.parquet(out).select("node", "time", "var", "z")


_GAPS_SQL = """
SELECT node, prev AS gap_start, time AS gap_end, CAST(epoch(time - prev) / 21600 - 1 AS BIGINT) AS missing FROM
(SELECT node, time, lag(time) OVER (PARTITION BY node ORDER BY time) AS prev FROM v_obs)
WHERE time - prev > INTERVAL 6 HOUR"""


def _gaps_of_parts(t: Tables, steps, parts, delay: str):
    """Each part arrives with all its files, and a run over what is there follows."""
    out, source = scratch_path(t.spark, "gaps"), scratch_path(t.spark, "steps")
    for part in parts:
        steps.where(part).select("node", "time").write.mode("append").parquet(source)
        arriving = streaming.read_files(t.spark, source, steps.select("node", "time").schema)
        streaming.stream_gaps(arriving, 6, out, f"{out}-checkpoint", delay).awaitTermination()
    return streaming.current_gaps(t.spark.read.parquet(out))


def _steps(t: Tables):
    """The steps of all nodes, written once for all parts, and the first and last of them."""
    steps = cut_lineage(t.obs.select("node", "time"))
    return steps, steps.agg(F.min("time").alias("first"), F.max("time").alias("last")).first()


@query("N2", _GAPS_SQL)
def stream_gaps(t: Tables):
    """Both halves of the table's time range in order, then late steps of all of it; the delay covers that range."""
    steps, ends = _steps(t)
    middle = F.lit(ends["first"] + (ends["last"] - ends["first"]) / 2)
    steps = steps.withColumn("_late", (F.col("node") % 7 == 3) & (F.dayofmonth("time") % 5 == 0))
    parts = (~F.col("_late") & (F.col("time") < middle), ~F.col("_late") & (F.col("time") >= middle), F.col("_late"))
    return _gaps_of_parts(t, steps, parts, f"{(ends['last'] - ends['first']).days + 1} days")


@query("N2", _GAPS_SQL)
def stream_gaps_expiring(t: Tables):
    """Five stretches of time in order with a delay of half a day: nodes silent for longer leave the state, and their gaps are found all the same."""
    steps, ends = _steps(t)
    cuts = [ends["first"] + k * (ends["last"] - ends["first"]) / 5 for k in range(1, 5)]
    stretch = sum((F.col("time") >= F.lit(c)).cast("int") for c in cuts)
    return _gaps_of_parts(t, steps, [stretch == k for k in range(5)], "12 hours")


@query("N3", """
SELECT user_id AS node, date_trunc('day', ts) + to_hours(CAST(6 * (hour(ts) // 6) AS BIGINT)) AS time, count(*) AS n,
       count(value) AS n_z, round(avg(value), 6) AS mean_z, round(var_pop(value) * count(value), 6) AS m2_z FROM events GROUP BY 1, 2""")
def stream_moments(t: Tables):
    out = scratch_path(t.spark, "moments")
    rows = _events(t).select(F.col("user_id").alias("node"), F.col("ts").alias("time"), F.col("value").alias("z"))
    streaming.stream_moments(rows, ["z"], out, f"{out}-checkpoint").awaitTermination()
    return streaming.latest(t.spark.read.parquet(out), ["node", "time"]).withColumns({c: F.round(c, 6) for c in ("mean_z", "m2_z")})


@query("N4", "SELECT frt, leadtime, node, time, z_pred, z_obs, z_pred - z_obs AS z_err FROM v_pairs")
def stream_verify(t: Tables):
    out = scratch_path(t.spark, "verify")
    forecasts = to_valid_time(_staged(t, t.fcst, "forecasts"))
    streaming.stream_verify(forecasts, _staged(t, t.obs, "observations"), "z", out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.parquet(out)


@query("N4", """
WITH w AS (SELECT max(time) - INTERVAL 1 DAY AS behind FROM v_obs),
f AS (SELECT frt, leadtime, node, frt + to_hours(CAST(leadtime AS BIGINT)) AS time, z AS z_pred FROM v_fcst)
SELECT f.frt, f.leadtime, f.node, f.time, z_pred, o.z AS z_obs, z_pred - o.z AS z_err FROM f LEFT JOIN v_obs o ON o.node = f.node AND o.time = f.time, w
WHERE o.z IS NOT NULL OR f.time <= behind""")
def stream_verify_unmatched(t: Tables):
    """Forecasts nobody observed come out with NULL once the watermark, one day behind the observations, has passed them."""
    out = scratch_path(t.spark, "verify")
    forecasts = to_valid_time(_staged(t, t.fcst, "forecasts"))
    streaming.stream_verify(forecasts, _staged(t, t.obs, "observations"), "z", out, f"{out}-checkpoint", "1 day", unmatched=True).awaitTermination()
    return t.spark.read.parquet(out)
