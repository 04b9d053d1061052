import datetime as dt
import os

from pyspark.sql import functions as F

from sphereframe import streaming
from sphereframe.operators import align, quality, scalers
from sphereframe.session import scratch_path


def arrive(df, path, cutoffs):
    """Write a table as several files in time order."""
    bounds = [None, *cutoffs, None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        part = part.where(F.col("time") > F.lit(lo)) if lo else part
        part = part.where(F.col("time") <= F.lit(hi)) if hi else part
        part.coalesce(1).write.mode("append").parquet(path)


CUTS = [dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 20)]


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_gaps_across_batches_equal_the_batch_twin(spark, tables):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    steps = tables.obs.select("node", "time")
    late = (F.col("node") % 5 == 1) & (F.dayofmonth("time") % 3 == 0)
    arrive(steps.where(~late), path, CUTS)
    steps.where(late).coalesce(1).write.mode("append").parquet(path)
    stream = streaming.read_files(spark, path, steps.schema, files_per_batch=1)
    streaming.stream_gaps(stream, 6, out, out + "-cp").awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 4
    assert rows(streaming.current_gaps(got)) == rows(quality.missing_timesteps(steps, 6))


def test_moments_across_batches(spark, tables):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    ev = tables.table("events").select(F.col("user_id").alias("node"), F.col("ts").alias("time"), F.col("value").alias("z"))
    # cut inside a window, so one window is updated by two batches
    arrive(ev, path, [dt.datetime(2024, 1, 8, 3), dt.datetime(2024, 1, 20, 15)])
    stream = streaming.read_files(spark, path, ev.schema, files_per_batch=1)
    streaming.stream_moments(stream, ["z"], out, out + "-cp", delay="3 days").awaitTermination()
    got = streaming.latest(spark.read.parquet(out), ["node", "time"])
    from sphereframe.functions.columns import truncate_hours
    want = scalers.partial_moments(ev.withColumn("time", truncate_hours("time", 6)), ["node", "time"], ["z"])
    a, b = (rows(d.withColumns({c: F.round(c, 6) for c in ("mean_z", "m2_z")})) for d in (got, want))
    assert a == b


def test_restart_adds_only_new_files(spark, tables):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    raw = tables.table("events").select(F.col("user_id").alias("n"), F.col("ts").alias("time"), "value")
    early = F.col("time") <= F.lit(CUTS[0])
    for part in (raw.where(early), raw.where(~early)):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = streaming.read_files(spark, path, raw.schema)
        streaming.stream_append(stream, {"n": "node", "value": "z"}, [], out, out + "-cp").awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == raw.count()
    assert got.select("batch").distinct().count() == 2


def test_verify_across_batches(spark, tables):
    f_path, o_path, out = (scratch_path(spark, n) for n in ("f", "o", "out"))
    forecasts = align.to_valid_time(tables.fcst)
    arrive(forecasts, f_path, CUTS)
    arrive(tables.obs, o_path, CUTS)
    f = streaming.read_files(spark, f_path, forecasts.schema, files_per_batch=1)
    o = streaming.read_files(spark, o_path, tables.obs.schema, files_per_batch=1)
    streaming.stream_verify(f, o, "z", out, out + "-cp", delay="40 days").awaitTermination()
    want = align.forecast_error(tables.fcst, tables.obs, ["z"])
    assert rows(spark.read.parquet(out)) == rows(want)


def test_silent_nodes_leave_the_state(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    parts = [[(1, 0), (1, 6), (2, 0), (3, 0)], [(2, 48), (2, 54)], [(1, 96), (2, 96)], [(1, 90), (1, 102), (2, 150)]]
    states = []
    for part in parts:
        spark.createDataFrame([(n, at(h)) for n, h in part], "node long, time timestamp_ntz").write.mode("append").parquet(path)
        stream = streaming.read_files(spark, path, spark.read.parquet(path).schema)
        query = streaming.stream_gaps(stream, 6, out, out + "-cp", delay="1 day")
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = spark.read.parquet(out)
    left = {(r.node, r.gap_start) for r in got.where("gap_end IS NULL").collect()}
    assert {(1, at(6)), (3, at(0))} <= left  # node 3 never comes back
    want = quality.missing_timesteps(spark.createDataFrame([(n, at(h)) for p in parts for n, h in p], "node long, time timestamp_ntz"), 6)
    assert rows(streaming.current_gaps(got)) == rows(want)
    assert states[-1] <= 4  # at most the last step and the timer of two nodes


def test_unmatched_forecasts(spark):
    f_path, o_path, out = (scratch_path(spark, n) for n in ("f", "o", "out"))
    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    fc = spark.createDataFrame([(n, at(h), float(h)) for n in (1, 2) for h in range(0, 120, 6)], "node long, time timestamp_ntz, z double")
    ob = spark.createDataFrame([(n, at(h), 1.0) for n in (1, 2) for h in range(0, 96, 6) if (h + n) % 4], "node long, time timestamp_ntz, z double")
    for df, path in ((fc, f_path), (ob, o_path)):
        df.write.parquet(path)
    streaming.stream_verify(streaming.read_files(spark, f_path, fc.schema), streaming.read_files(spark, o_path, ob.schema), "z", out, out + "-cp", "1 day", unmatched=True).awaitTermination()
    got = {(r.node, r.time): (r.z_pred, r.z_obs) for r in spark.read.parquet(out).collect()}
    seen = {(r.node, r.time) for r in ob.collect()}
    behind = max(t for _, t in seen) - dt.timedelta(days=1)
    assert got == {(r.node, r.time): (r.z, 1.0 if (r.node, r.time) in seen else None) for r in fc.collect() if (r.node, r.time) in seen or r.time <= behind}


def verified_in_runs(spark, runs, unmatched):
    """Forecasts and observations (node, hour, z) of each run, one after the other; the rows shown and the checkpoint."""
    f_path, o_path, out = (scratch_path(spark, n) for n in ("f", "o", "out"))
    schema = "node long, time timestamp_ntz, z double"
    for fc, ob in runs:
        for found, path in ((fc, f_path), (ob, o_path)):
            spark.createDataFrame([(n, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), z) for n, h, z in found], schema).coalesce(1).write.mode("append").parquet(path)
        f, o = (streaming.read_files(spark, p, spark.read.parquet(f_path).schema) for p in (f_path, o_path))
        streaming.stream_verify(f, o, "z", out, out + "-cp", "1 day", unmatched=unmatched).awaitTermination()
    return sorted((r.node, (r.time - dt.datetime(2024, 1, 1)) // dt.timedelta(hours=1), r.z_pred, r.z_obs) for r in spark.read.parquet(out).collect()), out + "-cp"


RUNS = [([(1, 0, 1.0), (1, 6, 2.0), (2, 6, 3.0), (1, 48, 4.0)], [(1, 6, 0.5)]),
        ([(1, 6, 2.5), (2, 48, 5.0)], [(1, 0, 0.25), (1, 48, 1.5), (1, 48, 1.75), (2, 48, None)]),
        ([(1, 12, 9.0), (1, 60, 6.0), (None, 54, 7.0)], [(2, 6, 0.75), (1, 54, 8.0), (1, 60, 8.5)])]  # 12 and the observation of 6 come too late


def test_verify_keeps_no_rows_in_the_engines_state(spark):
    got, checkpoint = verified_in_runs(spark, RUNS, False)
    assert [r for r in got if r[3] is not None] == [(1, 0, 1.0, 0.25), (1, 6, 2.0, 0.5), (1, 6, 2.5, 0.5), (1, 48, 4.0, 1.5), (1, 48, 4.0, 1.75), (1, 60, 6.0, 8.5)]
    assert [r for r in got if r[3] is None] == [(2, 48, 5.0, None)]  # observed, without a value
    assert not os.path.exists(f"{checkpoint}/state")


def test_unmatched_forecasts_come_out_once_over_several_runs(spark):
    got, checkpoint = verified_in_runs(spark, RUNS, True)
    assert got.count((2, 6, 3.0, None)) == 1 and got.count((2, 48, 5.0, None)) == 1
    assert len(got) == 8 and not os.path.exists(f"{checkpoint}/state")


def test_few_observations_are_hashed_instead_of_sorting_the_forecasts(spark, monkeypatch):
    from sphereframe.streaming import streams

    plans, verify = [], streams.verify

    def noted(*args):
        out = verify(*args)
        plans.append("ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(streams, "verify", noted)
    got = verified_in_runs(spark, RUNS, True)[0]
    assert plans == [True] * 3
    monkeypatch.setattr(streams, "OBSERVATIONS_A_TASK", 0)
    assert str(verified_in_runs(spark, RUNS, True)[0]) == str(got) and plans[3:] == [False] * 3


def test_nodes_share_the_state_of_their_group(spark):
    """A call of Python handles many nodes: in state and timers there are no more entries than groups."""
    from sphereframe.streaming import streams

    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    steps = (spark.range(3001).select(F.when(F.col("id") < 3000, F.col("id")).alias("node"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
             .where(F.pmod(F.xxhash64("node", "k"), F.lit(3)) == 0)
             .select("node", "k", F.timestamp_add("HOUR", F.when(F.pmod(F.coalesce("node", F.lit(1)), F.lit(50)) != F.col("k"), F.col("k") * 6), F.lit("2024-01-01").cast("timestamp_ntz")).alias("time")))
    for lo, hi in ((0, 6), (7, 13), (14, 20)):
        part = steps.where(F.col("k").between(lo, hi)).select("node", "time")
        part.coalesce(1).write.mode("append").parquet(path)
        query = streaming.stream_gaps(streaming.read_files(spark, path, part.schema), 6, out, out + "-cp", delay="1 day")
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * (streams.NODE_GROUPS + 1)
    got = spark.read.parquet(out)
    assert not got.where("gap_end IS NULL AND gap_start IS NOT NULL").isEmpty()
    assert rows(streaming.current_gaps(got)) == rows(quality.missing_timesteps(steps.where("time IS NOT NULL"), 6))
