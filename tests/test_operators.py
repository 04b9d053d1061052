import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphereframe import sources
from sphereframe.operators import align, quality, reshape, samples, scalers, verify
from sphereframe.session import cut_lineage, scratch_path, shared_dir


def test_scratch_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = spark.range(10).withColumn("t", F.lit("2020-01-01").cast("timestamp_ntz"))
    assert cut_lineage(df).dtypes == df.dtypes and cut_lineage(df).count() == 10


def test_write_modes(spark, tables):
    path = scratch_path(spark, "modes")
    sources.write_grid(tables.clim, path)
    n = tables.clim.count()
    with pytest.raises(Exception, match="already exists"):
        sources.write_grid(tables.clim, path)
    sources.write_grid(tables.clim, path, "append")
    assert spark.read.parquet(path).count() == 2 * n
    sources.write_grid(tables.clim, path, "force")
    assert spark.read.parquet(path).count() == n
    with pytest.raises(ValueError):
        sources.write_grid(tables.clim, path, "replace")


def test_time_range_prunes_partitions(spark, tables):
    path = scratch_path(spark, "prune")
    sources.write_grid(tables.clim, path)
    cut = sources.read_grid(path, ["qty"], "1997-03-05", "1997-04-10", spark=spark)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "price" not in plan.split("ReadSchema")[1]
    same = tables.clim.where((F.col("time") >= F.lit("1997-03-05").cast("timestamp_ntz"))
                             & (F.col("time") <= F.lit("1997-04-10").cast("timestamp_ntz")))
    assert cut.count() == same.count()


def test_read_grid_names_missing_columns(tables):
    with pytest.raises(ValueError, match="absent"):
        sources.read_grid(tables.clim, ["absent"])


def test_bucketed_table_aggregates_without_exchange(spark, tables):
    sources.write_bucketed(tables.clim, "clim_by_node", scratch_path(spark, "bucketed"), 4)
    agg = spark.table("clim_by_node").groupBy("node").agg(F.avg("qty"))
    assert "Exchange" not in agg._jdf.queryExecution().sparkPlan().toString()
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_rename_needs_a_mapping(tables):
    with pytest.raises(TypeError):
        reshape.rename_drop(tables.clim, ["qty"])
    with pytest.raises(ValueError):
        reshape.select_common_vars(tables.clim, tables.obs)


def test_scaler_round_trip_and_constant_column(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0)], "node long, a double, b double")
    stats = scalers.standard_fit(df, ["a", "b"])
    out = scalers.standard_transform(df, stats, ["a", "b"]).orderBy("node").collect()
    assert [r["a"] for r in out] == [-1.0, 1.0, None] and [r["b"] for r in out] == [None] * 3
    mm = scalers.minmax_fit(df, ["a"])
    assert [r["a"] for r in scalers.minmax_transform(df, mm, ["a"]).orderBy("node").collect()] == [0.0, 1.0, None]


def test_scores_of_a_perfect_and_an_unpaired_forecast(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 4.0, 4.0), ("a", None, 9.0), ("b", 1.0, None)],
                               "g string, z_pred double, z_obs double")
    rows = {(r["g"], r["skill"]): r["value"] for r in verify.deterministic(df, ["z"], ["g"]).collect()}
    assert rows["a", "RMSE"] == 0 and rows["a", "NSE"] == 1 and rows["a", "KGE"] == pytest.approx(1)
    assert rows["a", "pearson_R"] == pytest.approx(1) and rows["b", "RMSE"] is None
    with pytest.raises(ValueError):
        verify.deterministic(df, ["z"], ["g"], ["ACC"])


def test_spearman_against_numpy_ranks(spark):
    rng = np.random.default_rng(1)
    p, o = rng.integers(0, 12, 300).astype(float), rng.integers(0, 9, 300).astype(float)

    def avg_rank(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(p, o)], "g string, p double, o double")
    got = verify.spearman(df, "p", "o", ["g"]).first()
    assert got["spearman_R"] == pytest.approx(np.corrcoef(avg_rank(p), avg_rank(o))[0, 1])


def test_weighted_mse_by_hand(spark):
    pairs = spark.createDataFrame([(0, 1, 3.0, 1.0), (1, 1, 1.0, 1.0), (0, 2, 0.0, 1.0), (1, 2, 5.0, 2.0)],
                                  "node long, s long, z_pred double, z_obs double")
    nodes = spark.createDataFrame([(0, 1.0), (1, 3.0)], "node long, area double")
    mean = verify.weighted_mse(pairs, nodes, ["z"], ["s"], "mean").first()[0]
    assert mean == pytest.approx((4 + 0 + 1 + 27) / 4 / 2 / 1)
    assert verify.weighted_mse(pairs, nodes, ["z"], ["s"], "sum").first()[0] == pytest.approx(32 * 2)
    with pytest.raises(ValueError):
        verify.weighted_mse(pairs, nodes, ["z"], ["s"], "median")


def test_ar_plan_newest_and_oldest():
    newest = {(i, k): (o, j) for i, k, o, j, _ in samples.ar_plan([-2, -1], [0, 1], 1, 2)}
    oldest = {(i, k): (o, j) for i, k, o, j, _ in samples.ar_plan([-2, -1], [0, 1], 1, 2, False)}
    assert newest[0, -1] == (-1, None) and newest[1, -1] == (0, 0) and newest[2, -1] == (1, 1)
    assert oldest[2, -1] == (1, 0)


def test_batches_drop_or_keep_the_rest(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    full = samples.batches(df, ["k"], 10, 5).groupBy("batch").count().collect()
    assert len(full) == 10 and all(r["count"] == 10 for r in full)
    kept = samples.batches(df, ["k"], 10, 5, drop_last=False).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in kept) == [3] + [10] * 10


def test_lags_respect_gaps(spark):
    t0 = dt.datetime(2020, 1, 1)
    hours = [0, 6, 12, 24, 30, 36]
    df = spark.createDataFrame([(1, t0 + dt.timedelta(hours=h), float(h)) for h in hours], "node long, time timestamp_ntz, z double")
    got = {r["time"]: (r["z_m12"], r["z_m6"]) for r in samples.lag_features(df, ["z"], [-2, -1], 6).collect()}
    assert got == {t0 + dt.timedelta(hours=h): (h - 12.0, h - 6.0) for h in (12, 18, 36, 42)}


def test_missing_steps(spark):
    t0 = dt.datetime(2020, 1, 30)
    df = spark.createDataFrame([(1, t0 + dt.timedelta(hours=h)) for h in (0, 6, 24, 72)], "node long, time timestamp_ntz")
    got = sorted((r["gap_start"], r["missing"]) for r in quality.missing_timesteps(df, 6).collect())
    assert got == [(t0 + dt.timedelta(hours=6), 2), (t0 + dt.timedelta(hours=24), 7)]


def test_allclose_counts_one_sided_rows(spark):
    a = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, None), (3, 3.0, 3.0)], "node long, u double, v double")
    b = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.1, None)], "node long, u double, v double")
    got = {r["variable"]: (r["mismatches"], r["compared"]) for r in quality.allclose(a, b, ["u", "v"], ["node"]).collect()}
    assert got == {"u": (2, 3), "v": (1, 3)}


def test_align_many_of_equal_keys_shuffles_each_input_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dfs = [spark.range(100).select(F.col("id").alias("node"), F.col("id").alias("time"), F.lit(i).alias(f"v{i}")) for i in range(3)]
        plan = align.align_many(dfs)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_valid_time_needs_one_reference_time_to_drop_it(tables):
    with pytest.raises(ValueError):
        align.to_valid_time(tables.fcst, keep_frt=False)
    one = tables.fcst.where(F.col("frt") == tables.fcst.agg(F.min("frt")).scalar())
    assert "frt" not in align.to_valid_time(one, keep_frt=False).columns


def test_merge_vars_keeps_every_coordinate(spark):
    a = spark.createDataFrame([(1, 1, 5.0), (2, 1, None)], "node long, time long, a double")
    b = spark.createDataFrame([(2, 1, 7.0), (3, 1, 8.0)], "node long, time long, b double")
    got = {tuple(r) for r in reshape.merge_vars([a, b]).collect()}
    assert got == {(1, 1, 5.0, None), (2, 1, None, 7.0), (3, 1, None, 8.0)}


def test_persistence_spans_several_chunks_and_odd_leads(spark):
    t0 = dt.datetime(1969, 12, 20)
    hours = [0, 1, 5, 7, 30, 31, 200, 207, 500]
    df = spark.createDataFrame([(1, t0 + dt.timedelta(hours=h), float(h)) for h in hours] + [(2, t0, 1.0)],
                               "node long, time timestamp_ntz, z double")
    leads = [1, 7, 24, 207]
    got = {(r["z_pred"], r["leadtime"], r["z_obs"]) for r in align.persistence_forecast(df, leads, ["z"]).collect()}
    assert got == {(float(a), b - a, float(b)) for a in hours for b in hours if b - a in leads}


def test_window_samples_across_chunks(spark):
    t0 = dt.datetime(1970, 1, 29)
    hours = list(range(0, 24 * 10, 6))
    hours.remove(60)
    df = spark.createDataFrame([(1, t0 + dt.timedelta(hours=h), float(h)) for h in hours], "node long, time timestamp_ntz, z double")
    got = {r["time"]: (r["z_m6"], r["z_p0"], r["z_p12"]) for r in samples.window_samples(df, ["z"], [-6, 0, 12]).collect()}
    want = {t0 + dt.timedelta(hours=h): (h - 6.0, float(h), h + 12.0)
            for h in range(-50, 400) if {h - 6, h, h + 12} <= set(hours)}
    assert got == want


def test_half_seconds_do_not_meet_whole_seconds(spark):
    t0 = dt.datetime(1969, 12, 31, 22, 59, 59, 500000)
    hour = dt.timedelta(hours=1)
    df = spark.createDataFrame([(1, t0, 1.0), (1, t0 + hour, 2.0), (1, t0 + hour + dt.timedelta(microseconds=300000), 3.0)],
                               "node long, time timestamp_ntz, z double")
    got = [(r["z_pred"], r["z_obs"]) for r in align.persistence_forecast(df, [1, 2], ["z"]).collect()]
    assert got == [(1.0, 2.0)]
    assert [r["z_m1"] for r in samples.window_samples(df, ["z"], [-1, 0]).collect()] == [1.0]


def test_moments_with_nulls_and_offset(spark):
    import numpy as np

    values = [50_000 + 1e-4 * i for i in range(10)]
    df = spark.createDataFrame([(0, i % 3, v) for i, v in enumerate(values)] + [(1, 0, 2.0), (1, 1, None), (2, 0, None)], "node int, part int, y double")
    got = {r.node: r for r in scalers.merge_moments(scalers.partial_moments(df, ["node", "part"], ["y"]), ["node"], ["y"]).collect()}
    assert abs(got[0].var_y - np.var(values)) < 1e-12 and abs(got[0].mean_y - np.mean(values)) < 1e-9
    assert (got[1].n, got[1].mean_y, got[1].var_y) == (2, 2.0, 1e-30)
    assert (got[2].n, got[2].mean_y, got[2].var_y) == (1, None, None)


def test_rows_without_statistics_stay(spark):
    rows = [(1, "2020-01-05", 1.0), (1, "2020-01-06", 3.0), (1, "2020-02-05", 5.0)]
    df = spark.createDataFrame(rows, "node int, time string, y double").withColumn("time", F.col("time").cast("timestamp_ntz"))
    stats = scalers.anomaly_fit(df, ["y"], "month", (None, "2020-01-31"))
    got = {str(r.time.date()): r.y for r in scalers.anomaly_transform(df, stats, ["y"], "month").collect()}
    assert got == {"2020-01-05": -1.0, "2020-01-06": 1.0, "2020-02-05": None}


def test_day_labels_hold_the_whole_day(spark):
    from sphereframe.operators import select

    df = spark.range(16).select(F.expr("timestamp_ntz '2020-01-01' + make_dt_interval(0, cast(id * 6 as int))").alias("time"))
    assert select.time_slice(df, "2020-01-01", "2020-01-02").count() == 8
    assert select.time_slice(df, "2020-01-01", "2020-01-02T00:00:00").count() == 5
    split = select.split_periods(df, {"a": ("2020-01-01", "2020-01-02"), "b": ("2020-01-03", "2020-01-04")})
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"a": 8, "b": 8}


def test_largest_small_values(spark):
    from sphereframe.operators import remap

    weights = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "dst int, src int, w double")
    field = spark.createDataFrame([(0, 2e-10), (1, 9e-10)], "node int, q double")
    assert [r.q for r in remap.max_value_pool(field, weights, "q").collect()] == [9e-10]


def test_repeated_offsets(spark):
    from sphereframe.operators import samples

    df = spark.range(6).select(F.expr("timestamp_ntz '2020-01-01' + make_dt_interval(0, cast(id as int))").alias("time"))
    got = samples.valid_reference_times(df, df, [0, 1, 1]).orderBy("time").collect()
    assert [r.status for r in got] == ["ok"] * 5 + ["future"]


def test_boundary_keeps_rows(spark):
    df = spark.createDataFrame([(1, 10, 0.5), (2, 10, 1.5)], "node long, time long, z double")
    got = samples.with_boundary(df, lambda keys: keys.where("node = 1").withColumn("tisr", F.lit(3.0))).orderBy("node").collect()
    assert [tuple(r) for r in got] == [(1, 10, 0.5, 3.0), (2, 10, 1.5, None)]
