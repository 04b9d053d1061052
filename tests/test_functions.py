import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphereframe.functions import ranks, series
from sphereframe.functions.columns import clip, floor_at, time_keys
from sphereframe.functions.special import two_sided_p


def test_p_value_matches_numerical_integration():
    def brute(t, dof):
        x = np.linspace(0, abs(t), 200_001)
        log_c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)
        y = np.exp(log_c - (dof + 1) / 2 * np.log1p(x * x / dof))
        return 1 - 2 * np.trapezoid(y, x)

    for t, dof in [(0.0, 5), (0.3, 3), (1.0, 1), (2.5, 10), (-1.7, 40), (3.0, 1000)]:
        assert two_sided_p(np.array([t]), np.array([dof]))[0] == pytest.approx(brute(t, dof), abs=1e-8)
    assert np.isnan(two_sided_p(np.array([np.nan]), np.array([3.0]))[0])


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value most of those."""
    rng = random.Random(3)
    rows = [("hot", 7.0 if rng.random() < 0.4 else float(int(rng.lognormvariate(3, 2)))) for _ in range(4000)]
    rows += [("cold", float(v)) for v in range(37)] + [("cold", None), ("single", 1.5)]
    return rows, spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("splitters", [4, 256])
def test_quantiles_of_a_hot_group(skewed, splitters):
    rows, df = skewed
    out = {r["g"]: r for r in ranks.exact_quantiles(df, ["g"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}, splitters).collect()}
    for g in ("hot", "cold", "single"):
        values = [v for k, v in rows if k == g and v is not None]
        assert [out[g][c] for c in ("q1", "q2", "q9")] == pytest.approx(np.quantile(values, [0.25, 0.5, 0.9]).tolist())


def test_quantiles_without_groups(skewed):
    rows, df = skewed
    values = [v for _, v in rows if v is not None]
    got = ranks.exact_quantiles(df, [], "v", {"m": 0.5}, 4).collect()
    assert len(got) == 1 and got[0]["m"] == pytest.approx(np.median(values))


@pytest.mark.parametrize("splitters", [4, 256])
def test_ranks_of_a_hot_group(skewed, splitters):
    rows, df = skewed
    for r in ranks.value_ranks(df, ["g"], "v", splitters).collect():
        values = [v for k, v in rows if k == r["g"] and v is not None]
        assert r["below"] == sum(v < r["v"] for v in values)
        assert r["n"] == values.count(r["v"])


def test_numbering_is_a_permutation(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    one = ranks.numbered_by_hash(df, ["k"], 1).collect()
    again = ranks.numbered_by_hash(df.repartition(7), ["k"], 1).collect()
    other = ranks.numbered_by_hash(df, ["k"], 2).collect()
    assert sorted(r["position"] for r in one) == list(range(5000))
    assert {r["k"]: r["position"] for r in one} == {r["k"]: r["position"] for r in again}
    assert {r["k"]: r["position"] for r in one} != {r["k"]: r["position"] for r in other}


def test_previous_row_crosses_chunks(spark):
    start = dt.datetime(2020, 1, 1)
    times = [start + dt.timedelta(days=d) for d in (0, 3, 40, 41, 400, 401)]
    df = spark.createDataFrame([(1, t) for t in times] + [(2, times[2])], "node long, time timestamp_ntz")
    got = {(r["node"], r["time"]): r["prev_time"] for r in series.with_previous(df, ["node"], "time", ["time"]).collect()}
    want = {(1, t): p for t, p in zip(times, [None, *times[:-1]])} | {(2, times[2]): None}
    assert got == want


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-9.0,), (3.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(clip("v", -8, 8)).collect()] == [None, -8.0, 3.0, 8.0]
    assert [r[0] for r in df.select(floor_at("v", 0)).collect()] == [None, 0.0, 3.0, 9.0]


def test_unknown_time_group():
    with pytest.raises(ValueError):
        time_keys(["fortnight"])


def test_hour_bins(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, h),) for h in (0, 2, 3, 23)], "time timestamp_ntz")
    keys = time_keys({"hour": 3})
    assert [r[0] for r in df.select(F.col("time"), keys["hour"].alias("h")).select("h").collect()] == [0, 0, 3, 21]
