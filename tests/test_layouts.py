"""Stores that grow: node-contiguous tables, ingest of batches, ensembles, and roll-outs of whole states."""

import os
import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphereframe import sources
from sphereframe.functions.series import with_previous
from sphereframe.operators import graphs, samples, scalers, verify
from sphereframe.plans.networks import mesh

T0 = datetime(2020, 1, 1)


def exchanges(df) -> int:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def field(spark, nodes=6, steps=40):
    rows = [(n, T0 + timedelta(hours=6 * k), float(n * k % 7), float((n + k) % 5)) for n in range(nodes) for k in range(steps)]
    return spark.createDataFrame(rows, "node long, time timestamp_ntz, z_pred double, z_obs double").repartition(5)


def test_bucketed_table_needs_no_exchange(spark, tmp_path):
    df, name = field(spark), f"b_{uuid.uuid4().hex}"
    sources.write_bucketed(df, name, f"{tmp_path}/b", 4)
    stored = sources.read_bucketed(spark, name)
    for work in (lambda d: scalers.climatology(d, ["z_pred"], "month"), lambda d: verify.deterministic(d, ["z"], ["node"]),
                 lambda d: scalers.climatology(d, ["z_pred"], ["hour", "month"], period=(None, "2020-01-05"))):
        assert exchanges(work(stored)) == 0 < exchanges(work(df))
        key = lambda r: tuple(f"{v + 0.0:.9f}" if isinstance(v, float) else str(v) for v in r)
        assert sorted(map(key, work(stored).collect())) == sorted(map(key, work(df).collect()))
    with pytest.raises(Exception, match="exists"):
        sources.write_bucketed(df, name, f"{tmp_path}/b", 4)
    sources.write_bucketed(df.limit(7), name, f"{tmp_path}/b", 4, mode="force")
    assert sources.read_bucketed(spark, name).count() == 7
    with pytest.raises(ValueError, match="mode"):
        sources.write_bucketed(df, name, f"{tmp_path}/b", 4, mode="append")
    assert sources.read_bucketed(spark, name, ["z_obs"], "2020-01-02", "2020-01-03").columns == ["node", "time", "z_obs"]


def raw(spark, first, last, without=(), shift=0.0):
    rows = [(n, T0 + timedelta(hours=6 * k), n + k / 4 + shift, 0) for n in range(3) for k in range(first, last) if k not in without]
    return spark.createDataFrame(rows, "ncells long, time timestamp_ntz, var129 double, lon_bnds int")


def put(df, store, **more):
    return sources.ingest(df, store, step_hours=6, var_dict={"ncells": "node", "var129": "z"}, drops=["lon_bnds"], **more)


SCHEMA = "node long, time timestamp_ntz, z double"


def stored(spark, store, *period):
    return sorted(tuple(r) for r in sources.read_store(spark, store, SCHEMA, *period).collect())


def test_ingest(spark, tmp_path):
    store = f"{tmp_path}/store"
    assert stored(spark, store) == []
    assert put(raw(spark, 0, 130), store).status == "published"  # into February
    once = stored(spark, store)
    assert len(once) == 390 and once[0] == (0, T0, 0.0)
    assert put(raw(spark, 0, 130).repartition(7), store).status == "known"  # the same rows in another order
    assert stored(spark, store) == once

    files = sorted(os.path.join(d, f) for d, _, fs in os.walk(store) for f in fs)
    inside = put(raw(spark, 130, 200, without=(140, 141, 150)), store)
    assert inside.status == "refused" and sorted(tuple(r) for r in inside.gaps.collect()) == [
        (T0 + timedelta(hours=6 * a), T0 + timedelta(hours=6 * b), m) for a, b, m in ((139, 142, 2), (149, 151, 1))]
    between = put(raw(spark, 133, 200), store)
    assert between.status == "refused" and [tuple(r) for r in between.gaps.collect()] == [(T0 + timedelta(hours=6 * 129), T0 + timedelta(hours=6 * 133), 3)]
    assert sorted(os.path.join(d, f) for d, _, fs in os.walk(store) for f in fs) == files and stored(spark, store) == once

    assert put(raw(spark, 130, 200), store).status == "published"
    assert len(stored(spark, store)) == 600 and stored(spark, store)[:130] == once[:130]
    assert len(stored(spark, store, "2020-02-01", "2020-02-02")) == 3 * 8
    assert put(raw(spark, 0, 0), store).status == "empty"
    assert put(raw(spark, 200, 300), store, start="2030-01-01").status == "empty"


def test_ingest_reads_only_wanted_months(spark, tmp_path):
    store = f"{tmp_path}/store"
    put(raw(spark, 0, 300), store)
    assert all("month=2" in f for f in sources.read_store(spark, store, SCHEMA, "2020-02-03", "2020-02-20").inputFiles())


def test_unpublished_data_stays_invisible(spark, tmp_path):
    store = f"{tmp_path}/store"
    put(raw(spark, 0, 8), store)
    sources.write_grid(raw(spark, 8, 9).select(F.col("ncells").alias("node"), "time", F.col("var129").alias("z")), f"{store}/data/batch=broken")
    assert len(stored(spark, store)) == 24


def run(spark, shift):
    return spark.createDataFrame([(T0, h, n, h + n + shift) for h in (6, 12) for n in range(3)], "frt timestamp_ntz, leadtime int, node long, z double")


def test_members(spark, tmp_path):
    path = f"{tmp_path}/ens"
    sources.write_members({0: run(spark, 0.0), 1: run(spark, 1.0)}, path)
    sources.write_members({2: run(spark, 2.0)}, path)
    assert sources.stored_members(spark, path) == [0, 1, 2]
    kept = {f: os.stat(f"{path}/member=0/{f}").st_mtime_ns for f in os.listdir(f"{path}/member=0")}
    with pytest.raises(ValueError, match="stored already"):
        sources.write_members({1: run(spark, 5.0), 3: run(spark, 3.0)}, path)
    assert sources.stored_members(spark, path) == [0, 1, 2]
    sources.write_members({1: run(spark, 5.0)}, path, replace=True)
    assert {f: os.stat(f"{path}/member=0/{f}").st_mtime_ns for f in os.listdir(f"{path}/member=0")} == kept
    values = sources.read_members(spark, path, [1]).select("z").collect()
    assert sorted(r.z for r in values) == sorted(h + n + 5.0 for h in (6, 12) for n in range(3))
    for wrong in (run(spark, 0.0).drop("z"), run(spark, 0.0).withColumn("t", F.lit(1.0)), run(spark, 0.0).withColumn("z", F.col("z").cast("float"))):
        with pytest.raises(ValueError, match="does not fit"):
            sources.write_members({7: wrong}, path)
    with pytest.raises(ValueError, match="not stored"):
        sources.read_members(spark, path, [0, 9])
    with pytest.raises(ValueError, match="no runs"):
        sources.write_members({}, path)
    assert sources.read_members(spark, path).count() == 18


def plain_rollout(start, bc, ground, steps):
    z, p = [list(x) for x in start]
    out = []
    for i in range(steps):
        sun = bc[i] if bc[i] is not None else 0.0
        a, b = 0.5 * z[-1] + 0.5 * p[0] + sun + (ground or 0.0), z[0] + 2.0 * sun * i
        z, p = [*z[1:], a], [*p[1:], b]
        out.append((a, b))
    return out


@pytest.mark.parametrize("block", [None, 2])
def test_rollout_of_a_state(spark, block):
    def scorer(state, bc, static, i):
        sun, ground = np.nan_to_num(bc[:, 0]), np.nan_to_num(static[:, 0])
        return np.column_stack([0.5 * state[:, 1, 0] + 0.5 * state[:, 0, 1] + sun + ground, state[:, 0, 0] + 2.0 * sun * i])

    rng = np.random.default_rng(3)
    rows = [(n, T0 + timedelta(hours=24 * 29 + 6 * k), *rng.normal(size=4).tolist()) for n in range(4) for k in range(9)]
    sample = spark.createDataFrame(rows, "node long, time timestamp_ntz, z0 double, z1 double, p0 double, p1 double").repartition(3)
    sun = {(n, T0 + timedelta(hours=24 * 29 + 6 * k)): float(rng.normal()) for n in range(4) for k in range(14) if (n + k) % 5}
    bc = spark.createDataFrame([(n, t, v) for (n, t), v in sun.items()], "node long, time timestamp_ntz, tisr double")
    ground = {0: 1.5, 1: None, 2: -0.5}  # node 3 is not listed
    static = spark.createDataFrame(list(ground.items()), "node long, orog double")
    got = samples.rollout_state(sample, scorer, {"z": ["z0", "z1"], "p": ["p0", "p1"]}, 5, 6, boundary=bc, boundary_vars=["tisr"], static=static, static_vars=["orog"], block=block)
    found = {(r.node, r.time, r.iteration): (r.z, r.p, r.leadtime) for r in got.collect()}
    assert len(found) == 4 * 9 * 5
    for n, t, z0, z1, p0, p1 in rows:
        want = plain_rollout(((z0, z1), (p0, p1)), [sun.get((n, t + timedelta(hours=6 * i))) for i in range(5)], ground.get(n), 5)
        for i, (a, b) in enumerate(want):
            assert found[n, t, i] == (pytest.approx(a), pytest.approx(b), 6 * (i + 1))


def test_rollout_without_boundary_or_statics(spark):
    sample = spark.createDataFrame([(1, T0, 1.0, None)], "node long, time timestamp_ntz, z0 double, z1 double")
    out = samples.rollout_state(sample, lambda s, b, c, i: s[:, 0, :] + b.shape[1] + c.shape[1], {"z": ["z0", "z1"]}, 3, 6)
    assert [r.z for r in out.orderBy("iteration").collect()] == [1.0, None, 1.0]
    with pytest.raises(ValueError, match="lags"):
        samples.rollout_state(sample, None, {"z": ["z0", "z1"], "p": ["z0"]}, 3, 6)


def test_future_needs_one_exchange_of_samples(spark):
    sample = field(spark).select("node", "time", "z_obs")
    out = samples.with_future(sample, field(spark).withColumnRenamed("z_pred", "tisr"), ["tisr"], [0, 6, 12])
    row = out.where((F.col("node") == 3) & (F.col("time") == F.lit("2020-01-02").cast("timestamp_ntz"))).first()
    assert row.future.tisr == [float(3 * k % 7) for k in (4, 5, 6)] and out.count() == 240
    assert with_previous(sample, ["node"], "time", ["time"]).count() == 240


def test_largest_eigenvalue_in_the_mass_product(tables):
    lap, mass = graphs.cotan_laplacian(*mesh(tables))
    weights = {r.i: r.mass for r in mass.collect()}
    nodes = sorted(weights)
    at = {n: k for k, n in enumerate(nodes)}
    dense = np.zeros((len(nodes), len(nodes)))
    for r in lap.collect():
        dense[at[r.i], at[r.j]] += r.w
    root = np.sqrt(np.array([weights[n] for n in nodes]))
    assert np.allclose(dense, dense.T)
    top = np.linalg.eigvalsh(dense / root[:, None] / root[None, :])[-1]
    got = graphs.lmax_mass(lap, mass, steps=14)
    assert 0.97 * top <= got <= 1.02 * top
