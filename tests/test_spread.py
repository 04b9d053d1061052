"""Uneven data: isolated and crowded nodes, cells of very different size, unmatched rows, unlisted members."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sphereframe.functions.ranks import centred_ranks
from sphereframe.operators import align, graphs, grids, remap, scalers, verify


def on_sphere(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def uneven(isolated=30, crowd=700, seed=2):
    """A few nodes all over the sphere, and most within a thousandth of one place."""
    rng = np.random.default_rng(seed)
    return np.concatenate([on_sphere(rng.normal(size=(isolated, 3))), on_sphere(np.array([[0.3, -0.5, 0.8]]) + 1e-3 * rng.normal(size=(crowd, 3)))])


def frame(spark, x):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(x.tolist())], "node long, x double, y double, z double").repartition(6)


def test_neighbours_of_isolated_and_crowded_nodes(spark):
    x = uneven()
    got = graphs.knn_graph(frame(spark, x), 5, leaf_size=8).orderBy("i", "rank").collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = [(i, int(j), k + 1) for i in range(len(x)) for k, j in enumerate([j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:5])]
    assert [(r.i, r.j, r["rank"]) for r in got] == want


def test_fewer_nodes_than_neighbours(spark):
    got = graphs.knn_graph(frame(spark, uneven(3, 0)), 5).collect()
    assert sorted((r.i, r["rank"]) for r in got) == [(i, k) for i in range(3) for k in (1, 2)]


@pytest.mark.parametrize("block", [2048, 50])
def test_radius_in_a_crowded_cell(spark, block):
    x = uneven(40, 300)
    got = {(r.i, r.j) for r in graphs.radius_graph(frame(spark, x), 0.4, block).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert got == {(int(i), int(j)) for i, j in np.argwhere(d <= 0.4) if i != j}


def cells(spark, lat, lon, offset=0):
    rows = [(offset + i * (len(lon) - 1) + j, lat[i], lat[i + 1], lon[j], lon[j + 1]) for i in range(len(lat) - 1) for j in range(len(lon) - 1)]
    return spark.createDataFrame(rows, "node long, lat0 double, lat1 double, lon0 double, lon1 double")


@pytest.mark.parametrize("split", [4096, 5])
def test_overlaps_of_irregular_grids(spark, split):
    """One cell of each grid is hundreds of times wider than the others."""
    rng = np.random.default_rng(1)
    fine = cells(spark, [-90.0, *np.sort(rng.uniform(40, 60, 12)).tolist(), 90.0], [0.0, *np.sort(rng.uniform(100, 101, 20)).tolist(), 360.0])
    coarse = cells(spark, [-90.0, 39.5, 47.25, 90.0], [0.0, 100.25, 100.5, 300.0, 360.0], 1000)
    got = {(r.dst, r.src): r.w for r in remap.overlap_weights(fine, coarse, split).collect()}
    want = {}
    for a in fine.collect():
        for b in coarse.collect():
            lat, lon = (min(a.lat1, b.lat1), max(a.lat0, b.lat0)), (min(a.lon1, b.lon1), max(a.lon0, b.lon0))
            if lat[0] - lat[1] > 1e-9 and lon[0] - lon[1] > 1e-9:
                want[b.node, a.node] = (np.sin(np.radians(lat[0])) - np.sin(np.radians(lat[1]))) * np.radians(lon[0] - lon[1])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(w) for k, w in want.items())
    assert sum(got.values()) == pytest.approx(4 * np.pi)


def test_many_gaussian_rings(spark):
    nlat = 4096
    got = spark.range(nlat).select("id", grids.gaussian_sine(F.col("id"), F.lit(nlat)).alias("s")).orderBy("id").toPandas()["s"].to_numpy()
    assert np.abs(got - np.polynomial.legendre.leggauss(nlat)[0][::-1]).max() < 1e-12


@pytest.mark.parametrize("nlat", [2, 8, 46])
def test_octahedral_rows_from_nodes(spark, nlat):
    half = nlat // 2
    rows = grids.grid_octahedral(spark, nlat).orderBy("node").collect()
    want = [(ring, k * 360.0 / size) for ring in range(nlat) for size in [4 * min(ring + 1, nlat - ring) + 16] for k in range(size)]
    assert len(rows) == 4 * half * (half + 9) == len(want)
    assert [(r.ring, pytest.approx(r.lon)) for r in rows] == want


def test_reach_by_sketches(spark):
    rng = np.random.default_rng(5)
    edges = {(int(i), int(j)) for i, j in rng.integers(0, 2000, (6000, 2))}
    df = spark.createDataFrame([(i, j) for i, j in edges], "i long, j long")
    ahead = {n: {n} for e in edges for n in e}
    reached = {n: {n} for n in ahead}
    for i, j in edges:
        ahead[i].add(j)
    for hops in (0, 1, 2, 3):
        if hops:
            reached = {n: set().union(*(reached[j] for j in ahead[n])) for n in ahead}
        got = {r.node: r.reached for r in graphs.reach_sketched(df, hops).collect()}
        assert got.keys() == reached.keys()
        assert all(abs(got[n] - len(reached[n])) <= max(1, 0.07 * len(reached[n])) for n in got)
    assert graphs.reach(df, 3).first().pairs == sum(map(len, reached.values()))


def test_unmatched_rows_stay(spark):
    obs = spark.createDataFrame([(1, 10, 1.0), (2, 10, 2.0), (3, 11, 3.0)], "node long, time long, z double")
    static = spark.createDataFrame([(1, 7.0)], "node long, orog double")
    bc = spark.createDataFrame([(2, 10, 0.5)], "node long, time long, tisr double")
    got = align.attach_static_bc(obs, static, bc, ["orog"], ["tisr"], ["z"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 10, 7.0, None, 1.0), (2, 10, None, 0.5, 2.0), (3, 11, None, None, 3.0)]


def test_unlisted_members_stop_the_median(spark):
    ens = spark.createDataFrame([(1, m, float(m)) for m in (0, 1, 5)], "node long, member int, z double")
    assert verify.ensemble_median(ens, ["z"], ["node"], [0, 1, 5, 9]).first().z == 1.0
    with pytest.raises(PySparkException, match="not among the given ones"):
        verify.ensemble_median(ens, ["z"], ["node"], [0, 1]).collect()
    with pytest.raises(PySparkException, match="NULL"):
        verify.ensemble_median(ens.withColumn("member", F.lit(None).cast("int")), ["z"], ["node"], [0, 1]).collect()


def test_ranks_from_the_middle(spark):
    df = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 1.0, 2.0)] + [("b", 5.0)], "g string, v double")
    got = {(r.g, r.v): r["rank"] for r in centred_ranks(df, ["g"], "v").collect()}
    assert got == {("a", 1.0): -1.0, ("a", 2.0): 0.5, ("a", 3.0): 1.5, ("b", 5.0): 0.0}


def test_merged_moments_without_keys_and_with_null_keys(spark):
    rows = [(None if i % 3 == 0 else i % 3, 1e6 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, z double").repartition(4)
    partials = scalers.partial_moments(df.withColumn("part", F.col("z") % 7), ["k", "part"], ["z"])
    z = np.array([v for _, v in rows])
    one = scalers.merge_moments(partials.drop("k", "part"), [], ["z"]).first()
    assert (one.n, one.mean_z) == (60, pytest.approx(z.mean())) and one.var_z == pytest.approx(z.var())
    got = {r.k: r for r in scalers.merge_moments(partials.drop("part"), ["k"], ["z"]).collect()}
    for k in (None, 1, 2):
        own = np.array([v for key, v in rows if key == k])
        assert (got[k].n, got[k].mean_z) == (20, pytest.approx(own.mean())) and got[k].var_z == pytest.approx(own.var())


def test_ensemble_median_neither_sorts_nor_exchanges_its_members(spark, tables):
    from sphereframe.operators import verify
    from sphereframe.plans.views import MEMBERS

    plan = verify.ensemble_median(tables.ens, ["z"], members=MEMBERS)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.count("Exchange") == 1  # of the events, before they become a hundred rows each


def test_tasks_of_an_ensemble_grow_with_its_events(spark, tables, monkeypatch):
    from sphereframe.plans import views

    monkeypatch.setattr(views, "EVENTS_A_TASK", 100)
    assert views.Tables(spark, tables.sf_dir).ens.rdd.getNumPartitions() == -(-tables.table("events").count() // 100)


def test_stored_members_are_exchanged_once_for_their_median(spark, tables, monkeypatch):
    from sphereframe.plans import layouts

    seen, median = [], verify.ensemble_median

    def noted(*args, **kwargs):
        seen.append((args[0], median(*args, **kwargs)))
        return seen[-1][1]

    monkeypatch.setattr(layouts.verify, "ensemble_median", noted)
    layouts.ensemble_store(tables)
    plan = seen[0][1]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert plan.index("HashAggregate") < plan.index("Exchange") and "HashAggregate" not in plan[plan.index("Exchange"):]


def test_members_are_written_where_they_are_made(spark, tmp_path):
    from sphereframe import sources

    path = str(tmp_path / "members")
    sources.write_members({m: spark.range(0, 30, 1, 3).select("id", F.lit(1.0).alias("z")) for m in (0, 1)}, path)
    assert len(spark.read.parquet(path).inputFiles()) == 6
    assert spark.read.parquet(path).groupBy("member").count().orderBy("member").collect() == [(0, 30), (1, 30)]


def test_parts_of_stored_members_do_not_grow_with_the_events(spark, tmp_path, monkeypatch):
    from sphereframe.plans import layouts, views

    monkeypatch.setattr(views, "EVENTS_A_TASK", 100, raising=False)
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "16k")

    def largest(n):
        """Rows of the largest file, each written by one task, over ``n`` places with an event each."""
        (spark.range(n).select(F.col("id").alias("event_id"), F.lit("2024-01-01T07:00:00").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
                               (F.col("id") % 7).cast("double").alias("value")).write.parquet(f"{tmp_path}/{n}/events.parquet"))
        members = layouts.ensemble_members(views.Tables(spark, f"{tmp_path}/{n}"))
        assert {r.member: r.n for r in members.collect()} == dict.fromkeys(views.MEMBERS, n * len(views.LEADS))
        return max(r["count"] for r in spark.read.parquet(*members.inputFiles()).groupBy(F.input_file_name()).count().collect())

    try:
        assert largest(4000) < 2 * largest(500)
    finally:
        spark.conf.set(advisory, before)


def test_tasks_of_a_mesh_grow_with_its_faces(spark, tables, monkeypatch):
    from sphereframe.plans.networks import mesh

    monkeypatch.setattr(graphs, "FACES_A_TASK", 10)
    vertices, faces = mesh(tables, tables.cells)
    tasks = -(-faces.count() // 10)
    for table in graphs.cotan_laplacian(vertices, faces, inverse_mass=True):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert f", {tasks}), REPARTITION_BY_NUM" in plan


def test_tasks_of_products_grow_with_the_weights(spark, monkeypatch):
    monkeypatch.setattr(remap, "WEIGHTS_A_TASK", 2)
    weights = spark.createDataFrame([(k // 2, k, 1.0) for k in range(10)], "dst long, src long, w double")
    field = spark.createDataFrame([(k, m, float(k)) for k in range(10) for m in range(3)], "node long, time long, z double")
    pooled = remap.general_avg_pool(field, weights, ["z"], ["time"])
    back = remap.general_avg_unpool(pooled, weights, ["z"], ["time"])
    assert back._jdf.queryExecution().executedPlan().toString().count(", 5), REPARTITION_BY_NUM") == 2
    assert {(r.node, r.time): r.z for r in back.collect()} == {(k, m): 2 * (k // 2) + 0.5 for k in range(10) for m in range(3)}


def test_lmax_makes_its_laplacian_once(spark):
    from sphereframe.plans import networks

    class Once:
        asked = 0

        @property
        def laplacian(self):
            self.asked += 1
            return spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, -1.0), (1, 0, -1.0)], "i long, j long, w double")

    t = Once()
    row = networks.lmax(t).first()
    assert t.asked == 1 and row.bound == 2.0 and 2.0 <= row.lmax < 2.1


@pytest.mark.parametrize("places", [10, 200])
def test_tasks_of_a_neighbour_search_grow_with_its_places(spark, monkeypatch, places):
    """Also where the number is that of the shuffle partitions, four here."""
    plans, cut = [], graphs.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graphs, "PLACES_A_TASK", places)
    monkeypatch.setattr(graphs, "cut_lineage", noted)
    graphs.knn_graph(frame(spark, uneven()), 5, leaf_size=8)
    assert any("hashpartitioning(place#" in p and f", {73 if places == 10 else 5}), REPARTITION_BY_NUM" in p for p in plans)


def test_a_neighbour_search_broadcasts_nothing(spark, monkeypatch):
    """Places and cubes grow with the nodes; here they are far below the size up to which Spark broadcasts."""
    plans, cut = [], graphs.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graphs, "cut_lineage", noted)
    plans.append(graphs.knn_graph(frame(spark, uneven()), 5, leaf_size=8)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 7 and not any("Broadcast" in p for p in plans)


def test_p_values_can_be_sent_after_local_use():
    import numpy as np
    from pyspark import cloudpickle

    from sphereframe.functions import special

    special.two_sided_p(np.array([1.0]), np.array([5.0]))
    assert cloudpickle.dumps({k: v for k, v in vars(special).items() if k.startswith("_") and not k.startswith("__")})
