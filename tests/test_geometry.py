import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphereframe.operators import graphs, grids, remap


def test_healpix_pixels_are_distinct_and_balanced(spark):
    n = 8
    rows = grids.grid_healpix(spark, n).collect()
    assert len(rows) == 12 * n * n
    assert len({(round(r["lat"], 9), round(r["lon"], 9)) for r in rows}) == len(rows)
    assert sum(r["area"] for r in rows) == pytest.approx(4 * math.pi)
    assert sum(math.sin(math.radians(r["lat"])) for r in rows) == pytest.approx(0, abs=1e-9)
    # children lie next to their parent
    parents = {r["node"]: r for r in grids.grid_healpix(spark, n // 2).collect()}
    for r in rows:
        p = parents[r["node"] // 4]
        a, b = (np.radians([x["lat"], x["lon"]]) for x in (r, p))
        cosine = math.sin(a[0]) * math.sin(b[0]) + math.cos(a[0]) * math.cos(b[0]) * math.cos(a[1] - b[1])
        assert math.acos(min(1, cosine)) < 1.2 * math.sqrt(4 * math.pi / (12 * (n // 2) ** 2))
    with pytest.raises(ValueError):
        grids.grid_healpix(spark, 6)


def test_octahedral_latitudes_are_legendre_roots(spark):
    nlat = 16
    rows = grids.grid_octahedral(spark, nlat).collect()
    assert len(rows) == 4 * 8 * (8 + 9)
    assert sorted(r["node"] for r in rows) == list(range(len(rows)))
    polynomial = np.polynomial.legendre.Legendre.basis(nlat)
    for lat in {r["lat"] for r in rows}:
        assert polynomial(math.sin(math.radians(lat))) == pytest.approx(0, abs=1e-10)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_icosahedral_counts(spark, n):
    rows = grids.grid_icosahedral(spark, n).collect()
    assert len(rows) == 10 * n * n + 2
    assert len({(round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in rows}) == len(rows)
    assert sum(r["x"] for r in rows) == pytest.approx(0, abs=1e-9)


def test_cubed_counts(spark):
    rows = grids.grid_cubed(spark, 4).collect()
    assert len({(round(r["lat"], 9), round(r["lon"], 9)) for r in rows}) == 96


def test_polygon_areas_cover_the_sphere(spark):
    cells = grids.grid_equiangular(spark, 9, 18)
    total = grids.polygon_areas(grids.cell_boundaries(cells)).agg(F.sum("area")).first()[0]
    assert total == pytest.approx(4 * math.pi)
    assert cells.agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi)


def test_grid_shape_repairs_ratio():
    assert grids.grid_shape(36 * 72, 2) == (36, 72)
    assert grids.grid_shape(46 * 92, 2) == (46, 92)
    with pytest.raises(ValueError):
        grids.grid_shape(1501, 2)


def test_sizes_round_trip(spark):
    df = spark.range(1, 30).select((F.col("id") * 2).alias("p"))
    for s in grids.SAMPLINGS:
        back = df.select("p", grids.npix_to_params(s, grids.params_to_npix(s, F.col("p"))).alias("q"))
        for r in back.collect():
            assert r["q"] == pytest.approx(r["p"])


def test_weights_conserve_area(spark):
    src, dst = grids.grid_equiangular(spark, 12, 24), grids.grid_equiangular(spark, 5, 10)
    row = remap.check_weights(remap.overlap_weights(src, dst), src, dst).first()
    assert row["total_area"] == pytest.approx(4 * math.pi)
    assert max(row["dst_deviation"], row["src_deviation"], row["row_sum_deviation"]) < 1e-12


def test_remap_to_itself_is_identity(spark):
    cells = grids.grid_equiangular(spark, 6, 12)
    field = cells.select("node", F.col("lat").alias("v"))
    weights = remap.overlap_weights(cells, cells)
    out = {r["node"]: r["v"] for r in remap.remap(field, weights, ["v"]).collect()}
    assert out == pytest.approx({r["node"]: r["v"] for r in field.collect()})
    assert remap.inversion_error(remap.pool_matrix(weights), remap.unpool_matrix(weights)).agg(
        F.max(F.abs("error"))).first()[0] < 1e-12


def brute_knn(points, k):
    out = {}
    for i, p in points.items():
        d = sorted((math.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2])), j)
                   for j, q in points.items() if j != i)
        out[i] = [(j, dist) for dist, j in d[:k]]
    return out


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return tuple(x / n for x in v)


def crowded_points():
    """Copies of one place, a dense cluster, a spread background and two lone nodes."""
    rng = random.Random(5)
    points = [unit((1, 0, 0))] * 120
    points += [unit((0.2 + rng.gauss(0, 1e-4), 0.9 + rng.gauss(0, 1e-4), rng.gauss(0, 1e-4))) for _ in range(130)]
    points += [unit([rng.gauss(0, 1) for _ in range(3)]) for _ in range(120)]
    points += [unit((0.2, 0.9, -0.1)), (0.0, 0.0, 1.0), (0.0, 0.0, -1.0)]
    rng.shuffle(points)
    return dict(enumerate(points))


@pytest.mark.parametrize("k,leaf", [(5, 8), (20, 64)])
def test_knn_equals_brute_force_on_uneven_nodes(spark, k, leaf):
    points = crowded_points()
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "node long, x double, y double, z double")
    got = {}
    for r in graphs.knn_graph(df, k, leaf).orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append((r["j"], r["d"]))
    assert got == brute_knn(points, k)


def test_knn_with_fewer_nodes_than_neighbours(spark):
    points = {0: (1.0, 0.0, 0.0), 1: (0.0, 1.0, 0.0), 2: (-1.0, 0.0, 0.0)}
    df = spark.createDataFrame([(i, *p) for i, p in points.items()], "node long, x double, y double, z double")
    got = {(r["i"], r["j"]) for r in graphs.knn_graph(df, 5).collect()}
    assert got == {(i, j) for i in points for j in points if i != j}


def test_laplacian_rows_sum_to_zero_and_spectrum_is_bounded(tables):
    combinatorial = graphs.laplacian(tables.edges)
    assert combinatorial.groupBy("i").agg(F.abs(F.sum("w")).alias("s")).agg(F.max("s")).first()[0] < 1e-9
    pdf = tables.laplacian.toPandas()
    n = int(pdf["i"].max()) + 1
    dense = np.zeros((n, n))
    dense[pdf["i"], pdf["j"]] = pdf["w"]
    assert np.allclose(dense, dense.T)
    top = np.linalg.eigvalsh(dense)[-1]
    assert top <= graphs.lmax(tables.laplacian) <= top * 1.06


def test_chebyshev_matches_dense_recurrence(tables):
    pdf = tables.laplacian.toPandas()
    field = tables.points.select("node", "f0").toPandas().sort_values("node")
    n = len(field)
    dense = np.zeros((n, n))
    dense[pdf["i"], pdf["j"]] = pdf["w"]
    x = field["f0"].to_numpy()
    terms = [x, dense @ x]
    for _ in range(2):
        terms.append(2 * dense @ terms[-1] - terms[-2])
    got = graphs.chebyshev_basis(tables.laplacian, tables.points.select("node", "f0"), ["f0"], 4).toPandas()
    for k in range(4):
        assert np.allclose(got[got["k"] == k].sort_values("node")["f0"], terms[k])


def test_cotan_laplacian_annihilates_constants(tables):
    from sphereframe.plans.networks import mesh

    lap, mass = graphs.cotan_laplacian(*mesh(tables))
    assert lap.groupBy("i").agg(F.abs(F.sum("w")).alias("s")).agg(F.max("s")).first()[0] < 1e-9
    assert mass.agg(F.min("mass")).first()[0] > 0


def test_stencil_wraps_in_longitude_only(spark):
    one = spark.createDataFrame([(0, 1.0)], "node long, v double")
    out = {r["node"]: r["v"] for r in remap.stencil(one, {(0, 1): 2.0, (1, 0): 3.0, (0, -1): 5.0}, 3, 4, ["v"]).collect()}
    # cell 0 = (0, 0): it is the right neighbour of (0, 3) and the left one of (0, 1); nothing lies below row 0
    assert out == {3: 2.0, 1: 5.0}


def test_max_value_pool_round_trip(spark):
    w = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0), (1, 2, 1.0)], "dst long, src long, w double")
    field = spark.createDataFrame([(0, 1.0), (1, 9.0), (2, 4.0)], "node long, v double")
    pooled = remap.max_value_pool(field, w, "v")
    assert {(r["node"], r["v"], r["index"]) for r in pooled.collect()} == {(0, 9.0, 1), (1, 9.0, 1)}
    back = {r["node"]: r["v"] for r in remap.max_value_unpool(pooled, w, "v").collect()}
    assert back == {0: 0.0, 1: 9.0, 2: 0.0}


def test_area_around_a_pole(spark):
    cap = lambda lat: 2 * math.pi * (1 - math.sin(math.radians(lat)))
    ring = lambda node, lat, step: [(node, k, float(k * step % 360), lat) for k in range(abs(360 // step))]
    rows = ring(0, 60.0, 1) + ring(1, -60.0, -1) + ring(2, -30.0, 1) + ring(3, 60.0, 90)
    got = {r.node: r.area for r in grids.polygon_areas(spark.createDataFrame(rows, "node int, k int, lon double, lat double")).collect()}
    assert abs(got[0] - cap(60)) < 1e-3 and abs(got[1] - cap(60)) < 1e-3 and abs(got[2] - cap(-30)) < 1e-2
    assert abs(got[3] - 0.573) < 1e-3


def test_voronoi_masses_add_up(spark):
    # a right, an acute and an obtuse triangle apart from each other
    places = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (10, 0, 0), (12, 0, 0), (11, 1.9, 0), (20, 0, 0), (24, 0, 0), (21, 0.5, 0)]
    vertices = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(places)], "node int, x double, y double, z double")
    faces = spark.createDataFrame([(0, 1, 2), (3, 4, 5), (6, 7, 8)], "v0 int, v1 int, v2 int")
    mass = {r.i: r.mass for r in graphs.cotan_laplacian(vertices, faces)[1].collect()}
    areas = [0.5, 1.9, 1.0]
    assert all(abs(sum(mass[3 * k + c] for c in range(3)) - areas[k]) < 1e-12 for k in range(3))
    assert abs(mass[0] - 0.25) < 1e-12 and abs(mass[8] - 0.5) < 1e-12 and abs(mass[6] - 0.25) < 1e-12
