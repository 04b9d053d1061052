"""Queries over grids, remapping and pooling.

Grid resolutions follow the number of customers, so every table here grows
with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import graphs, grids, remap
from .registry import query
from .views import Tables, _overlap, beside_sql


def _power_of_two(t: Tables) -> int:
    """Smallest power of two n with more than 12 n^2 nodes for the customers."""
    n = 1
    while 12 * n * n <= t.customers:
        n *= 2
    return n


_N_HEALPIX = "(SELECT CAST(pow(2, greatest(0, ceil(log2((count(*) + 1) / 12.0) / 2))) AS BIGINT) AS n FROM customer)"


@query("I1", beside_sql("SELECT node, i, j, lat0, lat1, lon0, lon1, (lat0 + lat1) / 2 AS lat, (lon0 + lon1) / 2 AS lon, area FROM v_grid"))
def grid_equiangular(t: Tables):
    """Every cell, with its customer's balance."""
    return t.beside(t.cells)


@query("I2", beside_sql(f"""
WITH RECURSIVE p AS (SELECT unnest(range(12 * n * n)) AS node, n FROM {_N_HEALPIX}),
f AS (SELECT node, n, node // (n * n) AS face, node % (n * n) AS w FROM p),
b AS (SELECT node, n, face, w, CAST(0 AS BIGINT) AS ix, CAST(0 AS BIGINT) AS iy, CAST(1 AS BIGINT) AS bit FROM f
      UNION ALL SELECT node, n, face, w // 4, ix + bit * (w % 2), iy + bit * ((w // 2) % 2), bit * 2 FROM b WHERE bit < n),
x AS (SELECT node, n, face, ix, iy FROM b WHERE bit = n),
r AS (SELECT *, [2,2,2,2,3,3,3,3,4,4,4,4][face + 1] * n - ix - iy - 1 AS ring, [1,3,5,7,0,2,4,6,1,3,5,7][face + 1] AS fl FROM x),
q AS (SELECT *, CASE WHEN ring < n THEN ring WHEN ring > 3 * n THEN 4 * n - ring ELSE n END AS m,
      CASE WHEN ring < n OR ring > 3 * n THEN 0 ELSE (ring - n) % 2 END AS s FROM r),
z AS (SELECT *, CASE WHEN ring < n THEN 1.0::DOUBLE - m * m / (3.0::DOUBLE * n * n) WHEN ring > 3 * n
      THEN m * m / (3.0::DOUBLE * n * n) - 1.0::DOUBLE ELSE (2 * n - ring) * 2.0::DOUBLE / (3.0::DOUBLE * n) END AS z,
      (fl * m + ix - iy + 1 + s) // 2 AS p0 FROM q),
l AS (SELECT *, CASE WHEN p0 > 4 * m THEN p0 - 4 * m WHEN p0 < 1 THEN p0 + 4 * m ELSE p0 END AS p FROM z)
SELECT node, ring, degrees(asin(z)) AS lat, (p - (s + 1) * 0.5::DOUBLE) * 90.0::DOUBLE / m AS lon,
       4 * pi() / (12 * n * n) AS area FROM l"""))
def grid_healpix(t: Tables):
    """Every node of the nested equal-area sampling, with its customer's balance."""
    return t.beside(grids.grid_healpix(t.spark, _power_of_two(t)))


# Newton steps on the three-term recurrence, one row of the recursion per ring, step and degree.
@query("I3", """
WITH RECURSIVE g AS (SELECT 2 * CAST(ceil((sqrt(82 + count(*)) - 9) / 2) AS BIGINT) AS nlat FROM customer),
r AS (SELECT unnest(range(nlat)) AS ring, nlat FROM g),
p AS (SELECT ring, nlat, 0 AS step, 1 AS k, 1.0::DOUBLE AS p0, x AS p1, x FROM (SELECT ring, nlat, cos(pi() * (ring + 0.75) / (nlat + 0.5)) AS x FROM r)
  UNION ALL SELECT ring, nlat, CASE WHEN k = nlat THEN step + 1 ELSE step END, CASE WHEN k = nlat THEN 1 ELSE k + 1 END,
    CASE WHEN k = nlat THEN 1.0::DOUBLE ELSE p1 END,
    CASE WHEN k = nlat THEN x - p1 * (x * x - 1) / (nlat * (x * p1 - p0)) ELSE ((2 * k + 1) * x * p1 - k * p0) / (k + 1) END,
    CASE WHEN k = nlat THEN x - p1 * (x * x - 1) / (nlat * (x * p1 - p0)) ELSE x END FROM p WHERE step < 6),
l AS (SELECT ring, degrees(asin(x)) AS lat FROM p WHERE step = 6),
s AS (SELECT ring, 4 * least(ring + 1, nlat - ring) + 16 AS size, nlat FROM r),
b AS (SELECT ring, size, sum(size) OVER (ORDER BY ring) - size AS before FROM s)
SELECT c_custkey AS node, ring, lat, (c_custkey - before) * 360.0::DOUBLE / size AS lon FROM customer JOIN b ON c_custkey >= before AND c_custkey < before + size JOIN l USING (ring)""")
def grid_octahedral(t: Tables):
    """Customers on the rings of a reduced Gaussian sampling."""
    return grids.octahedral_nodes(t.keys, 2 * math.ceil((math.sqrt(82 + t.customers) - 9) / 2))


@query("I3", """
WITH RECURSIVE r AS (SELECT c_custkey AS node, c_acctbal AS v, c_custkey % 24 AS ring, cos(pi() * (c_custkey % 24 + 0.75) / 24.5) AS x0 FROM customer),
q AS (SELECT DISTINCT ring, x0 FROM r),
p AS (SELECT ring, 0 AS step, 1 AS k, 1.0::DOUBLE AS p0, x0 AS p1, x0 AS x FROM q
  UNION ALL SELECT ring, CASE WHEN k = 24 THEN step + 1 ELSE step END, CASE WHEN k = 24 THEN 1 ELSE k + 1 END, CASE WHEN k = 24 THEN 1.0::DOUBLE ELSE p1 END,
    CASE WHEN k = 24 THEN x - p1 * (x * x - 1) / (24 * (x * p1 - p0)) ELSE ((2 * k + 1) * x * p1 - k * p0) / (k + 1) END,
    CASE WHEN k = 24 THEN x - p1 * (x * x - 1) / (24 * (x * p1 - p0)) ELSE x END FROM p WHERE step < 6)
SELECT ring, degrees(asin(x)) AS lat, count(*) AS n, avg(v) AS z FROM r JOIN p USING (ring) WHERE step = 6 GROUP BY 1, 2""")
def gaussian_latitudes(t: Tables):
    """Customers on the rings of a Gaussian grid: balances averaged by the latitude of each customer's ring."""
    ring = F.pmod("c_custkey", F.lit(24))
    placed = t.table("customer").select(ring.alias("ring"), "c_acctbal")
    means = placed.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("z"))
    return means.select("ring", F.degrees(F.asin(grids.gaussian_sine(F.col("ring"), F.lit(24)))).alias("lat"), "n", "z")


_CUBED = "(SELECT CAST(ceil(sqrt((count(*) + 1) / 6.0)) AS BIGINT) AS n FROM customer)"


@query("I4", beside_sql(f"""
WITH c AS (SELECT unnest(range(6 * n * n)) AS node, n FROM {_CUBED}),
f AS (SELECT node, node // (n * n) AS face, tan(pi() / 4 * ((2 * ((node % (n * n)) // n) + 1) / n::DOUBLE - 1)) AS a,
      tan(pi() / 4 * ((2 * (node % n) + 1) / n::DOUBLE - 1)) AS b FROM c),
v AS (SELECT node, face, CASE WHEN face < 3 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s, a, b,
      sqrt(1 + a * a + b * b) AS n FROM f)
SELECT node, face, CASE face % 3 WHEN 0 THEN s WHEN 1 THEN b ELSE a END / n AS x,
       CASE face % 3 WHEN 1 THEN s WHEN 2 THEN b ELSE a END / n AS y, CASE face % 3 WHEN 2 THEN s WHEN 0 THEN b ELSE a END / n AS z FROM v"""))
def grid_cubed(t: Tables):
    """Every node on the faces of a cubed sphere, with its customer's balance."""
    return t.beside(grids.grid_cubed(t.spark, math.ceil(math.sqrt((t.customers + 1) / 6.0))).drop("lon", "lat"))


_ICO = "(SELECT CAST(ceil(sqrt((count(*) - 2) / 10.0)) AS BIGINT) AS n FROM customer)"


@query("I4", f"SELECT 10 * n * n + 2 AS nodes, 10 * n * n + 2 AS places, CAST(0 AS DOUBLE) AS off_sphere FROM {_ICO}")
def grid_icosahedral(t: Tables):
    """Node count, distinct places (no shared node made twice) and distance from the sphere."""
    n = math.ceil(math.sqrt((t.customers - 2) / 10.0))
    g = grids.grid_icosahedral(t.spark, n)
    radius = F.abs(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) - 1.0)
    cell = [F.round(c, 9).alias(c) for c in "xyz"]
    places = g.select(*cell, radius.alias("_r")).groupBy("x", "y", "z").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_r").alias("_r"))
    return places.agg(F.sum("_n").alias("nodes"), F.count(F.lit(1)).alias("places"),
                      F.floor(F.max("_r") * 1e12).cast("double").alias("off_sphere"))


def _unit_sql(label: str) -> str:
    return f"CAST('0x' || substr(md5(node || ':42:{label}'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE"


@query("I4", beside_sql(f"SELECT node, degrees(asin(2 * {_unit_sql('z')} - 1)) AS lat, 360 * {_unit_sql('lon')} AS lon "
                        "FROM (SELECT unnest(range(count(*) + 1)) AS node FROM customer)"))
def grid_random(t: Tables):
    """A random place for node 0 and as many others as there are customers, with their customers' balances."""
    return t.beside(grids.grid_random(t.spark, t.customers + 1, 42))


_NPIX_SQL = {"equiangular": "2 * p * p", "gaussian": "4 * (p // 2) * (p // 2 + 9)", "healpix": "12 * p * p",
             "icosahedral": "10 * p * p + 2", "cubed": "6 * p * p"}
_PARAMS_SQL = {"equiangular": "round(sqrt(n / 2.0::DOUBLE))", "gaussian": "(sqrt(1296.0::DOUBLE + 16 * n) - 36) / 4",
               "healpix": "sqrt(n / 12.0::DOUBLE)", "icosahedral": "sqrt((n - 2) / 10.0::DOUBLE)", "cubed": "sqrt(n / 6.0::DOUBLE)"}


@query("I5", "WITH q AS (SELECT DISTINCT p_size::BIGINT AS p FROM part) " + " UNION ALL ".join(
    f"SELECT '{s}' AS sampling, p AS subdivisions, n AS npix, {_PARAMS_SQL[s]} AS params, "
    f"sqrt(2 * pi() * 6371 * 2 * 6371 / nullif(n, 0)) AS km FROM (SELECT p, {_NPIX_SQL[s]} AS n FROM q)" for s in grids.SAMPLINGS))
def grid_sizes(t: Tables):
    """Subdivisions -> nodes -> subdivisions and resolution for every sampling."""
    p = t.table("part").select(F.col("p_size").cast("long").alias("subdivisions")).distinct()
    parts = [p.withColumn("sampling", F.lit(s)).withColumn("npix", grids.params_to_npix(s, F.col("subdivisions")))
             .withColumn("params", grids.npix_to_params(s, F.col("npix"))) for s in grids.SAMPLINGS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("km", grids.resolution_km(F.col("npix"))).select("sampling", "subdivisions", "npix", "params", "km")


_W, _B = 15.0, 61
_BAND = f"({_W / 2!r}::DOUBLE + b * {(90.0 - _W) / (_B - 1)!r}::DOUBLE)"


@query("I6", f"""
WITH bands AS (SELECT unnest(range({_B})) AS b),
c AS (SELECT b, {_BAND} AS lat FROM bands),
n AS (SELECT b, c.lat, count(v.node) AS n FROM c LEFT JOIN v_nodes v
      ON abs(v.lat) >= c.lat - {_W / 2!r}::DOUBLE AND abs(v.lat) <= c.lat + {_W / 2!r}::DOUBLE GROUP BY 1, 2)
SELECT b AS band, lat, n, sqrt(2 * pi() * 6371 * (2 * (sin(radians(lat + {_W / 2!r}::DOUBLE)) - sin(radians(lat - {_W / 2!r}::DOUBLE))) * 6371)
       / nullif(n, 0)) AS km FROM n""")
def resolution_profile(t: Tables):
    return grids.resolution_profile(t.nodes, _W, _B)


@query("I7", beside_sql("SELECT node, area, area / (SELECT sum(area) FROM v_grid) AS weight FROM v_grid"))
def area_weights(t: Tables):
    return t.beside(grids.area_weights(t.cells.select("node", "area")))


_EDGE = ("2 * atan2(tan(radians({b} - {a}) / 2) * (tan(radians({p}) / 2) + tan(radians({q}) / 2)), "
         "1 + tan(radians({p}) / 2) * tan(radians({q}) / 2))")


@query("I8", beside_sql("SELECT node, abs(" + " + ".join([
    _EDGE.format(a="lon0", b="lon1", p="lat0", q="lat0"), _EDGE.format(a="lon1", b="lon1", p="lat0", q="lat1"),
    _EDGE.format(a="lon1", b="lon0", p="lat1", q="lat1"), _EDGE.format(a="lon0", b="lon0", p="lat1", q="lat0")]) +
    ") AS area FROM v_grid"))
def polygon_areas(t: Tables):
    return t.beside(grids.polygon_areas(grids.cell_boundaries(t.cells)))


@query("I9", beside_sql("SELECT node, i, j FROM v_grid"))
def node_ij(t: Tables):
    rows, columns = t.shape
    nlat, nlon = grids.grid_shape(rows * columns, 2)
    return t.beside(grids.node_ij(t.cells.select("node"), nlon))


@query("I10", "SELECT c_custkey AS node, c_custkey // 16 AS parent FROM customer")
def parent_map(t: Tables):
    return grids.parent_map(t.table("customer").select(F.col("c_custkey").alias("node")), 2)


@query("I10", beside_sql("SELECT node, (i // 2) * (nlon // 2) + j // 2 AS parent FROM v_grid, v_gs"))
def parent_map_grid(t: Tables):
    return t.beside(grids.parent_map_grid(t.cells, 2, t.shape[1]))


# --- remapping -------------------------------------------------------------------------------


@query("D10", beside_sql("SELECT dst, src, w FROM v_cell_w", "src"))
def overlap_weights(t: Tables):
    return t.beside(remap.overlap_weights(t.cells, t.dst), "src")


@query("K1", beside_sql("SELECT dst, src, w FROM v_cell_pool", "src"))
def pool_matrix(t: Tables):
    return t.beside(remap.pool_matrix(t.cell_weights), "src")


@query("K1", beside_sql("SELECT dst, src, w FROM v_cell_unpool", "src"))
def unpool_matrix(t: Tables):
    return t.beside(remap.unpool_matrix(t.cell_weights), "src")


@query("K2", "SELECT dst AS node, time, sum(w * z) / sum(w) AS z FROM v_w JOIN v_field ON src = node GROUP BY 1, 2")
def remap_fracarea(t: Tables):
    return remap.remap(t.field, t.weights, ["z"], ["time"])


@query("K2", "SELECT dst AS node, f.time, sum(w * z) / d.area AS z FROM v_w JOIN v_field f ON src = f.node "
             "JOIN v_dst d ON d.node = dst GROUP BY dst, f.time, d.area")
def remap_destarea(t: Tables):
    return remap.remap(t.field, t.weights, ["z"], ["time"], "destarea", t.dst)


@query("K3", """
WITH s AS (SELECT dst, soil, CAST(sum(p.w) AS FLOAT) AS w FROM v_pool p JOIN v_bal b ON p.src = b.node GROUP BY 1, 2)
SELECT dst AS node, soil FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY w DESC, soil) AS r FROM s) WHERE r = 1""")
def remap_largest_area(t: Tables):
    return remap.remap_largest_area(t.balance, t.weights, "soil")


@query("K4", """
SELECT (SELECT sum(w) FROM v_w) AS total_area,
(SELECT max(abs(coalesce(s, 0) - area)) FROM v_dst LEFT JOIN (SELECT dst, sum(w) AS s FROM v_w GROUP BY 1) ON node = dst) AS dst_deviation,
(SELECT max(abs(coalesce(s, 0) - area)) FROM v_src LEFT JOIN (SELECT src, sum(w) AS s FROM v_w GROUP BY 1) ON node = src) AS src_deviation,
(SELECT max(abs(s - 1)) FROM (SELECT dst, sum(w) AS s FROM v_pool GROUP BY 1)) AS row_sum_deviation""")
def check_weights(t: Tables):
    return remap.check_weights(t.weights, t.src, t.dst)


@query("K5", "SELECT node // 4 AS node, time, avg(z) AS z FROM v_obs GROUP BY 1, 2")
def nested_avg_pool(t: Tables):
    return remap.nested_avg_pool(t.obs, 4, ["z"], ["time"])


_NMAX = ("SELECT parent AS node, time, z, node AS index FROM (SELECT node, node // 4 AS parent, time, z, row_number() OVER "
         "(PARTITION BY node // 4, time ORDER BY z DESC, node) AS r FROM v_obs) WHERE r = 1")


@query("K6", _NMAX)
def nested_max_pool(t: Tables):
    return remap.nested_max_pool(t.obs, 4, "z", ["time"])


@query("K7", "SELECT node * 4 + c AS node, time, z FROM (SELECT node // 4 AS node, time, avg(z) AS z FROM v_obs GROUP BY 1, 2), "
             "(SELECT unnest(range(4)) AS c)")
def nested_avg_unpool(t: Tables):
    return remap.nested_avg_unpool(remap.nested_avg_pool(t.obs, 4, ["z"], ["time"]), 4, ["z"], ["time"])


@query("K8", f"SELECT node * 4 + c AS node, time, CASE WHEN node * 4 + c = index THEN z ELSE 0 END AS z FROM ({_NMAX}), "
             "(SELECT unnest(range(4)) AS c)")
def nested_max_unpool(t: Tables):
    return remap.nested_max_unpool(remap.nested_max_pool(t.obs, 4, "z", ["time"]), 4, "z", ["time"])


_BLOCK = ("SELECT f.node, f.time, f.z, (f.node // nlon) // 3 AS bi, (f.node % nlon) // 3 AS bj, nlat // 3 AS nbi, nlon // 3 AS nbj, "
          "nlon FROM v_field f, v_gs WHERE (f.node // nlon) // 3 < nlat // 3 AND (f.node % nlon) // 3 < nlon // 3")
_GAVG = f"SELECT bi * nbj + bj AS node, time, nbj, nlon, avg(z) AS z FROM ({_BLOCK}) GROUP BY 1, 2, 3, 4"
_GMAX = (f"SELECT bi * nbj + bj AS node, time, nbj, nlon, z, node AS index FROM (SELECT *, row_number() OVER (PARTITION BY bi, bj, time "
         f"ORDER BY z DESC, node) AS r FROM ({_BLOCK})) WHERE r = 1")
_FINE = ("(node // nbj) * 3 * nlon + (node % nbj) * 3 + a * nlon + b AS node", "(SELECT unnest(range(3)) AS a), (SELECT unnest(range(3)) AS b)")


@query("K9", f"SELECT node, time, z FROM ({_GAVG})")
def grid_avg_pool(t: Tables):
    return remap.grid_avg_pool(t.field, *t.shape, 3, ["z"], ["time"])


@query("K10", f"SELECT node, time, z, index FROM ({_GMAX})")
def grid_max_pool(t: Tables):
    return remap.grid_max_pool(t.field, *t.shape, 3, "z", ["time"])


@query("K11", f"SELECT {_FINE[0]}, z, time FROM ({_GAVG}), {_FINE[1]}")
def grid_avg_unpool(t: Tables):
    pooled = remap.grid_avg_pool(t.field, *t.shape, 3, ["z"], ["time"])
    return remap.grid_avg_unpool(pooled, *t.shape, 3, ["z"], ["time"])


@query("K12", f"SELECT node, time, CASE WHEN node = index THEN z ELSE 0 END AS z FROM (SELECT {_FINE[0]}, index, z, time FROM ({_GMAX}), {_FINE[1]})")
def grid_max_unpool(t: Tables):
    pooled = remap.grid_max_pool(t.field, *t.shape, 3, "z", ["time"])
    return remap.grid_max_unpool(pooled, *t.shape, 3, "z", ["time"])


_GEN = "SELECT dst AS node, time, sum(w * z) AS z FROM v_pool JOIN v_field ON src = node GROUP BY 1, 2"


@query("K13", _GEN)
def general_avg_pool(t: Tables):
    return remap.general_avg_pool(t.field, t.weights, ["z"], ["time"])


@query("K13", f"SELECT dst AS node, time, sum(w * z) AS z FROM v_unpool JOIN ({_GEN}) ON src = node GROUP BY 1, 2")
def general_avg_unpool(t: Tables):
    pooled = remap.general_avg_pool(t.field, t.weights, ["z"], ["time"])
    return remap.general_avg_unpool(pooled, t.weights, ["z"], ["time"])


_LARGEST = "SELECT dst, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY CAST(w AS FLOAT) DESC, src) AS r FROM v_pool) WHERE r = 1"
_MAREA = f"SELECT dst AS node, time, z FROM ({_LARGEST}) JOIN v_field ON src = node"
_SCATTER = ("SELECT w.src AS node, c.time, coalesce(max_by(c.z, CASE WHEN c.index = w.src THEN c.node END), 0) AS z "
            "FROM v_w w JOIN ({chosen}) c ON c.node = w.dst GROUP BY 1, 2")


@query("K14", _MAREA)
def max_area_pool(t: Tables):
    return remap.max_area_pool(t.field, t.weights, ["z"], ["time"])


@query("K14", _SCATTER.format(chosen=f"SELECT dst AS node, time, z, src AS index FROM ({_LARGEST}) JOIN v_field ON src = node"))
def max_area_unpool(t: Tables):
    pooled = remap.max_area_pool(t.field, t.weights, ["z"], ["time"])
    return remap.max_area_unpool(pooled, t.weights, "z", ["time"])


_MVAL = ("SELECT dst AS node, time, z, src AS index FROM (SELECT dst, src, time, z, row_number() OVER (PARTITION BY dst, time "
         "ORDER BY CAST(w * z AS FLOAT) DESC, src) AS r FROM v_pool JOIN v_field ON src = node) WHERE r = 1")


@query("K15", _MVAL)
def max_value_pool(t: Tables):
    return remap.max_value_pool(t.field, t.weights, "z", ["time"])


@query("K15", _SCATTER.format(chosen=_MVAL))
def max_value_unpool(t: Tables):
    pooled = remap.max_value_pool(t.field, t.weights, "z", ["time"])
    return remap.max_value_unpool(pooled, t.weights, "z", ["time"])


_INV = ("SELECT p.dst AS node, 1 - sum(p.w * u.w) AS error FROM v_pool p JOIN v_unpool u ON u.dst = p.src AND u.src = p.dst GROUP BY 1")


@query("K16", beside_sql(_INV.replace("v_pool", "v_cell_pool").replace("v_unpool", "v_cell_unpool")))
def inversion_error(t: Tables):
    return t.beside(remap.inversion_error(remap.pool_matrix(t.cell_weights), remap.unpool_matrix(t.cell_weights)))


@query("K16", f"SELECT avg(error) AS overall_error, count(*) AS nodes FROM ({_INV})")
def inversion_error_overall(t: Tables):
    error = remap.inversion_error(remap.pool_matrix(t.weights), remap.unpool_matrix(t.weights))
    return error.agg(F.avg("error").alias("overall_error"), F.count(F.lit(1)).alias("nodes"))


_W2 = f"({_overlap('v_dst', 'v_coarse')})"
_P2 = f"(SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM {_W2})"
_CHAIN = f"SELECT a.dst, b.src, sum(a.w * b.w) AS w FROM {_P2} a JOIN v_pool b ON b.dst = a.src GROUP BY 1, 2"
_DIRECT = f"(SELECT dst, src, w / sum(w) OVER (PARTITION BY dst) AS w FROM ({_overlap('v_src', 'v_coarse')}))"


def _chain(t: Tables, weights):
    coarse = t.grid(1, 4)
    return remap.compose(remap.pool_matrix(remap.overlap_weights(t.dst, coarse)), remap.pool_matrix(weights)), coarse


@query("K17", beside_sql(_CHAIN.replace("v_pool", "v_cell_pool"), "src"))
def compose(t: Tables):
    return t.beside(_chain(t, t.cell_weights)[0], "src")


@query("K17", f"""
SELECT c.dst AS node, sum(c.w) AS row_sum, sum(abs(c.w - coalesce(d.w, 0))) AS off_direct
FROM ({_CHAIN}) c LEFT JOIN {_DIRECT} d ON d.dst = c.dst AND d.src = c.src GROUP BY 1""")
def compose_vs_direct(t: Tables):
    """Chained remapping keeps row sums of one but differs from the direct matrix."""
    chained, coarse = _chain(t, t.weights)
    direct = remap.pool_matrix(remap.overlap_weights(t.src, coarse)).withColumnRenamed("w", "_d")
    both = chained.join(direct, ["dst", "src"], "left")
    return both.groupBy(F.col("dst").alias("node")).agg(
        F.sum("w").alias("row_sum"), F.sum(F.abs(F.col("w") - F.coalesce("_d", F.lit(0.0)))).alias("off_direct"))


def _lattice(t: Tables):
    """Laplacian of the four-neighbour graph of the customers' cells."""
    rows, columns = t.shape
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    edges = t.src.select("node", "i", "j", step.alias("s")).withColumn("i2", F.col("i") + F.col("s.a"))
    edges = edges.where((F.col("i2") >= 0) & (F.col("i2") < rows))
    other = F.col("i2") * columns + F.pmod(F.col("j") + F.col("s.b"), F.lit(columns))
    w = edges.select(F.col("node").alias("i"), other.alias("j"), F.lit(1.0).alias("w")).join(t.keys.withColumnRenamed("node", "j"), "j", "left_semi").select("i", "j", "w")
    return graphs.laplacian(w, "combinatorial")


_LATTICE = """SELECT i, j, sum(w) AS w FROM (SELECT i, unnest([j, i]) AS j, unnest([-1.0::DOUBLE, 1.0::DOUBLE]) AS w FROM
(SELECT s.node AS i, (s.i + a) * nlon + (s.j + b + nlon) % nlon AS j FROM v_src s, v_gs, (SELECT unnest([1, -1, 0, 0]) AS a, unnest([0, 0, 1, -1]) AS b)
 WHERE s.i + a >= 0 AND s.i + a < nlat) WHERE j IN (SELECT c_custkey FROM customer)) GROUP BY 1, 2"""


@query("K18", f"""
WITH l AS ({_LATTICE}), a AS (SELECT p.dst, l.j AS src, sum(p.w * l.w) AS w FROM v_pool p JOIN l ON l.i = p.src GROUP BY 1, 2)
SELECT a.dst AS i, u.src AS j, sum(a.w * u.w) AS w FROM a JOIN v_unpool u ON u.dst = a.src GROUP BY 1, 2""")
def coarsen_laplacian(t: Tables):
    return remap.coarsen_laplacian(remap.pool_matrix(t.weights), _lattice(t), remap.unpool_matrix(t.weights))


KERNEL = {(-1, -1): 0.0625, (-1, 0): 0.125, (-1, 1): 0.0625, (0, -1): 0.125, (0, 0): 0.25, (0, 1): 0.125,
          (1, -1): 0.0625, (1, 0): 0.125, (1, 1): -0.0625}


@query("K19", f"""
WITH k AS (SELECT unnest([{', '.join(str(a) for a, _ in KERNEL)}]) AS di, unnest([{', '.join(str(b) for _, b in KERNEL)}]) AS dj,
           unnest([{', '.join(str(w) for w in KERNEL.values())}])::DOUBLE AS w),
c AS (SELECT s.i, s.j, s.node, f.time, f.z FROM v_field f JOIN v_grid s ON s.node = f.node)
SELECT o.node, c.time, sum(k.w * c.z) AS z FROM c, k, v_gs g, v_grid o
WHERE o.i = c.i - k.di AND o.j = (c.j - k.dj + nlon) % nlon GROUP BY 1, 2""")
def stencil(t: Tables):
    return remap.stencil(t.field, KERNEL, *t.shape, ["z"], ["time"])
