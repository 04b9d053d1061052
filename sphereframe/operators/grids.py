"""Samplings of the sphere as node tables, their sizes, areas and hierarchies.

Every grid is ``spark.range`` plus column expressions: node coordinates are
computed where the row is made, whatever the resolution.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import safe_div
from ..functions.sphere import cell_area, resolution_km, xyz_to_lonlat


def _int_div(a: Column, b: int | Column) -> Column:
    b = b if isinstance(b, Column) else F.lit(int(b))
    return ((a - F.pmod(a, b)) / b).cast("long")


def grid_equiangular(spark: SparkSession, nlat: int, nlon: int) -> DataFrame:
    """Regular latitude-longitude cells, row 0 at the south."""
    return equiangular_cells(spark.range(nlat * nlon).withColumnRenamed("id", "node"), nlat, nlon)


def equiangular_cells(nodes: DataFrame, nlat: int, nlon: int) -> DataFrame:
    """The cells of those nodes of the grid that ``nodes`` lists; further columns ride along."""
    dlat, dlon = 180.0, 360.0
    cells = node_ij(nodes, nlon).withColumns({
        "lat0": F.col("i") * dlat / nlat - 90.0, "lat1": (F.col("i") + 1) * dlat / nlat - 90.0,
        "lon0": F.col("j") * dlon / nlon, "lon1": (F.col("j") + 1) * dlon / nlon})
    return cells.withColumns({
        "lat": (F.col("lat0") + F.col("lat1")) / 2.0, "lon": (F.col("lon0") + F.col("lon1")) / 2.0,
        "area": cell_area("lat0", "lat1", "lon0", "lon1")})


# HEALPix base faces: ring of the southernmost corner and longitude of the centre.
FACE_RING = [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]
FACE_LON = [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7]


def _deinterleave(bits: Column, start: int, n_bits: int) -> Column:
    out = F.lit(0).cast("long")
    for b in range(n_bits):
        out = out + F.shiftleft(F.shiftright(bits, 2 * b + start).bitwiseAND(F.lit(1)), b)
    return out


def grid_healpix(spark: SparkSession, n: int) -> DataFrame:
    """12 n^2 equal-area nodes in nested order; ``n`` is a power of two."""
    return healpix_nodes(spark.range(12 * n * n).withColumnRenamed("id", "node"), n)


def healpix_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """Ring, place and area of those nodes (nested order, 0 to 12 n^2 - 1) that ``nodes`` lists."""
    if n < 1 or n & (n - 1):
        raise ValueError("nested HEALPix order needs a power of two")
    order = n.bit_length() - 1
    face = _int_div(F.col("node"), n * n)
    within = F.pmod(F.col("node"), F.lit(n * n))
    pix = nodes.select("node", face.alias("face"), _deinterleave(within, 0, order).alias("ix"), _deinterleave(within, 1, order).alias("iy"))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("face") + 1).cast("int"))
    pix = pix.withColumn("ring", (pick(FACE_RING) * n - F.col("ix") - F.col("iy") - 1).cast("long"))
    ring = F.col("ring")
    north, south = ring < n, ring > 3 * n
    per_quarter = F.when(north, ring).when(south, 4 * n - ring).otherwise(F.lit(n))
    z = (F.when(north, 1.0 - per_quarter * per_quarter / F.lit(3.0 * n * n))
         .when(south, per_quarter * per_quarter / F.lit(3.0 * n * n) - 1.0)
         .otherwise((2 * n - ring) * 2.0 / F.lit(3.0 * n)))
    shift = F.when(north | south, F.lit(0)).otherwise(F.pmod(ring - n, F.lit(2)))
    place = _int_div(pick(FACE_LON) * per_quarter + F.col("ix") - F.col("iy") + 1 + shift, 2)
    place = F.when(place > 4 * per_quarter, place - 4 * per_quarter).when(place < 1, place + 4 * per_quarter).otherwise(place)
    lon = (place - (shift + 1) * 0.5) * 90.0 / per_quarter
    return pix.select("node", "ring", F.degrees(F.asin(z)).alias("lat"), lon.alias("lon"),
                      F.lit(4.0 * math.pi / (12 * n * n)).alias("area"))


@F.pandas_udf(DoubleType())
def gaussian_sine(ring: pd.Series, nlat: pd.Series) -> pd.Series:
    """Sine of the Gaussian latitude of each ring from the north: that root of the Legendre polynomial of degree ``nlat``.

    Newton steps from the usual first guess, all rings of a batch at once; the polynomial comes from its three-term recurrence.
    """
    out = np.empty(len(ring))
    for n in np.unique(nlat):
        rows = np.flatnonzero(nlat == n)
        x = np.cos(np.pi * (ring.to_numpy()[rows] + 0.75) / (n + 0.5))
        for _ in range(6):
            before, value = np.ones(len(x)), x
            for k in range(1, int(n)):
                before, value = value, ((2 * k + 1) * x * value - k * before) / (k + 1)
            x = x - value * (x * x - 1.0) / (n * (x * value - before))
        out[rows] = x
    return pd.Series(out)


def grid_octahedral(spark: SparkSession, nlat: int) -> DataFrame:
    """Reduced Gaussian grid: 4k+16 nodes on the k-th ring from either pole."""
    half = nlat // 2
    return octahedral_nodes(spark.range(4 * half * (half + 9)).withColumnRenamed("id", "node"), nlat)


def octahedral_nodes(nodes: DataFrame, nlat: int) -> DataFrame:
    """Ring and place of those nodes of a reduced Gaussian grid that ``nodes`` lists.

    The ring follows from the node in closed form; latitudes are found once for each ring, on the executors.
    """
    if nlat % 2:
        raise ValueError("nlat must be even")
    half = nlat // 2
    total = 4 * half * (half + 9)
    before = lambda r: 2 * r * (r + 9)  # noqa: E731  nodes north of ring r of the northern half
    mirrored = F.col("node") >= total // 2
    m = F.when(mirrored, total - 1 - F.col("node")).otherwise(F.col("node"))
    placed = nodes.select("node", m.alias("_m"), mirrored.alias("_south")).withColumn("_r", F.floor((F.sqrt(81.0 + 2.0 * F.col("_m")) - 9.0) / 2.0))
    near = F.col("_r")
    near = F.when(before(near) > F.col("_m"), near - 1).when(before(near + 1) <= F.col("_m"), near + 1).otherwise(near)  # the root was rounded
    placed = placed.withColumn("_r", near)
    size = 4 * (F.col("_r") + 1) + 16
    k = F.col("_m") - before(F.col("_r"))
    placed = placed.select("node", F.when(F.col("_south"), nlat - 1 - F.col("_r")).otherwise(F.col("_r")).alias("ring"),
                           (F.when(F.col("_south"), size - 1 - k).otherwise(k) * 360.0 / size).alias("lon"))
    rings = nodes.sparkSession.range(nlat).select(F.col("id").alias("ring"), F.degrees(F.asin(gaussian_sine(F.col("id"), F.lit(nlat)))).alias("lat"))
    return placed.join(rings, "ring").select("node", "ring", "lat", "lon")


def _with_lonlat(df: DataFrame) -> DataFrame:
    norm = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz"))
    unit = df.withColumns({a: F.col(f"v{a}") / norm for a in "xyz"})
    lon, lat = xyz_to_lonlat("x", "y", "z")
    return unit.withColumns({"lon": lon, "lat": lat}).drop("vx", "vy", "vz")


def grid_cubed(spark: SparkSession, n: int) -> DataFrame:
    """6 n^2 nodes: equiangular lattice on each face of a cube."""
    return cubed_nodes(spark.range(6 * n * n).withColumnRenamed("id", "node"), n)


def cubed_nodes(nodes: DataFrame, n: int) -> DataFrame:
    """Face and place of those nodes of a cubed sphere that ``nodes`` lists."""
    face = _int_div(F.col("node"), n * n)
    within = F.pmod(F.col("node"), F.lit(n * n))
    angle = lambda c: F.tan(F.lit(math.pi / 4) * ((2 * c + 1) / F.lit(float(n)) - 1.0))
    a, b = angle(_int_div(within, n)), angle(F.pmod(within, F.lit(n)))
    axis = F.pmod(F.col("face"), F.lit(3))
    sign = F.when(F.col("face") < 3, 1.0).otherwise(-1.0)
    cells = nodes.select("node", face.alias("face"), a.alias("a"), b.alias("b"))
    return _with_lonlat(cells.withColumns({
        "vx": F.when(axis == 0, sign).when(axis == 1, F.col("b")).otherwise(F.col("a")),
        "vy": F.when(axis == 1, sign).when(axis == 2, F.col("b")).otherwise(F.col("a")),
        "vz": F.when(axis == 2, sign).when(axis == 0, F.col("b")).otherwise(F.col("a"))}).drop("a", "b"))


def _icosahedron() -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    phi = (1 + math.sqrt(5)) / 2
    corners = [np.roll([0.0, s, t * phi], r) for r in range(3) for s in (1, -1) for t in (1, -1)]
    v = np.array(corners)
    near = lambda i, j: abs(np.linalg.norm(v[i] - v[j]) - 2.0) < 1e-9
    faces = [f for f in combinations(range(12), 3) if all(near(i, j) for i, j in combinations(f, 2))]
    return v / np.linalg.norm(v, axis=1, keepdims=True), faces


def grid_icosahedral(spark: SparkSession, n: int) -> DataFrame:
    """10 n^2 + 2 nodes: every face of an icosahedron cut into n^2 triangles.

    A shared edge or corner is made only by the first face it belongs to, so
    nothing needs to be deduplicated.
    """
    corners, faces = _icosahedron()
    seen_corner: set[int] = set()
    seen_edge: set[tuple[int, int]] = set()
    rows = []
    for f in faces:
        owned_corner = [c not in seen_corner for c in f]
        edges = [(f[1], f[2]), (f[0], f[2]), (f[0], f[1])]
        owned_edge = [e not in seen_edge for e in edges]
        seen_corner.update(f)
        seen_edge.update(edges)
        rows.append((*[[float(x) for x in corners[c]] for c in f], owned_corner, owned_edge))
    structs = [F.struct(*[F.array(*[F.lit(x) for x in part]).alias(name)
                          for name, part in zip(("p", "q", "r", "corner", "edge"), row)]) for row in rows]
    side = n + 1
    face = _int_div(F.col("id"), side * side)
    within = F.pmod(F.col("id"), F.lit(side * side))
    pts = spark.range(20 * side * side).select(
        F.col("id").alias("node"), face.alias("face"), _int_div(within, side).alias("a"), F.pmod(within, F.lit(side)).alias("b"))
    pts = pts.withColumn("c", n - F.col("a") - F.col("b")).where("c >= 0")
    pts = pts.withColumn("f", F.element_at(F.array(*structs), (F.col("face") + 1).cast("int")))
    w = [F.col("a"), F.col("b"), F.col("c")]
    zero = [c == 0 for c in w]
    at_corner = F.when(w[0] == n, F.col("f.corner")[0]).when(w[1] == n, F.col("f.corner")[1]).when(w[2] == n, F.col("f.corner")[2])
    on_edge = F.when(zero[0], F.col("f.edge")[0]).when(zero[1], F.col("f.edge")[1]).when(zero[2], F.col("f.edge")[2])
    pts = pts.where(F.coalesce(at_corner, on_edge, F.lit(True)))
    return _with_lonlat(pts.select("node", "face", *[
        (w[0] * F.col("f.p")[i] + w[1] * F.col("f.q")[i] + w[2] * F.col("f.r")[i]).alias(f"v{axis}")
        for i, axis in enumerate("xyz")]))


def _unit_interval(node: Column, seed: int, label: str) -> Column:
    digest = F.md5(F.concat_ws(":", node.cast("string"), F.lit(str(seed)), F.lit(label)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") / F.lit(float(2 ** 48))


def grid_random(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n uniformly random nodes; the same for any partitioning."""
    return random_nodes(spark.range(n).withColumnRenamed("id", "node"), seed)


def random_nodes(nodes: DataFrame, seed: int) -> DataFrame:
    """A uniformly random place for each node that ``nodes`` lists, the same whenever it is asked for."""
    z = 2.0 * _unit_interval(F.col("node"), seed, "z") - 1.0
    return nodes.select("node", F.degrees(F.asin(z)).alias("lat"), (360.0 * _unit_interval(F.col("node"), seed, "lon")).alias("lon"))


# --- sizes -----------------------------------------------------------------------------------

SAMPLINGS = ("equiangular", "gaussian", "healpix", "icosahedral", "cubed")


def params_to_npix(sampling: str, p: Column) -> Column:
    """Number of nodes; for ``equiangular`` p is the number of latitudes of a 1:2 grid."""
    half = _int_div(p, 2)
    return {"equiangular": 2 * p * p, "gaussian": 4 * half * (half + 9), "healpix": 12 * p * p,
            "icosahedral": 10 * p * p + 2, "cubed": 6 * p * p}[sampling].cast("long")


def npix_to_params(sampling: str, npix: Column) -> Column:
    """Inverse of :func:`params_to_npix` as a real number."""
    n = npix.cast("double")
    return {"equiangular": F.round(F.sqrt(n / 2.0)), "gaussian": (F.sqrt(1296.0 + 16.0 * n) - 36.0) / 4.0,
            "healpix": F.sqrt(n / 12.0), "icosahedral": F.sqrt((n - 2.0) / 10.0), "cubed": F.sqrt(n / 6.0)}[sampling]


def resolution_profile(nodes: DataFrame, width: float, bands: int) -> DataFrame:
    """Mean resolution in sliding bands of absolute latitude.

    A node is sent to the few bands it can fall in and the exact bounds are
    checked there: an equi-group instead of a range join.
    """
    step = (90.0 - width) / (bands - 1)
    lat = F.abs(F.col("lat"))
    first = F.greatest(F.floor((lat - width) / step) - 1, F.lit(0))
    last = F.least(F.floor(lat / step) + 1, F.lit(bands - 1))
    sent = nodes.select(lat.alias("_lat"), F.explode(F.sequence(first, last)).alias("band"))
    centre = F.lit(width / 2) + F.col("band") * F.lit(step)
    inside = (F.col("_lat") >= centre - width / 2) & (F.col("_lat") <= centre + width / 2)
    counts = sent.where(inside).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    all_bands = nodes.sparkSession.range(bands).withColumnRenamed("id", "band")
    height = F.sin(F.radians(centre + width / 2)) - F.sin(F.radians(centre - width / 2))
    return (all_bands.join(counts, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .select("band", centre.alias("lat"), "n", resolution_km(F.col("n"), height).alias("km")))


# --- areas -----------------------------------------------------------------------------------


def area_weights(nodes: DataFrame, area: str = "area", output: str = "weight") -> DataFrame:
    """Areas normalised to a sum of one."""
    total = nodes.agg(F.sum(area)).scalar()
    return nodes.withColumn(output, safe_div(F.col(area), total))


def cell_boundaries(cells: DataFrame) -> DataFrame:
    """Corners of rectilinear cells, counter-clockwise: (node, k, lon, lat)."""
    corner = lambda k, lon, lat: F.struct(F.lit(k).alias("k"), F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    corners = F.array(corner(0, "lon0", "lat0"), corner(1, "lon1", "lat0"), corner(2, "lon1", "lat1"), corner(3, "lon0", "lat1"))
    return cells.select("node", F.explode(corners).alias("_c")).select("node", "_c.*")


def polygon_areas(boundary: DataFrame) -> DataFrame:
    """Area of spherical polygons (great-circle edges) from ordered vertices (node, k, lon, lat).

    Sums, edge by edge, the signed area between the edge and the equator.  Where the edges go once around a pole, the
    polygon is what lies to their left, counter-clockwise seen from outside: a hemisphere less that sum.
    """
    by_k = W.partitionBy("node").orderBy("k")
    whole = by_k.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(by_k), F.first(c).over(whole))
    edges = boundary.select("node", "lon", "lat", nxt("lon").alias("lon_next"), nxt("lat").alias("lat_next"))
    turn = F.col("lon_next") - F.col("lon")
    turn = F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    t1, t2 = F.tan(F.radians("lat") / 2), F.tan(F.radians("lat_next") / 2)
    excess = 2.0 * F.atan2(F.tan(F.radians(turn) / 2) * (t1 + t2), 1.0 + t1 * t2)
    total, turns = F.sum(excess), F.sum(turn)
    return edges.groupBy("node").agg(F.when(F.abs(turns) > 180, 2 * math.pi - total).otherwise(F.abs(total)).alias("area"))


# --- indices ---------------------------------------------------------------------------------


def grid_shape(n_nodes: int, lonlat_ratio: float, tolerance: float = 1.25) -> tuple[int, int]:
    """Rows and columns of a flattened grid: the pair of divisors whose ratio is nearest to the wanted one.

    Fails where even that pair is off by more than the factor ``tolerance``.
    """
    small = [d for d in range(1, math.isqrt(n_nodes) + 1) if n_nodes % d == 0]
    pairs = [(d, n_nodes // d) for d in small] + [(n_nodes // d, d) for d in small]
    off, rows, columns = min(((abs(math.log(c / r / lonlat_ratio)), r, c) for r, c in pairs), default=(math.inf, 0, 0))
    if off > math.log(tolerance):
        raise ValueError(f"{n_nodes} nodes do not form a grid of about {lonlat_ratio} columns to a row")
    return rows, columns


def node_ij(df: DataFrame, nlon: int, node: str = "node") -> DataFrame:
    """Row and column of a flattened node."""
    return df.withColumns({"i": _int_div(F.col(node), nlon), "j": F.pmod(F.col(node), F.lit(nlon))})


def parent_map(nodes: DataFrame, coarsening: int = 1) -> DataFrame:
    """Nested parent of each node after ``coarsening`` halvings of the resolution."""
    return nodes.select("node", _int_div(F.col("node"), 4 ** coarsening).alias("parent"))


def parent_map_grid(cells: DataFrame, block: int, nlon: int) -> DataFrame:
    """Parent of each cell of a regular grid whose rows and columns are merged ``block`` by ``block``."""
    return cells.select("node", (_int_div(F.col("i"), block) * (nlon // block) + _int_div(F.col("j"), block)).alias("parent"))
