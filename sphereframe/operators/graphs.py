"""Graphs over nodes on the sphere: neighbours, weights, Laplacians and polynomial filters.

Edges are tables (i, j, d) or (i, j, w); a Laplacian is (i, j, w) with its
diagonal.  Matrix products are a join and an aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.ranks import exact_quantiles
from ..functions.sphere import chord
from ..session import cut_lineage
from .remap import spmm

MAX_LEVEL = 16
SALTS = 64
FACES_A_TASK = 100_000
PLACES_A_TASK = 500


# --- neighbour search ------------------------------------------------------------------------


def _cell(axis: str, level: Column) -> Column:
    """Index of a coordinate in [-1, 1] among 2^level equal intervals."""
    full = F.least(F.floor((F.col(axis) + 1.0) * float(2 ** (MAX_LEVEL - 1))), F.lit(2 ** MAX_LEVEL - 1))
    return _coarser(full, F.lit(MAX_LEVEL) - level)


def _coarser(index: Column, levels: Column) -> Column:
    """Index of the cube ``levels`` levels up."""
    return F.floor(index / F.pow(F.lit(2.0), levels)).cast("long")


def _side(level: Column) -> Column:
    return F.pow(F.lit(2.0), F.lit(1.0) - level)


def _distinct_places(nodes: DataFrame, keep: int) -> DataFrame:
    """One row per place with its ``keep`` smallest node ids.

    The first pass ranks inside random slices of a place, so the copies of one
    place never meet in one task; only ``keep`` per slice go on.
    """
    salted = nodes.select("node", "x", "y", "z").withColumn("_s", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    within = W.partitionBy("x", "y", "z", "_s").orderBy("node")
    few = salted.withColumn("_r", F.row_number().over(within)).where(F.col("_r") <= keep)
    overall = W.partitionBy("x", "y", "z").orderBy("node")
    best = few.withColumn("_r", F.row_number().over(overall)).where(F.col("_r") <= keep)
    return best.groupBy("x", "y", "z").agg(F.array_sort(F.collect_list("node")).alias("ids")).select(
        F.col("ids")[0].alias("place"), "x", "y", "z", "ids", F.size("ids").alias("m"))


def knn_graph(nodes: DataFrame, k: int, leaf_size: int = 32) -> DataFrame:
    """Exact k nearest neighbours by chord distance: (i, j, d, rank), ties to the smaller id.

    ``nodes`` is (node, x, y, z) on the unit sphere, however unevenly spread.
    Space is cut into cubes of 2^-level, of which only those with nodes are kept, with their counts.

    1. The smallest cube of a node with more than k nodes in it bounds the
       distance of its k-th neighbour, and its frontier starts with the cubes of
       that size around it.
    2. The frontier is sorted by farthest corner: where the counts reach k, the
       bound is tightened, and cubes beyond it go.  Cubes that are still crowded
       are replaced by their eighths, until none is left.  A frontier holds the
       cubes near the edge of the search ball only, however isolated its node is.
    3. Points of the remaining cubes are compared.

    Nodes at one place share a single search, so copies cost nothing.  No join broadcasts: places and cubes grow with the nodes, and a hash table of
    them, which the driver would build, is many times the compressed bytes by which Spark picks a broadcast.
    """
    need = k + 1
    places = cut_lineage(_distinct_places(nodes, need))
    located = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(MAX_LEVEL))))
    located = located.withColumns({f"c{a}": _cell(a, F.col("level")) for a in "xyz"})
    cell = ["level", "cx", "cy", "cz"]
    counts = cut_lineage(located.groupBy(*cell).agg(F.sum("m").alias("n")))
    total = places.agg(F.sum("m")).scalar()
    own = located.select("place", *cell).join(counts.hint("merge"), cell).groupBy("place").agg(F.coalesce(F.max(F.when(F.col("n") >= need, F.col("level"))), F.lit(0)).alias("home"))

    bound = F.when(total >= need, _side(F.col("home")) * math.sqrt(3.0) * (1 + 1e-9)).otherwise(F.lit(4.0))
    # A place fans out to 125 cubes, so the tasks that do it grow with the (counted) places.  With the number of partitions that the join has,
    # Spark would leave the repartition out and merge them by their few bytes.
    tasks = max(1, math.ceil(places.count() / PLACES_A_TASK))
    tasks += tasks == int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.select("place", "x", "y", "z").join(own.hint("merge"), "place").repartition(tasks, "place").withColumn("bound", bound).withColumnRenamed("home", "level")
    near = _neighbourhood(near, F.lit(2)).withColumns({f"c{a}": _cell(a, F.col("level")) + F.col(f"_d{a}") for a in "xyz"})
    inside = _min_distance(_side(F.col("level")), "c") <= F.col("bound")
    for a in "xyz":
        inside = inside & (F.col(f"c{a}") >= 0) & (F.col(f"c{a}") < F.pow(F.lit(2.0), F.col("level")))
    keep = ["place", "x", "y", "z", "bound", *cell]
    frontier = near.where(inside).select(*keep).join(counts.hint("merge"), cell)
    crowded = (F.col("n") > leaf_size) & (F.col("level") < MAX_LEVEL)
    by_high = W.partitionBy("place").orderBy("high", *cell).rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("place")
    while True:
        side = _side(F.col("level"))
        seen = frontier.withColumns({"low": _min_distance(side, "c"), "high": _max_distance(side, "c")}).withColumn("_seen", F.sum("n").over(by_high))
        tight = F.min(F.when(F.col("_seen") >= need, F.col("high"))).over(whole) * (1 + 1e-9)
        frontier = cut_lineage(seen.withColumn("bound", F.least(F.coalesce(tight, F.col("bound")), F.col("bound"))).where(F.col("low") <= F.col("bound")).select(*keep, "n"))
        if frontier.where(crowded).isEmpty():
            break
        eighths = frontier.where(crowded).drop("n").withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(7))))
        eighths = eighths.withColumns({f"c{a}": F.col(f"c{a}") * 2 + F.shiftright("_o", i).bitwiseAND(F.lit(1)) for i, a in enumerate("xyz")} | {"level": F.col("level") + 1})
        frontier = frontier.where(~crowded).unionByName(eighths.select(*keep).join(counts.hint("merge"), cell))

    points = located.select(*cell, F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "ids")
    d = chord(*[F.col(c) for c in ("x", "y", "z", "px", "py", "pz")])
    pairs = frontier.select("place", "x", "y", "z", *cell).join(points.hint("merge"), cell).select("place", d.alias("d"), F.explode("ids").alias("j"))
    nearest = W.partitionBy("place").orderBy("d", "j")
    best = pairs.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= need)
    lists = best.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("d", "j"))).alias("near"))

    owners = nodes.select("node", "x", "y", "z").join(places.select("place", "x", "y", "z").hint("merge"), ["x", "y", "z"])
    mine = owners.join(lists.hint("merge"), "place").select(
        F.col("node").alias("i"), F.filter("near", lambda e: e["j"] != F.col("node")).alias("near"))
    return mine.select("i", F.posexplode(F.slice("near", 1, k)).alias("_p", "_e")).select(
        "i", F.col("_e.j").alias("j"), F.col("_e.d").alias("d"), (F.col("_p") + 1).cast("int").alias("rank"))


def _neighbourhood(df: DataFrame, reach: Column) -> DataFrame:
    """Every step (_dx, _dy, _dz) of at most ``reach`` cells per axis."""
    for a in "xyz":
        df = df.withColumn(f"_d{a}", F.explode(F.sequence(-reach, reach)))
    return df


def _min_distance(side: Column, prefix: str) -> Column:
    """Distance from the query point to a cube (zero inside)."""
    total = F.lit(0.0)
    for a in "xyz":
        low = F.col(f"{prefix}{a}") * side - 1.0
        gap = F.greatest(low - F.col(a), F.col(a) - (low + side), F.lit(0.0))
        total = total + gap * gap
    return F.sqrt(total) * (1 - 1e-9)


def _max_distance(side: Column, prefix: str) -> Column:
    """Distance from the query point to the farthest corner of a cube."""
    total = F.lit(0.0)
    for a in "xyz":
        low = F.col(f"{prefix}{a}") * side - 1.0
        far = F.greatest(F.abs(F.col(a) - low), F.abs(F.col(a) - (low + side)))
        total = total + far * far
    return F.sqrt(total) * (1 + 1e-9)


def radius_graph(nodes: DataFrame, radius: float, block: int = 2048) -> DataFrame:
    """Edges (i, j, d) between nodes at most ``radius`` apart (chord).

    Cells as wide as the radius: a node looks into its own and the 26 cells around it.  A cell with more than ``block`` nodes is cut into blocks of
    that size, for those that look and those that are looked at, and the pairs of blocks are dealt over the tasks.
    """
    cell = ["cx", "cy", "cz"]
    at = {f"c{a}": F.floor(F.col(a) / F.lit(float(radius))) for a in "xyz"}
    placed = nodes.select("node", "x", "y", "z", *[c.alias(k) for k, c in at.items()])
    blocks = (placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
              .select(*cell, F.ceil(F.col("_n") / block).cast("long").alias("_blocks")))  # the crowded cells, a small part of the nodes
    count = F.coalesce("_blocks", F.lit(1).cast("long"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    left = placed.select(F.col("node").alias("i"), "x", "y", "z", *cell)
    left = _neighbourhood(left, F.lit(1)).withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"_d{a}") for a in "xyz"})
    left = left.join(blocks, cell, "left").withColumn("_l", F.pmod(F.xxhash64("i"), count)).withColumn("_r", every).drop("_blocks")
    right = placed.select(F.col("node").alias("j"), *[F.col(a).alias(f"p{a}") for a in "xyz"], *cell)
    right = right.join(blocks, cell, "left").withColumn("_r", F.pmod(F.xxhash64("j"), count)).withColumn("_l", every).drop("_blocks")
    d = chord(*[F.col(c) for c in ("x", "y", "z", "px", "py", "pz")])
    pairs = left.join(right, [*cell, "_l", "_r"]).where(F.col("i") != F.col("j")).select("i", "j", d.alias("d"))
    return pairs.where(F.col("d") <= F.lit(float(radius)))


# --- weights and statistics ----------------------------------------------------------------------

KERNELS = {
    "gaussian": lambda u: F.exp(-u * u),
    "taylor1": lambda u: 1.0 / (1.0 + u * u),
    "taylor2": lambda u: 1.0 / (1.0 + u * u + u * u * u * u / 2.0),
    "taylor3": lambda u: 1.0 / (1.0 + u * u + u * u * u * u / 2.0 + u * u * u * u * u * u / 6.0),
}


def symmetrise(edges: DataFrame, value: str = "w") -> DataFrame:
    """Both directions of every edge; the larger value where both exist."""
    both = edges.select("i", "j", value).unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), value))
    return both.groupBy("i", "j").agg(F.max(value).alias(value))


def edge_weights(edges: DataFrame, kernel: str = "gaussian", width: float | None = None) -> DataFrame:
    """Symmetric weights ``kernel(d / width)``; the default width is the mean edge length."""
    scale = F.lit(float(width)) if width is not None else edges.agg(F.avg("d")).scalar()
    return symmetrise(edges.select("i", "j", KERNELS[kernel](F.col("d") / scale).alias("w")))


def degree_stats(edges: DataFrame, weight: str = "w", length: str = "d") -> DataFrame:
    """Degree, weighted degree and mean, median and maximal edge length per node."""
    sums = edges.groupBy("i").agg(F.count(F.lit(1)).alias("degree"), F.sum(weight).alias("weighted_degree"),
                                  F.avg(length).alias("mean_length"), F.max(length).alias("max_length"))
    return sums.join(exact_quantiles(edges, ["i"], length, {"median_length": 0.5}), "i")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("w").alias("deg"))


def _with_degrees(edges: DataFrame, both: bool) -> DataFrame:
    deg = degrees(edges)
    out = edges.join(deg.withColumnRenamed("deg", "_di"), "i")
    return out.join(deg.select(F.col("i").alias("j"), F.col("deg").alias("_dj")), "j") if both else out


def laplacian(edges: DataFrame, kind: str = "combinatorial") -> DataFrame:
    """``combinatorial`` D - W, ``normalized`` I - D^-1/2 W D^-1/2 or ``random_walk`` I - D^-1 W, diagonal included."""
    if kind == "combinatorial":
        off = edges.select("i", "j", (-F.col("w")).alias("w"))
        diagonal = degrees(edges).select("i", F.col("i").alias("j"), F.col("deg").alias("w"))
    elif kind == "normalized":
        off = _with_degrees(edges, True).select("i", "j", (-safe_div(F.col("w"), F.sqrt("_di") * F.sqrt("_dj"))).alias("w"))
        diagonal = degrees(edges).select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    elif kind == "random_walk":
        off = _with_degrees(edges, False).select("i", "j", (-safe_div(F.col("w"), F.col("_di"))).alias("w"))
        diagonal = degrees(edges).select("i", F.col("i").alias("j"), F.lit(1.0).alias("w"))
    else:
        raise ValueError(f"unknown laplacian {kind!r}")
    return off.unionByName(diagonal)


def density_invariant(edges: DataFrame) -> DataFrame:
    """Weights divided by the degrees of both ends."""
    return _with_degrees(edges, True).select("i", "j", safe_div(F.col("w"), F.col("_di") * F.col("_dj")).alias("w"))


def cotan_laplacian(vertices: DataFrame, faces: DataFrame, inverse_mass: bool = False) -> tuple[DataFrame, DataFrame]:
    """Mesh Laplacian (i, j, w) and lumped mass (i, mass) of triangles (v0, v1, v2) over (node, x, y, z).

    Each corner gives half its cotangent to the opposite edge and, to its own
    mass, the part of the triangle nearest to it: the Voronoi area, or half and
    a quarter of a triangle with an obtuse angle there or elsewhere.  The faces are
    counted first: a task gets at most about ``FACES_A_TASK``, of which it makes twelve entries each.
    """
    tri, tasks = faces, max(1, math.ceil(faces.count() / FACES_A_TASK))
    for c in (0, 1, 2):
        tri = tri.repartition(tasks, f"v{c}").join(vertices.select(F.col("node").alias(f"v{c}"), *[F.col(a).alias(f"{a}{c}") for a in "xyz"]), f"v{c}")

    def corner(a: int, b: int, c: int) -> Column:
        """Cotangent at a with the edge (b, c) opposite."""
        u = [F.col(f"{s}{b}") - F.col(f"{s}{a}") for s in "xyz"]
        v = [F.col(f"{s}{c}") - F.col(f"{s}{a}") for s in "xyz"]
        dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
        cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        norm = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2])
        uu, vv = (w[0] * w[0] + w[1] * w[1] + w[2] * w[2] for w in (u, v))
        nearest = (F.when(dot < 0, norm / 4.0).when((uu < dot) | (vv < dot), norm / 8.0)
                   .otherwise(safe_div(uu * (vv - dot) + vv * (uu - dot), norm) / 8.0))
        return F.struct(F.col(f"v{a}").alias("own"), F.col(f"v{b}").alias("p"), F.col(f"v{c}").alias("q"),
                        (safe_div(dot, norm) / 2.0).alias("half_cot"), nearest.alias("part"))

    corners = tri.select(F.explode(F.array(corner(0, 1, 2), corner(1, 2, 0), corner(2, 0, 1))).alias("_c")).select("_c.*")
    mass = corners.groupBy(F.col("own").alias("i")).agg(F.sum("part").alias("mass"))
    entry = lambda i, j, sign: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (F.lit(sign) * F.col("half_cot")).alias("w"))
    entries = F.explode(F.array(entry("p", "q", -1.0), entry("q", "p", -1.0), entry("p", "p", 1.0), entry("q", "q", 1.0)))
    lap = corners.select(entries.alias("_e")).select("_e.*").groupBy("i", "j").agg(F.sum("w").alias("w"))
    if inverse_mass:
        lap = lap.join(mass, "i").select("i", "j", safe_div(F.col("w"), F.col("mass")).alias("w"))
    return lap, mass


# --- spectra and filters ---------------------------------------------------------------------------


def _matrix(lap: DataFrame) -> DataFrame:
    return lap.select(F.col("i").alias("dst"), F.col("j").alias("src"), "w")


def krylov_gram(lap: DataFrame, steps: int) -> tuple[float, DataFrame]:
    """A bound g on the spectrum and the one-row Gram matrix (columns ``g_<a>_<b>``) of Chebyshev vectors.

    The vectors are T_k(2 L / g - I) applied to one start vector; g is the
    largest absolute row sum of L.
    """
    lap = cut_lineage(lap)
    bound = lap.groupBy("i").agg(F.sum(F.abs("w")).alias("_r")).agg(F.max("_r")).first()[0]
    start = lap.select(F.col("i").alias("node")).distinct().select(
        "node", (F.lit(1.0) + F.pmod(F.col("node") * 7, F.lit(11)) / 16.0 - F.pmod(F.col("node"), F.lit(2)) * 2.0).alias("v"))
    basis = chebyshev_basis(rescale(lap, bound), start, ["v"], steps + 1)
    wide = basis.groupBy("node").pivot("k", list(range(steps + 1))).agg(F.first("v"))
    dots = [F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")).alias(f"g_{a}_{b}")
            for a in range(steps + 1) for b in range(a, steps + 1)]
    return bound, wide.agg(*dots)


def lmax(lap: DataFrame, steps: int = 10, tol: float = 5e-3) -> float:
    """Upper estimate of the largest eigenvalue of a symmetric Laplacian.

    Rayleigh-Ritz on a small Krylov space: the matrix products and scalar
    products run on the cluster, only about steps^2 / 2 sums come back.  The Ritz
    value is raised by twice the tolerance, or by the norm of its residual where
    the space was too small to reach the tolerance.
    """
    bound, gram_row = krylov_gram(lap, steps)
    row = gram_row.first()
    full = np.array([[row[f"g_{min(a, b)}_{max(a, b)}"] for b in range(steps + 1)] for a in range(steps + 1)])
    # The scaled operator S in terms of the vectors: S T_0 = T_1, S T_k = (T_{k+1} + T_{k-1}) / 2.
    shift = np.zeros((steps, steps + 1))
    shift[0, 1] = 1.0
    for k in range(1, steps):
        shift[k, k - 1] = shift[k, k + 1] = 0.5
    gram, projected = full[:steps, :steps], (shift @ full)[:, :steps]
    values, vectors = np.linalg.eigh(gram)
    keep = values > values[-1] * 1e-12
    inverse_root = vectors[:, keep] / np.sqrt(values[keep])
    ritz, small = np.linalg.eigh(inverse_root.T @ ((projected + projected.T) / 2.0) @ inverse_root)
    top = inverse_root @ small[:, -1]
    gap = shift.T @ top - ritz[-1] * np.append(top, 0.0)
    residual = math.sqrt(max(gap @ full @ gap, 0.0))
    estimate = (ritz[-1] + 1.0) * bound / 2.0
    return float(max(estimate * (1.0 + 2.0 * tol), estimate + residual * bound / 2.0))


def mass_krylov_gram(lap: DataFrame, mass: DataFrame, steps: int) -> tuple[float, DataFrame]:
    """A bound g on the spectrum of M^-1 L and one row of products of its Chebyshev vectors: ``m_<a>_<b>`` weighted by the mass, ``l_<a>_<b>`` by L.

    ``lap`` (i, j, w) is symmetric and ``mass`` (i, mass) positive.  The vectors are T_k(2 A / g - I) of A = M^-1 L, which is no symmetric matrix
    but a symmetric operator in the inner product <x, y> = sum(mass x y), where <x, A y> is the plain product of x with L y.
    """
    lap, mass = cut_lineage(lap), cut_lineage(mass)
    operator = cut_lineage(lap.join(mass, "i").select("i", "j", safe_div(F.col("w"), F.col("mass")).alias("w")))
    bound = operator.groupBy("i").agg(F.sum(F.abs("w")).alias("_r")).agg(F.max("_r")).first()[0]
    start = mass.select(F.col("i").alias("node"), (F.lit(1.0) + F.pmod(F.col("i") * 7, F.lit(11)) / 16.0 - F.pmod(F.col("i"), F.lit(2)) * 2.0).alias("v"))
    basis = chebyshev_basis(rescale(operator, bound), start, ["v"], steps)
    columns = [f"v{k}" for k in range(steps)]
    wide = cut_lineage(basis.groupBy("node").pivot("k", list(range(steps))).agg(F.first("v")).toDF("node", *columns))
    pairs = [(a, b) for a in range(steps) for b in range(a, steps)]
    ahead = spmm(_matrix(lap), wide, columns).withColumnsRenamed({c: f"l{c}" for c in columns})
    rows = wide.join(mass.withColumnRenamed("i", "node"), "node").join(ahead, "node")
    return bound, rows.agg(*[F.sum(F.col("mass") * F.col(f"v{a}") * F.col(f"v{b}")).alias(f"m_{a}_{b}") for a, b in pairs],
                           *[F.sum(F.col(f"v{a}") * F.col(f"lv{b}")).alias(f"l_{a}_{b}") for a, b in pairs])


def lmax_mass(lap: DataFrame, mass: DataFrame, steps: int = 12, tol: float = 5e-3) -> float:
    """Upper estimate of the largest eigenvalue of M^-1 L, for the Laplacian and lumped mass of a mesh.

    Rayleigh-Ritz in the mass inner product: of all vectors in a small Krylov space, the one with the largest x'Lx / x'Mx.  Only about steps^2
    sums come back to the driver.  The value is raised by twice the tolerance, as in :func:`lmax`, and never above the bound by row sums.
    """
    bound, products = mass_krylov_gram(lap, mass, steps)
    row = products.first()
    gram, stiff = (np.array([[row[f"{c}_{min(a, b)}_{max(a, b)}"] for b in range(steps)] for a in range(steps)]) for c in "ml")
    values, vectors = np.linalg.eigh(gram)
    keep = values > values[-1] * 1e-12
    inverse_root = vectors[:, keep] / np.sqrt(values[keep])
    ritz = np.linalg.eigvalsh(inverse_root.T @ stiff @ inverse_root)
    return float(min(ritz[-1] * (1.0 + 2.0 * tol), bound))


def rescale(lap: DataFrame, largest: float | Column, scale: float = 1.0) -> DataFrame:
    """``2 * scale / lmax * L - I``."""
    top = largest if isinstance(largest, Column) else F.lit(float(largest))
    scaled = lap.select("i", "j", (F.col("w") * (2.0 * scale) / top - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)).alias("w"))
    bare = lap.groupBy("i").agg(F.max(F.col("i") == F.col("j")).alias("_d")).where(~F.col("_d"))
    return scaled.unionByName(bare.select("i", F.col("i").alias("j"), F.lit(-1.0).alias("w")))


def chebyshev_basis(lap: DataFrame, field: DataFrame, values: Sequence[str], order: int, keys: Sequence[str] = ()) -> DataFrame:
    """T_0 .. T_{order-1} of the Laplacian applied to fields: (node, <keys>, k, <values>)."""
    matrix = _matrix(cut_lineage(lap) if order > 2 else lap)
    terms = [field.select("node", *keys, *values)]
    if order > 1:
        first = spmm(matrix, terms[0], values, keys)
        terms.append(cut_lineage(first) if order > 2 else first)
    for _ in range(2, order):
        ahead = spmm(matrix, terms[-1], values, keys)
        before = terms[-2].select("node", *keys, *[F.col(v).alias(f"_b_{v}") for v in values])
        joined = ahead.join(before, ["node", *keys], "full")
        terms.append(joined.select("node", *keys, *[
            (2.0 * F.coalesce(v, F.lit(0.0)) - F.coalesce(f"_b_{v}", F.lit(0.0))).alias(v) for v in values]))
        if len(terms) < order:
            terms[-1] = cut_lineage(terms[-1])
    out = terms[0].withColumn("k", F.lit(0))
    for k, term in enumerate(terms[1:], 1):
        out = out.unionByName(term.withColumn("k", F.lit(k)))
    return out.select("node", *keys, "k", *values)


def apply_mixing(basis: DataFrame, weights: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Linear combination over features and orders with a given table (feature, k, output, w)."""
    long = basis.unpivot(["node", *keys, "k"], list(values), "feature", "_x")
    return (long.join(weights, ["feature", "k"]).groupBy("node", *keys, "output")
            .agg(F.sum(F.col("_x") * F.col("w")).alias("value")))


def reach(edges: DataFrame, hops: int) -> DataFrame:
    """One row: node pairs (a node reaches itself) within ``hops`` steps and their share of all pairs.

    The work follows the number of pairs reached, which is what is counted.
    """
    nodes = edges.select("i").unionByName(edges.select(F.col("j").alias("i"))).distinct()
    n = nodes.agg(F.count(F.lit(1))).scalar()
    loops = nodes.select("i", F.col("i").alias("j"))
    step = edges.select("i", "j").unionByName(loops).distinct()
    pairs = loops
    for _ in range(hops):
        ahead = step.select(F.col("i").alias("j"), F.col("j").alias("_to"))
        pairs = pairs.join(ahead, "j").select("i", F.col("_to").alias("j")).distinct()
    return pairs.agg(F.count(F.lit(1)).alias("pairs")).select(
        "pairs", (F.col("pairs").cast("double") / (n.cast("double") * n.cast("double"))).alias("share"))


def reach_sketched(edges: DataFrame, hops: int, lg_k: int = 12) -> DataFrame:
    """(node, reached): estimate of how many nodes each node reaches within ``hops`` steps, itself included.

    A node's set is a HyperLogLog sketch of at most 2^lg_k registers.  Each step sends the sketches along the edges and unites them where they
    arrive, so the work is hops x edges whatever the number of pairs reached; the relative error is about 1.04 / 2^(lg_k / 2).
    """
    step = cut_lineage(edges.select("i", "j").unionByName(edges.select("i", F.col("i").alias("j"))).unionByName(edges.select(F.col("j").alias("i"), "j")).distinct())
    if hops == 0:
        return step.select(F.col("i").alias("node")).distinct().withColumn("reached", F.lit(1).cast("long"))
    sketches = step.groupBy("i").agg(F.hll_sketch_agg("j", lg_k).alias("s"))
    for _ in range(1, hops):
        sketches = step.join(cut_lineage(sketches).withColumnRenamed("i", "j"), "j").groupBy("i").agg(F.hll_union_agg("s", False).alias("s"))
    return sketches.select(F.col("i").alias("node"), F.hll_sketch_estimate("s").alias("reached"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins between the extremes (the last bin is closed)."""
    ends = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("_e")).scalar()
    width = (ends["hi"] - ends["lo"]) / float(bins)
    number = F.least(F.floor(safe_div(F.col(column) - ends["lo"], width)), F.lit(bins - 1)).cast("long")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.coalesce(number, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select(
        "bin", (ends["lo"] + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))
