"""Sparse-matrix remapping, pooling and stencils.

A matrix is an edge table (dst, src, w).  Fields are (node, <keys>, <values>)
tables; ``keys`` such as time ride along, and all value columns share one join
and one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..functions.sphere import cell_area
from .grids import _int_div

SLIVER_DEG = 1e-9
WEIGHTS_A_TASK = 25_000


def overlap_weights(src_cells: DataFrame, dst_cells: DataFrame, split: int = 4096) -> DataFrame:
    """Overlap areas of the cells of two rectilinear grids: (dst, src, w).

    Binned range join by size class: a cell's class is the power of two that holds its width, for each axis.  Two classes meet in bins as wide as
    the wider one, so a cell touches two or three bins an axis for each class of the other grid, however much the sizes differ.  Bins in which more
    than ``split`` cells of one class lie, under a cell that is much larger, are dealt over parts and the other side visits each part.  Pairs are
    kept in the first bin they share.
    """
    bounds = ("lat0", "lat1", "lon0", "lon1")

    def classed(cells: DataFrame, tag: str) -> DataFrame:
        out = cells.select(F.col("node").alias(tag), *[F.col(c).alias(f"{tag}_{c}") for c in bounds])
        for axis in ("lat", "lon"):
            width = F.col(f"{tag}_{axis}1") - F.col(f"{tag}_{axis}0")
            out = out.where(width > SLIVER_DEG).withColumn(f"{tag}_k{axis}", F.ceil(F.log2(width)).cast("int"))
        return out

    def binned(cells: DataFrame, tag: str, others: DataFrame, other: str) -> DataFrame:
        classes = others.agg(F.collect_set(F.struct(f"{other}_klat", f"{other}_klon"))).scalar()  # a few sizes, whatever the number of cells
        out = cells.withColumn("_o", F.explode(classes)).select("*", "_o.*").drop("_o")
        for axis in ("lat", "lon"):
            width = F.pow(F.lit(2.0), F.greatest(f"src_k{axis}", f"dst_k{axis}"))
            low, high = F.floor(F.col(f"{tag}_{axis}0") / width), F.floor(F.col(f"{tag}_{axis}1") / width)
            out = out.withColumn(f"{tag}_first_{axis}", low).withColumn(f"_{axis}", F.explode(F.sequence(low, high)))
        return out

    src, dst = classed(src_cells, "src"), classed(dst_cells, "dst")
    key = ["src_klat", "src_klon", "dst_klat", "dst_klon", "_lat", "_lon"]
    left, right = binned(src, "src", dst, "dst"), binned(dst, "dst", src, "src")

    def parts(rows: DataFrame, output: str) -> DataFrame:
        unequal = (F.col("src_klat") != F.col("dst_klat")) | (F.col("src_klon") != F.col("dst_klon"))  # of equal size, a few cells fill a bin
        return rows.where(unequal).groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / split).alias(output)).where(F.col(output) > 1)

    def dealt(rows: DataFrame, tag: str) -> DataFrame:
        other = "dst" if tag == "src" else "src"
        own, far = (F.coalesce(f"_n_{x}", F.lit(1)).cast("long") for x in (tag, other))
        out = rows.join(crowded, key, "left")
        return (out.withColumn(f"_p_{tag}", F.pmod(F.xxhash64(tag), own)).withColumn(f"_p_{other}", F.explode(F.sequence(F.lit(0).cast("long"), far - 1)))
                .drop("_n_src", "_n_dst"))

    crowded = parts(left, "_n_src").join(parts(right, "_n_dst"), key, "full")
    pairs = dealt(left, "src").join(dealt(right, "dst"), [*key, "_p_src", "_p_dst"])
    for axis in ("lat", "lon"):
        pairs = pairs.where(F.col(f"_{axis}") == F.greatest(f"src_first_{axis}", f"dst_first_{axis}"))
        pairs = pairs.withColumns({f"{axis}0": F.greatest(f"src_{axis}0", f"dst_{axis}0"),
                                   f"{axis}1": F.least(f"src_{axis}1", f"dst_{axis}1")})
        pairs = pairs.where(F.col(f"{axis}1") - F.col(f"{axis}0") > SLIVER_DEG)
    return pairs.select("dst", "src", cell_area("lat0", "lat1", "lon0", "lon1").alias("w"))


def _normalised(weights: DataFrame, by: str) -> DataFrame:
    totals = weights.groupBy(by).agg(F.sum("w").alias("_t"))
    return weights.join(totals, by).select("dst", "src", (F.col("w") / F.col("_t")).alias("w"))


def pool_matrix(weights: DataFrame) -> DataFrame:
    """Rows of the overlap areas normalised to one."""
    return _normalised(weights, "dst")


def unpool_matrix(weights: DataFrame) -> DataFrame:
    """Columns normalised to one and transposed: maps the coarse grid back."""
    return _normalised(weights, "src").select(F.col("src").alias("dst"), F.col("dst").alias("src"), "w")


def check_weights(weights: DataFrame, src_cells: DataFrame, dst_cells: DataFrame) -> DataFrame:
    """One row: largest deviation of row sums from destination areas, column sums from source
    areas, normalised row sums from one, and the total area."""
    def deviation(side: str, cells: DataFrame, output: str) -> Column:
        sums = weights.groupBy(F.col(side).alias("node")).agg(F.sum("w").alias("_s"))
        both = cells.select("node", "area").join(sums, "node", "full")
        gap = F.abs(F.coalesce("_s", F.lit(0.0)) - F.coalesce("area", F.lit(0.0)))
        return both.agg(F.max(gap)).scalar().alias(output)

    rows = pool_matrix(weights).groupBy("dst").agg(F.abs(F.sum("w") - 1.0).alias("_d"))
    return weights.agg(F.sum("w").alias("total_area")).select(
        "total_area", deviation("dst", dst_cells, "dst_deviation"), deviation("src", src_cells, "src_deviation"),
        rows.agg(F.max("_d")).scalar().alias("row_sum_deviation"))


def spmm(matrix: DataFrame, field: DataFrame, values: Sequence[str], keys: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Sparse matrix times fields: sum of w * value over sources, for every value column at once; the products in ``tasks`` tasks where that is given."""
    matrix = matrix if tasks is None else matrix.repartition(tasks, "src")
    joined = matrix.join(field.withColumnRenamed("node", "src"), "src")
    return joined.groupBy(F.col("dst").alias("node"), *keys).agg(
        *[F.sum(F.col("w") * F.col(v)).alias(v) for v in values])


def remap(field: DataFrame, weights: DataFrame, values: Sequence[str], keys: Sequence[str] = (),
          normalization: str = "fracarea", dst_cells: DataFrame | None = None) -> DataFrame:
    """Conservative remapping with overlap areas.

    ``fracarea`` divides by the covered part of the destination cell,
    ``destarea`` by its whole area (``dst_cells`` needed).
    """
    if normalization not in ("fracarea", "destarea"):
        raise ValueError(f"unknown normalization {normalization!r}")
    joined = weights.join(field.withColumnRenamed("node", "src"), "src")
    sums = []
    for v in values:
        sums += [F.sum(F.col("w") * F.col(v)).alias(f"_s_{v}"),
                 F.sum(F.when(F.col(v).isNotNull(), F.col("w"))).alias(f"_w_{v}")]
    agg = joined.groupBy(F.col("dst").alias("node"), *keys).agg(*sums)
    if normalization == "fracarea":
        return agg.select("node", *keys, *[safe_div(F.col(f"_s_{v}"), F.col(f"_w_{v}")).alias(v) for v in values])
    if dst_cells is None:
        raise ValueError("destarea needs the destination cells")
    return agg.join(dst_cells.select("node", "area"), "node").select(
        "node", *keys, *[safe_div(F.col(f"_s_{v}"), F.col("area")).alias(v) for v in values])


def _tied(c: Column) -> Column:
    """Weights that differ by rounding noise only compare as equal: 24 significant bits, whatever the unit."""
    return c.cast("float")


def remap_largest_area(field: DataFrame, weights: DataFrame, category: str, keys: Sequence[str] = ()) -> DataFrame:
    """Category with the largest share of each destination cell; ties to the smallest category."""
    pool = pool_matrix(weights)
    shares = (pool.join(field.withColumnRenamed("node", "src"), "src")
              .groupBy(F.col("dst").alias("node"), *keys, category).agg(F.sum("w").alias("_w")))
    best = F.min(F.struct((-_tied(F.col("_w"))).alias("w"), F.col(category).alias("c")))
    return shares.groupBy("node", *keys).agg(best.alias("_b")).select("node", *keys, F.col("_b.c").alias(category))


def compose(m2: DataFrame, m1: DataFrame) -> DataFrame:
    """Product of two sparse matrices (first ``m1``, then ``m2``)."""
    left = m2.select("dst", F.col("src").alias("_mid"), F.col("w").alias("_w2"))
    right = m1.select(F.col("dst").alias("_mid"), "src", F.col("w").alias("_w1"))
    return left.join(right, "_mid").groupBy("dst", "src").agg(F.sum(F.col("_w2") * F.col("_w1")).alias("w"))


def inversion_error(pool: DataFrame, unpool: DataFrame) -> DataFrame:
    """``1 - diag(pool . unpool)`` per coarse node."""
    back = unpool.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("_u"))
    both = pool.join(back, ["dst", "src"], "left")
    return both.groupBy(F.col("dst").alias("node")).agg(
        (1.0 - F.coalesce(F.sum(F.col("w") * F.col("_u")), F.lit(0.0))).alias("error"))


def coarsen_laplacian(pool: DataFrame, laplacian: DataFrame, unpool: DataFrame) -> DataFrame:
    """``pool . L . unpool`` with L as (i, j, w)."""
    l_matrix = laplacian.select(F.col("i").alias("dst"), F.col("j").alias("src"), "w")
    return compose(compose(pool, l_matrix), unpool).select(F.col("dst").alias("i"), F.col("src").alias("j"), "w")


# --- general pooling over a matrix --------------------------------------------------------------


def _tasks(weights: DataFrame) -> int:
    """Tasks for the products of a matrix and a field with further keys: a field has many rows a source, so they follow the (counted) weights."""
    return max(1, math.ceil(weights.count() / WEIGHTS_A_TASK))


def general_avg_pool(field: DataFrame, weights: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return spmm(pool_matrix(weights), field, values, keys, _tasks(weights))


def general_avg_unpool(field: DataFrame, weights: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return spmm(unpool_matrix(weights), field, values, keys, _tasks(weights))


def largest_source(weights: DataFrame) -> DataFrame:
    """(dst, src) of the source with the largest weight; ties to the smallest source."""
    pool = pool_matrix(weights)
    best = F.min(F.struct((-_tied(F.col("w"))).alias("w"), F.col("src").alias("src")))
    return pool.groupBy("dst").agg(best.alias("_b")).select("dst", F.col("_b.src").alias("src"))


def max_area_pool(field: DataFrame, weights: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Value of the source that covers most of each destination cell."""
    return (largest_source(weights).join(field.withColumnRenamed("node", "src"), "src")
            .select(F.col("dst").alias("node"), *keys, *values))


def _scatter(pooled: DataFrame, weights: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Write pooled values (node, index, value) to their source, zero on every other source of the matrix.

    Where two destinations chose the same source the largest destination wins.
    """
    pairs = weights.select(F.col("dst"), F.col("src"))
    sent = pairs.join(pooled.withColumnRenamed("node", "dst"), "dst")
    winner = F.max_by(value, F.when(F.col("src") == F.col("index"), F.col("dst")))
    return sent.groupBy(F.col("src").alias("node"), *keys).agg(F.coalesce(winner, F.lit(0.0)).alias(value))


def max_area_unpool(pooled: DataFrame, weights: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Put each pooled value back at the source it covers most."""
    chosen = largest_source(weights).select(F.col("dst").alias("node"), F.col("src").alias("index"))
    return _scatter(pooled.join(chosen, "node"), weights, value, keys)


def max_value_pool(field: DataFrame, weights: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Raw value and id of the source with the largest weight * value; ties to the smallest source."""
    joined = pool_matrix(weights).join(field.withColumnRenamed("node", "src"), "src")
    best = F.min(F.struct((-_tied(F.col("w") * F.col(value))).alias("r"), F.col("src").alias("src"), F.col(value).alias("v")))
    return (joined.where(F.col(value).isNotNull()).groupBy(F.col("dst").alias("node"), *keys).agg(best.alias("_b"))
            .select("node", *keys, F.col("_b.v").alias(value), F.col("_b.src").alias("index")))


def max_value_unpool(pooled: DataFrame, weights: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Write pooled values to their remembered source, zero elsewhere."""
    return _scatter(pooled, weights, value, keys)


# --- nested and block pooling ---------------------------------------------------------------------


def nested_avg_pool(df: DataFrame, k: int, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of k consecutive nested children."""
    return df.groupBy(_int_div(F.col("node"), k).alias("node"), *keys).agg(*[F.avg(v).alias(v) for v in values])


def _max_with_index(value: str, node: str = "node") -> Column:
    return F.min(F.struct((-F.col(value)).alias("r"), F.col(node).alias("index")))


def nested_max_pool(df: DataFrame, k: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Maximum of k consecutive children and the child that holds it (smallest on ties)."""
    return (df.where(F.col(value).isNotNull()).groupBy(_int_div(F.col("node"), k).alias("parent"), *keys)
            .agg(_max_with_index(value).alias("_b"))
            .select(F.col("parent").alias("node"), *keys, (-F.col("_b.r")).alias(value), F.col("_b.index").alias("index")))


def _children(df: DataFrame, k: int) -> DataFrame:
    first = F.col("node") * k
    return df.withColumn("_child", F.explode(F.sequence(first, first + (k - 1))))


def nested_avg_unpool(df: DataFrame, k: int, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Repeat the parent value on its k children."""
    return _children(df, k).select(F.col("_child").alias("node"), *keys, *values)


def nested_max_unpool(df: DataFrame, k: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Parent value on the remembered child, zero on the others."""
    hit = F.when(F.col("_child") == F.col("index"), F.col(value)).otherwise(F.lit(0.0))
    return _children(df, k).select(F.col("_child").alias("node"), *keys, hit.alias(value))


def _blocks(df: DataFrame, nlat: int, nlon: int, s: int) -> DataFrame:
    """Rows of complete s-by-s blocks with the block's flattened index."""
    bi, bj = _int_div(_int_div(F.col("node"), nlon), s), _int_div(F.pmod(F.col("node"), F.lit(nlon)), s)
    inside = (bi < nlat // s) & (bj < nlon // s)
    return df.where(inside).withColumn("parent", bi * (nlon // s) + bj)


def grid_avg_pool(df: DataFrame, nlat: int, nlon: int, s: int, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean of s-by-s blocks; incomplete blocks at the edges are dropped."""
    return (_blocks(df, nlat, nlon, s).groupBy(F.col("parent").alias("node"), *keys)
            .agg(*[F.avg(v).alias(v) for v in values]))


def grid_max_pool(df: DataFrame, nlat: int, nlon: int, s: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Maximum of s-by-s blocks and the cell that holds it (smallest on ties)."""
    return (_blocks(df, nlat, nlon, s).where(F.col(value).isNotNull()).groupBy("parent", *keys)
            .agg(_max_with_index(value).alias("_b"))
            .select(F.col("parent").alias("node"), *keys, (-F.col("_b.r")).alias(value), F.col("_b.index").alias("index")))


def _block_cells(df: DataFrame, nlat: int, nlon: int, s: int) -> DataFrame:
    """Fine cells of each coarse block; the fine grid has the original number of columns."""
    coarse = nlon // s
    bi, bj = _int_div(F.col("node"), coarse), F.pmod(F.col("node"), F.lit(coarse))
    offsets = F.explode(F.array(*[F.lit(int(a * nlon + b)).cast("long") for a in range(s) for b in range(s)]))
    return df.withColumn("_origin", bi * (s * nlon) + bj * s).withColumn("_o", offsets).withColumn(
        "_cell", F.col("_origin") + F.col("_o"))


def grid_avg_unpool(df: DataFrame, nlat: int, nlon: int, s: int, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Nearest upsampling: repeat the value over its block."""
    return _block_cells(df, nlat, nlon, s).select(F.col("_cell").alias("node"), *keys, *values)


def grid_max_unpool(df: DataFrame, nlat: int, nlon: int, s: int, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Value on the remembered cell, zero on the rest of the block."""
    hit = F.when(F.col("_cell") == F.col("index"), F.col(value)).otherwise(F.lit(0.0))
    return _block_cells(df, nlat, nlon, s).select(F.col("_cell").alias("node"), *keys, hit.alias(value))


def stencil(df: DataFrame, kernel: Mapping[tuple[int, int], float], nlat: int, nlon: int, values: Sequence[str],
            keys: Sequence[str] = (), periodic_lon: bool = True) -> DataFrame:
    """2-D convolution with a given kernel {(di, dj): w}: y[i,j] = sum w * x[i+di, j+dj].

    Longitude wraps (unless told not to), latitude is zero-padded.  Each cell
    sends its value to the cells it contributes to; one aggregation adds up.
    """
    taps = F.explode(F.array(*[F.struct(F.lit(int(di)).alias("di"), F.lit(int(dj)).alias("dj"), F.lit(float(w)).alias("w"))
                               for (di, dj), w in kernel.items()]))
    sent = df.withColumn("_t", taps)
    i = _int_div(F.col("node"), nlon) - F.col("_t.di")
    j = F.pmod(F.col("node"), F.lit(nlon)) - F.col("_t.dj")
    inside = (i >= 0) & (i < nlat)
    if periodic_lon:
        j = F.pmod(j, F.lit(nlon))
    else:
        inside = inside & (j >= 0) & (j < nlon)
    return (sent.where(inside).withColumn("_target", i * nlon + j).groupBy(F.col("_target").alias("node"), *keys)
            .agg(*[F.sum(F.col("_t.w") * F.col(v)).alias(v) for v in values]))
