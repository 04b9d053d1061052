"""Exact search for the largest integer inner products by best-first search in an M-tree.

Vectors of integers get one more coordinate that brings all of them to the same length, and queries a zero there: the largest inner product
becomes the smallest Euclidean distance, a metric.  The tree has paged nodes.  Its top page is the directory of blocks: each block holds
vectors around one routing object (a cell) whose distance to it lies in one interval.  A block is a tree of pages: entries of an inner page are
routing objects with covering radius, distance to the parent's routing object and child page; entries of a leaf are vectors with that distance.

A query first searches the block that fits it best, then all blocks that its k-th result so far does not exclude.  Inside a block pages are
taken best-first, and the triangle inequality on stored distances spares computing most others.  Pruning keeps a margin above rounding and
keeps ties; scores are exact integers.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, ship_package, written

SCALE = 1024
INT64 = np.iinfo(np.int64)
_RESULT = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Tree:
    """``page`` entries a page, about ``block`` vectors a block, more if there were over ``directory`` blocks; at most ``cells`` routing objects on top."""

    page: int = 128
    block: int = 4096
    directory: int = 65_536
    cells: int = 256
    sample: int = 2048  # rows (smallest hash) from which the cells' routing objects are chosen
    queries: int = 1000  # queries that meet a block at once


# --- integer vectors ---------------------------------------------------------------------------------

def packed(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers in the narrowest of two, four or eight bytes a component (floats beyond that)."""
    top = np.abs(x).max(axis=1)
    out: list[bytes] = [b""] * len(x)
    for dtype, rows in (("<i2", top < 2**15), ("<i4", (top >= 2**15) & (top < 2**31)), ("<f8", top >= 2**31)):
        for i, r in zip(np.flatnonzero(rows), x[rows].astype(dtype), strict=True):
            out[i] = r.tobytes()
    return out


def unpacked(raw: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(raw), dim))
    sizes = np.array([len(r) for r in raw])
    for size, dtype in ((2 * dim, "<i2"), (4 * dim, "<i4"), (8 * dim, "<f8")):
        rows = np.flatnonzero(sizes == size)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(raw[i] for i in rows), dtype).reshape(-1, dim)
    return out


def flat_bytes(x: np.ndarray) -> bytes:
    """All rows one after another, in one width."""
    dtype = next((d for d, top in (("<i2", 2**15), ("<i4", 2**31)) if np.abs(x).max() < top), "<f8")
    return x.astype(dtype).tobytes()


def from_flat(raw: bytes, rows: int, dim: int) -> np.ndarray:
    dtype = {2: "<i2", 4: "<i4", 8: "<f8"}[len(raw) // (rows * dim)]
    return np.frombuffer(raw, dtype).reshape(rows, dim).astype(np.float64)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows with ``q`` as 64-bit integers; what would leave them stays at their end."""
    if not len(x):
        return np.zeros(0, np.int64)
    if x.shape[1] * float(np.abs(x).max()) * float(np.abs(q).max()) < 2**53:
        return (x @ q).astype(np.int64)
    whole = [int(c) for c in q.tolist()]
    each = (sum(int(a) * b for a, b in zip(r, whole, strict=True)) for r in x.tolist())
    return np.array([min(max(s, INT64.min), INT64.max) for s in each], np.int64)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the coordinate that makes their squared length ``longest``."""
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))])


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def spread_out(points: np.ndarray, count: int) -> np.ndarray:
    """Indices of ``count`` points, each the farthest from those before it; fewer if the rest coincide with them."""
    chosen, far = [0], distances(points, points[0])
    while len(chosen) < min(count, len(points)):
        at = int(far.argmax())
        if far[at] <= 0:
            break
        chosen.append(at)
        far = np.minimum(far, distances(points, points[at]))
    return np.array(chosen)


# --- one block ---------------------------------------------------------------------------------------

@dataclass
class Page:
    """``refs`` are ids of vectors in a leaf and child pages else; ``parent`` are distances to the routing object of the page."""

    leaf: bool
    refs: np.ndarray
    points: np.ndarray
    parent: np.ndarray
    radius: np.ndarray


def build(ids: np.ndarray, points: np.ndarray, size: int) -> list[Page]:
    """Pages of a tree over lifted points, the root first; its routing object is the first point."""
    pages: list[Page | None] = [None]
    todo = [(0, np.arange(len(ids)), points[0])]
    none = np.zeros(0)
    while todo:
        page, rows, centre = todo.pop()
        far = distances(points[rows], centre)
        if len(rows) <= size:
            pages[page] = Page(True, ids[rows], points[rows], far, none)
            continue
        fan = min(size, -(-len(rows) // size))
        seeds = rows[spread_out(points[rows], fan)]
        best, near = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for k, seed in enumerate(seeds):
            d = distances(points[rows], points[seed])
            near[d < best], best = k, np.minimum(best, d)
        parts = [rows[near == k] for k in range(len(seeds))]
        if max(len(p) for p in parts) * 4 > len(rows) * 3:  # equal or lopsided points: even slices by distance, so the tree stays shallow
            parts = np.array_split(rows[np.argsort(far, kind="stable")], fan)
            seeds = np.array([p[len(p) // 2] for p in parts])
        children = np.arange(len(pages), len(pages) + len(parts))
        pages += [None] * len(parts)
        radius = np.array([distances(points[p], points[s]).max() for p, s in zip(parts, seeds, strict=True)])
        pages[page] = Page(False, children, points[seeds], distances(points[seeds], centre), radius)
        todo += [(int(c), p, points[s]) for c, p, s in zip(children, parts, seeds, strict=True)]
    return pages


class Block:
    """Best-first search over the pages of one block."""

    def __init__(self, pages: list[Page], longest: float):
        self.pages, self.longest, self.computed = pages, longest, 0

    def search(self, own: int | None, q: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(-score, id) of the ``k`` best, best first; below ``floor``, a score some ``k`` others reach already, nothing is looked for."""
        square = float(q @ q)
        slack = 1e-6 * (np.sqrt(square) + np.sqrt(self.longest) + 1)
        reach = lambda s: np.sqrt(max(0.0, square + self.longest - 2.0 * s)) + slack
        limit = np.inf if floor is None else reach(floor)
        best: list[tuple[int, int]] = []
        heap: list[tuple[float, int, float | None]] = [(0.0, 0, None)]  # bound, page, distance of the query to its routing object
        while heap:
            bound, at, from_parent = heapq.heappop(heap)
            if bound > limit:
                break
            page = self.pages[at]
            alive = np.arange(len(page.refs))
            if from_parent is not None:
                gap = np.abs(from_parent - page.parent)
                alive = np.flatnonzero((gap if page.leaf else gap - page.radius) <= limit)
            if not len(alive):
                continue
            self.computed += len(alive)
            if page.leaf:
                score, refs = exact_scores(page.points[alive, :-1], q), page.refs[alive]
                if len(best) >= k:
                    good = score >= -best[-1][0]
                    score, refs = score[good], refs[good]
                if len(score) > k:
                    good = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]  # k and one more: the query itself may be there
                    score, refs = score[good], refs[good]
                best = sorted([*best, *((-int(s), int(r)) for s, r in zip(score, refs, strict=True) if r != own)])[:k]
                if len(best) == k:
                    limit = min(limit, reach(-best[-1][0]))
            else:
                dot = page.points[alive, :-1] @ q
                far = np.sqrt(np.maximum(0.0, square + self.longest - 2.0 * dot))
                low = np.maximum(bound, far - page.radius[alive])
                for i in np.flatnonzero(low <= limit):
                    heapq.heappush(heap, (float(low[i]), int(page.refs[alive[i]]), float(far[i])))
        return best


# --- the table ---------------------------------------------------------------------------------------

def whole_numbers(df: DataFrame, vec: str, key: str) -> DataFrame:
    """(vec_id, dim, v, square): floor(1024 x) of each component, packed.

    Rows without id, null or empty vectors, and those with a null or non-finite component (also after scaling) take no part.
    """
    v = F.col(vec).cast("array<double>")
    out = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    out = out.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float("inf"))))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            flat = np.floor(SCALE * np.asarray(column.flatten())) + 0.0  # no negative zero: equal vectors have equal bytes
            size = np.asarray(column.value_lengths())
            ends = np.cumsum(size)
            raw, square = [b""] * len(size), np.zeros(len(size))
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                square[rows] = np.minimum((x * x).sum(axis=1), 1e300)
                for i, r in zip(rows, packed(x), strict=True):
                    raw[i] = r
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.array(raw, pa.binary()), pa.array(square)], names=["vec_id", "dim", "v", "square"])

    return out.mapInArrow(run, "vec_id long, dim int, v binary, square double")


def indexed(classes: DataFrame, dim: int, count: int, longest: float, spec: Tree) -> tuple[DataFrame, np.ndarray, pd.DataFrame]:
    """Pages of all blocks as a written table, the cells' routing objects, and the directory (block, cell, lo, hi)."""
    size = max(spec.block, -(-count // spec.directory))
    some = unpacked([bytes(r["v"]) for r in bounded_sample(classes.select("vec_id", "v"), spec.sample, "vec_id").collect()], dim)
    some = lifted(some, longest)
    pivots = some[spread_out(some, min(spec.cells, -(-count // size)))]

    def place(batches):
        for batch in batches:
            points = lifted(unpacked(batch.column(1).to_pylist(), dim), longest)
            far = np.stack([distances(points, p) for p in pivots], axis=1)
            cell = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], names=["vec_id", "v", "cell", "far"])

    placed = classes.select("vec_id", "v").mapInArrow(place, "vec_id long, v binary, cell int, far double")
    blocks = -(-count // size)
    parts = max(1, min(blocks, 2 * classes.sparkSession.sparkContext.defaultParallelism), blocks // 16)
    ordered = placed.repartitionByRange(parts, "cell", "far", "vec_id").sortWithinPartitions("cell", "far", "vec_id")

    def paged(batches):
        number, base = 0, TaskContext.get().partitionId() << 32
        ids, raw, far, cell = [], [], [], None

        def flush():
            nonlocal number
            pages = build(np.array(ids, np.int64), lifted(unpacked(raw, dim), longest), spec.page)
            yield pa.RecordBatch.from_arrays([
                pa.array([base + number] * len(pages), pa.int64()), pa.array(range(len(pages)), pa.int32()), pa.array([cell] * len(pages), pa.int32()), pa.array([far[0]] * len(pages)), pa.array([far[-1]] * len(pages)),
                pa.array([p.leaf for p in pages]), pa.array([p.refs.astype("<i8").tobytes() for p in pages], pa.binary()), pa.array([flat_bytes(p.points[:, :-1]) for p in pages], pa.binary()),
                pa.array([p.parent.tobytes() for p in pages], pa.binary()), pa.array([p.radius.tobytes() for p in pages], pa.binary())], names=["block", "page", "cell", "lo", "hi", "leaf", "refs", "points", "parent", "radius"])
            number += 1

        for batch in batches:
            for i, v, c, d in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if ids and (c != cell or len(ids) >= size):
                    yield from flush()
                    ids, raw, far = [], [], []
                cell = c
                ids.append(i), raw.append(v), far.append(d)
        if ids:
            yield from flush()

    pages = written(ordered.mapInArrow(paged, "block long, page int, cell int, lo double, hi double, leaf boolean, refs binary, points binary, parent binary, radius binary"), "pages")
    # one row a block: `directory` of them, one more for each cell and partition
    return pages, pivots, pages.filter("page = 0").select("block", "cell", "lo", "hi").toPandas()


def _asked(queries: DataFrame, dim: int, longest: float, pivots: np.ndarray, directory: pd.DataFrame, first: bool) -> DataFrame:
    """(query_id, v, floor, block): the best block of each query, or all others that its k-th score so far (``floor``) leaves open."""
    block, cell, lo, hi = (directory[c].to_numpy() for c in ("block", "cell", "lo", "hi"))

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if not raw:
                continue
            q = unpacked(raw, dim)
            square = (q * q).sum(axis=1)
            far = np.sqrt(np.maximum(0.0, square[:, None] + longest - 2.0 * q @ pivots[:, :-1].T))
            row, hit = [], []
            for i, floor in enumerate(batch.column(2).to_pylist()):
                bound = np.maximum(lo - far[i, cell], far[i, cell] - hi)  # of each block, by its interval; below 0 inside
                best = int(np.lexsort((block, far[i, cell], np.maximum(bound, 0.0)))[0])
                if first:
                    found = np.array([best])
                else:
                    slack = 1e-6 * (np.sqrt(square[i]) + np.sqrt(longest) + 1)
                    limit = np.inf if floor is None else np.sqrt(max(0.0, square[i] + longest - 2.0 * floor)) + slack
                    found = np.flatnonzero(bound <= limit)
                    found = found[found != best]
                row.append(np.full(len(found), i)), hit.append(block[found])
            at = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(np.concatenate(hit))], names=["query_id", "v", "floor", "block"])

    return queries.select("query_id", "v", "floor").mapInArrow(run, "query_id long, v binary, floor long, block long")


def _searched(asked: DataFrame, pages: DataFrame, dim: int, longest: float, k: int, spec: Tree) -> DataFrame:
    """Results of the queries in the blocks they ask; the queries of a block are dealt over parts."""
    asked = written(asked, "asked")
    parts = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / spec.queries).cast("long").alias("parts"))
    left = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("query_id", "v"), F.col("parts"))).drop("parts")
    right = pages.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def work(queries: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(nodes):
            nodes = nodes.sort_values("page")
            tree = [Page(leaf, np.frombuffer(refs, "<i8"), lifted(from_flat(points, len(refs) // 8, dim), longest), np.frombuffer(parent, "<f8"), np.frombuffer(radius, "<f8"))
                    for leaf, refs, points, parent, radius in nodes[["leaf", "refs", "points", "parent", "radius"]].itertuples(index=False)]
            block = Block(tree, longest)
            vectors = unpacked([bytes(v) for v in queries["v"]], dim)
            for own, q, floor in zip(queries["query_id"], vectors, queries["floor"], strict=True):
                out += [(own, i, -s) for s, i in block.search(int(own), q, k, None if pd.isna(floor) else int(floor))]
        frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return frame.astype("int64")

    by = ["block", "part"]
    return left.groupBy(*by).cogroup(right.select(*by, "page", "leaf", "refs", "points", "parent", "radius").groupBy(*by)).applyInPandas(work, _RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # a query's rows: at most k for each block it searched
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(df: DataFrame, is_query, *, k: int = 10, spec: Tree | None = None, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest integer inner product for every row where ``is_query`` (a condition on ``vec_id``) holds.

    Exact.  A query's own id is no candidate; equal scores go by smaller id.  Rows that repeat with one id and vector count once; an id with
    several vectors counts with its best score.  Of rows with equal vectors only the k + 1 smallest ids can be among the results, so only those
    are filed.  Vectors that take no part: see `whole_numbers`; of vectors of several lengths the most frequent length takes part.  Scores
    beyond 64 bits stay at their end.  Empty tables, and tables without queries, give no rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    spec = spec or Tree()
    vectors = whole_numbers(df, vec, key)
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("longest")).orderBy(F.col("n").desc(), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, longest = sizes[0]["dim"], sizes[0]["longest"]
    vectors = vectors.filter(F.col("dim") == dim).select("vec_id", "v")
    distinct = vectors.distinct()  # combined before it travels
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))  # cut to k + 1 rows of a vector before the exchange, too
    classes = written(distinct.withColumn("_place", place).filter(F.col("_place") <= k + 1).drop("_place"), "classes")
    pages, pivots, directory = indexed(classes, dim, classes.count(), longest, spec)

    queries = vectors.filter(is_query).distinct().select(F.col("vec_id").alias("query_id"), "v", F.lit(None).cast("long").alias("floor"))
    queries = written(queries, "queries")
    near = written(_searched(_asked(queries, dim, longest, pivots, directory, True), pages, dim, longest, k, spec), "near")
    floors = _best(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("_floor"))
    open_ = queries.join(floors, "query_id", "left").select("query_id", "v", F.col("_floor").alias("floor"))
    rest = _searched(_asked(open_, dim, longest, pivots, directory, False), pages, dim, longest, k, spec)
    return _best(near.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


# Vectors of one length, as the tables hold them; HUGEINT products keep the sums exact.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
q AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(max(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM q)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
