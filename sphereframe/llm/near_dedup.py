"""Near duplicates by an LSH forest over MinHash signatures.

A document is the set of its distinct runs of ``width`` words.  Documents with equal sets are one class from the start, so copies cost
nothing.  Each tree of the forest sorts the classes by its own sequence of MinHash values, over range partitions: what shares a long common
prefix stands side by side.  A region is a stretch with one prefix, taken at the smallest depth at which it is not crowded, so the depth adapts
to each region; all its classes are candidates.  In regions that are crowded at the least depth, every class also meets its neighbours of longest
common prefix on both sides, up to the second depth, so a class without company deeper down ascends to them.  Such regions are large families, and
regions cut by a partition's border are treated like them: what is still apart there goes through an exact join on rare shingles
(`rare_pairs`), so no link is lost however many classes share a region.

Candidates go through an estimate from whole signatures, with a margin of over four standard deviations, and are confirmed on full sets.
First each class is confirmed against its most similar partners only; of the remaining candidates, those whose ends are already connected need
no confirmation.  Components come from star contraction.  Nothing is collected to the driver but counts, and the counters that order shingles.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import discard, map_texts, ship_package, slices, written

WORDS = 150_000  # words a worker remembers the hashes of
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


@dataclass(frozen=True)
class Forest:
    """``trees`` orders of ``levels[-1]`` MinHash values each; regions are looked at in the depths ``levels``."""

    trees: int = 16
    levels: tuple[int, ...] = (2, 3, 4, 6, 8)
    crowd: int = 32  # classes in a region beyond which it is followed to the next depth
    beside: int = 3  # neighbours met on each side in crowded regions
    counters: int = 1 << 16  # counters of the sketch that orders shingles by how common they are

    @property
    def values(self) -> int:
        return self.trees * self.levels[-1]

    def multipliers(self) -> np.ndarray:
        return np.random.default_rng(20).integers(0, 1 << 63, self.values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_hashes: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    new = set(words).difference(_hashes)
    if len(_hashes) + len(new) > WORDS:
        _hashes.clear()
        new = set(words)
    _hashes.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; fewer words are one run, no words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    run = min(width, len(words))
    out = np.full(len(h) - run + 1, np.uint64(run))
    for i in range(run):
        out = (out ^ (out >> np.uint64(31))) * _M[i % 4] + h[i:len(h) - run + 1 + i]
    out = (out ^ (out >> np.uint64(29))) * _M[4]
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash values (upper halves of the smallest products), in slices so that long texts need little memory."""
    best = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 2048):
        best = np.minimum(best, (multipliers[:, None] * hashes[None, lo:lo + 2048]).min(axis=1))
    return (best >> np.uint64(32)).astype("<u4")


def signatures(df: DataFrame, forest: Forest, width: int, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, set, sig, low): digest of the set, its signature and the lowest bytes of that, all null without words."""
    multipliers = forest.multipliers()

    def work(ids: list, texts: list) -> dict:
        def reduce(part: list[str]) -> list[tuple]:
            out = []
            for t in part:
                s = shingles(t, width)
                if not len(s):
                    out.append((0, None, None, None))
                    continue
                sig = signature(s, multipliers)
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.tobytes(), sig.astype(np.uint8).tobytes()))
            return out

        got = in_slices(texts, 4_000_000, reduce)
        return {"doc_id": ids, "n_shingles": [g[0] for g in got], "set": [g[1] for g in got], "sig": [g[2] for g in got], "low": [g[3] for g in got]}

    return map_texts(df, "doc_id long, n_shingles long, set binary, sig binary, low binary", work, text=text, key=key)


def tree_keys(classes: DataFrame, forest: Forest) -> DataFrame:
    """(id, n, key): the place of every class in every tree; keys are the tree's number and its MinHash values, and sort as bytes."""
    depth = forest.levels[-1]

    def run(batches):
        for batch in slices(batches, 2000):
            count = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(count, forest.trees, depth)
            whole = np.concatenate([np.broadcast_to(np.arange(forest.trees, dtype=np.uint32)[None, :, None], (count, forest.trees, 1)), sig], axis=2).astype(">u4")
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * depth + 4), count * forest.trees, [None, pa.py_buffer(whole.tobytes())]).cast(pa.binary())
            ids, n = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), forest.trees) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), keys], names=["id", "n", "key"])

    return classes.select("id", "n", "sig").mapInArrow(run, "id long, n long, key binary")


def neighbours(ids: np.ndarray, n: np.ndarray, keys: np.ndarray, forest: Forest, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of a sorted stretch of trees, and the rows whose depth-first region is crowded or may go on beyond the stretch.

    ``keys`` has a row for each class and tree: the tree and its values.
    """
    size = len(ids)
    same = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1) - 1  # common prefix of neighbours in values; -1 across trees
    place, group, crowded = np.full(size, -1), np.zeros(size, np.int64), None
    for k, level in enumerate(forest.levels):
        group = np.concatenate([[0], np.cumsum(same < level)])
        many = np.bincount(group)[group]
        fits = (place < 0) & (many <= forest.crowd)
        place[fits] = group[fits] * len(forest.levels) + k
        if crowded is None:
            first, crowded = group, many > forest.crowd
        if k <= 1:
            near = group
    at = np.arange(size)
    pairs = []
    for step in range(1, forest.crowd):
        left, right = at[:size - step], at[step:]
        meet = (place[left] == place[right]) & (place[left] >= 0)
        if step <= forest.beside:
            meet |= crowded[left] & (near[left] == near[right])
        meet &= (n[left] * percent <= n[right] * 100) & (n[right] * percent <= n[left] * 100)
        pairs.append(np.stack([ids[left[meet]], ids[right[meet]]]))
    both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    open_ = crowded | (first == first[0]) | (first == first[-1])
    return both.min(axis=0), both.max(axis=0), np.flatnonzero(open_)


def candidates(classes: DataFrame, forest: Forest, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of neighbours in some tree whose sizes allow the wanted similarity.

    Also (id, region) of the classes in regions that are crowded at the least depth or cut by a border, for `rare_pairs`.
    """
    rows = tree_keys(classes, forest)
    width = forest.levels[-1] + 1
    parts = max(classes.sparkSession.sparkContext.defaultParallelism, -(-classes.count() * forest.trees // 100_000))

    def run(batches):
        held = []

        def flush():
            ids, n = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1))
            raw = b"".join(x for b in held for x in b.column(2).to_pylist())
            keys = np.frombuffer(raw, ">u4").reshape(-1, width).astype(np.uint32)
            a, b, open_ = neighbours(ids, n, keys, forest, percent)
            deep = keys[open_, :forest.levels[0] + 1].astype(np.uint64)
            region = np.zeros(len(open_), np.uint64)
            for k in range(deep.shape[1]):
                region = (region ^ (region >> np.uint64(30)) ^ deep[:, k]) * _M[6]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, ids[open_]])), pa.array(np.concatenate([b, ids[open_]])),
                                              pa.array(np.concatenate([np.zeros(len(a), np.int64), region.view(np.int64) | 1]))], names=["a", "b", "region"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 400_000:  # a partition that came out much too large is cut again
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "id")
    met = written(ordered.mapInArrow(run, "a long, b long, region long").distinct(), "met")
    return met.filter("region = 0 AND a <> b").select("a", "b"), met.filter("region <> 0").select(F.col("a").alias("id"), "region")


def common_counts(sets: DataFrame, counters: int) -> np.ndarray:
    """How many sets hold the shingles of each counter: bounded by ``counters`` rows, counted over all sets."""

    def run(batches):
        total = np.zeros(counters, np.int64)
        for batch in slices(batches, 500):
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            total += np.bincount((flat % np.uint64(counters)).astype(np.int64), minlength=counters)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["counter", "n"])

    out = np.zeros(counters, np.int64)
    counted = sets.select("full").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out[counted["counter"].to_numpy()] = counted["n"].to_numpy()
    return out


def rare_pairs(wide: DataFrame, sets: DataFrame, joined: DataFrame, percent: int, counters: int, posts: int = 256) -> DataFrame:
    """All pairs (a, b) of classes from open regions that lie in different components and may have the wanted similarity: a prefix filter join.

    All sets are ordered alike, rare shingles first, as far as the counters of a sketch tell (the order decides the work, not the result).  Two sets
    that are similar enough share one of their first ``n - ceil(percent * n / 100) + 1`` shingles, and behind the first they share enough is left in
    both, so only these first ones are sent.  Classes of a shingle's largest component are only looked at from the others, and shingles of more than
    ``posts`` classes are dealt over several groups.
    """
    known = wide.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = known.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    apart = written(known.join(mixed, "region", "left_semi").select("id", "component").distinct(), "apart")
    rank = common_counts(sets, counters).astype(np.uint32)

    def run(batches):
        for batch in slices(batches, 200):
            out = []
            for x, i, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(x, np.uint64)
                order = x[np.lexsort((x, rank[(x % np.uint64(counters)).astype(np.int64)]))]
                keep = len(x) - -(-len(x) * percent // 100) + 1
                out.append((np.full(keep, i), np.full(keep, c), np.full(keep, len(x)), order[:keep].view(np.int64), np.arange(keep)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(column)) for column in zip(*out, strict=True)], names=["id", "component", "n", "shingle", "at"])

    full = sets.join(apart, "id").select("full", "id", "component")
    first = written(full.mapInArrow(run, "id long, component long, n long, shingle long, at long").distinct(), "first")  # repeated rows with one id and set count once
    discard(apart)
    counts = first.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.sum("c").alias("all"), F.max(F.struct("c", "component")).alias("m"))
    parts = F.ceil(F.col("all") / posts).cast("long")
    placed = first.join(counts.filter(F.col("all") > F.col("m.c")).select("shingle", parts.alias("parts"), F.col("m.component").alias("main")), "shingle")
    left = placed.filter("component <> main").select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"))
    right = placed.select("shingle", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib"), "main")
    once = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    fits = (F.col("na") * percent <= F.col("nb") * 100) & (F.col("nb") * percent <= F.col("na") * 100)
    enough = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    met = left.join(right, ["shingle", "part"]).filter(once & fits & enough)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, forest: Forest, percent: int) -> DataFrame:
    """Pairs whose signatures agree in a share that the wanted similarity may have, with that share as ``agree``.

    Lowest bytes stand for the values: where values differ they agree by chance once in 256, which lets pairs pass but loses none.
    """
    p = percent / 100
    least = int(np.floor(forest.values * (p - 4.5 * np.sqrt(p * (1 - p) / forest.values))))
    values = forest.values

    def run(batches):
        for batch in slices(batches, 2000):
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, values) for i in (2, 3))
            agree = (a == b).sum(axis=1)
            keep = agree >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(agree[keep].astype(np.int32))], names=["a", "b", "agree"])

    sig = classes.select("id", "low")
    joined = pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long, agree int")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on full sets."""

    def run(batches):
        for batch in slices(batches, 500):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    joined = pairs.select("a", "b").join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", "xa", "xb")
    return joined.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b): the smallest node reachable, by alternating star contraction.

    Each round moves neighbours to the smallest node known nearby; minima are combined before they travel, so hubs are no hot keys
    of an aggregation, and joins on them are split by the engine.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if state["n"] == 0 or (before is not None and state == before):
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v")
        last, edges = edges, written(small.distinct(), "edges")
        discard(last)
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def near_duplicates(df: DataFrame, *, width: int = 4, percent: int = 80, forest: Forest | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Null and blank texts have no words: n_shingles 0, linked with nothing.  Repeated rows are linked through their equal sets and come
    out each; rows that share an id share a component.  A row with a null id comes out with its size, and with its class's component if it has one.
    """
    spark = df.sparkSession
    ship_package(spark)
    forest = forest or Forest()
    docs = written(signatures(df, forest, width, text=text, key=key), "signatures")
    members = written(docs.select("doc_id", "n_shingles", "set"), "members")
    least = members.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("id"))
    named = docs.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = written(named.join(least.select("set", F.col("id").alias("doc_id")), ["set", "doc_id"], "left_semi").dropDuplicates(["set", "doc_id"])
                      .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sig", "low"), "classes")
    discard(docs)
    met, wide = candidates(classes, forest, percent)
    pairs = written(estimated(met, classes, forest, percent), "pairs")

    # full sets of the classes with candidates
    ends = written(pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).unionByName(wide.select(F.col("id").alias("_id"))).distinct(), "ends")
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(ends, "_id", "left_semi")
    sets = written(map_texts(texts, "id long, full binary", lambda ids, ts: {"id": ids, "full": [shingles(t, width).tobytes() for t in ts]}, text="_text", key="_id"), "sets")
    discard(ends)

    best = lambda x, y: pairs.groupBy(x).agg(F.max(F.struct("agree", (-F.col(y)).alias("o"))).alias("m")).select(F.col(x), (-F.col("m.o")).alias(y))
    first = written(best("a", "b").unionByName(best("b", "a").select("a", "b")).distinct(), "best")
    links = written(confirmed(first, sets, percent), "links")
    joined = written(components(links), "joined")
    of = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    open_ = (pairs.join(first.withColumn("_done", F.lit(True)), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
             .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    more = written(confirmed(open_, sets, percent), "more")
    stars = lambda c: c.select(F.col("id").alias("a"), F.col("component").alias("b"))  # noqa: E731  what is connected already starts from its component
    whole = written(components(stars(joined).unionByName(more)), "components")
    discard(pairs, first, links, joined, more)
    rest = written(confirmed(estimated(rare_pairs(wide, sets, whole, percent, forest.counters), classes, forest, percent), sets, percent), "rest")
    if not rest.isEmpty():
        apart, whole = whole, written(components(stars(whole).unionByName(rest)), "components")
        discard(apart)
    discard(sets, classes, rest)

    found = members.join(least, "set", "left").join(whole, "id", "left")
    component = F.coalesce("component", "id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(df: DataFrame, *, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stand for their component, with all columns; rows with a null id stay."""
    gone = near_duplicates(df, width=width, percent=percent, text=text, key=key).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    return df.join(gone, key, "left_anti").select(*df.columns)
