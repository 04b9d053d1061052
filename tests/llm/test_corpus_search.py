"""The search, resampling and period operators against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_fixtures import CLASHING, SF, SMALL, nothing, tricky
from pyspark.sql import functions as F

from sphereframe.llm import mtree, periodicity, resampling
from sphereframe.llm.common import documents, table

import __spark_entry__

QUERIES = __spark_entry__.queries()
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- periodic runs ---------------------------------------------------------------------------------

def plain_runs(w, least=6, times=4):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            run = w[i:j + q]
            if len(run) >= max(least, times * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                out.add((i, len(run), q))
            i = j
    return out


def random_words(rng):
    n = rng.randint(0, 60)
    w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(n)]
    if n > 8 and rng.random() < 0.6:
        p, a = rng.randint(1, 8), rng.randrange(n)
        w = w[:a] + (w[a:a + p] * n)[:n - a]
    return w


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        w = random_words(rng)
        a = np.array(w, np.int64)
        assert set(periodicity.find_runs(a)) == periodicity.tree_runs(a) == plain_runs(w)
        assert periodicity.tree_runs(a, 2, 2) == plain_runs(w, 2, 2)


def test_extensions():
    rng = np.random.default_rng(1)
    s = np.concatenate([np.tile(rng.integers(1, 4, 7), 30), rng.integers(1, 3, 100)])
    ext = periodicity.Extensions(s, orders=True)
    a, b = rng.integers(0, len(s) + 1, (2, 3000))
    a, b = a[a != b], b[a != b]
    want = [next((k for k in range(len(s)) if max(i, j) + k >= len(s) or s[i + k] != s[j + k]), 0) for i, j in zip(a, b, strict=True)]
    assert ext.lce(a, b).tolist() == want
    for turn, rank in zip((1, -1), ext.ranks, strict=True):
        order = sorted(range(len(s) + 1), key=lambda i: [turn * x for x in s[i:].tolist()])
        assert np.argsort(rank).tolist() == order


def plain_periods(i, text):
    w = SPACE.findall(text or "")
    n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept)))


def test_periods_of_documents(spark):
    docs = documents(spark, SF)
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodicity"](spark, SF).collect()}
    short = [(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) < 1500]
    assert len(got) == docs.count() and len(short) > 100
    assert [got[i] for i, _ in short] == [plain_periods(i, t) for i, t in short]
    assert sum(g[1] > 0 for g in got.values()) >= 10


def test_collapse_and_tricky_rows(spark):
    out = periodicity.collapse(tricky(spark))
    assert out.columns == ["doc_id", "runs", "collapsed"] and out.count() == 15
    assert {r.collapsed for r in out.filter("doc_id < 3").collect()} == {""}
    assert periodicity.digest(periodicity.collapse(nothing(spark))).count() == 0
    text = "so we sang la la la la la la la all night"
    row = periodicity.collapse(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(3, 7, 1)] and row.collapsed == "so we sang la all night"


def test_long_texts():
    w = np.random.default_rng(2).integers(0, 500, 200)
    assert periodicity.find_runs(np.concatenate([w[:37], np.tile(w, 150), w[:11]])) == [(37, 30_011, 200)]
    assert periodicity.find_runs(np.zeros(30_000, np.int64)) == [(0, 30_000, 1)]


# --- resampling ------------------------------------------------------------------------------------

def plain_resample(rows, target, percent=5, least=20):
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: WORD.findall(fold(t))
    grams = lambda w: [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    each = [(i, words(t)) for i, t in rows]
    feats = [grams(w) for _, w in each]
    s, t = Counter(b for f in feats for b in f), Counter(b for x in target for b in grams(words(x)))
    ns, nt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in s}
    out = []
    for (i, w), f in zip(each, feats, strict=True):
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, len(w)])
    may = sorted((r for r in out if r[4] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    drawn = {id(r): k + 1 for k, r in enumerate(may[:percent * len(may) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("sf", [SF, SMALL])
def test_resampling_of_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_resampling"](spark, sf).collect()), key=str)
    assert got == plain_resample(rows, [r.text for r in table(spark, sf, "benchmark").collect()])
    assert sum(g[4] is not None for g in got) >= 5


def test_resampling_of_tricky_rows(spark):
    target = spark.createDataFrame([("the stone bridge over the river",), (None,)], "text string")
    rows = [(r.doc_id, r.text) for r in tricky(spark).collect()]
    for percent in (0, 5, 40, 100):
        got = sorted((tuple(r) for r in resampling.resample(tricky(spark), target, percent=percent).collect()), key=str)
        assert got == plain_resample(rows, ["the stone bridge over the river"], percent)
    assert resampling.resample(nothing(spark), target).count() == 0
    assert resampling.resample(tricky(spark), target.limit(0)).filter("rank IS NOT NULL").count() == 0
    assert set(CLASHING) & set(tricky(spark).columns)


def test_bracket_is_widened_and_keeps_ties(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"), F.monotonically_increasing_id().alias("_row"))
    order = sorted(((-(i % 7), i) for i in range(5000)))
    for keep, error in ((1, 1e-3), (714, 1e-9), (2500, 1e-6), (4999, 0.2), (5000, 1e-3)):
        got = rows.filter(resampling.top(rows, keep, 5000, error=error))
        assert {r.doc_id for r in got.collect()} == {i for _, i in order[:keep]}
    ranked = resampling.ranked(rows, F.col("score").desc(), F.col("doc_id"))
    assert [r.doc_id for r in ranked.orderBy("rank").collect()] == [i for _, i in order]


def test_crc_of_long_words():
    texts = ["x" * 5000 + " y " + "z" * 700, "é" * 100 + " É"]
    count, runs = resampling.features(texts, 10000)
    assert count.tolist() == [3, 2]
    assert sorted(runs[2][1].tolist()) == [zlib.crc32(("x" * 5000 + " y " + "z" * 700).encode()) % 10000]


# --- exact top-k -----------------------------------------------------------------------------------

def plain_top(rows, is_query, k=10):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    if not ok:
        return []
    dim = Counter(len(v) for _, v in ok).most_common(1)[0][0]
    whole = {(i, tuple(math.floor(1024 * c) for c in v)) for i, v in ok if len(v) == dim}
    out = []
    for q in sorted({i for i, _ in whole if is_query(i)}):
        best = {}
        for j, x in whole:
            if j != q:
                s = max(sum(a * b for a, b in zip(x, y, strict=True)) for i, y in whole if i == q)
                best[j] = max(best.get(j, s), s)
        top = sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]
        out += [(q, n + 1, j, min(max(s, -2**63), 2**63 - 1)) for n, (j, s) in enumerate(top)]
    return out


def found(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


TREE = mtree.Tree(page=8, block=64, cells=6, sample=100, queries=3)


def test_top_of_clusters_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 9))
    x = np.concatenate([c + 0.05 * rng.normal(size=(80, 9)) for c in centres] + [np.repeat(centres[:1], 150, axis=0), np.round(rng.normal(size=(60, 9)))])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)) * 5, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found(mtree.search(df, F.col("vec_id") % 100 == 0, spec=TREE)) == plain_top(rows, lambda i: i % 100 == 0)


def test_top_of_tricky_vectors(spark):
    bad = [(None, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0, 2.0, 3.0])]
    good = [(0, [0.0, 0.0]), (100, [0.5, -0.25]), (7, [0.5, -0.25]), (7, [0.5, -0.25]), (8, [-0.5, 0.0]), (8, [9.0, 1.0]), (9, [-0.0, 0.0]), (200, [70000.0, -3e9])]
    schema = "vec_id long, embedding array<double>, score string, query_id string, v string"
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in bad + good], schema)
    assert found(mtree.search(df, F.col("vec_id") % 100 == 0)) == plain_top(bad + good, lambda i: i % 100 == 0)
    assert mtree.search(df.filter("vec_id = 5"), F.col("vec_id") % 100 == 0).count() == 0
    assert mtree.search(df.filter("vec_id = 7"), F.col("vec_id") % 100 == 0).count() == 0
    huge = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [-1e30, 5.0]), (3, [1.0, 1.0])]
    assert found(mtree.search(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") == 0)) == plain_top(huge, lambda i: i == 0)


def test_stored_bounds_spare_computations():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 2000
    x = np.floor(np.concatenate([c + rng.normal(size=(100, 16)) * 50 for c in centres]))
    longest = float((x * x).sum(axis=1).max())
    pages = mtree.build(np.arange(len(x)), mtree.lifted(x, longest), 32)
    assert all(len(p.refs) <= 32 for p in pages)
    block = mtree.Block(pages, longest)
    for i in range(0, len(x), 200):
        s = x @ x[i]
        want = sorted(((-int(v), j) for j, v in enumerate(s) if j != i))[:5]
        assert block.search(i, x[i], 5) == want
    assert block.computed < 0.35 * 20 * len(x)


def test_pages_cover_their_points():
    x = np.floor(np.random.default_rng(7).normal(size=(900, 5)) * 100)
    points = mtree.lifted(x, float((x * x).sum(axis=1).max()))
    pages = mtree.build(np.arange(900), points, 16)

    def below(page):
        return list(pages[page].refs) if pages[page].leaf else [i for c in pages[page].refs for i in below(int(c))]

    assert sorted(below(0)) == list(range(900))
    for p in pages:
        if not p.leaf:
            for child, point, radius in zip(p.refs, p.points, p.radius, strict=True):
                assert mtree.distances(points[below(int(child))], point).max() <= radius + 1e-9
                assert np.allclose(pages[int(child)].parent, mtree.distances(pages[int(child)].points, point))
