"""Periodic runs of words by longest common extensions on suffix trees.

A run is a stretch of words with a smallest period that no neighbouring word extends.  Every run has a Lyndon root: at some place of it the
longest Lyndon word under the order of the words, or under the opposite order, is one period long.  So the two longest Lyndon words that start
at each place are all the candidates there are, and each is extended to both sides by a longest common extension: the depth of the lowest common
ancestor of two leaves in the suffix tree of the words (to the right) or of the reversed words (to the left).  Trees are built by Ukkonen's
algorithm; ancestors come from the Euler tour in constant time, for all candidates at once.

Trees are built for the stretches that can hold a run: in a run of at least four periods and six words, every five consecutive words occur
twice and every three occur three times.  That screen is exact, and repeated inside what it leaves.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, slices

LEAST, TIMES = 6, 4  # a run that counts has this many words and periods at least
BLOCK = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def suffix_tree(s: list[int]) -> tuple[array, array, array, dict[int, int], int]:
    """(start, end, parent, children, width) of the suffix tree of ``s``, whose last symbol 0 occurs nowhere else (Ukkonen).

    Node 0 is the root; the edge into a node reads ``s[start:end]``; ``children[node * width + symbol]`` is the child by first symbol.
    """
    n, width = len(s), max(s) + 1
    start, end, link, parent = array("q", [0]), array("q", [0]), array("q", [0]), array("q", [0])
    children: dict[int, int] = {}
    node = edge = length = rest = 0  # active point: below ``node``, ``length`` symbols along the edge that starts with s[edge]
    for i, symbol in enumerate(s):
        rest += 1
        made = 0  # inner node of this phase that still lacks its suffix link
        while rest:
            if not length:
                edge = i
            key = node * width + s[edge]
            child = children.get(key)
            if child is None:
                children[key] = len(start)
                start.append(i), end.append(n), link.append(0), parent.append(node)
                if made:
                    link[made] = node
                    made = 0
            else:
                span = min(end[child], i + 1) - start[child]
                if length >= span:
                    node, edge, length = child, edge + span, length - span
                    continue
                if s[start[child] + length] == symbol:
                    length += 1
                    if made:
                        link[made] = node
                    break
                inner = len(start)
                start.append(start[child]), end.append(start[child] + length), link.append(0), parent.append(node)
                children[key] = inner
                start[child] += length
                parent[child] = inner
                children[inner * width + s[start[child]]] = child
                children[inner * width + symbol] = len(start)
                start.append(i), end.append(n), link.append(0), parent.append(inner)
                if made:
                    link[made] = inner
                made = inner
            rest -= 1
            if not node and length:
                length -= 1
                edge = i - rest + 1
            elif node:
                node = link[node]
    return start, end, parent, children, width


class Extensions:
    """Longest common extensions of suffixes: minima of string depths over an Euler tour, from a table over blocks of the tour."""

    def __init__(self, symbols: np.ndarray, orders: bool = False):
        """``symbols`` are above 0; with ``orders`` also the ranks of the suffixes under both orders of the symbols (a prefix is smaller)."""
        s = [*symbols.tolist(), 0]
        n = len(s)
        start, end, parent, children, width = suffix_tree(s)
        keys = np.fromiter(children.keys(), np.int64, len(children))
        kids = np.fromiter(children.values(), np.int64, len(children))
        del children
        by, first = keys // width, keys % width
        nodes = len(start)
        starts = np.frombuffer(start, np.int64)
        at = np.concatenate([[0], np.cumsum(np.bincount(by, minlength=nodes))])
        tour, seen, leaf_of = self._walk(kids[np.lexsort((first, by))].tolist(), at.tolist(), nodes, end, starts.tolist(), n)
        self.first = np.empty(n, np.int64)
        leaves = np.flatnonzero(leaf_of >= 0)
        self.first[leaf_of[leaves]] = seen[leaves]
        self.ranks = []
        if orders:
            order = np.argsort(seen[leaves], kind="stable")
            rank = np.empty(n, np.int64)
            rank[leaf_of[leaves][order]] = np.arange(n)
            self.ranks.append(rank)
            turned = np.where(first == 0, 0, width - first)
            _, seen, leaf_of = self._walk(kids[np.lexsort((turned, by))].tolist(), at.tolist(), nodes, end, starts.tolist(), n)
            order = np.argsort(seen[leaves], kind="stable")
            rank = np.empty(n, np.int64)
            rank[leaf_of[leaves][order]] = np.arange(n)
            self.ranks.append(rank)
        pad = -len(tour) % BLOCK
        self.blocks = np.concatenate([tour, np.full(pad, n, np.int32)]).reshape(-1, BLOCK)
        self.before = np.minimum.accumulate(self.blocks, axis=1)
        self.after = np.minimum.accumulate(self.blocks[:, ::-1], axis=1)[:, ::-1]
        self.table = [self.blocks.min(axis=1)]
        while 2 ** len(self.table) <= len(self.blocks):
            last, half = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _walk(kids: list[int], at: list[int], nodes: int, end, starts: list[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Euler tour as string depths; where each node stands in it first; the suffix of each leaf (-1 for inner nodes)."""
        tour, seen, leaf_of = array("i", [0]), np.zeros(nodes, np.int64), np.full(nodes, -1, np.int64)
        stack, depths, turn = [0], [0], at[:-1]
        while stack:
            node = stack[-1]
            k = turn[node]
            if k == at[node + 1]:
                stack.pop(), depths.pop()
                if stack:
                    tour.append(depths[-1])
                continue
            turn[node] = k + 1
            child = kids[k]
            depth = depths[-1] + end[child] - starts[child]
            seen[child] = len(tour)
            tour.append(depth)
            if at[child] == at[child + 1]:
                leaf_of[child] = n - depth
                tour.append(depths[-1])
            else:
                stack.append(child), depths.append(depth)
        return np.frombuffer(tour, np.int32), seen, leaf_of

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes ``a`` and ``b`` (different places), elementwise."""
        out = np.empty(len(a), np.int64)
        for cut in range(0, len(a), 65536):
            part = slice(cut, cut + 65536)
            x, y = self.first[a[part]], self.first[b[part]]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            bl, br = lo // BLOCK, hi // BLOCK
            best = np.minimum(self.after[bl, lo % BLOCK], self.before[br, hi % BLOCK])
            for i in np.flatnonzero(bl == br):
                best[i] = self.blocks[bl[i], lo[i] % BLOCK:hi[i] % BLOCK + 1].min()
            gap = br - bl - 1
            level = np.zeros(len(gap), np.int64)
            level[gap > 0] = np.log2(gap[gap > 0]).astype(np.int64)
            for k in np.unique(level[gap > 0]):
                at = np.flatnonzero((gap > 0) & (level == k))
                best[at] = np.minimum(best[at], np.minimum(self.table[k][bl[at] + 1], self.table[k][br[at] - (1 << k)]))
            out[part] = best
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank: the end of the longest Lyndon word that starts there."""
    out, stack = np.empty(len(rank), np.int64), []
    for i in range(len(rank) - 1, -1, -1):
        while stack and rank[stack[-1]] > rank[i]:
            stack.pop()
        out[i] = stack[-1] if stack else len(rank)
        stack.append(i)
    return out


def tree_runs(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``least`` symbols and ``times`` periods (two at least) in an array of numbers."""
    n = len(symbols)
    if n < max(least, times):
        return set()
    symbols = np.unique(symbols, return_inverse=True)[1] + 1
    right = Extensions(symbols, orders=True)
    pairs = []
    for rank in right.ranks:
        stop = next_smaller(rank[:n].tolist())
        fits = np.flatnonzero((stop < n + 1) & ((stop - np.arange(n)) * times <= n))
        pairs.append(np.stack([fits, stop[fits]]))
    i, j = np.unique(np.concatenate(pairs, axis=1), axis=1)
    if not len(i):
        return set()
    ahead = right.lce(i, j)  # j may be n, the end
    del right
    back = Extensions(symbols[::-1]).lce(n - i, n - j)
    period, begin, length = j - i, i - back, j + ahead - (i - back)
    good = length >= np.maximum(least, times * period)
    return set(zip(begin[good].tolist(), length[good].tolist(), period[good].tolist()))


def _grams(symbols: np.ndarray, width: int) -> np.ndarray:
    """How often the ``width`` symbols from each place on occur (equal hashes count as equal: never too few)."""
    n = len(symbols) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ (h >> np.uint64(29))) * _ODD + symbols[k:k + n].astype(np.uint64)
    _, place, count = np.unique(h, return_inverse=True, return_counts=True)
    return count[place]


def find_runs(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least six words and four periods, by start, then period."""
    out, todo = set(), [(0, len(symbols))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < LEAST:
            continue
        part = symbols[lo:hi]
        may = _grams(part, 5) >= 2
        if may.any():
            often = _grams(part, 3) >= 3
            may &= often[:-2] & often[1:-1] & often[2:]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], may.astype(np.int8), [0]])))
        found = [(lo + int(a), lo + int(b) + 4) for a, b in zip(edges[::2], edges[1::2], strict=True)]  # starts a..b-1 cover words up to b + 3
        if found == [(lo, hi)]:
            out.update((lo + start, length, period) for start, length, period in tree_runs(part))
        else:
            todo += found
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(parts: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in parts), np.int64, len(parts))


def kept_mask(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for words that no run contains behind its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])


def collapse(df: DataFrame, *, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, runs, collapsed) of every row: its periodic runs by start, then period, and its text with each run cut to its first period.

    ``runs`` holds (start, length, period) in words; ``collapsed`` joins the words that stay by one space.  ``rewrite(id, words)`` may change the
    words before.  Null, empty and blank texts have no runs and an empty collapsed text.  Repeated rows come out each; a null id is kept.  One
    pass, nothing is shuffled; an empty table gives no rows and further columns are ignored.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        for batch in slices(batches, 200):
            ids, found, texts = batch.column(0).to_pylist(), [], []
            for i, t in zip(ids, batch.column(1).to_pylist(), strict=True):
                parts = words(t)
                if rewrite:
                    parts = rewrite(i, parts)
                runs = find_runs(numbered(parts)) if len(parts) >= LEAST else []
                if runs:
                    mask = kept_mask(len(parts), runs)
                    parts = [w for w, keep in zip(parts, mask.tolist(), strict=True) if keep]
                found.append([{"start": a, "length": b, "period": c} for a, b, c in runs])
                texts.append(b" ".join(parts).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, _RUNS), pa.array(texts, pa.string())], schema=_OUT)

    return rows.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the longest (ties: smallest start, then period), and digests of runs and collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    out = found.withColumn("_best", longest)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
                      F.expr("(_best.length * 1000) div -_best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(i: int | None, parts: list[bytes]) -> list[bytes]:
    """Words of a document with a period planted in one of ten, by the crc32 of its id; a row without id stays as it is."""
    n = len(parts)
    h = 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 or not n:
        return parts
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return parts[:a] + (parts[a:a + p] * ((n - a) // p + 1))[:n - a]
