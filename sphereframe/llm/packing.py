"""Packing documents into windows of fixed length with a non-negative least squares plan.

Documents become token ids with an end id.  Full windows are cut off first; what remains of a document has a length below the window.
The histogram of these lengths (one count per length, whatever the number of documents) is all the driver sees.  Shallow combinations of
two or three lengths that fill a window exactly are the columns of a least squares problem against the histogram; its non-negative
solution says how often each combination is used, and is rounded down to what the histogram holds.  Documents get a rank within their
length, and ranks are mapped to places in windows by the plan.  Residual documents are packed greedily one after the other and cut at
window borders; the last, incomplete window is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import in_slices
from .common import map_texts, pa_schema, written

CHUNKS, KNOWN_WORDS = 400_000, 400_000  # chunks and words a worker remembers; it starts anew beyond
TRIPLES = 3000  # combinations of three lengths offered to the solver, the most promising by their counts
PER_BUCKET = 20_000  # documents in one bucket of the ranking
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# Letters and digits among the first 256 characters, and chunks of them that need no normalisation besides lower case.
LETTERS, DIGITS = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ", "0-9²³¹¼½¾"
PLAIN = re.compile(r"[!-~¡-ÿ]+")
WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins across blanks.

    Each distinct chunk between blanks is looked up or put together from its words, each distinct word is encoded once.  Words are handed
    to the tokenizer many at a time; their last ids carry the end-of-word mark.  Chunks with characters beyond the first 256 or control
    characters go to the tokenizer whole, and so does every text in which one of the tokenizer's added tokens is spelled out.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = os.path.commonprefix(self.added)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.end = end_id.to_bytes(4, "little")
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        for lo in range(0, len(words), 2000):
            part = words[lo:lo + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            flat = ids.tobytes()
            if len(cut) == len(part) and cut[-1] == len(flat):
                self.words.update(zip(part, (flat[a:b] for a, b in zip([0, *cut], cut)), strict=True))
            else:
                self.words.update((w, self._whole(w)) for w in part)

    def _learn(self, chunks: set[str]) -> None:
        plain = [c for c in chunks if (c.isprintable() if c.isascii() else PLAIN.fullmatch(c))]  # chunks hold no blanks
        self.known.update((c, self._whole(c)) for c in chunks.difference(plain))
        if not plain:
            return
        split = [[w] if w.isalpha() else WORDS.findall(w) for w in "\n".join(plain).lower().split("\n")]
        self._learn_words(list(set().union(*split).difference(self.words)))
        word = self.words.__getitem__
        self.known.update(zip(plain, (word(w[0]) if len(w) == 1 else b"".join(map(word, w)) for w in split), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, the end id last."""
        special = {i for i, t in enumerate(texts) if self.mark in t and any(a in t for a in self.added)}
        split = [[""] if i in special else t.replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        if len(self.known) > CHUNKS:
            self.known = {"": b""}
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        self._learn(set().union(*split).difference(self.known))
        return [(self._whole(texts[i]) if i in special else b"".join(map(self.known.__getitem__, chunks))) + self.end for i, chunks in enumerate(split)]


@lru_cache(maxsize=2)
def tokenizer(path: str, end_id: int) -> WordTokenizer:
    return WordTokenizer(path, end_id)


def tokenized(df: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """(doc_id, n, crcs of the full windows, crc and ids of the rest), without the ids of full windows, which are never moved again."""

    def work(ids: list, texts: list) -> dict:
        tok = tokenizer(path, end_id)

        def reduce(part: list[str]) -> list[tuple]:
            out = []
            for code in tok.encode(part):
                full = len(code) // (4 * window) * 4 * window
                out.append((len(code) // 4, [zlib.crc32(code[i:i + 4 * window]) for i in range(0, full, 4 * window)], zlib.crc32(code[full:]), code[full:]))
            return out

        got = in_slices(texts, 4_000_000, reduce)
        return {"doc_id": ids, "n": [g[0] for g in got], "crcs": [g[1] for g in got], "rest_crc": [g[2] for g in got], "rest": [g[3] for g in got]}

    return map_texts(df, "doc_id long, n long, crcs array<long>, rest_crc long, rest binary", work)


def combinations(counts: np.ndarray, window: int, triples: int) -> list[tuple[int, ...]]:
    """Pairs, and the most promising triples, of present lengths that add up to the window."""
    present = np.flatnonzero(counts)
    pairs = [(int(a), int(window - a)) for a in present if a <= window - a and counts[window - a]]
    a, b = np.meshgrid(present, present, indexing="ij")
    c = window - a - b
    ok = (a <= b) & (b <= c) & (c > 0)
    a, b, c = a[ok], b[ok], c[ok]
    has = counts[c] > 0
    a, b, c = a[has], b[has], c[has]
    best = np.argsort(-np.minimum(np.minimum(counts[a], counts[b]), counts[c]), kind="stable")[:triples]
    return pairs + list(zip(a[best].tolist(), b[best].tolist(), c[best].tolist(), strict=True))


def repeat_counts(counts: np.ndarray, combos: list[tuple[int, ...]], steps: int = 400) -> np.ndarray:
    """How often to use each combination: non-negative least squares by accelerated projected gradient, rounded down to what there is."""
    if not combos:
        return np.zeros(0, np.int64)
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.concatenate([np.array(c) for c in combos])
    size, h = len(counts), counts.astype(float)
    use = np.bincount(row, minlength=size).astype(float)
    # Gershgorin bound of A'A: a combination meets every combination that shares one of its lengths
    bound = max(1.0, float(np.bincount(col, weights=use[row]).max()) * 3)
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        miss = np.bincount(row, weights=y[col], minlength=size) - h
        new = np.maximum(0.0, y - np.bincount(col, weights=miss[row], minlength=len(combos)) / bound)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    left, out = counts.astype(np.int64).copy(), np.zeros(len(combos), np.int64)
    needs = [np.unique(c, return_counts=True) for c in combos]
    for limit in (np.floor(x).astype(np.int64), None):  # the solution first, then whatever still fits whole
        for j in np.argsort(-x, kind="stable"):
            lengths, times = needs[j]
            n = int((left[lengths] // times).min())
            n = n if limit is None else min(n, int(limit[j]))
            if n > 0:
                out[j] += n
                left[lengths] -= n * times
    return out


def plan(counts: np.ndarray, window: int, triples: int = TRIPLES) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, int]:
    """(length, first rank, ranks, first sequence, offset) of every place the plan fills, ranks covered of each length, sequences used."""
    combos = combinations(counts, window, triples)
    repeats = repeat_counts(counts, combos)
    covered, places, sequences = np.zeros(len(counts), np.int64), [], 0
    for combo, n in zip(combos, repeats.tolist(), strict=True):
        offset = 0
        for length in combo if n else ():
            places.append((length, int(covered[length]), n, sequences, offset))
            covered[length] += n
            offset += length
        sequences += n
    return places, covered, sequences


def stream_cuts(start: int, length: int, total: int, window: int) -> list[tuple[int, int, int, int]]:
    """(sequence, offset, from, length) of the pieces of ``length`` ids that stand at ``start`` in a stream of ``total`` ids."""
    out, at, end = [], start, start + length
    whole = total // window * window
    while at < end:
        if at < whole:
            seq, lo, hi = at // window, at // window * window, at // window * window + window
        else:  # the incomplete last window: one sequence for each power of two in its length
            seq, lo, rest = whole // window, whole, total - whole
            hi = lo + (1 << (rest.bit_length() - 1))
            while at >= hi:
                rest -= hi - lo
                seq, lo = seq + 1, hi
                hi = lo + (1 << (rest.bit_length() - 1))
        stop = min(end, hi)
        out.append((seq, at - lo, at - start, stop - at))
        at = stop
    return out


def pack(df: DataFrame, path: str, *, end_id: int = 1, window: int = 2048, per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per piece of a document (columns of ``PIECES``).

    A null or empty text is the end id alone.  Rows are told apart by their place in the tokenized table, so repeated rows and repeated
    or null ids each get places of their own.  An empty table gives no pieces.  Further columns are ignored.
    """
    spark = df.sparkSession
    docs = written(tokenized(df, path, end_id, window).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    small = docs.select("_row", "doc_id", "n", "rest_crc", (F.col("n") % window).alias("len"), F.expr(f"n div {window}").alias("full"))
    histogram = small.groupBy("len").agg(F.count(F.lit(1)).alias("c"), F.sum("full").alias("f")).collect()  # at most `window` rows
    counts = np.zeros(window, np.int64)
    for r in histogram:
        counts[r["len"]] = r["c"]
    documents, counts[0] = int(counts.sum()), 0
    places, covered, planned = plan(counts, window)
    total = int(((counts - covered) * np.arange(window)).sum())
    streamed = total // window + bin(total % window).count("1")

    buckets = max(1, -(-documents // per_bucket))
    small = small.withColumn("bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    before = Window.partitionBy("len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small.groupBy("len", "bucket").agg(F.count(F.lit(1)).alias("c")).select("len", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("len", "bucket").orderBy("_row")
    taken = spark.createDataFrame([(i, int(covered[i])) for i in range(window)], "len long, covered long")
    ranked = (small.withColumn("r", F.row_number().over(inside)).join(offsets, ["len", "bucket"]).join(F.broadcast(taken), "len")
              .withColumn("rank", F.col("first") + F.col("r") - 1).drop("first", "r"))
    # positions in the stream of residual documents and numbers of the full windows: sums before each bucket, then within it
    ranked = ranked.withColumn("_stream", F.when(F.col("rank") >= F.col("covered"), F.col("len")).otherwise(F.lit(0)))
    ranked = written(ranked, "ranks")
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    sums = ranked.groupBy("bucket").agg(F.sum("_stream").alias("s"), F.sum("full").alias("f"))
    sums = sums.select("bucket", F.coalesce(F.sum("s").over(order), F.lit(0)).alias("s0"), F.coalesce(F.sum("f").over(order), F.lit(0)).alias("f0"))
    run = Window.partitionBy("bucket").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (ranked.withColumn("s", F.sum("_stream").over(run)).withColumn("f", F.sum("full").over(run)).join(sums, "bucket")
              .withColumn("pos", F.col("s0") + F.col("s") - F.col("_stream"))
              .withColumn("window0", F.col("f0") + F.col("f") - F.col("full") + F.lit(planned + streamed)))
    rest = placed.filter("len > 0")
    start = F.col("full") * window

    slots = spark.createDataFrame(places, "len long, lo long, many long, seq0 long, at long")  # at most three rows for each combination
    by_plan = (rest.filter("rank < covered").join(F.broadcast(slots), "len").filter("rank >= lo AND rank < lo + many")
               .select("doc_id", start.alias("start"), F.col("len").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                       (F.col("seq0") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("at").alias("offset")))
    stream = rest.filter("rank >= covered").select("_row", "doc_id", "n", "len", "full", "rest_crc", "pos")
    last = total // window * window
    uncut = (F.expr(f"pos div {window}") == F.expr(f"(pos + len - 1) div {window}")) & (F.col("pos") + F.col("len") <= last)
    by_stream = stream.filter(uncut).select("doc_id", start.alias("start"), F.col("len").alias("length"), F.col("rest_crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
                                            (F.expr(f"pos div {window}") + F.lit(planned)).alias("sequence_id"), (F.col("pos") % window).alias("offset"))

    schema = pa_schema(PIECES)

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, n, length, full, pos, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for seq, offset, lo, size in stream_cuts(pos, length, total, window):
                    rows.append((doc, full * window + lo, size, zlib.crc32(ids[4 * lo:4 * (lo + size)]), n, planned + seq, offset))
            columns = list(zip(*rows, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    by_cut = stream.filter(~uncut).join(docs.select("_row", "rest"), "_row").select("doc_id", "n", "len", "full", "pos", "rest").mapInArrow(cut, PIECES)
    whole = (placed.filter("full > 0").select("_row", "n", "window0").join(docs.select("_row", "doc_id", "crcs"), "_row")
             .select("doc_id", "n", "window0", F.posexplode("crcs").alias("i", "crc"))
             .select("doc_id", (F.col("i") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
                     F.col("n").alias("doc_tokens"), (F.col("window0") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return by_plan.unionByName(by_stream).unionByName(by_cut).unionByName(whole)
