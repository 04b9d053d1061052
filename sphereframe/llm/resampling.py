"""Importance resampling towards a target distribution of word runs.

Runs of one to three words are hashed to ``buckets`` buckets by crc32.  Counts of all documents and of a target table give each bucket a gain;
a document's weight is the sum of gains over its runs, and a Gumbel variate from its id turns the largest scores into a draw without replacement.

Weights come from arrays: a batch's words are numbered once, the crc32 of a run follows from those of its words (crc32 is linear, so appending
bytes is a table look-up on the first part), and gains are summed by position.  The cutoff comes from a quantile sketch: two quantiles bracket it,
rows outside are counted exactly, a bracket that misses is widened, and only the rows inside are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, slices, written

BUCKETS = 10_000
LONGEST = 64  # bytes appended at once
WORDS = 150_000  # words a worker remembers

# A-Z in lower case; all but digits, letters and bytes above 0x7F end a word.
_FOLD = bytes(b if chr(b).isdigit() or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_BYTE = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the crc's own table: what one byte adds, by linearity


def _zeros_table() -> np.ndarray:
    """[n, k, b]: what byte k of a crc becomes when n zero bytes are appended, n up to LONGEST."""
    table = np.empty((LONGEST + 1, 4, 256), np.uint32)
    table[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    for n in range(LONGEST):
        table[n + 1] = (table[n] >> np.uint32(8)) ^ _BYTE[table[n] & np.uint32(255)]
    return table


_ZEROS = _zeros_table()


def appended(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings joined, from those of the parts and the length of the second."""
    out, left = first.copy(), length.copy()
    at = np.arange(len(out))
    while len(at):
        n, c = np.minimum(left[at], LONGEST), out[at]
        out[at] = _ZEROS[n, 0, c & 255] ^ _ZEROS[n, 1, (c >> 8) & 255] ^ _ZEROS[n, 2, (c >> 16) & 255] ^ _ZEROS[n, 3, c >> 24]
        left[at] -= n
        at = at[left[at] > 0]
    return out ^ second


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


_known: dict[bytes, int] = {}
_crc = [np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)]  # of a word, of a space and the word, length of both


def _numbers(parts: list[bytes]) -> np.ndarray:
    """Row of each word in the tables of crcs, which forget all words when there are too many."""
    new = set(parts).difference(_known)
    if new:
        if len(_known) + len(new) > WORDS:
            _known.clear()
            _crc[:] = [c[:0] for c in _crc]
            new = set(parts)
        new = list(new)
        _known.update(zip(new, range(len(_known), len(_known) + len(new)), strict=True))
        for k, values in enumerate(((zlib.crc32(w) for w in new), (zlib.crc32(b" " + w) for w in new), (len(w) + 1 for w in new))):
            _crc[k] = np.concatenate([_crc[k], np.fromiter(values, _crc[k].dtype, len(new))])
    return np.fromiter(map(_known.__getitem__, parts), np.int64, len(parts))


def features(texts: list[str | None], buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each text, and (index of the text, bucket) of all its runs, for one, two and three words."""
    parts = [words(t) for t in texts]
    count = np.array([len(p) for p in parts], np.int64)
    flat = [w for p in parts for w in p]
    doc = np.repeat(np.arange(len(texts)), count)
    row = _numbers(flat)
    run, out = _crc[0][row], []
    for width in (1, 2, 3):
        if width > 1:
            same = doc[:max(0, len(row) - width + 1)] == doc[width - 1:]
            run = appended(run[:len(same)], _crc[1][row[width - 1:]], _crc[2][row[width - 1:]])
            out.append((doc[width - 1:][same], (run[same] % np.uint32(buckets)).astype(np.int64)))
        else:
            out.append((doc, (run % np.uint32(buckets)).astype(np.int64)))
    return count, out


def _pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches in parts whose texts hold about ``most`` characters, or one text."""
    for batch in slices(batches, 500):
        texts = batch.column(column).to_pylist()
        lo, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= most or i == len(texts) - 1:
                yield batch.slice(lo, i + 1 - lo), texts[lo:i + 1]
                lo, size = i + 1, 0


def bucket_counts(df: DataFrame, *, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Runs in each bucket over all texts: counted in arrays, one row of a bucket from each task; ``buckets`` rows reach the driver."""
    ship_package(df.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for _, texts in _pieces(batches, 0):
            for _, bucket in features(texts, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) for each bucket."""
    s, t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def weights(df: DataFrame, gain: np.ndarray, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    ship_package(df.sparkSession)

    def run(batches):
        for batch, texts in _pieces(batches, 1):
            count, runs = features(texts, len(gain))
            total = np.zeros(len(texts) + 1, np.int64)
            for doc, bucket in runs:
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                total[:-1] += np.diff(sums[np.searchsorted(doc, np.arange(len(texts) + 1))])
            n = sum(np.maximum(0, count - k) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count), pa.array(n), pa.array(total[:-1])], names=["doc_id", "n_words", "n_features", "weight"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, key: Column) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 8 hex digits of sha256("seed:key"); null for a null key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` from 1 in the given order, which has to be total: range partitions, ordered inside, behind the counts of those before them."""
    at = F.monotonically_increasing_id()
    spread = written(df.repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return spread.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def top(scored: DataFrame, keep: int, total: int, *, error: float = 1e-3) -> Column | None:
    """Condition that holds for the ``keep`` first of ``total`` rows (score descending, then doc_id, then _row); None if there are none to keep.

    Two quantiles of a sketch bracket the cutoff.  Rows above and inside are counted exactly; a bracket without the cutoff is widened until it
    holds it.  Only its rows are sorted.
    """
    if keep <= 0:
        return None
    if keep >= total:
        return F.lit(True)
    q = 1 - keep / total
    while True:
        edges = [max(0.0, q - error), min(1.0, q + error)]
        lo, hi = scored.select(F.percentile_approx("score", edges, min(1_000_000, math.ceil(2 / error))).alias("e")).first()["e"]
        lo, hi = (None if edges[0] == 0.0 else lo), (None if edges[1] == 1.0 else hi)  # an end of the range leaves nothing outside
        above = F.lit(False) if hi is None else F.col("score") > hi
        inside = ~above & (F.lit(True) if lo is None else F.col("score") >= lo)
        n = scored.select(F.count_if(above).alias("above"), F.count_if(inside).alias("inside")).first()
        if n["above"] < keep <= n["above"] + n["inside"]:
            break
        error *= 8
    order = [F.col("score").desc(), F.col("doc_id"), F.col("_row")]
    cut = ranked(scored.filter(inside).select("score", "doc_id", "_row"), *order).filter(F.col("rank") == keep - n["above"]).first()
    tied = F.col("score") == cut["score"]
    first = (F.col("doc_id") < cut["doc_id"]) | ((F.col("doc_id") == cut["doc_id"]) & (F.col("_row") <= cut["_row"]))
    return (F.col("score") > cut["score"]) | (tied & first)


def resample(df: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, text: str = "text", key: str = "doc_id",
             target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; ``rank`` counts the drawn ones from 1 and is null for the rest.

    Of the N rows with ``least_words`` words, floor(percent N / 100) are drawn: highest score first, ties by smaller id.  Null and empty texts
    have no features, weight 0, and are never drawn.  Rows that repeat with the same id are rows of their own.  A row with a null id counts in the
    corpus but has no score and is not drawn.  Empty tables give no rows, and an empty target leaves only the corpus in the gains.
    """
    gain = gains(bucket_counts(df, buckets=buckets, text=text), bucket_counts(target, buckets=buckets, text=target_text))
    scored = weights(df, gain, text=text, key=key).withColumn("score", F.col("weight") + gumbel(seed, F.col("doc_id"))).withColumn("_row", F.monotonically_increasing_id())
    scored = written(scored, "scored")  # row numbers must not change any more
    may = scored.filter((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    total = may.count()
    columns = ["doc_id", "n_features", "weight", "score"]
    chosen = top(may, total * percent // 100, total)
    if chosen is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    chosen = (F.col("n_words") >= least_words) & F.col("score").isNotNull() & chosen
    rest = scored.filter(~F.coalesce(chosen, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = ranked(scored.filter(chosen), F.col("score").desc(), F.col("doc_id"), F.col("_row"))
    return rest.unionByName(drawn.select(*columns, F.col("rank").cast("long").alias("rank")))
