"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and texts whose label is not looked at.  Features are the densities of hashed runs of five bytes of the
lower-cased text; those whose mean differs most between the two samples, against its standard error, are kept.  A linear classifier minimises the class-prior-corrected risk

    prior * E_toxic[loss(g)] + max(0, E_unlabelled[loss(-g)] - prior * E_toxic[loss(-g)])

with the logistic loss.  Where the second term falls below zero, the step goes against it (the non-negative correction).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_texts, ship_package, slices, written

GRAM, BITS = 5, 20
TOXIC_ROWS, OTHER_ROWS = 4000, 8000  # bounds of the training sample
FEATURES = 192
NAMES = [f"{part}{k}" for k in (0, 1) for part in "nsq"]


@dataclass(frozen=True)
class Model:
    """``slot[hash]`` is the index of a kept feature or -1."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        g = self.bias + float(kept_densities(grams(text), self.slot, len(self.weights)) @ self.weights)
        return float(1.0 / (1.0 + np.exp(-np.clip(g, -30, 30))))


def grams(text: str) -> np.ndarray:
    """Hashes of all runs of five bytes of the text with a blank at both ends."""
    raw = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(raw) < GRAM:
        return np.zeros(0, np.int64)
    code = raw[:-GRAM + 1].astype(np.uint32)
    for i in range(1, GRAM):
        code = code * np.uint32(0x01000193) ^ raw[i:len(raw) - GRAM + 1 + i]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def density(counts: np.ndarray, runs: int) -> np.ndarray:
    """Occurrences per thousand runs in sixteenths, at most 255; short texts are damped as if they had 400 runs more."""
    return np.minimum(255, np.rint(16_000 * counts / (runs + 400))).astype(np.int64)


def kept_densities(codes: np.ndarray, slot: np.ndarray, features: int) -> np.ndarray:
    at = slot[codes]
    return density(np.bincount(at[at >= 0], minlength=features), len(codes)) / 16.0


def _sample(df: DataFrame, labels: DataFrame, usable: Column, toxic_rows: int, other_rows: int, text: str, key: str) -> DataFrame:
    """(_toxic, _text): at most ``toxic_rows`` confirmed and ``other_rows`` further rows, the latter without regard to labels."""
    confirmed = labels.filter(F.col("toxic") == 1).select(F.col(key).alias("_id")).distinct()
    ids = df.select(F.col(key).alias("_id")).filter(F.col("_id").isNotNull())
    ids = ids.filter(usable)
    toxic = bounded_sample(ids.join(confirmed, "_id", "left_semi").distinct(), toxic_rows, "_id")
    other = bounded_sample(ids, other_rows, "_id").distinct()
    wanted = toxic.withColumn("_toxic", F.lit(1)).unionByName(other.withColumn("_toxic", F.lit(0)))
    texts = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(wanted), "_id").select("_toxic", "_text")  # at most toxic_rows + other_rows ids


def fit(df: DataFrame, labels: DataFrame, usable: Column, *, prior: float | None = None, text: str = "text", key: str = "doc_id",
        toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS, features: int = FEATURES) -> Model:
    """Fit on a bounded sample of the rows where ``usable`` (a condition on the column ``_id``) holds.

    ``prior`` is the share of toxic texts; by default the share among the usable labels.  Without any confirmed text the model
    scores everything near zero.
    """
    ship_package(df.sparkSession)
    sample = written(_sample(df, labels, usable, toxic_rows, other_rows, text, key), "sample")
    size = 1 << BITS

    def count(batches):
        # per class: documents with the feature, sums of densities and of their squares, all whole numbers
        total, docs = np.zeros((2, 3, size), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for toxic, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = grams(t)
                at, counts = np.unique(codes, return_counts=True)
                v = density(counts, len(codes))
                total[toxic][:, at] += np.stack([np.ones_like(v), v, v * v])
                docs[toxic] += 1
        at = np.flatnonzero(total[:, 0].any(axis=0))
        columns = [np.append(total[k, j, at], docs[k]) for k in (0, 1) for j in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, size), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], names=["at", *NAMES])

    # sums over the bounded sample; the best features are picked on the executors
    sums = sample.mapInArrow(count, "at int, " + ", ".join(f"{n} long" for n in NAMES)).groupBy("at").agg(*[F.sum(n).alias(n) for n in NAMES])
    docs = sums.filter(F.col("at") == size).collect()
    n0, n1 = (docs[0]["n0"], docs[0]["n1"]) if docs else (0, 0)
    known = labels.select(F.col(key).alias("_id"), "toxic").filter(F.col("toxic").isNotNull()).filter(usable).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not n0 or not n1:
        return Model(np.full(size, -1, np.int16), np.zeros(1), -4.0)
    prior = min(max(prior if prior is not None else (known or 0.1), 0.005), 0.9)
    m0, m1 = F.col("s0") / n0, F.col("s1") / n1
    apart = (m1 - m0) / F.sqrt((F.col("q0") / n0 - m0 * m0 + 25) / n0 + (F.col("q1") / n1 - m1 * m1 + 25) / n1)
    best = sums.filter((F.col("at") < size) & (F.col("n1") >= min(4, n1)) & (m1 > m0)).orderBy(apart.desc(), "at").limit(min(features, max(32, 2 * n1))).collect()  # fewer than confirmed rows can tell apart
    slot = np.full(size, -1, np.int16)
    slot[[r["at"] for r in best]] = np.arange(len(best))
    width = max(1, len(best))

    def present(batches):
        for batch in batches:
            found = [kept_densities(grams(t), slot, width).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.binary())], names=["toxic", "found"])

    rows = sample.mapInArrow(present, "toxic int, found binary").collect()  # at most toxic_rows + other_rows rows of `width` numbers
    x = np.stack([np.frombuffer(r["found"], np.float32) for r in rows])
    toxic = np.array([r["toxic"] for r in rows])
    order = np.array(sorted(range(len(rows)), key=lambda i: (toxic[i], bytes(rows[i]["found"]))))  # whatever the order in which rows arrive
    w, b = learn(x[order][toxic[order] == 1], x[order][toxic[order] == 0], prior, decay=min(0.02, max(1e-3, 1.0 / n1)))
    return Model(slot, w, b)


def learn(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier under the non-negative risk, by Adam on the full sample.

    The correction makes steps jump back and forth near the end, so steps shrink and the second half of the path is averaged.
    """
    w = np.zeros(positive.shape[1] + 1, np.float64)
    w[-1] = np.log(prior / (1 - prior)) - 1
    m, v, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def back(x, d):
        return np.append(x.T @ d.astype(np.float32), d.sum())

    for t in range(1, steps + 1):
        gp, gu = positive @ w[:-1].astype(np.float32) + w[-1], unlabelled @ w[:-1].astype(np.float32) + w[-1]
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_negative = back(unlabelled, sigmoid(gu) / len(gu)) - prior * back(positive, sigmoid(gp) / len(gp))
        d_positive = prior * back(positive, -sigmoid(-gp) / len(gp))
        grad = (d_positive + d_negative if negative_risk >= 0 else -d_negative) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate / (1 + 4 * t / steps) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        if 2 * t > steps:
            mean += w / (steps - steps // 2)
    return mean[:-1], float(mean[-1])


def score(df: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row from its whole text; null and empty texts get the score of a text without features."""
    return map_texts(df, "doc_id long, score double", lambda ids, texts: {"doc_id": ids, "score": [model.score(t) for t in texts]}, text=text, key=key)


def keep_clean(df: DataFrame, model: Model, *, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Rows of ``df`` scored below ``threshold``, with all columns."""
    ship_package(df.sparkSession)

    at = df.columns.index(text)

    def clean(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(clean, df.schema)
