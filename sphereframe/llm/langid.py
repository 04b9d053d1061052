"""Language identification by error-correcting output codes.

Each language gets a codeword of bits.  One binary linear classifier per bit predicts it from hashed runs of one to three bytes; decoding
adds, for every language, the logistic loss of its codeword under the margins of all classifiers and takes the language of least loss.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, ship_package

BITS = 12  # buckets of hashed runs
ROWS = 2400  # bound of the training sample


@dataclass(frozen=True)
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        return (self.trust * np.logaddexp(0, -margins[:, None, :] * self.codes[None])).sum(axis=2)


def code_book(k: int, seed: int = 11) -> np.ndarray:
    """Codewords of ``k`` classes: all 2^(k-1) - 1 distinct splits for few classes, else the best of many random books of 15 log2 k bits."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        bits = [[1 if (s >> c) & 1 else -1 for c in range(k)] for s in range(1, 1 << (k - 1))]
        return np.array(bits, float).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):
        book = rng.choice([-1.0, 1.0], (k, int(15 * np.log2(k))))
        book = book[:, np.abs(book.sum(axis=0)) < k]
        apart = min((book[i] != book[j]).sum() for i in range(k) for j in range(i))
        if best is None or apart > best[0]:
            best = apart, book
    return best[1]


def runs(text: str) -> np.ndarray:
    """Relative frequencies (square root) of hashed runs of one to three bytes of the lower-cased text with blanks around it."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    two = raw[:-1] * np.uint32(257) + raw[1:]
    three = two[:-1] * np.uint32(0x01000193) ^ raw[2:]
    out = np.zeros(1 << BITS)
    for codes in (raw, two + np.uint32(1 << 17), three + np.uint32(1 << 30)):
        out += np.bincount((codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(out / max(1.0, out.sum()))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def fit(df: DataFrame, usable: Column, *, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = ROWS) -> Model:
    """Fit on at most ``rows`` rows with a language where ``usable`` (a condition on ``_id``) holds, the bound shared evenly by the languages."""
    ship_package(df.sparkSession)
    known = df.select(F.col(key).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & F.col("_id").isNotNull())
    known = known.filter(usable)
    counts = {r["_lang"]: r["count"] for r in known.groupBy("_lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((0, 1)), np.zeros((1 << BITS, 1)), np.zeros(1), np.ones(1))
    each = -(-rows // len(langs))
    # of each language the rows of smallest hash: those below a share that holds eight times as many are ordered
    share = F.create_map(*[c for code in langs for c in (F.lit(code), F.lit(8.0 * each / counts[code]))])
    hashed = known.select("_id", "_lang", F.xxhash64("_id").alias("_h")).filter(F.col("_h").cast("double") / F.lit(2.0**64) + 0.5 < share[F.col("_lang")])
    order = Window.partitionBy("_lang").orderBy("_h", "_id")
    sample = hashed.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= each).select("_id", "_lang")
    place = {code: i for i, code in enumerate(langs)}

    def features(batches):
        for batch in batches:
            pairs = [(place[code], runs(t).astype(np.float32).tobytes()) for code, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], names=["y", "x"])

    chosen = known.join(F.broadcast(sample.distinct()), ["_id", "_lang"])  # at most `rows` ids
    got = chosen.select("_lang", "_text").mapInArrow(features, "y int, x binary").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    y = np.array([r["y"] for r in got])
    codes = code_book(len(langs))
    weights, bias, trust = learn(x, codes[y])
    return Model(langs, codes, weights, bias, trust)


def learn(x: np.ndarray, targets: np.ndarray, *, steps: int = 150, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once (Adam on the full sample); bits weigh in decoding by their accuracy in training."""
    w, b = np.zeros((x.shape[1], targets.shape[1])), np.zeros(targets.shape[1])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        margin = x @ w.astype(np.float32) + b
        pull = -targets / (1 + np.exp(np.clip(targets * margin, -30, 30))) / len(x)
        for value, grad, m, v in ((w, x.T @ pull.astype(np.float32) + decay * w, state[0], state[1]), (b, pull.sum(axis=0), state[2], state[3])):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.999
            v += 0.001 * grad * grad
            value -= 0.3 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    right = ((x @ w + b) * targets > 0).mean(axis=0)
    return w, b, np.maximum(0.05, 2 * right - 1)


def predict(df: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, runner_up, ambiguous) of every row from its whole text.

    ``und`` with score 0 where the text is null, empty or has no letter, or where no language was learned.  The score is the share of the
    chosen language in exp(-loss); below 0.6 a row is flagged ambiguous.  Equal losses go to the language that sorts first.
    """

    def work(ids: list, texts: list) -> dict:
        out: dict[str, list] = {"doc_id": ids, "lang_pred": ["und"] * len(ids), "score": [0.0] * len(ids), "runner_up": [None] * len(ids), "ambiguous": [True] * len(ids)}
        rows = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
        for lo in range(0, len(rows), 256):
            part = rows[lo:lo + 256]
            loss = model.losses(np.stack([runs(texts[i]) for i in part]))
            share = np.exp(loss.min(axis=1, keepdims=True) - loss)
            share /= share.sum(axis=1, keepdims=True)
            order = np.argsort(loss, axis=1, kind="stable")
            for i, s, o in zip(part, share, order, strict=True):
                out["lang_pred"][i], out["score"][i], out["ambiguous"][i] = model.langs[o[0]], float(s[o[0]]), bool(s[o[0]] < 0.6)
                out["runner_up"][i] = model.langs[o[1]] if len(o) > 1 else None
        return out

    return map_texts(df, "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean", work, text=text, key=key)
