"""Text quality by a sparse ensemble of rules.

Statistics of every whole text are the input.  Small trees are grown on random parts of a bounded labelled sample; every path from a root
becomes a conjunctive rule over the statistics.  A lasso logistic regression keeps few rules and gives them weights.  What remains is
compiled into one Spark column expression, so scoring needs nothing but the statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, map_texts

ROWS = 8000  # bound of the training sample
STATS = ["chars", "words", "word_chars", "lines", "line_words", "upper", "digits", "blanks", "punctuation", "symbols", "pipes", "bangs", "marked_words", "upper_words",
         "distinct_words", "distinct_lines", "non_ascii", "top_word", "stops"]

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[ord(c) for c in ".,;:'\"()-"]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = True
MARKED = re.compile(r"[#$%&*+<=>@^~|]")


def statistics(text: str) -> list[float]:
    """The numbers named in ``STATS``; all 0 for an empty text.  Counts of characters are of UTF-8 bytes, shares are of those."""
    if not text:
        return [0.0] * len(STATS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = int(raw.sum())
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    share = lambda mask: float(raw[mask].sum()) / size
    return [np.log1p(size), np.log1p(len(words)), (size - float(raw[BLANK].sum())) / n, np.log1p(len(lines)), len(words) / len(lines), share(UPPER), share(DIGIT), share(BLANK),
            share(PUNCT), share(SYMBOL), float(raw[124]) / n, float(raw[33]) / n, len(MARKED.findall(text)) / n, text.count(".\n") / len(lines),
            len(counts) / n, len(set(lines)) / len(lines), float(raw[128:].sum()) / size, max(counts.values(), default=0) / n, float(raw[46]) / n]


def with_statistics(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, one double per statistic) of every row from its whole text; a null text counts as empty."""

    def work(ids: list, texts: list) -> dict:
        rows = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATS))
        return {"doc_id": ids} | {name: rows[:, i] for i, name in enumerate(STATS)}

    return map_texts(df, "doc_id long, " + ", ".join(f"{s} double" for s in STATS), work, text=text, key=key)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above?, threshold)


@dataclass(frozen=True)
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for stat, above, at in rule:
                c = F.col(STATS[stat])
                holds = holds & ((c > F.lit(at)) if above else (c <= F.lit(at)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATS[s]} {'>' if up else '<='} {at:.6g}" for s, up, at in rule) for rule, w in zip(self.rules, self.weights, strict=True)]


def _best_split(x: np.ndarray, y: np.ndarray, columns: np.ndarray, least: int) -> tuple[int, float] | None:
    """Statistic and threshold of the largest fall in squared error, among up to 32 quantiles of each statistic."""
    best, found = 1e-9, None
    total, n = y.sum(), len(y)
    base = total * total / n
    for j in columns:
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 32)))
        below = x[:, j][:, None] <= cuts[None, :]
        nl = below.sum(axis=0)
        sl = y @ below
        ok = (nl >= least) & (n - nl >= least)
        gain = np.where(ok, sl * sl / np.maximum(nl, 1) + (total - sl) ** 2 / np.maximum(n - nl, 1) - base, -1)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (int(j), float(cuts[k]))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, seed: int = 5) -> list[Rule]:
    """Distinct paths of all trees, each grown on a random half of the rows and of the statistics at every split."""
    rng, found = np.random.default_rng(seed), {}

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            found[tuple(sorted(path))] = None
        if len(path) == depth or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        split = _best_split(x[rows], y[rows], columns, 5)
        if split is None:
            return
        j, at = split
        up = x[rows, j] > at
        grow(rows[~up], (*path, (j, False, at)))
        grow(rows[up], (*path, (j, True, at)))

    for _ in range(trees):
        grow(rng.choice(len(y), max(1, len(y) // 2), replace=False), ())
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, *, penalty: float = 0.002, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute penalty by accelerated proximal gradient; the bias is not penalised."""
    n = len(y)
    lip = 0.25 * float(np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2) / n + 1e-9
    w = np.zeros(z.shape[1] + 1)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        g = z @ v[:-1] + v[-1]
        d = (1 / (1 + np.exp(-np.clip(g, -30, 30))) - y) / n
        new = v - np.append(z.T @ d, d.sum()) / lip
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - penalty / lip, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit(df: DataFrame, labels: DataFrame, usable: Column, *, text: str = "text", key: str = "doc_id", rows: int = ROWS) -> Ensemble:
    """Fit on at most ``rows`` labelled rows where ``usable`` (a condition on ``_id``) holds; without both labels the score is constant."""
    known = labels.select(F.col(key).alias("_id"), F.col("quality").alias("_y")).filter(F.col("_y").isNotNull() & F.col("_id").isNotNull())
    chosen = bounded_sample(known.filter(usable).groupBy("_id").agg(F.max("_y").alias("_y")), rows, "_id")
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # at most `rows` ids
    got = with_statistics(texts, text="_text", key="_id").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_y", *STATS).collect()
    got = sorted(tuple(r) for r in got)
    y = np.array([float(r[0]) for r in got])
    if not len(y) or y.min() == y.max():
        return Ensemble([], [], 2.0 * (y.mean() if len(y) else 0.5) - 1.0)
    x = np.array([r[1:] for r in got])
    rules = tree_rules(x, y)
    if not rules:  # too few rows to grow a tree
        return Ensemble([], [], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    z = np.stack([np.logical_and.reduce([(x[:, j] > at) if up else (x[:, j] <= at) for j, up, at in rule]) for rule in rules], axis=1).astype(float)
    w, b = lasso(z, y)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([rules[i] for i in kept], [float(w[i]) for i in kept], b)


def score(df: DataFrame, model: Ensemble, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the score of zero statistics."""
    return with_statistics(df, text=text, key=key).select("doc_id", model.column().alias("score"))
