"""Secrets in texts: fixed patterns plus character Markov models of random strings and of ordinary identifiers.

Both models are first-order chains over printable ASCII.  They are trained from labelled strings; `labelled_strings` takes these from the
corpus itself: values found by the fixed patterns are random, words made of letters (also joined by `_`, `.` or `-`) are ordinary.  The
training pass counts transitions over all rows and hands one small matrix per task to an aggregation, so nothing grows with the corpus but
the counts.  A string is reported where the log-likelihood ratio per character of the two models exceeds a threshold, one of its own for
strings of letters only.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, ship_package, slices

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ORDINARY = re.compile(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*")
WORD = re.compile(r"[A-Za-z_.-]{6,}")
REACH = 8
FIRST, LAST = 32, 127  # range of characters of the models; everything else counts as FIRST


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio of each transition, random over ordinary, and the threshold per character."""

    ratio: np.ndarray
    threshold: float = 0.7
    letters: float = 0.3  # for strings without digits, whose ordinary kind scores far below zero

    def score(self, s: str) -> float:
        codes = _codes(s)
        return float(self.ratio[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0


def _codes(s: str) -> np.ndarray:
    raw = np.frombuffer(s.encode("ascii", "replace"), np.uint8).astype(np.int64)
    return np.where((raw >= FIRST) & (raw < LAST), raw - FIRST, 0)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, sorted by start, then kind in the order of ``KINDS``."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def labelled_strings(text: str, base: list[tuple[int, int, str]]) -> tuple[list[str], list[str]]:
    """Random and ordinary strings of a text."""
    random = []
    for start, end, kind in base:
        m = ASSIGN.match(text, start) if kind == "assign" else None
        random.append(m[2] if m else text[start:end])
    return random, [w for w in WORD.findall(text) if ORDINARY.fullmatch(w)]


NOUNS = ("user", "page", "index", "max", "min", "count", "name", "path", "file", "cache", "request", "response", "session", "value", "table", "config", "server", "client", "handler",
         "version", "update", "total", "average", "buffer", "stream", "record", "column", "query", "result", "http", "default", "internal", "is", "get", "set", "by", "id", "to", "of", "new")


def seed_strings(count: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Labelled strings by rule, so that no corpus leaves a kind of character unseen.

    Random: 16 to 48 letters of the usual key alphabets.  Ordinary: two to four words joined in the usual ways, some with a short number.
    """
    rng = np.random.default_rng(seed)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabets = [np.array(list(a)) for a in (upper + lower + digits + "+/", digits + "abcdef", upper + digits, lower + digits, upper + lower + digits + "_-")]
    random = ["".join(rng.choice(alphabets[i % 5], int(rng.integers(16, 49)))) for i in range(count)]
    ordinary = []
    for i in range(count):
        words = [NOUNS[j] for j in rng.integers(0, len(NOUNS), int(rng.integers(2, 5)))]
        words = [w.title() for w in words] if i % 3 == 0 else [w.upper() for w in words] if i % 7 == 0 else words
        ordinary.append(("", "_", "-", "/")[i % 4].join(words) + (str(rng.integers(0, 3000)) if i % 2 else ""))
    return random, ordinary


def transitions(strings: list[str]) -> np.ndarray:
    """Counts of adjacent characters within the strings, as a flat matrix."""
    size = LAST - FIRST
    joined = np.frombuffer("\n".join(strings).encode("ascii", "replace"), np.uint8).astype(np.int64)
    inside = (joined[:-1] != 10) & (joined[1:] != 10)
    left, right = joined[:-1][inside] - FIRST, joined[1:][inside] - FIRST
    return np.bincount(left * size + right, minlength=size * size)


def _chain(counts: np.ndarray) -> np.ndarray:
    """Transition probabilities of two count matrices with add-one smoothing."""
    counts = counts.reshape(2, LAST - FIRST, LAST - FIRST) + 1.0
    return counts / counts.sum(axis=2, keepdims=True)


def train(df: DataFrame, *, text: str = "text", threshold: float = 0.7) -> Markov:
    """Transition counts of both classes over all rows of ``df``.

    Strings made by rule (`seed_strings`) are counted too, so an empty table still trains a sound model.  A null text counts as empty.
    """
    size = (LAST - FIRST) ** 2

    def count(batches):
        total = np.zeros((2, size), np.int64)
        for batch in batches:
            random, ordinary = [], []
            for t in batch.column(0).to_pylist():
                a, b = labelled_strings(t, base_spans(t))
                random += a
                ordinary += b
                if len(ordinary) > 200_000:
                    total[1] += transitions(ordinary)
                    ordinary = []
            total[0] += transitions(random)
            total[1] += transitions(ordinary)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(total[kind, at], pa.int64())], names=["kind", "at", "c"])

    got = (df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(count, "kind int, at int, c long")
           .groupBy("kind", "at").agg(F.sum("c").alias("c")).collect())  # at most 2 * 95 * 95 rows
    corpus = np.zeros((2, size))
    for r in got:
        corpus[r["kind"], r["at"]] = r["c"]
    seeds = np.stack([transitions(strings) for strings in seed_strings()]).astype(float)
    logp = np.log((_chain(seeds) + _chain(corpus)) / 2)  # half each, however large the corpus
    return Markov(logp[0] - logp[1], threshold)


def all_spans(text: str, model: Markov, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base spans and the strings the models call random.

    A string that meets base spans is reported too, as a span of its own, where ``REACH`` or more of its characters lie outside them.
    """
    out = list(base)
    for m in STRING.finditer(text):
        s, (lo, hi) = m[0], m.span()
        met = [(max(a, lo), min(b, hi)) for a, b, _ in base if a < hi and lo < b]
        if met and hi - lo - len(set().union(*(range(a, b) for a, b in met))) < REACH:
            continue
        if model.score(s) > (model.threshold if any(c.isdigit() for c in s) else model.letters):
            out.append((lo, hi, "markov"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, model: Markov, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_spans, spans) of every row, spans as ``kind:start:end`` in code points, end exclusive.

    A null text counts as empty and has no spans; rows with equal ids are scanned each; other columns are ignored.
    """

    def work(ids: list, texts: list) -> dict:
        out: dict[str, list] = {"doc_id": ids} | {f"n_{k}": [] for k in KINDS} | {"base_spans": [], "spans": []}
        for t in texts:
            base = base_spans(t)
            spans = all_spans(t, model, base)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in spans))
            out["base_spans"].append(listed(base))
            out["spans"].append(listed(spans))
        return out

    return map_texts(df, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_spans string, spans string", work, text=text, key=key)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for lo, hi, kind in spans:
        if lo >= at:
            out += [text[at:lo], f"[{kind}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]]) if spans else text


def redact(df: DataFrame, model: Markov, *, text: str = "text") -> DataFrame:
    """``df`` with the secrets of its text column replaced; null texts stay null, all rows and columns are kept."""

    at = df.columns.index(text)

    def clean(batches):
        for batch in slices(batches):
            texts = [t if t is None else redact_text(t, all_spans(t, model, base_spans(t))) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    ship_package(df.sparkSession)
    return df.mapInArrow(clean, df.schema)


def digest(spans: DataFrame) -> DataFrame:
    """The scan with its base spans reduced to a digest."""
    return spans.withColumn("base_sha256", F.sha2(F.col("base_spans"), 256)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def digest_of(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
