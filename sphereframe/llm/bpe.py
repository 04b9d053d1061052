"""Byte-level BPE on length-bucketed padded matrices.

Every distinct piece of text becomes one row of a padded matrix of token ids; rows of similar length share a matrix.  In each round
every row merges its leftmost pair of smallest rank and the matrix is compacted, until no row has a pair left.  Pairs are looked up in
an open-addressing hash table of all (left id, right id) -> merged id.

Pieces longer than ``LONG`` bytes would need as many rounds as they have merges, each over the whole row.  They follow the same
merge order with a heap over a linked list (`_encode_long`), which is exact and takes n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

LONG = 96  # bytes of the longest piece that goes through the matrices
CACHE = 300_000  # pieces a worker remembers; it starts anew beyond
NO_PAIR = np.int32(1 << 30)
_MULT = np.uint64(0x9E3779B97F4A7C15)


# The classes of the splitting pattern among the first 256 characters.
LATIN1 = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": r"\t-\r \x85\xa0"}


def latin1_pattern(pattern: str) -> str | None:
    """The pattern with its classes spelled out for texts of the first 256 characters, which the faster standard module then splits.

    None for a pattern that uses other escapes.
    """
    def spell(m: re.Match) -> str:
        part = m[0]
        for name, chars in LATIN1.items():
            part = part.replace(name, chars)
        return part if m[0][0] == "[" else f"[{part}]"

    out = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s", spell, pattern.replace(r"(?!\S)", r"(?![^\s])"))
    return None if re.search(r"\\[pPdDwWSbB]", out) else out


class PairTable:
    """Hash table (left id, right id) -> rank of the merged token, -1 where there is none."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (max(1, len(pairs)) * 4 - 1).bit_length())
        keys = np.full(1 << self.bits, -1, np.int64)
        values = np.full(1 << self.bits, -1, np.int32)
        new = np.array([(a << 32) | b for a, b in pairs], np.int64)
        ranks = np.array(list(pairs.values()), np.int32)
        slot = self._slot(new)
        probes = 0
        while len(new):  # each pass seats one key per free slot, the rest move on
            free = np.flatnonzero(keys[slot] == -1)
            first = free[np.unique(slot[free], return_index=True)[1]]
            keys[slot[first]], values[slot[first]] = new[first], ranks[first]
            rest = np.ones(len(new), bool)
            rest[first] = False
            new, ranks, slot = new[rest], ranks[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            probes += 1
        self.keys, self.values, self.probes = keys, values, max(1, probes)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where the two do not merge (ids below 0 are padding)."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(key.shape, NO_PAIR, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, key = out.ravel(), key.ravel()[open_]
        slot = self._slot(key)
        for _ in range(self.probes):
            at = self.keys[slot]
            hit = at == key
            flat[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (at != -1)
            open_, key, slot = open_[more], key[more], (slot[more] + 1) & ((1 << self.bits) - 1)
            if not len(open_):
                break
        return flat.reshape(out.shape)


class ByteBpe:
    """Encoder and decoder for a table ``bytes -> rank``; ids are ranks, as in rank files."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        narrow = latin1_pattern(pattern)
        self.narrow = re.compile(narrow) if narrow else None
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.table = PairTable(self.pairs)
        self.vocab: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.whole = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "ByteBpe":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as 32-bit integers: a whole-piece token where there is one, merges otherwise."""
        out = list(map(self.whole.get, pieces))
        rest = np.array([i for i, o in enumerate(out) if o is None], np.int64)
        length = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        for i in rest[length > LONG]:
            out[i] = self._encode_long(pieces[i])
        bucket = np.where(length > LONG, 0, -(-length // 4))
        for width in np.unique(bucket[bucket > 0]):
            rows = rest[bucket == width]
            for lo in range(0, len(rows), 8192):
                part = rows[lo:lo + 8192].tolist()
                for i, ids in zip(part, self._encode_matrix([pieces[i] for i in part], int(width) * 4), strict=True):
                    out[i] = ids
        return out

    def _encode_matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int32, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.table.rank(ids[:, :-1], ids[:, 1:])
        done, sizes, row = np.full((n, width), -1, np.int32), length.copy(), np.arange(n)
        while len(row):
            at = rank.argmin(axis=1)  # the first of the smallest: leftmost
            best = rank[np.arange(len(row)), at]
            over = best == NO_PAIR
            if over.any():
                done[row[over], :ids.shape[1]], sizes[row[over]] = ids[over], length[over]
                keep = ~over
                ids, rank, row, at, best, length = ids[keep], rank[keep], row[keep], at[keep], best[keep], length[keep]
                if not len(row):
                    break
            # compaction: what stands right of the merged pair moves one place to the left
            length = length - 1
            wide = max(int(length.max()), 2)
            moved = np.arange(wide)[None, :] > at[:, None]
            ids = np.concatenate([ids, np.full((len(row), 1), -1, np.int32)], axis=1)
            ids = np.where(moved, ids[:, 1:wide + 1], ids[:, :wide])
            rank = np.concatenate([rank, np.full((len(row), 2), NO_PAIR)], axis=1)
            rank = np.where(moved[:, :wide - 1], rank[:, 1:wide], rank[:, :wide - 1])
            here = np.arange(len(row))
            ids[here, at] = best
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.table.rank(ids[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < wide - 1)
            rank[right, at[right]] = self.table.rank(best[right], ids[right, at[right] + 1])
        flat = done[np.arange(width) < sizes[:, None]].astype("<u4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _encode_long(self, piece: bytes) -> bytes:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.pairs.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return np.array([x for x, on in zip(ids, alive, strict=True) if on], "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        if self.narrow is not None:
            try:
                text.encode("latin-1")
                return self.narrow.findall(text)
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        out: list[bytes] = []
        if len(self.known) > CACHE:
            self.known.clear()
        new = list(set().union(*split).difference(self.known)) if split else []
        for lo in range(0, len(new), CACHE):
            part = new[lo:lo + CACHE]
            self.known.update(zip(part, self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in part]), strict=True))
        for pieces in split:
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """Bytes behind ids given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteBpe:
    return ByteBpe.from_file(path, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, *, text: str = "text", key: str = "doc_id", slice_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, ids binary, decoded binary) of every row; ids are little-endian unsigned 32-bit integers.

    ``path`` names a rank file present on every executor (it belongs to an installed package).  A null text counts as empty and gives no
    ids; repeated rows are encoded each; further columns of ``df`` are ignored.  Batches are cut after ``slice_chars`` characters, so a
    worker holds few long texts at a time.
    """

    def work(ids: list, texts: list) -> dict:
        bpe = encoder(path, pattern)
        codes = in_slices(texts, slice_chars, bpe.encode)
        return {"doc_id": ids, "ids": codes, "decoded": [bpe.decode(c) for c in codes]}

    return map_texts(df, "doc_id long, ids binary, decoded binary", work, text=text, key=key)


def in_slices(texts: list[str], chars: int, work) -> list:
    """``work`` applied to consecutive slices of about ``chars`` characters."""
    out, lo, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > chars:
            out += work(texts[lo:i + 1])
            lo, size = i + 1, 0
    return out + (work(texts[lo:]) if lo < len(texts) else [])


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): lengths and digests taken where the ids are made, so no id array leaves the task."""

    def work(ids: list, texts: list) -> dict:
        bpe = encoder(path, pattern)

        def reduce(part: list[str]) -> list[tuple[int, str, str]]:
            return [(len(c) // 4, hashlib.sha256(c).hexdigest(), hashlib.sha256(bpe.decode(c)).hexdigest()) for c in bpe.encode(part)]

        got = in_slices(texts, 4_000_000, reduce)
        return {"doc_id": ids, "n_tokens": [g[0] for g in got], "ids_sha256": [g[1] for g in got], "decoded_sha256": [g[2] for g in got]}

    return map_texts(df, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
