"""Byte-level BPE over a public vocabulary: whole pre-tokens by a minimal perfect hash, the rest by merging linked bytes."""

from __future__ import annotations

import base64
import heapq
import os
from collections import OrderedDict

import numpy as np
import regex
import xxhash

#: Where the public vocabulary files are, unless a path is given.
DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of the vocabulary: a fixed value that comes with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of n byte strings: n slots, one displacement per bucket of about four keys.

    ``slot_of`` gives for any string the only slot it can be in; the caller compares the string kept there, so strings
    outside the key set are told apart exactly.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        hi, lo = self._hashes(keys)
        bucket = (hi % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        shift = np.zeros(self.buckets, dtype=np.int64)
        free = np.ones(n, dtype=bool)
        slots = np.empty(n, dtype=np.int64)
        by_size = np.argsort(-(starts[1:] - starts[:-1]), kind="stable")
        lone = []
        for b in by_size:
            own = order[starts[b] : starts[b + 1]]
            if len(own) < 2:
                if len(own):
                    lone.append((b, own[0]))
                continue
            d = 1
            while True:
                tries = np.arange(d, d + 512, dtype=np.uint64)
                at = (_mix(lo[own][:, None] + tries[None, :] * np.uint64(0xA24BAED4963EE407)) % np.uint64(n)).astype(np.int64)
                ok = free[at].all(axis=0)
                for j in np.flatnonzero(ok):
                    if len(set(at[:, j])) == len(own):
                        shift[b], slots[own] = int(tries[j]), at[:, j]
                        free[at[:, j]] = False
                        break
                else:
                    d += 512
                    continue
                break
        rest = np.flatnonzero(free)
        for (b, k), slot in zip(lone, rest, strict=False):  # a bucket of one key names its slot outright
            shift[b], slots[k] = -int(slot) - 1, slot
        self.shift, self.slots = shift, slots

    @staticmethod
    def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        both = [xxhash.xxh3_128_intdigest(k) for k in keys]
        return np.array([h >> 64 for h in both], dtype=np.uint64), np.array([h & _M64 for h in both], dtype=np.uint64)

    def slot_of(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.empty(0, dtype=np.int64)
        hi, lo = self._hashes(keys)
        d = self.shift[(hi % np.uint64(self.buckets)).astype(np.int64)]
        hashed = (_mix(lo + d.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) % np.uint64(self.n)).astype(np.int64)
        return np.where(d < 0, -d - 1, hashed)


class Vocabulary:
    """Token ids of texts. Its size is that of the vocabulary file (about 50,000 entries), so it may be broadcast."""

    MISSES = 200_000

    def __init__(self, path: str | None = None):
        path = path or os.environ.get("EMBERGLASS_VOCAB", DEFAULT_VOCAB)
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [base64.b64decode(a) for a, _ in pairs]
        ranks = np.array([int(b) for _, b in pairs], dtype=np.int64)
        self.hash = PerfectHash(tokens)
        self.tokens: list[bytes] = [b""] * len(tokens)
        self.ranks = np.empty(len(tokens), dtype=np.int64)
        for t, r, s in zip(tokens, ranks, self.hash.slots, strict=True):
            self.tokens[s], self.ranks[s] = t, r
        self._start()

    def _start(self) -> None:
        self.pattern = regex.compile(PATTERN)
        self.misses: OrderedDict[bytes, list[int]] = OrderedDict()
        self.known = {t: int(r) for t, r in zip(self.tokens, self.ranks, strict=True)}

    def __getstate__(self) -> dict:
        return {"hash": self.hash, "tokens": self.tokens, "ranks": self.ranks}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token outside the vocabulary: its bytes are a linked list, a heap gives the lowest-ranked neighbours to join."""
        n = len(piece)
        known = self.known
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it is joined to the one before
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := known.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # one of the two parts has changed since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := known.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := known.get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(known[piece[i : end[i]]])
            i = end[i]
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for null and for empty text. Lone surrogates are read as the replacement character."""
        number: dict[str, int] = {}
        rows = []
        for t in texts:
            rows.append([number.setdefault(p, len(number)) for p in self.pattern.findall(t)] if t else [])
        pieces = [p.encode("utf-8", "replace") for p in number]
        slots = self.hash.slot_of(pieces)
        ids: list[list[int]] = []
        for p, s, r in zip(pieces, slots.tolist(), self.ranks[slots].tolist() if pieces else [], strict=True):
            if self.tokens[s] == p:
                ids.append([r])
                continue
            hit = self.misses.get(p)
            if hit is None:
                hit = self.misses[p] = self.merge(p)
                if len(self.misses) > self.MISSES:
                    self.misses.popitem(last=False)
            ids.append(hit)
        return [[i for k in row for i in ids[k]] for row in rows]
