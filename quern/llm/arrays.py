"""Array kernels over batches of UTF-8 texts, used inside Spark tasks.

A ``TextBatch`` holds a bounded slice of an Arrow batch as one byte buffer, texts separated by a
newline. Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; lines end at ``\\n``. Hashes are
64-bit mixes of eight-byte windows, so equal spans always get equal values. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one TextBatch holds at most, unless a single text is longer.
BATCH_BYTES = 2 << 20
_LONG_SPAN = 4096
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)

#: ASCII white space: \x09-\x0D and \x20.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


_KEPT: list = []


def kept(make):
    """make, whose last result a Python worker keeps from task to task until another operator needs the room."""
    cached = lru_cache(maxsize=1)(make)
    _KEPT.append(cached)
    return cached


def alone(*used) -> None:
    """Called where a task begins: lets go of what other operators' tasks have left in this worker."""
    for cached in _KEPT:
        if cached not in used:
            cached.cache_clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Ordered hash of every k consecutive hashes; shorter by k - 1."""
    n = len(hashes) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * _A
        out ^= out >> np.uint64(29)
    return mix(out)


class TextBatch:
    def __init__(self, texts: list[str | None], lower: bool = False):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        joined = b"\n".join([b"", *parts, b""])
        if lower:
            joined = joined.translate(LOWER)
        self.n = len(parts)
        self.start = np.cumsum(lens + 1) - lens
        self.end = self.start + lens
        self._padded = joined + b"\0" * 8
        self.bytes = np.frombuffer(self._padded, np.uint8, len(joined))
        self._windows = np.ndarray((len(joined) + 1,), "<u8", self._padded, 0, (1,))

    def _spans(self, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        return edge[::2], edge[1::2]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of every word, in order."""
        start, end = self._spans(WHITE[self.bytes])
        return start, end, np.searchsorted(self.start, start, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of every line that is not empty."""
        start, end = self._spans(self.bytes == 10)
        return start, end, np.searchsorted(self.start, start, "right") - 1

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        out = size.astype(np.uint64) * _A
        left = np.flatnonzero(size <= _LONG_SPAN)
        at, todo = start[left], size[left]
        while len(left):
            value = self._windows[at] & _MASKS[np.minimum(todo, 8)]
            h = (out[left] ^ value) * _B
            out[left] = h ^ (h >> np.uint64(32))
            more = todo > 8
            left, at, todo = left[more], at[more] + 8, todo[more] - 8
        out = mix(out)
        for i in np.flatnonzero(size > _LONG_SPAN):
            digest = hashlib.blake2b(self._padded[start[i] : end[i]], digest_size=8).digest()
            out[i] = int.from_bytes(digest, "little")
        return out

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.end] - total[self.start]

    def span_bytes(self, start: int, end: int) -> bytes:
        return self._padded[start:end]


def slices(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to at most limit, or that hold a single item."""
    lo = total = 0
    for i, size in enumerate(sizes):
        if i > lo and total + size > limit:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield lo, len(sizes)


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """First row and texts of each bounded slice of an Arrow string column."""
    texts = column.to_pylist()
    for lo, hi in slices([len(t) if t else 0 for t in texts], limit):
        yield lo, texts[lo:hi]


def repeated(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the same value occurs again under the same owner, for each item."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    out = np.zeros(len(owner), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Vocabulary:
    """Encodings of distinct words by hash, in flat arrays; ``encode`` gets unseen words as bytes.

    The memory is bounded: beyond ``most`` words the table starts anew, and its generation grows: slots of
    another generation mean nothing.
    """

    generation = 0

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.generation += 1
        self.hashes = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.int32)

    def rows(self, hashes: np.ndarray, span) -> np.ndarray:
        """Slot of each hash; span(i) gives the bytes of item i."""
        uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(uniq) > self.most:
            self._clear()
        at = np.searchsorted(self.hashes, uniq)
        known = np.zeros(len(uniq), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == uniq[inside]
        fresh = np.flatnonzero(~known)
        slots = np.empty(len(uniq), np.int64)
        slots[known] = self.slot[at[known]]
        if len(fresh):
            lists = self.encode([span(i) for i in first[fresh]])
            base = len(self.bounds) - 1
            slots[fresh] = base + np.arange(len(fresh))
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, np.fromiter((x for y in lists for x in y), np.int32, int(sizes.sum()))))
            merged = np.concatenate((self.hashes, uniq[fresh]))
            order = np.argsort(merged, kind="stable")
            self.hashes, self.slot = merged[order], np.concatenate((self.slot, slots[fresh]))[order]
        return slots[inverse]

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def expand(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slots in order, and for each the index of its slot item."""
        sizes = self.bounds[slots + 1] - self.bounds[slots]
        item = np.repeat(np.arange(len(slots)), sizes)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.ids[self.bounds[slots][item] + offset], item
