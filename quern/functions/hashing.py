"""Hashes as Spark columns.

MD5, CRC and the order-independent multiset digest are built-in expressions. The 32-bit multiplicative hashes
need wrap-around arithmetic, which numpy gives per Arrow batch. Null inputs give null unless stated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Fixed values of the digest: the largest primes below 2^32, one for each word.
PRIMES = (4294967291, 4294967279, 4294967231, 4294967197, 4294967189, 4294967161, 4294967143, 4294967111)


def md5_checksum(c: Column) -> Column:
    """The 16 raw bytes."""
    return F.unhex(F.md5(c))


def md5_matches(c: Column, checksum: Column) -> Column:
    return F.md5(c) == F.lower(F.hex(checksum))


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def crc32_shard(c: Column, shards: int) -> Column:
    return (F.crc32(c.cast("binary")) % shards).cast("int")


def float_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def _murmur(data: list[bytes], seed: int) -> np.ndarray:
    """Murmur3 of 32 bits for each item: blocks of four bytes in step, then the tails."""
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    rotate = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    size = np.fromiter(map(len, data), np.int64, len(data))
    start = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(data) + b"\0\0\0\0", np.uint8)
    h = np.full(len(data), seed, np.uint32)
    word = lambda at: raw[at].astype(np.uint32) | raw[at + 1].astype(np.uint32) << 8 | raw[at + 2].astype(np.uint32) << 16 | raw[at + 3].astype(np.uint32) << 24
    with np.errstate(over="ignore"):
        for i in range(int(size.max(initial=0)) // 4):
            on = np.flatnonzero(size // 4 > i)
            k = rotate(word(start[on] + 4 * i) * c1, 15) * c2
            h[on] = rotate(h[on] ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        rest = np.flatnonzero(size % 4)
        tail = word(start[rest] + size[rest] // 4 * 4) & ((1 << 8 * (size[rest] % 4)) - 1).astype(np.uint32)
        h[rest] ^= rotate(tail * c1, 15) * c2
        h ^= size.astype(np.uint32)
        h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
        h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        return h ^ h >> np.uint32(16)


def murmur3_32(c: Column, seed: int = 0) -> Column:
    """Unsigned murmur3 of the bytes, as a long."""

    @pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        some = x.notna()
        out = pd.Series([None] * len(x), dtype="Int64")
        out[some.to_numpy()] = _murmur([bytes(v) for v in x[some]], seed).astype(np.int64)
        return out

    return run(c.cast("binary"))


def fnv1a_32(c: Column) -> Column:
    """Unsigned FNV-1a of the bytes, as a long."""

    @pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        data = [bytes(v) if v is not None else b"" for v in x]
        size = np.fromiter(map(len, data), np.int64, len(data))
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(data) or b"\0", np.uint8)
        h = np.full(len(data), 0x811C9DC5, np.uint32)
        with np.errstate(over="ignore"):
            for i in range(int(size.max(initial=0))):
                on = np.flatnonzero(size > i)
                h[on] = (h[on] ^ raw[start[on] + i]) * np.uint32(0x01000193)
        return pd.Series(h.astype(np.int64)).where(x.notna().reset_index(drop=True))

    return run(c.cast("binary"))


def fnv_shard(c: Column, shards: int) -> Column:
    """FNV-1a modulo shards; null for empty or null keys."""
    if shards <= 0:
        raise ValueError("shards must be positive")
    return F.when(F.octet_length(c) > 0, (fnv1a_32(c) % shards).cast("int"))


def _consistent(keys: np.ndarray, shards: int) -> np.ndarray:
    """Rounds of a 32-bit chain, each of two 16-bit draws; shard i takes draw mod (65535 - i), the least wins."""
    if shards < 2:
        return np.zeros(len(keys), np.int64)
    with np.errstate(over="ignore"):
        h = (keys ^ keys >> np.uint64(32)).astype(np.uint32)
        best, least = np.zeros(len(keys), np.int64), np.full(len(keys), 1 << 17, np.int64)
        live = np.ones(len(keys), bool)
        for shard in range(0, shards, 2):
            k = h * np.uint32(0xCC9E2D51)
            k = (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)
            x = np.uint32(12345) ^ k
            x = (x << np.uint32(13) | x >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
            x ^= np.uint32(4)
            x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
            h = x ^ x >> np.uint32(16)
            for i, draw in ((shard, h & np.uint32(0xFFFF)), (shard + 1, h >> np.uint32(16))):
                if i < shards:
                    position = draw.astype(np.int64) % (65535 - i)
                    better = live & (position < least)
                    least[better], best[better] = position[better], i
            live &= least > 0
    return best


def consistent_hash(key: Column, shards: int) -> Column:
    """Shard of an unsigned 64-bit key (a long's bits); stable but for 1 / n of the keys when n grows by one."""
    if not 0 <= shards <= 65535:
        raise ValueError("shards must be between 0 and 65535")

    @pandas_udf("int")
    def run(x: pd.Series) -> pd.Series:
        some = x.notna().to_numpy()
        keys = x.fillna(0).astype("int64").to_numpy().view(np.uint64)
        return pd.Series(_consistent(keys, shards)).where(some)

    return run(key.cast("long"))


def _words(c: Column) -> list[Column]:
    """The eight little-endian words of an item's SHA-256."""
    h = F.sha2(c.cast("binary"), 256)
    out = []
    for i in range(8):
        n = F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
        low, next_ = n.bitwiseAND(0xFF), F.shiftright(n, 8).bitwiseAND(0xFF)
        out.append(F.shiftleft(low, 24) + F.shiftleft(next_, 16) + F.shiftright(n, 16).bitwiseAND(0xFF) * 256 + F.shiftright(n, 24))
    return out


def digest_state(c: Column, sign: Column | int = 1) -> Column:
    """Aggregate: the order-independent state of a multiset, eight words each modulo its prime; sign -1 removes an
    item. Sums are exact, so partial states of any partitioning add up alike: each word's upper and lower 16 bits are
    summed by themselves, as longs, for up to 2^46 rows. A null item is null in all of them, without a condition, so
    that Spark computes an item's hash once for all sums."""
    weight = sign if isinstance(sign, Column) else F.lit(sign)
    out = []
    for w, p in zip(_words(c), PRIMES, strict=True):
        x, prime = w % p * weight, F.lit(p).cast("long")
        high, low = (F.coalesce(F.sum(part), F.lit(0).cast("long")) for part in (F.shiftright(x, 16), x.bitwiseAND(0xFFFF)))
        out.append(F.pmod(F.pmod(high, prime) * 65536 + F.pmod(low, prime), prime))
    return F.array(*out)


def combine_states(state: Column) -> Column:
    """Aggregate: the state of the union of the multisets."""
    return F.array(*(F.pmod(F.coalesce(F.sum(state[i].cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")), F.lit(p).cast("decimal(20,0)")).cast("long") for i, p in enumerate(PRIMES)))


def subtract_states(a: Column, b: Column) -> Column:
    """The state of a without b; a null state is that of the empty multiset."""
    some = lambda w: F.coalesce(w, F.lit(0).cast("long"))
    return F.array(*(F.pmod(some(a[i]) - some(b[i]), F.lit(p).cast("long")) for i, p in enumerate(PRIMES)))


def state_digest(state: Column) -> Column:
    """32 bytes, little-endian words; of a null state 32 zero bytes."""
    words = F.transform(state, lambda w: F.concat(*(F.substring(F.lpad(F.hex(w), 8, "0"), 7 - 2 * b, 2) for b in range(4))))
    return F.coalesce(F.unhex(F.array_join(words, "")), F.lit(bytes(32)))


def digest_valid(digest: Column) -> Column:
    """Whether 32 bytes are a state: every word below its prime."""
    ok = F.octet_length(digest) == 32
    for i, p in enumerate(PRIMES):
        h = F.hex(digest)
        word = F.conv(F.concat(*(F.substring(h, 8 * i + 7 - 2 * b, 2) for b in range(4))), 16, 10).cast("long")
        ok = ok & (word < p)
    return ok
