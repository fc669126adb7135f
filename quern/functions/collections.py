"""Sets, bitmaps, extremes, samples and recency over columns and DataFrames.

Sets are arrays without repeats; bitmaps are arrays of booleans or, packed, of bytes with the lowest bit first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Largest number that zipf draws.
MOST_DRAWN = 10_000


def union(a: Column, b: Column) -> Column:
    """Null sets count as empty."""
    none = F.coalesce(a, b)
    return F.when(none.isNotNull(), F.array_union(F.coalesce(a, F.slice(none, 1, 0)), F.coalesce(b, F.slice(none, 1, 0))))


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def is_superset(a: Column, b: Column) -> Column:
    return is_subset(b, a)


def set_equal(a: Column, b: Column) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def contains(a: Column, value: Column) -> Column:
    return F.array_contains(a, value)


def added(a: Column, value: Column) -> Column:
    return F.array_distinct(F.array_append(a, value))


def removed(a: Column, value: Column) -> Column:
    return F.array_remove(a, value)


def remove_if(a: Column, condition: Callable[[Column], Column]) -> Column:
    """a without the members for which the condition holds."""
    return F.filter(a, lambda x: ~condition(x))


def each(a: Column, f: Callable[[Column], Column]) -> Column:
    """f of every member."""
    return F.transform(a, f)


def keyed_set(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last in order, combined in every task before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, *(F.col(f"_last.{c}").alias(c) for c in rest)).select(*df.columns)


def bits(n: int) -> Column:
    """n clear bits."""
    return F.array_repeat(F.lit(False), n)


def set_bit(b: Column, i: Column | int, value: bool = True) -> Column:
    """b with bit i changed; out of range is an error."""
    i = F.lit(i) if isinstance(i, int) else i
    put = F.transform(b, lambda x, at: F.when(at == i, F.lit(value)).otherwise(x))
    return F.when((i >= 0) & (i < F.size(b)), put).otherwise(F.raise_error(F.lit("bit out of range")))


def is_set(b: Column, i: Column | int) -> Column:
    """False beyond the ends."""
    return F.coalesce(F.get(b, F.lit(i) if isinstance(i, int) else i), F.lit(False))


def any_set(b: Column, lo: int, hi: int) -> Column:
    """Whether a bit of the closed range is set."""
    return F.exists(F.slice(b, lo + 1, hi - lo + 1), lambda x: x)


def any_clear(b: Column, lo: int, hi: int) -> Column:
    return F.exists(F.slice(b, lo + 1, hi - lo + 1), lambda x: ~x)


def set_range(b: Column, lo: int, hi: int, value: bool = True) -> Column:
    return F.transform(b, lambda x, at: F.when(at.between(lo, hi), F.lit(value)).otherwise(x))


def or_prefix(a: Column, b: Column) -> Column:
    """a with the bits of b on their common prefix."""
    return F.transform(a, lambda x, i: x | F.coalesce(F.get(b, i), F.lit(False)))


def bit_inserted(b: Column, i: int, value: bool) -> Column:
    return F.array_insert(b, i + 1, F.lit(value))


def bit_appended(b: Column, value: bool) -> Column:
    return F.array_append(b, F.lit(value))


def bit_deleted(b: Column, i: int) -> Column:
    return F.filter(b, lambda _, at: at != i)


def packed(b: Column) -> Column:
    """Bytes of a bit array, the first bit lowest."""
    byte = lambda at: F.aggregate(F.slice(b, at * 8 + 1, 8), F.struct(F.lit(0).alias("v"), F.lit(0).alias("n")), lambda s, x: F.struct((s["v"] + F.when(x, F.expr("1")).otherwise(0) * F.pow(F.lit(2), s["n"]).cast("int")).alias("v"), (s["n"] + 1).alias("n")))["v"]
    count = F.ceil(F.size(b) / 8).cast("int")
    return F.when(F.size(b) > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda at: F.lpad(F.hex(byte(at)), 2, "0")), ""))).otherwise(F.lit(b""))


def least_bytes(*c: Column) -> Column:
    return F.least(*c)


def greatest_bytes(*c: Column) -> Column:
    return F.greatest(*c)


def sample(df: DataFrame, k: int, seed: int, key: Sequence[str] | None = None) -> DataFrame:
    """Exactly k rows (an error if there are fewer), the k of the least seeded hashes: a top-k, not a sort of all."""
    if k < 0:
        raise ValueError("k must not be negative")
    if k > df.count():
        raise ValueError("k exceeds the rows")
    return df.orderBy(F.xxhash64(F.lit(seed), *(key or df.columns)), *(key or df.columns)).limit(k)


def pick(df: DataFrame, k: int, seed: int, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """A sample by unique key, and the rows that it leaves."""
    chosen = sample(df, k, seed, key)
    return chosen, df.join(chosen.select(*key), list(key), "left_anti")


def shuffled(df: DataFrame, seed: int, key: Sequence[str]) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key)


def jittered(c: Column, fraction: float, seed: int) -> Column:
    """c changed by a uniform share of at most fraction either way."""
    return c * (1 + fraction * (2 * F.rand(seed) - 1))


def normal(seed: int) -> Column:
    """Draws of mean 0 and deviation 1."""
    return F.randn(seed)


def exponential(seed: int) -> Column:
    """Draws of mean 1."""
    return -F.log(1 - F.rand(seed))


def zipf(s: float, v: float, most: int, seed: int) -> Column:
    """Draws of k from 0 to most with weights (v + k)^-s, s over 1 and v at least 1: the first k whose share of the
    weights reaches a uniform draw, by bisection over a table that is a literal of most + 1 numbers."""
    if s <= 1 or v < 1 or not 0 <= most <= MOST_DRAWN:
        raise ValueError(f"s must exceed 1, v be 1 at least and most lie in 0 to {MOST_DRAWN}")
    total, shares = 0.0, []
    for k in range(most + 1):
        total += (v + k) ** -s
        shares.append(total)
    table = F.array(*(F.lit(x / total) for x in shares))
    steps = F.sequence(F.lit(1), F.lit(max(most, 1).bit_length() + 1))
    first = F.struct(F.lit(0).alias("lo"), F.lit(most).alias("hi"), F.rand(seed).alias("u"))
    middle = lambda b: F.shiftright(b["lo"] + b["hi"], 1)
    low = lambda b: F.get(table, middle(b)) < b["u"]
    halved = lambda b, _: F.struct(F.when((b["lo"] < b["hi"]) & low(b), middle(b) + 1).otherwise(b["lo"]).alias("lo"), F.when((b["lo"] < b["hi"]) & ~low(b), middle(b)).otherwise(b["hi"]).alias("hi"), b["u"].alias("u"))
    return F.aggregate(steps, first, halved)["lo"]


def most_recent(accesses: DataFrame, key: str, order: Sequence[str], size: int, partition: Sequence[str] = ()) -> DataFrame:
    """What a cache of the given size holds after all accesses: the keys of the latest ones, newest first."""
    if size < 1:
        raise ValueError("size must be positive")
    last = accesses.groupBy(*partition, key).agg(F.max(F.struct(*order)).alias("_at"))
    if not partition:
        return last.orderBy(F.desc("_at")).limit(size).select(key, "_at.*")
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("_at")))
    return last.withColumn("_n", place).where(F.col("_n") <= size).select(*partition, key, "_at.*")
