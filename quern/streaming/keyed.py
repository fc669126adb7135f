"""A versioned key-value store as folds over operations, in batch and as a stream.

The operations of a key are applied in order of ``seq`` to its item (value, flags, version, expiration). A
batch is dealt by key and sorted within partitions, then folded row by row with one item in memory, so a
key with very many operations is a long task but never a large one.

Rules: get of a missing key is a miss, not an error; a set with version 0 is unconditional, with another it must
match; add fails on a present key, replace and delete on an absent one; counters are decimal text, decrement
stops at 0, and an absent counter is seeded unless its expiration says never. Versions count up from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Status texts of responses; fixed values.
OK, KEY_NOT_FOUND, KEY_EXISTS, NOT_STORED, BAD_VALUE, INVALID = "ok", "key not found", "key exists", "item not stored", "non-numeric value", "invalid arguments"
#: Names of the response codes of the wire; fixed values.
CODES = {
    0x00: "no error", 0x01: "key not found", 0x02: "key exists", 0x03: "value too large", 0x04: "invalid arguments", 0x05: "item not stored", 0x06: "non-numeric value", 0x07: "bucket of another server",
    0x08: "authentication error", 0x09: "authentication continues", 0x81: "unknown command", 0x82: "out of memory", 0x83: "not supported", 0x84: "internal error", 0x85: "busy", 0x86: "temporary failure",
}
#: Expiration that forbids seeding a counter; longest key and value in bytes.
NEVER_SEED, MAX_KEY, MAX_VALUE = 0xFFFFFFFF, 250, 1 << 20

OPERATION = "seq long, op string, key string, value binary, flags long, version long, expiration long, delta long, initial long"
STATE = "key string, value binary, flags long, version long, expiration long"
_RESULT = f"kind string, seq long, op string, status string, {STATE}"


def code_name(code: Column) -> Column:
    """Name of a response code, or what is wrong with it."""
    names = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.coalesce(names[code.cast("int")], F.concat(F.lit("invalid status: "), code.cast("string")))


def valid_key(key: Column) -> Column:
    """1 to 250 bytes without blanks, control characters or DEL."""
    return F.octet_length(key).between(1, MAX_KEY) & ~key.rlike(r"[\x00-\x20\x7f]")


def valid_value(value: Column, most: int = MAX_VALUE) -> Column:
    return value.isNotNull() & (F.octet_length(value) <= most)


def apply(item: tuple | None, op: str, value, flags, version, expiration, delta, initial) -> tuple[tuple | None, str]:
    """New item (value, flags, version, expiration) and status of one operation."""
    version, last = version or 0, item[2] if item else 0
    store = lambda v: ((v, flags or 0, last + 1, expiration or 0), OK)
    if op == "get":
        return item, OK if item else KEY_NOT_FOUND
    if op == "cas":
        op = "set" if version else "add"
    if op == "set":
        if version and not item:
            return item, KEY_NOT_FOUND
        return (item, KEY_EXISTS) if version and version != last else store(value)
    if op == "add":
        return (item, NOT_STORED) if item else store(value)
    if op == "replace":
        if not item:
            return item, NOT_STORED
        return (item, KEY_EXISTS) if version and version != last else store(value)
    if op == "delete":
        return (None, OK) if item else (item, KEY_NOT_FOUND)
    if op in ("append", "prepend"):
        if not item:
            return item, NOT_STORED
        return (item[0] + value if op == "append" else value + item[0], item[1], last + 1, item[3]), OK
    if op in ("increment", "decrement"):
        if not item:
            return (item, KEY_NOT_FOUND) if expiration == NEVER_SEED else store(str(initial or 0).encode())
        if not item[0].isdigit():
            return item, BAD_VALUE
        n = int(item[0]) + (delta or 0) if op == "increment" else max(0, int(item[0]) - (delta or 0))
        return (str(n % (1 << 64)).encode(), item[1], last + 1, item[3]), OK
    return item, INVALID


def _null(v):
    return None if v is None or v is pd.NA or v != v else v


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, item = None, None
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.key != key:
                if item is not None:
                    out.append(("state", None, None, None, key, *item))
                key, item = r.key, None
            number = [int(x) if (x := _null(v)) is not None else None for v in (r.flags, r.version, r.expiration, r.delta, r.initial)]
            value = bytes(r.value) if r.value is not None else None
            if r.op == "_held":
                item = (value, number[0], number[1], number[2])
                continue
            item, status = apply(item, r.op, value, *number)
            shown = item if status == OK and item else (None, None, 0, None)
            out.append(("response", r.seq, r.op, status, key, *shown))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])
    if item is not None:
        yield pd.DataFrame([("state", None, None, None, key, *item)], columns=[c.split()[0] for c in _RESULT.split(", ")])


def apply_operations(state: DataFrame, operations: DataFrame) -> DataFrame:
    """kind 'response' rows, one for each operation with a valid key, and kind 'state' rows, the new items."""
    held = state.selectExpr("-1L AS seq", "'_held' AS op", "key", "value", "flags", "version", "expiration", "0L AS delta", "0L AS initial")
    fine = operations.where(valid_key(F.col("key")))
    bad = operations.where(~F.coalesce(valid_key(F.col("key")), F.lit(False)))
    dealt = held.unionByName(fine.select(*held.columns)).repartition("key").sortWithinPartitions("key", "seq")
    refused = bad.select(F.lit("response").alias("kind"), "seq", "op", F.lit(INVALID).alias("status"), "key", F.lit(None).cast("binary").alias("value"), F.lit(None).cast("long").alias("flags"), F.lit(0).cast("long").alias("version"), F.lit(None).cast("long").alias("expiration"))
    return dealt.mapInPandas(_fold, _RESULT).unionByName(refused)


def stream_operations(operations: DataFrame) -> DataFrame:
    """Responses of a stream of operations; each key's item lives in the query's state store. Operations of a
    micro-batch are ordered by seq within it."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        item = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            number = [int(x) if (x := _null(v)) is not None else None for v in (r.flags, r.version, r.expiration, r.delta, r.initial)]
            item, status = apply(item, r.op, bytes(r.value) if r.value is not None else None, *number)
            shown = item if status == OK and item else (None, None, 0, None)
            out.append((r.seq, r.op, status, key[0], *shown))
        if item:
            state.update(item)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["seq", "op", "status", "key", "value", "flags", "version", "expiration"])

    held = "value binary, flags long, version long, expiration long"
    return operations.groupBy("key").applyInPandasWithState(run, f"seq long, op string, status string, {STATE}", held, "update", GroupStateTimeout.NoTimeout)


def flushed(operations: DataFrame) -> DataFrame:
    """The operations after the last flush of the store; what came before it leaves no item. One row tells the place."""
    last = operations.where("op = 'flush'").agg(F.coalesce(F.max("seq"), F.lit(-1).cast("long")).alias("_last"))
    return operations.crossJoin(F.broadcast(last)).where(F.col("seq") > F.col("_last")).drop("_last")


def get_multi(state: DataFrame, keys: DataFrame) -> DataFrame:
    """found and item for every distinct key; a miss has version 0."""
    hit = state.withColumn("_hit", F.lit(True))
    out = keys.select("key").distinct().join(hit, "key", "left")
    return out.select("key", "value", "flags", F.coalesce("version", F.lit(0)).alias("version"), "expiration", F.coalesce("_hit", F.lit(False)).alias("found"))


def read_through(cache: DataFrame, storage: DataFrame, keys: DataFrame, on: str = "key") -> tuple[DataFrame, DataFrame]:
    """Values by key, from the cache or else from storage, and the cache with what storage gave."""
    wanted = keys.select(on).distinct()
    c, s = cache.select(on, F.col("value").alias("_c"), F.lit(True).alias("_in")), storage.select(on, F.col("value").alias("_s"))
    joined = wanted.join(c, on, "left").join(s, on, "left")
    got = joined.select(on, F.coalesce("_c", "_s").alias("value"))
    fresh = joined.where(F.col("_in").isNull() & F.col("_s").isNotNull()).select(on, F.col("_s").alias("value"))
    return got, cache.select(on, "value").unionByName(fresh)


def write_through(cache: DataFrame, storage: DataFrame, changes: DataFrame, on: str = "key") -> tuple[DataFrame, DataFrame]:
    """Storage, then cache, after changes (one row a key; NULL values delete)."""
    kept = changes.where(F.col("value").isNotNull()).select(on, "value")
    return tuple(x.select(on, "value").join(changes.select(on), on, "left_anti").unionByName(kept) for x in (storage, cache))


# States of a shard; fixed values.
ACTIVE, WRITE_ONLY, DOWN, WARM_UP = "active", "write_only", "down", "warm_up"


def routed(operations: DataFrame, shards: DataFrame, shard: Column) -> DataFrame:
    """operations with shard, address and the action of the router: run, miss (reads of a shard that does not
    serve), skip (writes that succeed without effect) or unmapped. shards: shard, address, state."""
    reads = F.col("op") == "get"
    action = (
        F.when(F.col("state").isNull(), "unmapped")
        .when(F.col("state") == ACTIVE, "run")
        .when(F.col("state") == DOWN, F.when(reads, "miss").otherwise("skip"))
        .when((F.col("state").isin(WRITE_ONLY, WARM_UP)) & reads, "miss")
        .otherwise("run")
    )
    return operations.withColumn("shard", shard).join(shards, "shard", "left").withColumn("action", action)


def shard_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """address and change ('register' or 'unregister') between two shard tables."""
    add, drop = new.select("address").subtract(old.select("address")), old.select("address").subtract(new.select("address"))
    return add.withColumn("change", F.lit("register")).unionByName(drop.withColumn("change", F.lit("unregister")))
