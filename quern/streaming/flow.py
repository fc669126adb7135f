"""Flow control and assignment: token buckets, queue time-outs, hash rings and metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quern.functions.durable import checkpointed

#: Fills of a bucket in a second.
FILLS = 20


def token_bucket(requests: DataFrame, quota: float, most: float, key: str = "key", at: str = "ts", tokens: str = "tokens") -> DataFrame:
    """requests with throttled: whether the bucket of the key lacked tokens. A bucket starts full, gets quota / 20
    tokens at each twentieth of a second and holds at most `most`; a refused request takes none. Dealt by key and
    folded in order of time with one bucket in memory. A negative `most` never throttles."""
    plain = requests.drop("throttled")
    if most < 0:
        return plain.withColumn("throttled", F.lit(False))
    names = plain.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left, tick = object(), 0.0, 0
        for batch in batches:
            verdict = []
            micros = batch["_us"].tolist()
            for k, us, want in zip(batch[key].tolist(), micros, batch[tokens].tolist(), strict=True):
                here = us * FILLS // 1_000_000
                if k != now:
                    now, left, tick = k, most, here
                left, tick = min(most, left + (here - tick) * quota / FILLS), here
                verdict.append(want > left)
                left -= 0 if verdict[-1] else want
            yield batch[names].assign(throttled=verdict)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "throttled boolean"])
    return plain.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).repartition(key).sortWithinPartitions(key, at).mapInPandas(run, schema)


def expired(queue: DataFrame, now: Column, timeout_seconds: float, at: str = "enqueued") -> DataFrame:
    """queue with expired: whether an entry has waited for the time-out or longer."""
    waited = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return queue.withColumn("expired", waited >= int(timeout_seconds * 1_000_000))


def ring_lookup(keys: DataFrame, ring: DataFrame, key_hash: str = "key_hash") -> DataFrame:
    """keys with the node of the least ring position at or after their hash, or else of the least of all.

    Keys and positions are sorted together by range, so no key meets more than its own stretch of the ring:
    the next position is a window within each range, and what lies beyond a range's last position takes the
    first of the following ranges, a table of one row per range. Of nodes at one position the least counts.
    """
    spark = keys.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = ring.select(F.col("position").alias("_h"), F.lit(1).alias("_own"), F.col("node").alias("_node"))
    both = keys.withColumn("_h", F.col(key_hash)).withColumns({"_own": F.lit(0), "_node": F.lit(None).cast(ring.schema["node"].dataType)}).unionByName(nodes, allowMissingColumns=True)
    cuts = np.array(sorted(set(both.stat.approxQuantile("_h", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else [])))

    @pandas_udf("long")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series(np.where(h.isna(), 0, np.searchsorted(cuts, h.to_numpy())))

    first = nodes.withColumn("_r", place("_h")).groupBy("_r").agg(F.min_by("_node", F.struct("_h", "_node")).alias("_f"))
    every = spark.range(len(cuts) + 1).toDF("_r").join(first, "_r", "left")
    after = F.first("_f", ignorenulls=True).over(Window.orderBy("_r").rowsBetween(1, Window.unboundedFollowing))  # one row per range
    beyond = every.withColumn("_after", after).withColumn("_wrap", F.first("_f", ignorenulls=True).over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    nearest = F.last("_node", ignorenulls=True).over(Window.partitionBy("_r").orderBy(F.desc("_h"), F.desc("_own"), F.desc("_node")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_r", place("_h")).withColumn("_next", nearest).where("_own = 0").join(F.broadcast(beyond.select("_r", "_after", "_wrap")), "_r", "left")
    return found.select(*keys.columns, F.coalesce("_next", "_after", "_wrap").alias("node"))


def fixed_order(instances: DataFrame, seed: str | None = None) -> DataFrame:
    """instances by id, highest first, or by the MD5 of id and seed."""
    return instances.orderBy(F.desc("id")) if seed is None else instances.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), "id")


def round_robin(requests: DataFrame, count: int, order: Sequence[str]) -> DataFrame:
    """requests with turn: their running number in order, modulo count; numbered by range, not in one task. The
    numbered rows are checkpointed, as a range sort that runs again may cut elsewhere."""
    ranked = checkpointed(requests.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.spark_partition_id()))
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_id").alias("_lo"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    return ranked.join(F.broadcast(before), "_p").withColumn("turn", ((F.col("_id") - F.col("_lo") + F.col("_b")) % count).cast("int")).select(*requests.columns, "turn")


def nearest_nodes(keys: DataFrame, ring: DataFrame, k: int, key_hash: str = "key_hash") -> DataFrame:
    """keys with nodes: the k nodes that follow their hash on the ring, those marked down (column down) left out. Each
    node's followers are found on the ring, a table of one row per node, and looked up in its stead."""
    up = ring.where(~F.coalesce("down", F.lit(False))) if "down" in ring.columns else ring
    size = up.count()
    at = F.row_number().over(Window.orderBy("position", "node")) - 1  # the ring: as many rows as there are nodes
    placed = up.select("node", "position", at.alias("_i"))
    later = placed.select(F.col("_i").alias("_j"), F.col("node").alias("_next"))
    steps = placed.select("position", "_i", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max(min(k, size) - 1, 0))), lambda d: F.struct(d.alias("d"), ((F.col("_i") + d) % max(size, 1)).alias("_j")))).alias("s"))
    follow = steps.select("position", "_i", "s.d", "s._j").join(later, "_j").groupBy("_i", "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "_next"))), lambda x: x["_next"]).alias("node"))
    return ring_lookup(keys, follow.select("node", "position"), key_hash).withColumnRenamed("node", "nodes")


def observed(df: DataFrame, name: str, counters: dict[str, Column], summaries: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """df that counts rows where a condition holds, and sums up columns, as it runs."""
    seen = Observation(name)
    metrics = [F.count(F.when(c, 1)).alias(n) for n, c in counters.items()]
    for n, c in (summaries or {}).items():
        metrics += [F.count(c).alias(f"{n}_count"), F.sum(c).alias(f"{n}_sum"), F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max")]
    return df.observe(seen, *metrics), seen
