import random

from quern.streaming import flow, keyed

OPS = keyed.OPERATION


def _model(ops):
    """A store as a dictionary, and the statuses."""
    items, out = {}, {}
    for seq, op, key, *rest in sorted(ops):
        items[key], out[seq] = keyed.apply(items.get(key), op, *rest)
    return {k: v for k, v in items.items() if v is not None}, out


def test_replay_equals_model(spark):
    r = random.Random(5)
    kinds = ["get", "set", "cas", "add", "replace", "delete", "append", "prepend", "increment", "decrement"]
    ops = [(i, r.choice(kinds), r.choice("abcdef"), r.choice([b"7", b"x", b"10"]), 0, r.choice([0, 0, 1, 2, 3]), r.choice([0, keyed.NEVER_SEED]), 3, 5) for i in range(600)]
    got = keyed.apply_operations(spark.createDataFrame([], keyed.STATE), spark.createDataFrame(ops, OPS).repartition(5)).collect()
    items, statuses = _model(ops)
    assert {x.seq: x.status for x in got if x.kind == "response"} == statuses
    assert {x.key: (bytes(x.value), x.flags, x.version, x.expiration) for x in got if x.kind == "state"} == items


def test_contract(spark):
    ops = [(1, "set", "k", b"v", 0, 5, 0, 0, 0), (2, "add", "k", b"a", 1, 0, 0, 0, 0), (3, "add", "k", b"b", 0, 0, 0, 0, 0), (4, "set", "k", b"c", 0, 9, 0, 0, 0), (5, "decrement", "n", None, 0, 0, 0, 4, 2), (6, "decrement", "n", None, 0, 0, 0, 9, 0), (7, "get", "bad key", None, 0, 0, 0, 0, 0), (8, "add", None, b"", 0, 0, 0, 0, 0)]
    got = {x.seq: x for x in keyed.apply_operations(spark.createDataFrame([], keyed.STATE), spark.createDataFrame(ops, OPS)).collect() if x.kind == "response"}
    assert [got[i].status for i in range(1, 9)] == [keyed.KEY_NOT_FOUND, keyed.OK, keyed.NOT_STORED, keyed.KEY_EXISTS, keyed.OK, keyed.OK, keyed.INVALID, keyed.INVALID]
    assert got[2].version == 1 and bytes(got[5].value) == b"2" and bytes(got[6].value) == b"0"


def test_cache_and_shards(spark):
    kv = "key string, value string"
    cache, storage = spark.createDataFrame([("a", "1")], kv), spark.createDataFrame([("a", "9"), ("b", "2")], kv)
    got, fuller = keyed.read_through(cache, storage, spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string"))
    assert {r.key: r.value for r in got.collect()} == {"a": "1", "b": "2", "c": None}
    assert {r.key: r.value for r in fuller.collect()} == {"a": "1", "b": "2"}
    s, c = keyed.write_through(fuller, storage, spark.createDataFrame([("a", None), ("d", "4")], kv))
    assert {r.key for r in s.collect()} == {"b", "d"} == {r.key for r in c.collect()}
    from pyspark.sql import functions as F

    ops = spark.createDataFrame([(i, op) for i in range(5) for op in ("get", "set")], "n int, op string")
    shards = spark.createDataFrame([(0, "h0", "active"), (1, "h1", "write_only"), (2, "h2", "down"), (3, "h3", "warm_up")], "shard int, address string, state string")
    action = {(r.n, r.op): r.action for r in keyed.routed(ops, shards, F.col("n")).collect()}
    assert [action[(i, "get")] for i in range(5)] == ["run", "miss", "miss", "miss", "unmapped"]
    assert [action[(i, "set")] for i in range(5)] == ["run", "run", "skip", "run", "unmapped"]


def test_stream_of_operations(spark, tmp_path):
    ops = [(i, "increment", "k", b"", 0, 0, 0, 2, 0) for i in range(5)]
    spark.createDataFrame(ops, OPS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))
    q = keyed.stream_operations(stream).writeStream.format("memory").queryName("kv").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [bytes(r.value) for r in spark.table("kv").orderBy("seq").collect()] == [b"0", b"2", b"4", b"6", b"8"]


def test_token_bucket(spark):
    rows = [(k, t * 0.02 * (1 + k), 1.0) for k in range(2) for t in range(200)]
    df = spark.createDataFrame([(k, t, w) for k, t, w in rows], "key int, t double, tokens double").selectExpr("key", "timestamp_micros(CAST(t * 1000000 AS BIGINT)) AS ts", "tokens", "t")
    got = {(r.key, r.t): r.throttled for r in flow.token_bucket(df, 20.0, 5.0).collect()}
    for k in range(2):
        left, tick = 5.0, 0
        for key, t, w in rows:
            if key == k:
                now = int(t * 1_000_000) * 20 // 1_000_000
                left, tick = min(5.0, left + (now - tick) * 1.0), now
                assert got[(k, t)] == (w > left)
                left -= w if w <= left else 0
    assert not any(r.throttled for r in flow.token_bucket(df, 20.0, -1).collect())


def test_ring_and_round_robin(spark):
    r = random.Random(2)
    ring = sorted((r.randrange(10_000), f"n{i}") for i in range(40))
    keys = [(i, r.randrange(11_000)) for i in range(500)]
    got = flow.ring_lookup(spark.createDataFrame(keys, "k int, key_hash long"), spark.createDataFrame(ring, "position long, node string")).collect()
    assert len(got) == 500
    by_position = {}
    for p, n in ring:
        by_position.setdefault(p, set()).add(n)
    for x in got:
        want = min((p for p, _ in ring if p >= x.key_hash), default=ring[0][0])
        assert x.node in by_position[want]
    turns = flow.round_robin(spark.range(50).repartition(6), 4, ["id"]).orderBy("id").collect()
    assert [t.turn for t in turns] == [i % 4 for i in range(50)]


def test_observed(spark):
    from pyspark.sql import functions as F

    df, seen = flow.observed(spark.range(10), "m", {"even": F.col("id") % 2 == 0}, {"id": F.col("id")})
    df.collect()
    assert seen.get == {"even": 5, "id_count": 10, "id_sum": 45, "id_min": 0, "id_max": 9}
