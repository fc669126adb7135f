import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import collections as C
from quern.functions import hashing as H
from quern.functions import values as V


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_murmur_and_fnv_vectors(spark):
    known = {"": 0x6E9C81DC, "1": 0x09C5063B, "12": 0xFF0B3B72, "123": 0xD44872DB, "test1": 0xA09F7757, "foobar": 0xAEA81970}
    got = spark.createDataFrame([(k,) for k in [*known, None]], "k string").select("k", H.murmur3_32(F.col("k"), 0x123456).alias("h"), H.fnv1a_32(F.col("k")).alias("f"), H.fnv_shard(F.col("k"), 10).alias("s")).collect()
    assert {r.k: r.h for r in got} == {**known, None: None}
    for r in got:
        if r.k:
            h = 0x811C9DC5
            for b in r.k.encode():
                h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
            assert (r.f, r.s) == (h, h % 10)
    assert {r.k: r.s for r in got}[""] is None


def test_consistent_hash(spark):
    r = one(spark, H.consistent_hash(F.lit(0).cast("long"), 5), H.consistent_hash(F.lit(0).cast("long"), 1), H.consistent_hash(F.lit(None).cast("long"), 5))
    assert tuple(r) == (4, 0, None)
    keys = spark.range(5000)
    moved = keys.select((H.consistent_hash(F.col("id"), 20) != H.consistent_hash(F.col("id"), 21)).cast("int").alias("m")).agg(F.sum("m")).first()[0]
    assert moved < 2 * 5000 / 21


def test_multiset_digest(spark):
    words = [0xBA4DF22C, 0x0EA3B05F, 0x2A3BE826, 0x9EE2B9C5, 0x5C1E161B, 0x5E42A71F, 0x62330473, 0x24988B93]
    items = spark.createDataFrame([("hello",), (None,)], "x string")
    r = items.agg(H.digest_state(F.col("x")).alias("s")).select("s", H.state_digest(F.col("s")).alias("d"), H.digest_valid(H.state_digest(F.col("s"))).alias("v")).first()
    assert r.s == words and r.v
    assert bytes(r.d) == b"".join(w.to_bytes(4, "little") for w in words)
    rnd = random.Random(1)
    rows = [(str(rnd.random()), i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "x string, g int")
    whole = df.agg(H.digest_state(F.col("x")).alias("s")).first().s
    parts = df.groupBy("g").agg(H.digest_state(F.col("x")).alias("s"))
    assert parts.agg(H.combine_states(F.col("s")).alias("s")).first().s == whole
    less = df.where("g > 0").agg(H.digest_state(F.col("x")).alias("s")).first().s
    gone = df.where("g = 0").agg(H.digest_state(F.col("x")).alias("s")).first().s
    assert one(spark, H.subtract_states(F.array(*map(F.lit, whole)), F.array(*map(F.lit, gone))))[0] == less
    assert bytes(one(spark, H.state_digest(F.lit(None).cast("array<long>")))[0]) == bytes(32)
    assert one(spark, H.digest_valid(F.lit(b"\xff" * 32)))[0] is False


def test_md5_hex_crc(spark):
    r = one(spark, H.md5_checksum(F.lit("it just works")), H.hex_text(F.lit(b"\x01\xaf")), H.crc32_shard(F.lit("k"), 2), H.md5_matches(F.lit("a"), H.md5_checksum(F.lit("a"))))
    assert (bytes(r[0]).hex(), r[1], r[2], r[3]) == ("7170bd5a9d5348e831100f6b81ffdadc", "01af", zlib.crc32(b"k") % 2, True)


def test_numbers():
    assert (V.parse_number("0xA"), V.parse_number("012"), V.parse_number("-5"), V.parse_number("18446744073709551615")) == (10, 10, -5, 2**64 - 1)
    for bad in ("", "18446744073709551616", "-9223372036854775809", "+18446744073709551615", "x"):
        with pytest.raises(ValueError):
            V.parse_number(bad)


@given(st.integers(-(2**63), 2**64 - 1))
def test_numbers_round_trip(n):
    assert V.parse_number(str(n)) == n


def test_value_codec(spark):
    df = spark.createDataFrame([(5, 1.5, "é" * 200, b"\0x", None)], "a long, b double, c string, d binary, e string")
    enc = df.select(*(V.encoded(F.col(c)).alias(c) for c in df.columns))
    raw = enc.first()
    assert bytes(raw.c)[:3] == bytes([4, 0x90, 0x03]) and bytes(raw.e) == b"\0" and bytes(raw.a) == b"\x01\x015"
    back = enc.select(*(V.decoded(F.col(c)).alias(c) for c in df.columns)).first()
    assert [back[c]["kind"] for c in df.columns] == [1, 2, 4, 3, 0]
    assert bytes(back.c["value"]).decode() == "é" * 200 and back.e["value"] is None


def test_conversion(spark):
    df = spark.createDataFrame([("5", "x"), (None, "y")], "a string, b string")
    got = V.converted_row(df, ["int", "string"], nullable=True).collect()
    assert [(r.a, r.b) for r in got] == [(5, "x"), (None, "y")]
    with pytest.raises(Exception, match="not a int"):
        V.converted_row(df, ["int", "string"]).collect()
    with pytest.raises(ValueError):
        V.converted_row(df, ["int"])


def test_bits(spark):
    b = C.set_bit(C.set_bit(C.bits(11), 3), 9)
    r = one(spark, C.packed(b), C.is_set(b, 3), C.is_set(b, 99), C.any_set(b, 4, 8), C.any_clear(b, 3, 3), C.packed(C.bit_deleted(b, 0)), C.packed(C.bit_inserted(b, 0, True)), C.or_prefix(C.bits(3), C.set_bit(C.bits(9), 1)), C.packed(C.bits(0)))
    assert (bytes(r[0]), r[1], r[2], r[3], r[4]) == (b"\x08\x02", True, False, False, False)
    assert (bytes(r[5]), bytes(r[6]), r[7], bytes(r[8])) == (b"\x04\x01", b"\x11\x04", [False, True, False], b"")
    with pytest.raises(Exception, match="out of range"):
        one(spark, C.set_bit(C.bits(3), 3))


def test_sets_and_samples(spark):
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))
    r = one(spark, C.union(a, F.lit(None).cast("array<int>")), C.set_equal(a, F.array(F.lit(2), F.lit(1))), C.is_superset(a, b), C.added(a, F.lit(2)), C.removed(a, F.lit(1)), C.contains(a, F.lit(2)))
    assert tuple(r) == ([1, 2], True, False, [1, 2], [2], True)
    df = spark.range(100)
    chosen, rest = C.pick(df, 10, 3, ["id"])
    assert chosen.count() == 10 and rest.count() == 90 and chosen.intersect(rest).count() == 0
    assert sorted(r.id for r in C.shuffled(df, 1, ["id"]).collect()) == list(range(100))
    for k in (-1, 101):
        with pytest.raises(ValueError):
            C.sample(df, k, 1)
    recent = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 0)], "k string, t int")
    assert [r.k for r in C.most_recent(recent, "k", ["t"], 2).collect()] == ["a", "b"]
