"""Queries over functions, change logs, the keyed store and flow control, with their SQL."""

from __future__ import annotations

import datetime as dt
import hashlib
import struct
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions import collections as C
from quern.functions import hashing as H
from quern.functions import values as V
from quern.operators import expressions as E
from quern.operators import statements as S
from quern.operators.tables import Parquet
from quern.plans.schema import CUSTOMER, NATION, ORDERS, PART, REGION, SUPPLIER
from quern.sources import binlog
from quern.sources.logwriter import LogWriter
from quern.streaming import flow, keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _statement(name: str, statement, sql: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = (lambda spark, d: statement.frame(Parquet(spark, d))), sql


# Statements.

_statement(
    "typed_literals",
    S.select(
        REGION, REGION.r_regionkey, E.Literal(True).alias("b"), E.Literal(-7).alias("i"), E.Literal(1.5).alias("f"), E.Literal("it's 100%").alias("s"), E.Literal(dt.datetime(1999, 1, 2, 3, 4, 5, 678)).alias("d"),
        E.Func("hex", b"\x01\xab").alias("x"), E.Literal(Decimal("12.50")).alias("m"),
    ),
    "SELECT r_regionkey, true AS b, -7::BIGINT AS i, 1.5::DOUBLE AS f, 'it''s 100%' AS s, TIMESTAMP '1999-01-02 03:04:05.000678' AS d, '01AB' AS x, 12.50::DECIMAL(4,2) AS m FROM region",
)
_statement("zero_arguments", S.select(REGION, REGION.r_name, E.Func("round", E.Func("pi"), 6).alias("pi")), "SELECT r_name, round(pi(), 6) AS pi FROM region")
_base = S.select(ORDERS, ORDERS.o_orderkey).where(E.gt(ORDERS.o_totalprice, 200000.0))
_statement("statement_copies", S.union_all(_base.and_where(E.eq(ORDERS.o_orderstatus, "F")).comment("one"), _base.and_where(E.neq(ORDERS.o_orderstatus, "F")).for_update()), "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
_statement(
    "join_nested_right",
    S.select(REGION.inner_join(NATION.left_join(SUPPLIER, E.eq(NATION.n_nationkey, SUPPLIER.s_nationkey)), E.eq(REGION.r_regionkey, NATION.n_regionkey)), REGION.r_name, NATION.n_name, SUPPLIER.s_suppkey),
    "SELECT r_name, n_name, s_suppkey FROM region JOIN (nation LEFT JOIN supplier ON n_nationkey = s_nationkey) ON r_regionkey = n_regionkey",
)
_statement("union_single", S.union(S.select(CUSTOMER, CUSTOMER.c_mktsegment.alias("k"))).where(E.neq(E.ColumnRef(None, "k"), "BUILDING")), "SELECT c_mktsegment AS k FROM customer WHERE c_mktsegment <> 'BUILDING'")
_statement("literal_forms", S.select(PART, PART.p_partkey).where(E.or_(E.like(PART.p_brand, "Brand%"), E.regexp(PART.p_type, "^[A-M]"), E.In(PART.p_size, [1, 2, 3]))).and_where(E.lte(PART.p_size, 40)), "SELECT p_partkey FROM part WHERE (p_brand LIKE 'Brand%' OR regexp_matches(p_type, '^[A-M]') OR p_size IN (1, 2, 3)) AND p_size <= 40")


# Hashes and digests.

_BYTES = "list_transform(range(strlen({0})), lambda i: ascii(substr({0}, CAST(i AS INTEGER) + 1, 1))::UBIGINT)"
_M = 0xFFFFFFFF


def _rotated(x: str, r: int) -> str:
    return f"(((({x}) << {r}) | (({x}) >> {32 - r})) & {_M})"


def murmur_sql(column: str, seed: int) -> str:
    """Murmur3 of 32 bits over ASCII text, in steps of unsigned 64-bit numbers."""
    scrambled = lambda w: f"(({_rotated(f'(({w}) * {0xCC9E2D51}) & {_M}', 15)} * {0x1B873593}) & {_M})"
    block = f"(({_rotated(f'xor(h, {scrambled("w")})', 13)} * 5 + {0xE6546B64}) & {_M})"
    words = "list_transform(range(len(b) // 4), lambda i: b[4*i+1] + b[4*i+2] * 256 + b[4*i+3] * 65536 + b[4*i+4] * 16777216)"
    rest = "coalesce(b[len(b) // 4 * 4 + 1], 0) + coalesce(b[len(b) // 4 * 4 + 2], 0) * 256 + coalesce(b[len(b) // 4 * 4 + 3], 0) * 65536"
    steps = [
        ("h0", f"list_reduce(list_prepend({seed}::UBIGINT, {words}), lambda h, w: {block})"), ("h1", f"CASE WHEN len(b) % 4 > 0 THEN xor(h0, {scrambled(rest)}) ELSE h0 END"), ("h2", "xor(h1, len(b)::UBIGINT)"),
        ("h3", "xor(h2, h2 >> 16)"), ("h4", f"(h3 * {0x85EBCA6B}) & {_M}"), ("h5", "xor(h4, h4 >> 13)"), ("h6", f"(h5 * {0xC2B2AE35}) & {_M}"), ("h7", "xor(h6, h6 >> 16)"),
    ]
    inner = f"SELECT *, {_BYTES.format(column)} AS b FROM part"
    for name, e in steps:
        inner = f"SELECT *, ({e})::UBIGINT AS {name} FROM ({inner})"
    return inner


@_query(f"SELECT p_partkey, CAST(h7 AS BIGINT) AS h FROM ({murmur_sql('p_name', 0x123456)})")
def murmur3_text(spark, d):
    return Parquet(spark, d)["part"].select("p_partkey", H.murmur3_32(F.col("p_name"), 0x123456).alias("h"))


_FNV_SQL = f"list_reduce(list_prepend(2166136261::UBIGINT, {_BYTES.format('p_name')}), lambda h, b: (xor(h, b) * 16777619) & {_M})"


@_query(f"SELECT p_partkey, CAST({_FNV_SQL} AS BIGINT) AS h, CAST({_FNV_SQL} % 7 AS INTEGER) AS shard FROM part")
def fnv_text(spark, d):
    return Parquet(spark, d)["part"].select("p_partkey", H.fnv1a_32(F.col("p_name")).alias("h"), H.fnv_shard(F.col("p_name"), 7).alias("shard"))


@_query("SELECT event_id, epoch(ts) AS seconds FROM events")
def float_seconds(spark, d):
    return Parquet(spark, d)["events"].select("event_id", H.float_seconds(F.col("ts")).alias("seconds"))


@_query("SELECT doc_id, doc_id % 3 <> 0 OR lang = text AS fits FROM documents")
def md5_validate(spark, d):
    t = Parquet(spark, d)["documents"]
    return t.select("doc_id", H.md5_matches(F.col("text"), H.md5_checksum(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.col("text")))).alias("fits"))


def _words_sql(source: str, group: str = "g") -> str:
    le = lambda i: " || ".join(f"substr(h, {8 * i + 2 * b + 1}, 2)" for b in (3, 2, 1, 0))
    words = [f"CAST(sum(CAST(concat('0x', {le(i)}) AS BIGINT) % {p}) % {p} AS BIGINT) AS w{i}" for i, p in enumerate(H.PRIMES)]
    return f"SELECT {group}, {', '.join(words)} FROM (SELECT *, sha256(x) AS h FROM ({source})) GROUP BY {group}"


_HEX = " || ".join(f"printf('%02x%02x%02x%02x', w{i} & 255, (w{i} >> 8) & 255, (w{i} >> 16) & 255, (w{i} >> 24) & 255)" for i in range(8))


@_query(f"SELECT g, {_HEX} AS digest, true AS valid FROM ({_words_sql('SELECT lang AS g, text AS x FROM documents')})")
def digest_combine(spark, d):
    """States by source, combined by language, as the 32 bytes of the digest."""
    t = Parquet(spark, d)["documents"]
    parts = t.groupBy("lang", "source").agg(H.digest_state(F.col("text")).alias("s"))
    whole = parts.groupBy(F.col("lang").alias("g")).agg(H.combine_states(F.col("s")).alias("s"))
    digest = H.state_digest(F.col("s"))
    return whole.select("g", H.hex_text(digest).alias("digest"), H.digest_valid(digest).alias("valid"))


_STATUS_SQL = "SELECT o_orderpriority AS g, CAST(o_orderkey AS VARCHAR) AS x FROM orders WHERE o_orderstatus <> 'F'"


@_query(f"SELECT g, {_HEX} AS digest FROM ({_words_sql(_STATUS_SQL)})")
def digest_subtract(spark, d):
    t = Parquet(spark, d)["orders"].select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").cast("string").alias("x"), "o_orderstatus")
    every = t.groupBy("g").agg(H.digest_state(F.col("x")).alias("s"))
    gone = t.where("o_orderstatus = 'F'").groupBy("g").agg(H.digest_state(F.col("x")).alias("less"))
    return every.join(gone, "g", "left").select("g", H.hex_text(H.state_digest(H.subtract_states(F.col("s"), F.col("less")))).alias("digest"))


@_query("SELECT r_name, repeat('0', 64) AS digest FROM region")
def digest_empty(spark, d):
    """A null state digests as the empty multiset does."""
    return Parquet(spark, d)["region"].select("r_name", H.hex_text(H.state_digest(F.lit(None).cast("array<bigint>"))).alias("digest"))


# Values.


@_query("SELECT c_custkey, '04' || printf('%02X', strlen(c_name)) || hex(encode(c_name)) AS name, '01' || printf('%02X', strlen(CAST(c_custkey AS VARCHAR))) || hex(encode(CAST(c_custkey AS VARCHAR))) AS number, '00' AS nothing FROM customer")
def value_codec(spark, d):
    hex_ = lambda c: F.hex(V.encoded(c))
    return Parquet(spark, d)["customer"].select("c_custkey", hex_(F.col("c_name")).alias("name"), hex_(F.col("c_custkey")).alias("number"), hex_(F.lit(None).cast("string")).alias("nothing"))


@_query("SELECT doc_id, 4 AS kind, text AS value FROM documents")
def value_round_trip(spark, d):
    t = Parquet(spark, d)["documents"].select("doc_id", V.decoded(V.encoded(F.col("text"))).alias("v"))
    return t.select("doc_id", "v.kind", F.col("v.value").cast("string").alias("value"))


@_query("SELECT c_custkey, 1 AS a, 2 AS b, 4 AS c, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 4 END AS d FROM customer")
def value_kinds(spark, d):
    t = Parquet(spark, d)["customer"]
    return t.select("c_custkey", V.kind_of(F.col("c_custkey")).alias("a"), V.kind_of(F.col("c_acctbal")).alias("b"), V.kind_of(F.col("c_name")).alias("c"), V.kind_of(F.when(F.col("c_custkey") % 2 != 0, F.col("c_name"))).alias("d"))


@_query("SELECT o_orderkey, CAST(o_custkey % 100 AS TINYINT) AS small, o_custkey <> 7 AS flag, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS maybe FROM orders")
def value_conversion(spark, d):
    text = F.col("o_custkey").cast("string")
    t = Parquet(spark, d)["orders"]
    return t.select(
        "o_orderkey", V.converted((F.col("o_custkey") % 100).cast("string"), "tinyint").alias("small"), V.converted((F.col("o_custkey") - 7).cast("string"), "boolean").alias("flag"),
        V.converted(F.when(F.col("o_orderkey") % 2 == 0, text), "bigint", nullable=True).alias("maybe"),
    )


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -5 END AS k FROM orders")
def default_conversion(spark, d):
    given = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string"))
    return Parquet(spark, d)["orders"].select("o_orderkey", V.converted_or(given, "bigint", F.lit(-5)).alias("k"))


@_query("SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS balance FROM customer")
def row_conversion(spark, d):
    t = Parquet(spark, d)["customer"].select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_acctbal").cast("string").alias("balance"))
    return V.converted_row(t, ["bigint", "int", "double"])


@_query("SELECT p_partkey, chr(39) || base64(encode(p_name)) || chr(39) AS shown FROM part")
def ascii_encoding(spark, d):
    return Parquet(spark, d)["part"].select("p_partkey", V.encode_ascii(F.col("p_name")).alias("shown"))


# Sets, bits, samples.

_SETS_SQL = "SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 7)) AS a, list_sort(list(DISTINCT o_orderkey % 5)) AS b FROM orders GROUP BY o_custkey"


def _sets(spark, d):
    t = Parquet(spark, d)["orders"]
    return t.groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 7).alias("a"), F.collect_set(F.col("o_orderkey") % 5).alias("b"))


@_query(
    f"SELECT o_custkey, list_contains(a, 3) AS has, list_sort(list_distinct(list_append(a, 9))) AS more, list_filter(a, lambda x: x <> 3) AS less, len(a) AS n, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS over, "
    f"a = b AS same, list_filter(a, lambda x: x % 2 = 1) AS odd, list_transform(a, lambda x: x * 10) AS each FROM ({_SETS_SQL})"
)
def set_edits(spark, d):
    a, b = F.col("a"), F.col("b")
    return _sets(spark, d).select(
        "o_custkey", C.contains(a, F.lit(3).cast("long")).alias("has"), F.array_sort(C.added(a, F.lit(9).cast("long"))).alias("more"), F.array_sort(C.removed(a, F.lit(3).cast("long"))).alias("less"), F.size(a).cast("long").alias("n"),
        C.is_superset(a, b).alias("over"), C.set_equal(a, b).alias("same"), F.array_sort(C.remove_if(a, lambda x: x % 2 != 1)).alias("odd"), F.array_sort(C.each(a, lambda x: x * 10)).alias("each"),
    )


_BITS_SQL = "SELECT p_partkey, list_transform(range(10), lambda i: (p_partkey >> CAST(i AS INTEGER)) & 1 = 1) AS b FROM part"


@_query(
    f"SELECT p_partkey, list_transform(range(10), lambda i: CASE WHEN i = 4 THEN true ELSE b[i + 1] END) AS changed, b[6] AS fifth, false AS beyond, list_contains(b[3:6], false) AS gap, list_transform(range(10), lambda i: b[i + 1] OR i < 2) AS joined, "
    f"list_concat(b[1:2], [true], b[3:10]) AS put, list_concat(b[1:2], b[4:10]) AS cut, printf('%02X%02X', p_partkey & 255, (p_partkey >> 8) & 3) AS bytes, list_append(b, true) AS longer FROM ({_BITS_SQL})"
)
def bit_vectors(spark, d):
    bits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.col("p_partkey").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
    t = Parquet(spark, d)["part"].select("p_partkey", bits.alias("b"))
    b = F.col("b")
    return t.select(
        "p_partkey", C.set_bit(b, 4).alias("changed"), C.is_set(b, 5).alias("fifth"), C.is_set(b, 99).alias("beyond"), C.any_clear(b, 2, 5).alias("gap"), C.or_prefix(b, F.array(F.lit(True), F.lit(True))).alias("joined"),
        C.bit_inserted(b, 2, True).alias("put"), C.bit_deleted(b, 2).alias("cut"), F.hex(C.packed(b)).alias("bytes"), C.bit_appended(b, True).alias("longer"),
    )


@_query("SELECT p_partkey, least(p_name, p_brand, p_type) AS lo, greatest(p_name, p_brand, p_type) AS hi FROM part")
def byte_extremes(spark, d):
    three = [F.col(c) for c in ("p_name", "p_brand", "p_type")]
    return Parquet(spark, d)["part"].select("p_partkey", C.least_bytes(*three).alias("lo"), C.greatest_bytes(*three).alias("hi"))


@_query("SELECT 100::BIGINT AS picked, count(*) - 100 AS rest, 0::BIGINT AS both, count(*) AS every FROM orders")
def sample_and_rest(spark, d):
    """A sample has its size, shares no row with the rest, and together they are the table."""
    t = Parquet(spark, d)["orders"].select("o_orderkey")
    chosen, rest = C.pick(t, 100, 7, ["o_orderkey"])
    sizes = chosen.agg(F.count("*").alias("picked")).crossJoin(rest.agg(F.count("*").alias("rest"))).crossJoin(chosen.join(rest, "o_orderkey").agg(F.count("*").alias("both")))  # single rows
    return sizes.crossJoin(C.shuffled(t, 3, ["o_orderkey"]).agg(F.count_distinct("o_orderkey").alias("every")))


@_query("SELECT event_id, true AS inside FROM events")
def jitter(spark, d):
    t = Parquet(spark, d)["events"].select("event_id", F.lit(100.0).alias("x"))
    return t.select("event_id", C.jittered(F.col("x"), 0.25, 5).between(75, 125).alias("inside"))


@_query("SELECT true AS normal_mean, true AS normal_spread, true AS exponential_mean, true AS zipf_first, true AS zipf_range, count(*) AS n FROM lineitem")
def random_draws(spark, d):
    """Means and shares of seeded draws lie within six standard errors of what they should be."""
    t = Parquet(spark, d)["lineitem"].select(C.normal(1).alias("g"), C.exponential(2).alias("e"), C.zipf(2.0, 1.0, 99, 3).alias("z"))
    near = lambda c, want, spread: F.abs(c - want) <= 6 * spread / F.sqrt(F.count("*"))
    first = 1 / sum((1 + k) ** -2.0 for k in range(100))
    return t.agg(
        near(F.avg("g"), 0.0, 1.0).alias("normal_mean"), near(F.avg(F.col("g") * F.col("g")), 1.0, 2.0**0.5).alias("normal_spread"), near(F.avg("e"), 1.0, 1.0).alias("exponential_mean"),
        near(F.avg((F.col("z") == 0).cast("double")), first, 0.5).alias("zipf_first"), ((F.min("z") >= 0) & (F.max("z") <= 99)).alias("zipf_range"), F.count("*").alias("n"),
    )


# Change logs. Each row of a table is written as a log file of its own, in tasks that rows are dealt to by their first
# column, as the table may lie in one piece. Their number is given: rows are small beside the work on them, and by
# their bytes adaptive execution would put them into a few tasks.

_FILES = "path string, content binary"


def _logs(rows: DataFrame, write: Callable[[LogWriter, tuple], None], name: Callable[[tuple], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = LogWriter(checksum=row[0] % 2 == 0)
                write(w, row)
                paths.append(name(row))
                contents.append(bytes(w.data))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])

    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, rows.columns[0]).mapInArrow(run, _FILES)


def _customer_events(spark, d, *types: int, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The events of a log file of each customer, of the given types or all, with the given columns or all."""

    def write(w: LogWriter, row: tuple) -> None:
        key, segment = row
        w.previous_gtids({hashlib.md5(str(key).encode()).digest(): [(1, key + 1)]})
        w.gtid(hashlib.md5(str(key).encode()).digest(), key)
        w.query("db", f"touch {key}", b"\1" + struct.pack("<Q", key) + b"\5\3UTC" + b"\x0c\2a\0b\0")
        w.rows_query(f"row {segment}")
        w.xid(key * 3)
        w.rotate(f"log.{key + 1 + key % 2:06d}", 4)
        w.stop()

    rows = Parquet(spark, d)["customer"].select("c_custkey", "c_mktsegment")
    return binlog.events_of(_logs(rows, write, lambda row: f"log.{row[0]:06d}"), types=types or None, columns=columns)


_LOG = "printf('log.%06d', c_custkey)"
_SID = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12)"


@_query("SELECT unnest(['FORMAT_DESCRIPTION', 'PREVIOUS_GTIDS', 'GTID', 'QUERY', 'ROWS_QUERY', 'XID', 'ROTATE', 'STOP']) AS name, count(*) AS n FROM customer")
def log_event_types(spark, d):
    return _customer_events(spark, d, columns=("file", "type")).groupBy(binlog.event_name(F.col("type")).alias("name")).agg(F.count("*").alias("n"))


@_query(f"SELECT {_LOG} AS file, 7::BIGINT AS thread_id, 'db' AS database, 'touch ' || CAST(c_custkey AS VARCHAR) AS statement FROM customer")
def log_queries(spark, d):
    return binlog.queries(_customer_events(spark, d, binlog.QUERY)).select("file", "thread_id", "database", "statement")


@_query(f"SELECT {_LOG} AS file, c_custkey AS sql_mode, 'UTC' AS time_zone, ['a', 'b'] AS updated_databases, c_custkey & 4 <> 0 AS third, CAST(NULL AS VARCHAR) AS error FROM customer")
def log_query_status(spark, d):
    got = binlog.query_status(_customer_events(spark, d, binlog.QUERY))
    return got.select("file", F.col("sql_mode").cast("long").alias("sql_mode"), "time_zone", "updated_databases", binlog.mode_enabled(F.col("sql_mode"), 2).alias("third"), "error")


@_query(f"SELECT {_LOG} AS file, true AS commit, {_SID} AS sid, c_custkey AS number FROM (SELECT *, md5(CAST(c_custkey AS VARCHAR)) AS m FROM customer)")
def log_gtids(spark, d):
    return binlog.gtids(_customer_events(spark, d, binlog.GTID)).where("error is null").select("file", "commit", "sid", F.col("number").cast("long").alias("number"))


@_query(f"SELECT {_LOG} AS file, md5(CAST(c_custkey AS VARCHAR)) AS sid, 1::BIGINT AS first, c_custkey + 1 AS last FROM customer")
def log_previous_gtids(spark, d):
    return binlog.previous_gtids(_customer_events(spark, d, binlog.PREVIOUS_GTIDS)).where("error is null").select("file", "sid", "first", "last")


@_query(f"SELECT {_LOG} AS file, c_custkey * 3 AS xid FROM customer")
def log_transactions(spark, d):
    return binlog.transactions(_customer_events(spark, d, binlog.XID)).select("file", F.col("xid").cast("long").alias("xid"))


@_query(f"SELECT {_LOG} AS file, 'row ' || c_mktsegment AS statement FROM customer")
def log_row_queries(spark, d):
    return binlog.row_queries(_customer_events(spark, d, binlog.ROWS_QUERY)).select("file", "statement")


@_query(f"SELECT {_LOG} AS file, printf('log.%06d', c_custkey + 1 + c_custkey % 2) AS new_file, 4::BIGINT AS new_position, CASE WHEN c_custkey % 2 = 1 THEN 'not the next file' END AS error FROM customer")
def log_rotations(spark, d):
    return binlog.checked_rotations(_customer_events(spark, d), "log.").select("file", "new_file", "new_position", "error")


@_query("SELECT count(*) * 6 AS n FROM customer")
def log_relayed(spark, d):
    return binlog.relayed(_customer_events(spark, d)).agg(F.count("*").alias("n"))


@_query(
    "SELECT printf('log.%06d', n_nationkey) AS file, 4 AS version, '5.6.20-log' AS server, CASE WHEN n_nationkey % 3 = 1 THEN 21 ELSE 19 END AS header_size, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END AS checksum, "
    "CASE n_nationkey % 3 WHEN 1 THEN 'headers have extra bytes' WHEN 2 THEN 'TABLE_MAP has a fixed size other than 8' END AS error FROM nation"
)
def log_formats(spark, d):
    """Format events of which some have wrong sizes; the last of each file."""

    def write(w: LogWriter, row: tuple) -> None:
        w.format(w.checksum, **[{}, {"header": 21}, {f"t{binlog.TABLE_MAP}": 7}][row[0] % 3])

    events = binlog.events_of(_logs(Parquet(spark, d)["nation"].select("n_nationkey"), write, lambda row: f"log.{row[0]:06d}"))
    last = F.max_by(F.struct("version", "server", "header_size", "checksum", "error"), "position").alias("l")
    return binlog.formats(events).groupBy("file").agg(last).select("file", "l.*")


@_query("SELECT s_suppkey, s_name, s_acctbal, s_nationkey - 12 AS shifted FROM supplier")
def log_typed_rows(spark, d):
    """Suppliers as inserted rows, in version 1 or 2 with extra information, numbers read as signed."""

    def write(w: LogWriter, row: tuple) -> None:
        key, name, balance, nation = row
        text = name.encode()
        w.table_map(1, "db", "supplier", [8, 15, 5, 1], (200).to_bytes(2, "little") + b"\x08", [False] * 4)
        w.rows([binlog.WRITE_V1, binlog.WRITE_V2][key % 2], 1, 4, [([False] * 4, struct.pack("<Q", key) + bytes([len(text)]) + text + struct.pack("<dB", balance, (nation - 12) % 256))], b"\0\5foo" if key % 2 else b"")

    rows = Parquet(spark, d)["supplier"].select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    log = binlog.changes(binlog.events_of(_logs(rows, write, lambda row: f"log.{row[0]:06d}")), "FAILFAST")
    return log.select(*binlog.typed(F.col("after"), StructType.fromDDL("s_suppkey bigint, s_name string, s_acctbal double, shifted int"), {"shifted": 8}))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'deleted' WHEN c_custkey % 4 = 1 THEN 'renamed' ELSE c_name END AS c_name, upper(['insert', 'update', 'delete'][CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END]) AS last FROM customer")
def log_operations(spark, d):
    """The last operation on each customer, by the images before and after it."""

    def write(w: LogWriter, row: tuple) -> None:
        key, name = row
        image = lambda n: ([False, False], struct.pack("<I", key) + bytes([len(n)]) + n.encode())
        w.table_map(3, "db", "customer", [3, 15], (200).to_bytes(2, "little"), [False, True])
        w.rows(binlog.WRITE_V2, 3, 2, [image(name)])
        if key % 4 < 2:
            w.rows(binlog.UPDATE_V1, 3, 2, [image(name), image(["deleted", "renamed"][key % 4])])
        if key % 4 == 0:
            w.rows(binlog.DELETE_V2, 3, 2, [image("deleted")])

    log = binlog.changes(binlog.events_of(_logs(Parquet(spark, d)["customer"].select("c_custkey", "c_name"), write, lambda row: f"log.{row[0]:06d}")), "FAILFAST")
    last = log.groupBy("file").agg(F.max_by(F.struct("before", "after", "operation"), F.struct("position", "row")).alias("l"))
    image = F.coalesce("l.after", "l.before")
    return last.select(image[0].cast("long").alias("c_custkey"), image[1].alias("c_name"), F.upper("l.operation").alias("last"))


# Keyed store.


def _operations(spark, d, ops: tuple[str, ...]) -> DataFrame:
    e = Parquet(spark, d)["events"]
    op = F.element_at(F.array(*map(F.lit, ops)), (F.col("event_id") % len(ops) + 1).cast("int"))
    number = lambda n: F.lit(n).cast("long")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("u"), F.col("user_id")).alias("key"), F.col("event_type").cast("binary").alias("value"), number(3).alias("flags"), number(0).alias("version"), number(0).alias("expiration"), (F.col("event_id") % 10).alias("delta"), number(5).alias("initial"))


def _fold_sql(ops: tuple[str, ...], item: str, version: str, status: str, start: str = "NULL::VARCHAR") -> str:
    """The operations of each key one after another: item and version before each, then what it does."""
    names = ", ".join(f"'{o}'" for o in ops)
    return (
        f"WITH RECURSIVE given AS (SELECT event_id AS seq, [{names}][event_id % {len(ops)} + 1] AS op, concat('u', user_id) AS key, event_type AS value, event_id % 10 AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), "
        f"fold AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS op, {start} AS item, 0::BIGINT AS version, NULL::VARCHAR AS status FROM given WHERE n = 1 UNION ALL "
        f"SELECT g.key, g.n, g.seq, g.op, {item}, {version}, {status} FROM fold f JOIN given g ON g.key = f.key AND g.n = f.n + 1) "
    )


_KV = ("set", "get", "add", "replace", "delete", "append", "prepend", "cas")
_HAS = "f.item IS NOT NULL"
_ITEM = (
    f"CASE WHEN g.op = 'set' OR (g.op IN ('add', 'cas') AND NOT {_HAS}) OR (g.op = 'replace' AND {_HAS}) THEN g.value WHEN g.op = 'delete' THEN NULL "
    f"WHEN g.op = 'append' AND {_HAS} THEN f.item || g.value WHEN g.op = 'prepend' AND {_HAS} THEN g.value || f.item ELSE f.item END"
)
_VERSION = f"CASE WHEN g.op = 'delete' THEN 0 WHEN g.op = 'set' OR (g.op IN ('add', 'cas') AND NOT {_HAS}) OR (g.op IN ('replace', 'append', 'prepend') AND {_HAS}) THEN f.version + 1 ELSE f.version END"
_STATUS = f"CASE WHEN g.op IN ('get', 'delete') THEN CASE WHEN {_HAS} THEN 'ok' ELSE 'key not found' END WHEN g.op IN ('add', 'cas') THEN CASE WHEN {_HAS} THEN 'item not stored' ELSE 'ok' END WHEN g.op = 'set' OR {_HAS} THEN 'ok' ELSE 'item not stored' END"


@_query(_fold_sql(_KV, _ITEM, _VERSION, _STATUS) + "SELECT seq, op, key, status, CASE WHEN status = 'ok' THEN item END AS value, CASE WHEN status = 'ok' THEN version ELSE 0 END AS version FROM fold WHERE n > 0")
def kv_responses(spark, d):
    done = keyed.apply_operations(spark.createDataFrame([], keyed.STATE), _operations(spark, d, _KV))
    return done.where("kind = 'response'").select("seq", "op", "key", "status", F.col("value").cast("string").alias("value"), "version")


@_query(_fold_sql(_KV, _ITEM, _VERSION, _STATUS) + "SELECT key, arg_max(item, n) AS value, arg_max(version, n) AS version FROM (SELECT key, n, coalesce(item, '') AS item, version, item IS NULL AS gone FROM fold) GROUP BY key HAVING NOT arg_max(gone, n)")
def kv_state(spark, d):
    done = keyed.apply_operations(spark.createDataFrame([], keyed.STATE), _operations(spark, d, _KV))
    return done.where("kind = 'state'").select("key", F.col("value").cast("string").alias("value"), "version")


_COUNT = ("increment", "increment", "decrement", "get")
_SUM = "CASE WHEN g.op = 'get' THEN f.item WHEN f.item IS NULL THEN '5' WHEN g.op = 'increment' THEN CAST(CAST(f.item AS BIGINT) + g.delta AS VARCHAR) ELSE CAST(greatest(0, CAST(f.item AS BIGINT) - g.delta) AS VARCHAR) END"


@_query(_fold_sql(_COUNT, _SUM, "f.version + CASE WHEN g.op = 'get' THEN 0 ELSE 1 END", "CASE WHEN g.op = 'get' AND f.item IS NULL THEN 'key not found' ELSE 'ok' END") + "SELECT seq, op, key, status, item AS value, version FROM fold WHERE n > 0")
def kv_counters(spark, d):
    done = keyed.apply_operations(spark.createDataFrame([], keyed.STATE), _operations(spark, d, _COUNT))
    return done.where("kind = 'response'").select("seq", "op", "key", "status", F.col("value").cast("string").alias("value"), "version")


@_query("SELECT concat('c', o_custkey) AS key, CASE WHEN o_custkey % 2 = 0 THEN c_name END AS value, o_custkey % 2 = 0 AS found, CASE WHEN o_custkey % 2 = 0 THEN 4 ELSE 0 END::BIGINT AS version FROM (SELECT DISTINCT o_custkey FROM orders) JOIN customer ON o_custkey = c_custkey")
def kv_get_multi(spark, d):
    t = Parquet(spark, d)
    state = t["customer"].where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("key"), F.col("c_name").cast("binary").alias("value"), F.lit(0).cast("long").alias("flags"), F.lit(4).cast("long").alias("version"), F.lit(0).cast("long").alias("expiration"))
    got = keyed.get_multi(state, t["orders"].select(F.concat(F.lit("c"), "o_custkey").alias("key")))
    return got.select("key", F.col("value").cast("string").alias("value"), "found", "version")


@_query("SELECT 'cache' AS place, concat('c', c_custkey) AS key, CASE WHEN c_custkey % 3 = 1 THEN 'new' ELSE c_name END AS value FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 3 = 1 OR c_custkey % 2 = 0) UNION ALL SELECT 'storage', concat('c', c_custkey), CASE WHEN c_custkey % 3 = 1 THEN 'new' ELSE c_name END FROM customer WHERE c_custkey % 3 <> 0")
def cache_write_through(spark, d):
    c = Parquet(spark, d)["customer"]
    key = F.concat(F.lit("c"), "c_custkey").alias("key")
    storage, cache = c.select(key, F.col("c_name").alias("value")), c.where("c_custkey % 2 = 0").select(key, F.col("c_name").alias("value"))
    changes = c.where("c_custkey % 3 < 2").select(key, F.when(F.col("c_custkey") % 3 == 1, F.lit("new")).alias("value"))
    stored, cached = keyed.write_through(cache, storage, changes)
    return cached.select(F.lit("cache").alias("place"), "key", "value").unionByName(stored.select(F.lit("storage").alias("place"), "key", "value"))


_SHARDS = [(0, "a:1", keyed.ACTIVE), (1, "b:1", keyed.DOWN), (2, "c:1", keyed.WRITE_ONLY), (3, "d:1", keyed.WARM_UP)]


@_query(
    "SELECT event_id AS seq, CAST(user_id % 5 AS INTEGER) AS shard, ['a:1', 'b:1', 'c:1', 'd:1'][user_id % 5 + 1] AS address, CASE user_id % 5 WHEN 0 THEN 'run' WHEN 4 THEN 'unmapped' WHEN 1 THEN CASE WHEN event_id % 2 = 1 THEN 'miss' ELSE 'skip' END ELSE CASE WHEN event_id % 2 = 1 THEN 'miss' ELSE 'run' END END AS action FROM events"
)
def shard_routing(spark, d):
    ops = _operations(spark, d, ("set", "get"))
    shards = spark.createDataFrame(_SHARDS, "shard int, address string, state string")
    return keyed.routed(ops, shards, (F.substring("key", 2, 20).cast("long") % 5).cast("int")).select("seq", "shard", "address", "action")


@_query("SELECT concat('h', s_suppkey) AS address, CASE WHEN s_suppkey % 3 = 0 THEN 'unregister' ELSE 'register' END AS change FROM supplier WHERE s_suppkey % 3 < 2")
def shard_change_list(spark, d):
    s = Parquet(spark, d)["supplier"].select("s_suppkey", F.concat(F.lit("h"), "s_suppkey").alias("address"))
    return keyed.shard_changes(s.where("s_suppkey % 3 <> 1"), s.where("s_suppkey % 3 <> 0"))


@_query("SELECT event_id, strlen(event_type) <= 5 AS key, octet_length(encode(props)) <= 9 AS value FROM events")
def kv_validation(spark, d):
    e = Parquet(spark, d)["events"]
    key = F.when(F.length("event_type") <= 5, F.col("event_type")).otherwise(F.concat("event_type", F.lit(" ")))
    return e.select("event_id", keyed.valid_key(key).alias("key"), keyed.valid_value(F.col("props").cast("binary"), 9).alias("value"))


@_query("SELECT concat('u', user_id) AS key, arg_max(event_type, event_id) AS value, count(*) AS version FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id % 997 = 0) AND event_id % 997 <> 0 GROUP BY user_id")
def kv_flush(spark, d):
    """Sets, and a flush now and then: items are those of the sets after the last flush."""
    ops = _operations(spark, d, ("set",)).withColumn("op", F.when(F.col("seq") % 997 == 0, "flush").otherwise(F.col("op")))
    done = keyed.apply_operations(spark.createDataFrame([], keyed.STATE), keyed.flushed(ops))
    return done.where("kind = 'state'").select("key", F.col("value").cast("string").alias("value"), "version")


@_query("SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'key exists' WHEN n_nationkey = 5 THEN 'item not stored' WHEN n_nationkey > 9 THEN concat('invalid status: ', n_nationkey) END AS name FROM nation WHERE n_nationkey IN (2, 5) OR n_nationkey > 9")
def kv_codes(spark, d):
    return Parquet(spark, d)["nation"].where("n_nationkey in (2, 5) or n_nationkey > 9").select("n_nationkey", keyed.code_name(F.col("n_nationkey")).alias("name"))


# Flow control.

_BUCKET = (
    "WITH RECURSIVE given AS (SELECT event_id, user_id, epoch_us(ts) * 20 // 1000000 AS tick, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "fold AS (SELECT event_id, user_id, n, tick, {most} - CASE WHEN 1.0 > {most} THEN 0 ELSE 1.0 END AS remaining, 1.0 > {most} AS throttled FROM given WHERE n = 1 UNION ALL "
    "SELECT g.event_id, g.user_id, g.n, g.tick, have - CASE WHEN 1.0 > have THEN 0 ELSE 1.0 END, 1.0 > have FROM (SELECT f.user_id, f.n, least({most}, f.remaining + (g.tick - f.tick) * {quota} / 20) AS have, g.event_id, g.tick FROM fold f JOIN given g ON g.user_id = f.user_id AND g.n = f.n + 1) x "
    "JOIN given g ON g.event_id = x.event_id) SELECT event_id, throttled FROM fold"
)


@_query(_BUCKET.format(most="3.0::DOUBLE", quota="0.0001::DOUBLE"))
def token_bucket_requests(spark, d):
    e = Parquet(spark, d)["events"].select("event_id", "user_id", "ts", F.lit(1.0).alias("tokens"))
    return flow.token_bucket(e, 0.0001, 3.0, key="user_id").select("event_id", "throttled")


@_query("SELECT s_suppkey AS id FROM supplier ORDER BY md5(concat('seed:', s_suppkey)), s_suppkey LIMIT 5")
def instance_order(spark, d):
    return flow.fixed_order(Parquet(spark, d)["supplier"].select(F.col("s_suppkey").alias("id")), "seed").limit(5)


_RING = "SELECT s_suppkey AS node, CAST(concat('0x', substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 8)) AS BIGINT) AS position FROM supplier WHERE s_suppkey % 4 <> 0"


@_query(
    f"WITH ring AS (SELECT node, position, row_number() OVER (ORDER BY position, node) - 1 AS i, count(*) OVER () AS size FROM ({_RING})), keys AS (SELECT o_orderkey, CAST(concat('0x', substr(md5(concat('k', CAST(o_orderkey AS VARCHAR))), 1, 8)) AS BIGINT) AS key_hash FROM orders), "
    "every AS (SELECT list(node ORDER BY i) AS nodes, any_value(size) AS size FROM ring) "
    "SELECT o_orderkey, list_transform(range(least(3, size)), lambda d: nodes[(coalesce(i, 0) + d) % size + 1]) AS nodes FROM (SELECT k.o_orderkey, r.i FROM keys k ASOF LEFT JOIN ring r ON k.key_hash <= r.position), every"
)
def ring_nearest(spark, d):
    """The three nodes that follow each key, every fourth node being marked down."""
    t = Parquet(spark, d)
    spot = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    ring = t["supplier"].select(F.col("s_suppkey").alias("node"), spot(F.col("s_suppkey").cast("string")).alias("position"), (F.col("s_suppkey") % 4 == 0).alias("down"))
    keys = t["orders"].select("o_orderkey", spot(F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))).alias("key_hash"))
    return flow.nearest_nodes(keys, ring, 3).select("o_orderkey", "nodes")


@_query("SELECT count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) AS price_count, max(o_totalprice) AS price_max, min(o_totalprice) AS price_min FROM orders")
def counters(spark, d):
    """Counters and a summary that the table's own pass fills."""
    watched, seen = flow.observed(Parquet(spark, d)["orders"], "orders", {"finished": F.col("o_orderstatus") == "F"}, {"price": F.col("o_totalprice")})
    watched.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([tuple(got[k] for k in ("finished", "price_count", "price_max", "price_min"))], "finished long, price_count long, price_max double, price_min double")


# The same functions under the names of the first module's queries.
ORACLE_SQL["murmur3"] = ORACLE_SQL["murmur3_text"]
ORACLE_SQL["fnv_shard"] = f"SELECT p_partkey, shard FROM ({ORACLE_SQL['fnv_text']})"
ORACLE_SQL["token_bucket"] = f"SELECT e.event_id, e.user_id, e.ts, 1.0::DOUBLE AS tokens, f.throttled FROM events e JOIN ({ORACLE_SQL['token_bucket_requests']}) f ON f.event_id = e.event_id"
