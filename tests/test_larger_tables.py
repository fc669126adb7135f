"""Queries on tables with what only larger copies of the test tables hold, against their SQL in DuckDB."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import hashing as H
from quern.plans import more, queries
from quern.sources import binlog as B
from quern.sources.logwriter import LogWriter
from quern.streaming import flow
from test_queries import _norm

QUERIES, ORACLE_SQL = queries.QUERIES | more.QUERIES, queries.ORACLE_SQL | more.ORACLE_SQL
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def equals_sql(spark, tmp_path):
    """Whether a query over one table, given as DuckDB's SELECT, gives what its SQL gives."""

    def run(name: str, **tables: str) -> list[str]:
        db = duckdb.connect()
        for table, select in tables.items():
            db.execute(f"COPY ({select}) TO '{tmp_path}/{table}.parquet'")
            db.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = QUERIES[name](spark, str(tmp_path))
        got = sorted("|".join(map(_norm, r)) for r in df.collect())
        rel = db.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})")
        assert got == sorted("|".join(map(_norm, r)) for r in rel.fetchall())
        return got

    return run


def test_upsert_where_shifted_keys_are_taken(equals_sql):
    rows = "(5, 1, 'F', 1e1), (1000005, 2, 'O', 2e1), (6, 3, 'F', 3e1), (1000006, 4, 'P', 4e1), (7, 5, 'F', 5e1)"
    got = equals_sql("upsert", orders=f"SELECT * FROM (VALUES {rows}) t(o_orderkey, o_custkey, o_orderstatus, o_totalprice)")
    assert len(got) == 8


def _log(*table_ids):
    w = LogWriter()
    for i in table_ids:
        w.table_map(i, "d", f"t{i}", [3], b"", [False])
        w.rows(B.WRITE_V2, i, 1, [([False], i.to_bytes(4, "little"))])
    return bytes(w.data)


def _events(spark, *logs):
    return B.events_of(spark.createDataFrame([(f"f{i}", bytearray(x)) for i, x in enumerate(logs)], "path string, content binary"))


def test_small_files_share_batches():
    files = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(900)]), pa.array([_log(1)] * 900, pa.binary())], names=["path", "content"])
    batches = list(B.framed(iter([files, files])))
    assert [b.num_rows for b in batches] == [B.BATCH_ROWS, 1800 * 3 - B.BATCH_ROWS]


def test_changes_read_events_once(spark):
    events = _events(spark, _log(1, 2, 1), _log(3), _log())
    log = B.changes(events, "FAILFAST")
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 2
    rows = sorted((r.file, r.table, r.after) for r in log.collect())
    assert rows == [("f0", "t1", ["1"]), ("f0", "t1", ["1"]), ("f0", "t2", ["2"]), ("f1", "t3", ["3"])]
    assert rows == sorted((r.file, r.table, r.after) for r in B.changes(events.drop("map"), "FAILFAST").collect())


def test_relayed_reads_events_once(spark):
    w = LogWriter()
    w.xid(1)
    w.format(False)
    w.rotate("log.000002")
    w.xid(2)
    kept = B.relayed(_events(spark, bytes(w.data), bytes(LogWriter().data)))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    assert [(r.file, r.type) for r in kept.orderBy("file", "position").collect()] == [("f0", B.XID), ("f0", B.FORMAT), ("f0", B.XID)]


def test_rotations_past_a_million(spark, equals_sql):
    got = equals_sql("log_rotations", customer="SELECT i AS c_custkey, 'X' AS c_mktsegment FROM range(999997, 1000003) t(i)")
    assert sum(r.endswith("None") for r in got) == 3
    names = {"f.0999999": "f.1000000", "f.1000000": "f.000001", "f.000001": "f.0000002", "f.000003": "f.00000x", "f.000004": "f.000005x", "f.000006": "f.x000007", "f.1999999": "f.2000000"}
    files = []
    for name, target in names.items():
        w = LogWriter()
        w.rotate(target)
        files.append((name, bytearray(w.data)))
    events = B.events_of(spark.createDataFrame(files, "path string, content binary"))
    assert {r.file: r.error for r in B.checked_rotations(events, "f.").collect()} == {
        "f.0999999": "not the next file", "f.1000000": "not the next file", "f.000001": "wrong prefix", "f.000003": "wrong number", "f.000004": "wrong prefix", "f.000006": "wrong prefix", "f.1999999": None,
    }


def test_ring_of_shared_positions_over_many_ranges(spark):
    ring = spark.createDataFrame([(10, "b"), (10, "a"), (20, "c"), (30, "a")], "position long, node string")
    keys = spark.createDataFrame([(0, 5), (1, 10), (2, 11), (3, 25), (4, 31), (5, None)], "k int, key_hash long")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = flow.ring_lookup(keys, ring)
        assert [r.node for r in found.orderBy("k").collect()] == ["a", "a", "c", "a", "a", "a"]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 10
        near = flow.nearest_nodes(keys, ring, 3).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert [r.nodes for r in near] == [["a", "b", "c"], ["a", "b", "c"], ["c", "a", "a"], ["a", "a", "b"], ["a", "b", "c"], ["a", "b", "c"]]


def test_digests_hash_each_item_once(spark):
    df = spark.range(100).selectExpr("id % 3 g", "if(id > 5, cast(id as string), null) x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.groupBy("g").agg(H.digest_state(F.col("x")).alias("s"))._jdf.queryExecution()
        code = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(plan, "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert code.count("DigestUtils.sha256Hex") == 1


def test_digest_of_groups_that_lose_nothing(equals_sql):
    rows = "(1, 'a', 'F'), (2, 'a', 'O'), (3, 'b', 'O'), (4, 'b', 'P')"
    equals_sql("digest_subtract", orders=f"SELECT * FROM (VALUES {rows}) t(o_orderkey, o_orderpriority, o_orderstatus)")


@pytest.mark.parametrize("name, types", [("log_query_status", {B.QUERY}), ("log_row_queries", {B.ROWS_QUERY}), ("log_queries", {B.QUERY}), ("log_event_types", {B.FORMAT, B.PREVIOUS_GTIDS, B.GTID, B.QUERY, B.ROWS_QUERY, B.XID, B.ROTATE, B.STOP}), ("log_transactions", {B.XID}), ("log_gtids", {B.GTID}), ("log_previous_gtids", {B.PREVIOUS_GTIDS})])
def test_log_files_are_dealt_to_all_tasks(spark, monkeypatch, name, types):
    """Also where their rows have few bytes; framing gives the events that the query reads."""
    seen, real = [], B.events_of
    monkeypatch.setattr(B, "events_of", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    QUERIES[name](spark, SMALL)
    got = seen[0].select("file", "type", F.spark_partition_id().alias("p")).collect()
    assert len({r.p for r in got}) >= spark.sparkContext.defaultParallelism
    assert {r.type for r in got} == types and len(got) == len({r.file for r in got}) * len(types)


def test_framing_by_type_is_a_filter(spark):
    w = LogWriter(checksum=True)
    w.xid(1)
    w.table_map(1, "d", "t", [3], b"", [False])
    w.format(False)
    w.rows(B.WRITE_V2, 1, 1, [([False], bytes(4))])
    w.xid(2)
    short = bytes(w.data) + B.HEADER.pack(0, B.XID, 1, 7, 0, 0)
    files = spark.createDataFrame([("a", bytearray(w.data)), ("b", bytearray(short)), ("c", bytearray(b"none")), ("d", bytearray(w.data[:-3]))], "path string, content binary")
    every = B.events_of(files, verify=True).collect()
    for types in [{B.XID}, {B.WRITE_V2}, {B.TABLE_MAP}, {B.FORMAT, B.XID}, {B.TABLE_MAP, B.WRITE_V2}, set()]:
        wanted = [r for r in every if r.type in types or r.error]
        assert B.events_of(files, verify=True, types=types).collect() == wanted
    assert {bytes(r.map) for r in every if r.type == B.WRITE_V2} == {bytes(r.body) for r in every if r.type == B.TABLE_MAP}


def test_framing_by_columns_is_a_projection(spark):
    w = LogWriter(checksum=True)
    w.table_map(1, "d", "t", [3], b"", [False])
    w.rows(B.WRITE_V2, 1, 1, [([False], bytes(4))])
    w.format(False)
    w.xid(2)
    spoiled = w.data + B.HEADER.pack(0, B.XID, 1, 7, 0, 0)
    spoiled[4 + 19 + 52] ^= 1  # when the first format event was made
    files = spark.createDataFrame([("a", bytearray(w.data)), ("b", spoiled), ("c", bytearray(b"none")), ("d", bytearray(w.data[:-3]))], "path string, content binary")
    for columns in [("file", "type"), ("type",), ("map", "position"), ("error", "file", "body"), ("length", "next_position", "error")]:
        for types in [None, {B.XID}, {B.WRITE_V2}, {B.FORMAT, B.TABLE_MAP}]:
            for verify in [False, True]:
                every = B.events_of(files, verify, types)
                got = B.events_of(files, verify, types, columns)
                assert got.columns == list(columns) and got.dtypes == every.select(*columns).dtypes
                assert got.collect() == every.select(*columns).collect()
    assert {r.error for r in B.events_of(files, True).collect()} == {None, "checksum does not fit", "an event shorter than its header", "not a change log"}


def test_event_types_are_counted_from_headers(spark, monkeypatch):
    """Bodies stay where they are."""
    seen, real = [], B.events_of
    monkeypatch.setattr(B, "events_of", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    counts = {r.name: r.n for r in QUERIES["log_event_types"](spark, SMALL).collect()}
    assert seen[0].columns == ["file", "type"]
    assert len(counts) == 8 and set(counts.values()) == {spark.read.parquet(f"{SMALL}/customer.parquet").count()}
    w = LogWriter(checksum=True)
    w.query("db", "x" * 1000)
    assert [e[:7] for e in B.frames(bytes(w.data), bodies=False)] == [e[:7] for e in B.frames(bytes(w.data))]
    assert {e[7] for e in B.frames(bytes(w.data), bodies=False)} == {b""}
