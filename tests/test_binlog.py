import struct

import pytest
from pyspark.sql import functions as F

from quern.sources import binlog as B
from quern.sources.logwriter import LogWriter

KINDS = [1, 2, 9, 3, 8, 4, 5, 7, 12, 13, 15, 252, 254, 17, 18]
META = bytes([4, 8]) + (300).to_bytes(2, "little") + bytes([2, 254, 4, 3, 6])
NULLS = [False] * len(KINDS)


def _values() -> bytes:
    day = (1 << 39) + (((2014 * 13 + 5) << 5 | 17) << 17 | 10 << 12 | 20 << 6 | 30)
    return (
        b"\xff" + b"\x02\x01" + b"\1\0\0" + struct.pack("<I", 7) + struct.pack("<Q", 2**64 - 1) + struct.pack("<f", 1.5) + struct.pack("<d", -2.25) + struct.pack("<I", 1_400_000_000)
        + struct.pack("<Q", 20140517102030) + bytes([114]) + struct.pack("<H", 3) + "né".encode() + struct.pack("<H", 2) + b"\xff\xfe" + bytes([2]) + b"ab" + struct.pack(">I", 9) + b"\x04\xd2" + day.to_bytes(5, "big") + b"\x00\x00\x07"
    )


@pytest.fixture(params=[False, True])
def log(request):
    w = LogWriter(checksum=request.param)
    w.query("db", "BEGIN")
    w.gtid(bytes(range(16)), 2**63 + 1)
    w.rows_query("insert into t")
    w.table_map(5, "db", "t", KINDS, META, [True] * len(KINDS))
    w.rows(B.WRITE_V2, 5, len(KINDS), [(NULLS, _values()), ([True] * len(KINDS), b"")])
    w.rows(B.WRITE_V1, 6, len(KINDS), [(NULLS, _values())])
    w.xid(2**64 - 1)
    w.rotate("log.000002")
    w.stop()
    return bytes(w.data)


def _events(spark, *logs):
    return B.events_of(spark.createDataFrame([(f"f{i}", bytearray(x)) for i, x in enumerate(logs)], "path string, content binary"))


def test_all_types(spark, log):
    rows = B.changes(_events(spark, log)).orderBy("position", "row").collect()
    good = [r for r in rows if r.error is None]
    assert good[0].after == ["255", "258", "1", "7", "18446744073709551615", "1.5", "-2.25", "1400000000", "2014-05-17 10:20:30", "2014", "né", "0xfffe", "ab", "9.123400", "2014-05-17 10:20:30.000007"][:12] + ["ab\0\0"] + ["9.123400", "2014-05-17 10:20:30.000007"]
    assert good[1].after == [None] * len(KINDS) and good[0].before is None and good[0].operation == "insert"
    assert [r.error for r in rows if r.error] == ["the table map in force is of another table"]
    with pytest.raises(Exception, match="another table"):
        B.changes(_events(spark, log), "FAILFAST").collect()


def test_other_events(spark, log):
    e = _events(spark, log)
    assert [(r.database, r.statement) for r in B.queries(e).collect()] == [("db", "BEGIN")]
    assert [int(r.xid) for r in B.transactions(e).collect()] == [2**64 - 1]
    assert [(r.new_file, r.new_position) for r in B.rotations(e).collect()] == [("log.000002", 4)]
    g = B.gtids(e).first()
    assert (g.sid, int(g.number), g.commit, g.error) == ("00010203-0405-0607-0809-0a0b0c0d0e0f", 2**63 + 1, True, None)
    assert B.row_queries(e).first().statement == "insert into t"


def test_frames_stop_at_a_partial_event(spark, log):
    whole = list(B.frames(log))
    assert whole[-1][2] == B.STOP and whole[-1][0] + whole[-1][4] == len(log)
    for cut in range(4, len(log), 7):
        part = list(B.frames(log[:cut]))
        assert part == whole[: len(part)]
    assert _events(spark, b"nonsense").first().error == "not a change log"


def test_checksums():
    w = LogWriter(checksum=True)
    w.xid(1)
    spoiled = bytes(w.data[:-6]) + b"\xff" + bytes(w.data[-5:])
    assert [e[-1] for e in B.frames(spoiled, verify=True)] == [None, "checksum does not fit"]
    assert [e[-1] for e in B.frames(bytes(w.data), verify=True)] == [None, None]


def test_signed_and_current_rows(spark):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("k int, v tinyint")
    w = LogWriter()
    w.table_map(1, "d", "t", [3, 1], b"", [False, True])
    image = lambda k, v: ([False, False], struct.pack("<IB", k, v & 255))
    w.rows(B.WRITE_V2, 1, 2, [image(1, -3), image(2, 5)])
    w.rows(B.UPDATE_V2, 1, 2, [image(1, -3), image(1, -4)])
    w.rows(B.DELETE_V2, 1, 2, [image(2, 5)])
    log = B.changes(_events(spark, bytes(w.data)))
    signed = log.where("operation = 'insert'").select(*B.typed(log["after"], schema, {"v": 8})).collect()
    assert sorted(r.v for r in signed) == [-3, 5]
    base = spark.createDataFrame([(2, 9), (3, 7)], schema)
    plain = StructType.fromDDL("k int, v int")
    now = B.current_rows(base.selectExpr("k", "CAST(v AS INT) AS v"), log, plain, ["k"])
    assert {r.k: r.v for r in now.collect()} == {1: 252, 3: 7}


def test_previous_gtids(spark):
    body = struct.pack("<Q", 1) + bytes(16) + struct.pack("<Q", 2) + struct.pack("<qqqq", 1, 5, 7, 9)
    w = LogWriter()
    w._event(B.PREVIOUS_GTIDS, body)
    assert [(r.first, r.last) for r in B.previous_gtids(_events(spark, bytes(w.data))).collect()] == [(1, 5), (7, 9)]


def test_tailing_a_folder(spark, tmp_path):
    spark.dataSource.register(B.LogSource)
    folder = tmp_path / "logs"
    folder.mkdir()
    w = LogWriter()
    w.xid(1)
    (folder / "log.000001").write_bytes(bytes(w.data) + b"\1\2\3")  # an event that is being written

    def run():
        q = spark.readStream.format("quern_log").option("path", str(folder)).option("prefix", "log.").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).where(f"type = {B.XID}").count()

    assert run() == 1
    w.xid(2)
    (folder / "log.000001").write_bytes(bytes(w.data))
    more = LogWriter()
    more.xid(3)
    (folder / "log.000002").write_bytes(bytes(more.data))
    assert run() == 3
    assert run() == 3
    assert spark.read.format("quern_log").option("path", str(folder)).option("prefix", "log.").load().where(f"type = {B.XID}").count() == 3


def test_rotations_are_checked(spark):
    def log(target):
        w = LogWriter()
        w.rotate(target)
        return bytes(w.data)

    names = {"log.000001": "log.000002", "log.999999": "log.000000", "log.000005": "log.000007", "log.000008": "other.000009", "log.000010": "log.abc"}
    events = B.events_of(spark.createDataFrame([(n, bytearray(log(t))) for n, t in names.items()], "path string, content binary"))
    got = {r.file: r.error for r in B.checked_rotations(events, "log.").collect()}
    assert got == {"log.000001": None, "log.999999": None, "log.000005": "not the next file", "log.000008": "wrong prefix", "log.000010": "wrong prefix"}
    kinds = {r.n for r in events.select(B.event_name(events["type"]).alias("n")).collect()}
    assert kinds == {"FORMAT_DESCRIPTION", "ROTATE"}
    assert B.relayed(events).count() == 0 and len(B.EVENT_NAMES) == 36


def test_checksum_changes_midway(spark, tmp_path):
    """Events after a second format event are cut as that one says, wherever a piece starts."""
    w = LogWriter(checksum=False)
    w.xid(1)
    w.format(True)
    w.xid(2)
    middle = len(w.data)
    w.xid(3)
    w.format(False)
    w.xid(4)
    path = tmp_path / "log.000001"
    path.write_bytes(bytes(w.data))
    whole = [e for e in B._events_between(B._Piece(str(path), 4, None))]
    assert [e[8] for e in whole if e[3] == B.XID] == [struct.pack("<Q", i) for i in (1, 2, 3, 4)]
    at, checksum = B.end_of(str(path))
    assert (at, checksum) == (len(w.data), 0)
    path.write_bytes(bytes(w.data[:middle]))
    place = B.end_of(str(path))
    assert place == (middle, 4)
    path.write_bytes(bytes(w.data))
    assert list(B._events_between(B._Piece(str(path), *place[:1], None, place[1]))) == [e for e in whole if e[1] >= middle]


def test_tail_goes_on_from_its_place(tmp_path):
    r = B._TailReader({"path": str(tmp_path), "prefix": "log."})
    assert r.latestOffset() == r.initialOffset() and r.partitions(r.initialOffset(), r.initialOffset()) == []
    logs = {n: LogWriter(checksum=True) for n in ("999998", "999999", "000000", "000001")}
    for n, w in logs.items():
        w.xid(int(n))
        (tmp_path / f"log.{n}").write_bytes(bytes(w.data))
    assert [f[-6:] for f in r._numbered()] == list(logs)
    end = r.latestOffset()
    assert [p.path[-6:] for p in r.partitions(r.initialOffset(), end)] == list(logs)
    logs["000001"].xid(7)
    (tmp_path / "log.000001").write_bytes(bytes(logs["000001"].data) + b"\0" * 9)
    after = r.latestOffset()
    pieces = r.partitions(end, after)
    assert [list(B._events_between(p))[0][8] for p in pieces] == [struct.pack("<Q", 7)] and r.partitions(after, after) == []
    assert [f[-6:] for f in B._TailReader({"path": str(tmp_path), "prefix": "log.", "first": "999999"})._numbered()] == ["999999", "000000", "000001"]


STATUS = bytes([0]) + struct.pack("<I", 5) + bytes([1]) + struct.pack("<Q", 1 << 63) + bytes([3]) + struct.pack("<HH", 2, 1) + b"\4abcdef" + b"\5\3UTC" + b"\6\3std" + bytes([7, 9, 0, 8, 8, 0, 9]) + struct.pack("<Q", 3) + b"\x0b\4root\x09localhost" + b"\x0c\2a\0b\0" + b"\x0d\x01\x00\x02"


def test_status_variables(spark):
    w = LogWriter()
    for s in (STATUS, b"", b"\x0c\xfe", b"\2\1a", b"\5\7UT"):
        w.query("db", "BEGIN", s)
    full, none, many, old, short = B.query_status(_events(spark, bytes(w.data))).orderBy("position").collect()
    assert full[2:] == (5, 1 << 63, 2, 1, b"abcdef", "UTC", "std", 9, 8, 3, "root", "localhost", ["a", "b"], 0x020001, None)
    assert set(none[2:]) == {None} == set(many[2:])
    assert (old.error, short.error) == ("unknown status code 2", "the body ends early")
    got = B.query_status(_events(spark, bytes(w.data))).orderBy("position").select(B.mode_enabled(F.col("sql_mode"), 3).alias("low"), B.mode_enabled(F.col("sql_mode"), 63).alias("high")).collect()
    assert [tuple(r) for r in got][:2] == [(False, True), (False, False)]
    assert {r.statement for r in B.queries(_events(spark, bytes(w.data))).collect()} == {"BEGIN"}


def test_formats_are_checked(spark):
    wrong = {"": {}, "not version 4": {"version": 3}, "headers have extra bytes": {"header": 21}, "TABLE_MAP has a fixed size other than 8": {f"t{B.TABLE_MAP}": 7}, "unknown checksum algorithm": {"algorithm": 2}}
    w = LogWriter()
    for change in list(wrong.values())[1:]:
        w.format(False, **change)
    w._event(B.FORMAT, b"\4\0" + bytes(60))
    got = B.formats(_events(spark, bytes(w.data))).orderBy("position").collect()
    assert [r.error or "" for r in got] == [*wrong, "unknown variant of the format"]
    assert (got[0].version, got[0].server, got[0].created, got[0].header_size, got[0].checksum, len(got[0].sizes)) == (4, "5.6.20-log", 1_400_000_000, 19, 0, 35)


def test_bodies_that_end_early(spark):
    w = LogWriter()
    w.previous_gtids({bytes(16): [(1, 5)]})
    w._event(B.PREVIOUS_GTIDS, struct.pack("<Q", 2) + bytes(16))
    w._event(B.PREVIOUS_GTIDS, struct.pack("<Q", 0) + b"x")
    assert [r.error for r in B.previous_gtids(_events(spark, bytes(w.data))).orderBy("position").collect()] == [None, "the body ends early", "bytes are left over"]


def test_extra_information(spark):
    w = LogWriter()
    w.table_map(1, "d", "t", [3], b"", [False])
    one = [([False], struct.pack("<I", 1))]
    for extra in (b"", b"\0\5foo", b"\7x"):
        w.rows(B.WRITE_V2, 1, 1, one, extra)
    got = B.changes(_events(spark, bytes(w.data))).orderBy("position").collect()
    assert [(r.extra, r.error) for r in got] == [(None, None), (b"\0\5foo", None), (None, "unknown kind of extra information")]
