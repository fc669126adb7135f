"""Row-based change logs as DataFrames.

Files are framed into events (one row each), in parallel over files; event bodies are then decoded by column
expressions, and row events, joined with the table map in force, into row images in parallel over events.
Integers are unsigned as the log gives them; ``typed`` reads them as signed where a schema says so.

A body that cannot be decoded gives a row with ``error`` set (or fails the query in mode FAILFAST). The year type
is a plain number. Checksum bytes are cut off and, on request, verified.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Collection, Iterator, Sequence
from decimal import Decimal
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values of the log format.
MAGIC = b"\xfebin"
QUERY, STOP, ROTATE, FORMAT, XID, TABLE_MAP, ROWS_QUERY, GTID, PREVIOUS_GTIDS = 2, 3, 4, 15, 16, 19, 29, 33, 35
WRITE_V1, UPDATE_V1, DELETE_V1, WRITE_V2, UPDATE_V2, DELETE_V2 = 23, 24, 25, 30, 31, 32
OPERATIONS = {WRITE_V1: "insert", WRITE_V2: "insert", UPDATE_V1: "update", UPDATE_V2: "update", DELETE_V1: "delete", DELETE_V2: "delete"}
EVENT_NAMES = (
    "UNKNOWN", "START_V3", "QUERY", "STOP", "ROTATE", "INTVAR", "LOAD", "SLAVE", "CREATE_FILE", "APPEND_BLOCK", "EXEC_LOAD", "DELETE_FILE", "NEW_LOAD", "RAND", "USER_VAR", "FORMAT_DESCRIPTION", "XID",
    "BEGIN_LOAD_QUERY", "EXECUTE_LOAD_QUERY", "TABLE_MAP", "PRE_GA_WRITE_ROWS", "PRE_GA_UPDATE_ROWS", "PRE_GA_DELETE_ROWS", "WRITE_ROWS_V1", "UPDATE_ROWS_V1", "DELETE_ROWS_V1", "INCIDENT", "HEARTBEAT",
    "IGNORABLE", "ROWS_QUERY", "WRITE_ROWS_V2", "UPDATE_ROWS_V2", "DELETE_ROWS_V2", "GTID", "ANONYMOUS_GTID", "PREVIOUS_GTIDS",
)
HEADER = struct.Struct("<IBIIIH")

EVENT = "file string, position long, timestamp long, type int, server_id long, length long, next_position long, flags int, body binary, error string"
#: What framing whole files adds: with row events the body of the table map in force.
FRAMED = f"{EVENT}, map binary"
_FRAMED_SQL = {c.split()[0]: c for c in FRAMED.split(", ")}
_KINDS = dict(zip(_FRAMED_SQL, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.binary()], strict=True))
#: Events, and bytes of their bodies and maps, of a batch.
BATCH_ROWS, BATCH_BYTES = 5000, 1 << 22


def frames(data: bytes, at: int = 4, checksum: int | None = None, verify: bool = False, types: Collection[int] | None = None, bodies: bool = True) -> Iterator[tuple]:
    """(position, header fields, body, error) of the whole events from `at` on; a partial last event is left out.
    checksum: bytes of checksum after bodies, None while no format event has told. types: event types to give, None
    for all; other events are stepped over. Without bodies only headers are read: bodies are empty and not verified."""
    while at + 19 <= len(data):
        ts, kind, server, size, following, flags = HEADER.unpack_from(data, at)
        if size < 19:
            yield (at, ts, kind, server, size, following, flags, b"", "an event shorter than its header")
            return
        if at + size > len(data):
            return
        if types is not None and kind not in types and kind != FORMAT:
            at += size
            continue
        if not bodies:
            if types is None or kind in types:
                yield (at, ts, kind, server, size, following, flags, b"", None)
            at += size
            continue
        body, error = data[at + 19 : at + size], None
        if kind == FORMAT:
            checksum = _checksum_size(body)
        cut = 4 if checksum else 0
        if cut and verify and zlib.crc32(data[at : at + size - 4]) != int.from_bytes(body[-4:], "little"):
            error = "checksum does not fit"
        if types is None or kind in types:
            yield (at, ts, kind, server, size, following, flags, body[: len(body) - cut], error)
        at += size


def _checksum_size(format_body: bytes) -> int:
    """4 where the format event says CRC32; versions before 5.6 have no checksum byte."""
    return 4 if _version_of(format_body[2:52]) >= (5, 6, 1) and len(format_body) > 57 + 5 and format_body[-5] == 1 else 0


@lru_cache(maxsize=64)
def _version_of(text: bytes) -> tuple[int, ...]:
    version = text.rstrip(b"\0").decode("latin-1")
    return tuple(int("".join(c for c in p if c.isdigit()) or 0) for p in version.split(".")[:3])


def read(spark: SparkSession, path: str, verify: bool = False, types: Collection[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The events of the log files under path, on any store that Spark reads; a file is the unit of work."""
    return events_of(spark.read.format("binaryFile").load(path).select("path", "content"), verify, types, columns)


def events_of(files: DataFrame, verify: bool = False, types: Collection[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The events of files given as rows (path, content), with map: the body of the table map in force at a row event.
    types: the event types wanted, None for all. Every file is walked through whole; rows that say where one cannot be
    read on stay. columns: those wanted, None for all; Spark cannot tell the tasks which ones a query goes on to use, and
    without body and map only headers are read."""
    return files.mapInArrow(lambda batches: framed(batches, verify, types, columns), ", ".join(_FRAMED_SQL[c] for c in columns or _FRAMED_SQL))


def framed(batches: Iterator[pa.RecordBatch], verify: bool = False, types: Collection[int] | None = None, columns: Sequence[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of events, which run on from file to file, so that many small files cost no more than one large one."""
    names = list(columns or _FRAMED_SQL)
    places = [list(_FRAMED_SQL).index(c) for c in names]
    # an itemgetter of one place gives no tuple
    wanted = itemgetter(*places) if len(places) > 1 else lambda row: (row[places[0]],)
    bodies = verify or "body" in names or "map" in names
    # row events need the maps before them
    walked = None if types is None else {*types, TABLE_MAP} if OPERATIONS.keys() & set(types) else set(types)
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, table = content.as_py(), None
            rows = [(0, 0, 0, 0, 0, 0, 0, b"", "not a change log")] if data[:4] != MAGIC else frames(data, verify=verify, types=walked, bodies=bodies)
            for row in rows:
                table = row[7] if row[2] == TABLE_MAP else table
                if types is not None and row[2] not in types and row[8] is None:
                    continue
                known = table if row[2] in OPERATIONS else None
                whole = (name, *row, known)
                held.append(wanted(whole) if columns else whole)
                size += len(row[7]) + len(known or b"")
                if len(held) == BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(held, names)
                    held, size = [], 0
    if held:
        yield _batch(held, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


def little_endian(c: Column, at: int, size: int) -> Column:
    """Unsigned number of size bytes at a 0-based place: a long, or decimal(20,0) for eight bytes."""
    h = F.hex(F.substring(c, at + 1, size))
    text = F.conv(F.concat(*(F.substring(h, 2 * (size - 1 - i) + 1, 2) for i in range(size))), 16, 10)
    return text.cast("decimal(20,0)") if size == 8 else text.cast("long")


def _rest(at: int | Column) -> Column:
    start = F.lit(at + 1) if isinstance(at, int) else at + 1
    return F.substring(F.col("body"), start, F.octet_length("body"))


def queries(events: DataFrame) -> DataFrame:
    b = F.col("body")
    schema_size, status = F.conv(F.hex(F.substring(b, 9, 1)), 16, 10).cast("int"), little_endian(b, 11, 2).cast("int")
    of = events.where(F.col("type") == QUERY)
    return of.select("file", "position", little_endian(b, 0, 4).alias("thread_id"), little_endian(b, 4, 4).alias("seconds"), little_endian(b, 9, 2).alias("error_code"), F.substring(b, F.lit(14), status).alias("status"), F.substring(b, status + 14, schema_size).cast("string").alias("database"), _rest(status + 14 + schema_size).cast("string").alias("statement"))


#: Status variables of statements by code; fixed values of the log format. Kinds: sizes of numbers, t a text with
#: its length before it, n a counted list of texts that end in 0, and plain bytes.
STATUS = {
    0: ("flags2", 4), 1: ("sql_mode", 8), 3: (("auto_increment_increment", 2), ("auto_increment_offset", 2)), 4: ("charset", "6"), 5: ("time_zone", "t"), 6: ("catalog", "t"), 7: ("lc_time_names", 2),
    8: ("charset_database", 2), 9: ("table_map_for_update", 8), 11: (("invoker_user", "t"), ("invoker_host", "t")), 12: ("updated_databases", "n"), 13: ("microseconds", 3),
}
_STATUS_SQL = "flags2 long, sql_mode decimal(20,0), auto_increment_increment int, auto_increment_offset int, charset binary, time_zone string, catalog string, lc_time_names int, charset_database int, table_map_for_update decimal(20,0), invoker_user string, invoker_host string, updated_databases array<string>, microseconds int, error string"
#: From this number of databases on their names are left out.
MANY_DATABASES = 254


def status_fields(status: bytes) -> dict:
    """The variables of a statement's status bytes."""
    b, out = Bytes(status), {}
    while b.at < len(status):
        code = b.number(1)
        if code not in STATUS:
            raise ValueError(f"unknown status code {code}")
        fields = STATUS[code]
        for name, kind in fields if isinstance(fields[0], tuple) else (fields,):
            if isinstance(kind, int):
                out[name] = b.number(kind)
            elif kind == "t":
                out[name] = b.take(b.number(1)).decode("utf-8", "replace")
            elif kind == "n":
                n = b.number(1)
                out[name] = None if n >= MANY_DATABASES else [b.until_zero().decode("utf-8", "replace") for _ in range(n)]
            else:
                out[name] = b.take(int(kind))
    return out


def query_status(events: DataFrame) -> DataFrame:
    """file, position and the status variables of every statement, null where one is not set; error for bytes that
    cannot be read."""
    names = [x.split()[0] for x in _STATUS_SQL.split(", ")]
    number, text = pa.decimal128(20, 0), pa.string()
    kinds = [pa.string(), pa.int64(), pa.int64(), number, pa.int32(), pa.int32(), pa.binary(), text, text, pa.int32(), pa.int32(), number, text, text, pa.list_(text), pa.int32(), text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, position, status in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = status_fields(status)
                except ValueError as e:
                    found = {"error": str(e)}
                found = {k: Decimal(v) if k in ("sql_mode", "table_map_for_update") else v for k, v in found.items()}
                rows.append((file, position, *(found.get(n) for n in names)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=["file", "position", *names])

    return queries(events).select("file", "position", "status").mapInArrow(run, f"file string, position long, {_STATUS_SQL}")


#: Sizes of the fixed part by event type, and of the format event of versions 5.5 and 5.6; fixed values.
FIXED_SIZES = {QUERY: 13, STOP: 0, ROTATE: 8, XID: 0, TABLE_MAP: 8, WRITE_V1: 8, UPDATE_V1: 8, DELETE_V1: 8, ROWS_QUERY: 0, WRITE_V2: 10, UPDATE_V2: 10, DELETE_V2: 10, GTID: 25, PREVIOUS_GTIDS: 0}
FORMAT_SIZES = (84, 92)


def formats(events: DataFrame) -> DataFrame:
    """file, position, version, server, created, header_size, sizes (fixed sizes by event type, from type 1 on), checksum
    (0 none, 1 CRC32, null before 5.6) and error, for format events: wrong versions, sizes or checksums."""
    b = F.col("body")
    byte = lambda at: F.conv(F.hex(F.substring(b, at + 1, 1)), 16, 10).cast("int")
    tail = F.octet_length(b) - 57
    # from 5.6 on an algorithm byte and a checksum follow, which is cut off where it is in use
    old, new = tail == 27, tail.isin(36, 40)
    at = lambda i: F.conv(F.hex(F.substring(b, i + F.lit(57), F.lit(1))), 16, 10).cast("int")
    # relay logs of a 5.5 source and a 5.6 replica have room for more types than the source knows
    known = F.when(new & (byte(57 + WRITE_V2 - 1) > 0), 35).otherwise(27)
    of = events.where(F.col("type") == FORMAT).select(
        "file", "position", little_endian(b, 0, 2).cast("int").alias("version"), F.regexp_extract(F.substring(b, 3, 50).cast("string"), r"^([^\x00]*)", 1).alias("server"), little_endian(b, 52, 4).alias("created"), byte(56).alias("header_size"),
        F.when(old | new, F.transform(F.sequence(F.lit(1), known), at)).alias("sizes"), F.when(new, byte(57 + 35)).alias("checksum"),
    )
    size = lambda kind: F.get("sizes", F.lit(kind - 1))
    wrong = [F.when(size(k).isNotNull() & (size(k) != n), F.lit(f"{EVENT_NAMES[k]} has a fixed size other than {n}")) for k, n in FIXED_SIZES.items()]
    wrong.append(F.when(~size(FORMAT).isin(*FORMAT_SIZES), F.lit("FORMAT_DESCRIPTION has an unknown fixed size")))
    error = (
        F.when(F.col("sizes").isNull(), "unknown variant of the format")
        .when(F.col("version") != 4, "not version 4")
        .when(F.col("header_size") != HEADER.size, "headers have extra bytes")
        .when(~F.coalesce("checksum", F.lit(0)).isin(0, 1), "unknown checksum algorithm")
        .otherwise(F.nullif(F.concat_ws("; ", *wrong), F.lit("")))
    )
    return of.withColumn("error", error)


def mode_enabled(sql_mode: Column, bit: int) -> Column:
    """Whether a bit of the SQL mode, an unsigned number, is set; false where there is none."""
    wide = lambda n: F.lit(Decimal(n)).cast("decimal(21,0)")
    return F.coalesce(sql_mode.cast("decimal(20,0)") % wide(2 << bit) >= wide(1 << bit), F.lit(False))


def rotations(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == ROTATE).select("file", "position", little_endian(F.col("body"), 0, 8).cast("long").alias("new_position"), _rest(8).cast("string").alias("new_file"))


def checked_rotations(events: DataFrame, prefix: str) -> DataFrame:
    """rotations with error: a file's rotation must name the prefix and the number after its own, 999999 before 0.
    Numbers have six digits, or more where files are already numbered beyond 999999."""
    digits = F.substring(F.col("new_file"), F.lit(len(prefix) + 1), F.length("new_file"))
    named = F.regexp_extract("file", rf"\Q{prefix}\E([0-9]{{6,}})$", 1)
    own = F.when(named != "", named).otherwise(F.regexp_extract("file", r"([0-9]{6})$", 1)).try_cast("long")
    wrong = (
        F.when(~F.startswith("new_file", F.lit(prefix)) | (F.length(digits) != 6) & ~F.rlike(digits, F.lit("^[1-9][0-9]{6,}$")), "wrong prefix")
        .when(~F.rlike(digits, F.lit("^[0-9]+$")), "wrong number")
        .when(~F.coalesce(digits.try_cast("long") == F.when(own == 999_999, 0).otherwise(own + 1), F.lit(False)), "not the next file")
    )
    return rotations(events).withColumn("error", wrong)


def relayed(events: DataFrame) -> DataFrame:
    """Events of relay logs without what the relay itself wrote: the first format event of each file, and
    rotations whose header says they were not sent on (a timestamp other than 0)."""
    own = (F.col("type") == ROTATE) & (F.col("timestamp") != 0)
    is_format = F.col("type") == FORMAT
    # a file's format events meet in one group, every other event is a group of its own
    w = Window.partitionBy("file", F.when(is_format, F.lit(-1).cast("long")).otherwise(F.col("position"))).orderBy("position")
    return events.where(~own).withColumn("_nth", F.rank().over(w)).where(~is_format | (F.col("_nth") > 1)).select(*events.columns)


def event_name(kind: Column) -> Column:
    """Name of an event type; null for numbers beyond the format's."""
    return F.get(F.array(*map(F.lit, EVENT_NAMES)), kind)


def transactions(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == XID).select("file", "position", little_endian(F.col("body"), 0, 8).alias("xid"))


def gtids(events: DataFrame) -> DataFrame:
    b = F.col("body")
    h = F.lower(F.hex(F.substring(b, 2, 16)))
    sid = F.concat_ws("-", *(F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    wrong = F.when(F.octet_length(b) != 25, "wrong size").when(~F.substring(b, 1, 1).isin(F.lit(b"\0"), F.lit(b"\1")), "wrong commit flag")
    return events.where(F.col("type") == GTID).select("file", "position", (F.substring(b, 1, 1) == F.lit(b"\1")).alias("commit"), sid.alias("sid"), little_endian(b, 17, 8).alias("number"), wrong.alias("error"))


def row_queries(events: DataFrame) -> DataFrame:
    """Statements of row events; their first byte, a length, is of no use."""
    return events.where(F.col("type") == ROWS_QUERY).select("file", "position", _rest(1).cast("string").alias("statement"))


def previous_gtids(events: DataFrame) -> DataFrame:
    """sid, first, last (excluded) of every interval; a body that ends early gives one row with error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows: list[tuple] = []
            for file, position, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b, found = Bytes(body), []
                try:
                    for _ in range(b.number(8)):
                        sid = b.take(16).hex()
                        found += [(file, position, sid, *struct.unpack("<qq", b.take(16)), None) for _ in range(b.number(8))]
                    if b.at != len(body):
                        raise ValueError("bytes are left over")
                except ValueError as e:
                    found = [(file, position, None, None, None, str(e))]
                rows += found
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["file", "position", "sid", "first", "last", "error"])

    return events.where(F.col("type") == PREVIOUS_GTIDS).select("file", "position", "body").mapInArrow(run, "file string, position long, sid string, first long, last long, error string")


class Bytes:
    """A cursor over a body."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the body ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int, order: str = "little") -> int:
        return int.from_bytes(self.take(n), order)

    def packed(self) -> int:
        """A length-encoded number."""
        n = self.number(1)
        if n == 251:
            raise ValueError("a null length")
        return self.number({252: 2, 253: 3, 254: 8}[n]) if n > 251 else n

    def until_zero(self) -> bytes:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("the body ends early")
        raw = self.data[self.at : end]
        self.at = end + 1
        return raw

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i // 8] >> i % 8 & 1) for i in range(n)]


_INTEGERS = {1: 1, 2: 2, 3: 4, 8: 8, 9: 3}
_META = {4: 1, 5: 1, 15: 2, 16: 2, 17: 1, 18: 1, 246: 2, 252: 1, 253: 2, 254: 2}


def table_map(body: bytes) -> dict:
    b = Bytes(body)
    out = {"id": b.number(6), "flags": b.number(2)}
    for name in ("database", "table"):
        out[name] = b.take(b.number(1)).decode("utf-8", "replace")
        b.take(1)
    n = b.packed()
    kinds = list(b.take(n))
    meta = Bytes(b.take(b.packed()))
    out["metas"] = []
    for i, kind in enumerate(kinds):
        m = meta.take(_META.get(kind, 0))
        if kind == 254 and m[0] and m[0] & 0x30 != 0x30:  # the length's high bits lie in the type byte
            kinds[i], m = m[0] | 0x30, bytes([m[1], ((m[0] & 0x30) ^ 0x30) >> 4])
        elif kind == 254:
            kinds[i], m = m[0] or 254, bytes([m[1], 0])
        out["metas"].append(m)
    if meta.at != len(meta.data):
        raise ValueError("metadata is left over")
    out["kinds"], out["nullable"] = kinds, b.bits(n)
    return out


def _fraction(b: Bytes, digits: int) -> int:
    """Microseconds of a fraction of the given precision."""
    size = (digits + 1) // 2
    return b.number(size, "big") * 10 ** (6 - 2 * size)


def field(kind: int, meta: bytes, b: Bytes) -> str:
    """A value as text: numbers in decimal, times in ISO form, bytes as UTF-8 or else 0x and hex."""
    if kind in _INTEGERS:
        return str(b.number(_INTEGERS[kind]))
    if kind == 4:
        return repr(struct.unpack("<f", b.take(4))[0])
    if kind == 5:
        return repr(struct.unpack("<d", b.take(8))[0])
    if kind == 7:
        return str(b.number(4))
    if kind == 13:
        return str(b.number(1) + 1900)
    if kind == 12:
        d = f"{b.number(8):014d}"
        return f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:10]}:{d[10:12]}:{d[12:14]}"
    if kind == 17:
        return f"{b.number(4, 'big')}.{_fraction(b, meta[0]):06d}"
    if kind == 18:
        packed = b.number(5, "big") - (1 << 39)
        day, clock = packed >> 17, packed & (1 << 17) - 1
        months = day >> 5
        return f"{months // 13:04d}-{months % 13:02d}-{day & 31:02d} {clock >> 12:02d}:{clock >> 6 & 63:02d}:{clock & 63:02d}.{_fraction(b, meta[0]):06d}"
    if kind in (15, 253, 254):
        most = int.from_bytes(meta, "little") if kind != 254 else meta[0] | meta[1] << 8
        raw = b.take(b.number(1 if most < 256 else 2))
        raw = raw.ljust(most, b"\0") if kind == 254 else raw
    elif kind == 252:
        raw = b.take(b.number(meta[0]))
    else:
        raise ValueError(f"values of type {kind} are not decoded")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "0x" + raw.hex()


def row_images(kind: int, body: bytes, m: dict) -> list[tuple[list | None, list | None]]:
    """(before, after) of each row of a row event, values by column; unused columns are None."""
    b = Bytes(body)
    if b.number(6) != m["id"]:
        raise ValueError("the table map in force is of another table")
    b.take(2)
    if kind >= WRITE_V2:
        extra = b.number(2)
        if extra < 2:
            raise ValueError("wrong size of extra information")
        if extra > 2 and b.data[b.at] != 0:
            raise ValueError("unknown kind of extra information")
        b.take(extra - 2)
    width = b.packed()
    if width > len(m["kinds"]):
        raise ValueError("more columns than the table has")
    used = [b.bits(width) for _ in range(2 if OPERATIONS[kind] == "update" else 1)]

    def image(columns: list[bool]) -> list:
        here = [i for i, u in enumerate(columns) if u]
        nulls = b.bits(len(here))
        out: list = [None] * len(m["kinds"])
        for i, null in zip(here, nulls, strict=True):
            if null and not m["nullable"][i]:
                raise ValueError("NULL in a column that has none")
            if not null and m["kinds"][i] != 6:
                out[i] = field(m["kinds"][i], m["metas"][i], b)
        return out

    rows = []
    while b.at < len(body):
        images = [image(u) for u in used]
        rows.append({"insert": (None, images[0]), "delete": (images[0], None)}.get(OPERATIONS[kind]) or (images[0], images[1]))
    return rows


def extra_of(kind: int, body: bytes) -> bytes | None:
    """Extra information of rows of version 2, without its length; null where there is none."""
    size = int.from_bytes(body[8:10], "little") - 2 if kind >= WRITE_V2 else 0
    return body[10 : 10 + size] if size > 0 else None


def changes(events: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """file, position, row, database, table, operation, before, after (arrays of text), error and extra (the bytes that
    rows of version 2 carry), one row per row image. The map in force is the last of the file before the event.

    Events of whole files bring that map with them. For others, such as those of a tail, the maps alone go through the
    file's window, with the places of events. Bodies are dealt by event, so that one large file is decoded by many
    tasks.
    """
    rows = events.where(F.col("type").isin(TABLE_MAP, *OPERATIONS))
    is_map = F.col("type") == TABLE_MAP
    bodies = rows.where(~is_map)
    if "map" in events.columns:
        joined = bodies.select("file", "position", "type", "body", "map").repartition("file", "position")
    else:
        w = Window.partitionBy("file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
        places = rows.select("file", "position", "type", F.when(is_map, F.col("body")).alias("_m")).withColumn("map", F.last("_m", ignorenulls=True).over(w)).where(~is_map).select("file", "position", "map")
        joined = bodies.select("file", "position", "type", "body").join(places, ["file", "position"])
    names = ["file", "position", "row", "database", "table", "operation", "before", "after", "error", "extra"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[bytes | None, dict] = (None, {})
        for batch in batches:
            out = []
            for file, position, kind, body, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if raw is None:
                        raise ValueError("no table map before the rows")
                    if raw != seen[0]:
                        seen = (raw, table_map(raw))
                    m = seen[1]
                    out += [(file, position, i, m["database"], m["table"], OPERATIONS[kind], x, y, None, extra_of(kind, body)) for i, (x, y) in enumerate(row_images(kind, body, m))]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    if mode == "FAILFAST":
                        raise
                    out.append((file, position, None, None, None, OPERATIONS[kind], None, None, str(e), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 10, kinds, strict=True)], names=names)

    return joined.select("file", "position", "type", "body", "map").mapInArrow(run, "file string, position long, row int, database string, table string, operation string, before array<string>, after array<string>, error string, extra binary")


def typed(images: Column, schema: StructType, bits: dict[str, int] | None = None) -> list[Column]:
    """The columns of a row image under a schema; bits: width of the integer columns that are signed."""
    out = []
    for i, f in enumerate(schema):
        text = images[i]
        if bits and f.name in bits:
            n = text.cast("decimal(20,0)")
            half = F.lit(1 << bits[f.name] - 1).cast("decimal(20,0)")
            text = F.when(n >= half, n - half - half).otherwise(n)
        out.append(text.cast(f.dataType).alias(f.name))
    return out


def current_rows(base: DataFrame, log: DataFrame, schema: StructType, key: list[str]) -> DataFrame:
    """base after the changes: by key the last image of the log wins, an insert or update over a delete before it."""
    image = F.coalesce("after", "before")
    rows = log.where("error is null").select(*typed(image, schema), F.struct("file", "position", "row").alias("_at"), (F.col("operation") == "delete").alias("_gone"))
    rest = [f.name for f in schema if f.name not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest, "_gone"), "_at").alias("_l"))
    kept = base.join(last.select(*key), key, "left_anti").select(*schema.names)
    return kept.unionByName(last.where("not _l._gone").select(*(F.col(k) if k in key else F.col(f"_l.{k}").alias(k) for k in schema.names)))


class LogSource(DataSource):
    """Format quern_log: events of rotating files prefix000001, prefix000002 ... in a folder, local or of a store that
    pyarrow's file systems reach; after 999999 comes 000000. As a stream its offset is the last file, the place after
    its last whole event and the checksum size in force there, and reading goes on from that place; options: path,
    prefix, first (file number)."""

    @classmethod
    def name(cls) -> str:
        return "quern_log"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FolderReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _TailReader(self.options)


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None, checksum: int | None = None):
        self.path, self.start, self.stop, self.checksum = path, start, stop, checksum


def _opened(path: str):
    """A file of any store, for reading at places."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(inner)


def _events_between(piece: _Piece) -> Iterator[tuple]:
    with _opened(piece.path) as f:
        if f.read(4) != MAGIC:
            if piece.stop is None:
                raise ValueError(f"{piece.path} is not a change log")
            return
        f.seek(piece.start)
        data = f.read() if piece.stop is None else f.read(piece.stop - piece.start)
    for at, *rest in frames(data, 0, piece.checksum):
        yield (piece.path, piece.start + at, *rest)


def end_of(path: str, at: int = 4, checksum: int = 0) -> tuple[int, int]:
    """The place after the last whole event, and the checksum size in force there, found from the headers alone."""
    with _opened(path) as f:
        size = f.size()
        while at + HEADER.size <= size:
            f.seek(at)
            _, kind, _, length, _, _ = HEADER.unpack(f.read(HEADER.size))
            if length < HEADER.size or at + length > size:
                break
            if kind == FORMAT:
                checksum = _checksum_size(f.read(length - HEADER.size))
            at += length
    return at, checksum


def in_turn(files: list[str]) -> list[str]:
    """Log files by number; where numbers have gone past 999999, those after the widest gap come first."""
    number = lambda f: int(f[-6:]) if f[-6:].isdigit() else int("".join(c for c in f.rsplit(".", 1)[-1] if c.isdigit()) or 0)
    files = sorted(files, key=number)
    if len(files) > 1 and number(files[0]) == 0 and number(files[-1]) == 999_999:
        gaps = [number(b) - number(a) for a, b in zip(files[:-1], files[1:], strict=True)]
        cut = gaps.index(max(gaps)) + 1
        files = files[cut:] + files[:cut]
    return files


class _FolderReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _files(self) -> list[str]:
        from pyarrow import fs

        folder, prefix = self.options["path"].rstrip("/"), self.options.get("prefix", "")
        store, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file]
        return in_turn([f"{folder}/{n}" for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()])

    def partitions(self) -> list[_Piece]:
        return [_Piece(f, 4, None) for f in self._files()]

    def read(self, partition: _Piece) -> Iterator[tuple]:
        return _events_between(partition)


class _TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.files = _FolderReader(options)
        self.first = options.get("first")
        self.reached: dict = {}

    def _numbered(self) -> list[str]:
        files = self.files._files()
        if self.first is None:
            return files
        start = [i for i, f in enumerate(files) if int(f[-6:]) == int(self.first)]
        return files[start[0] :] if start else [f for f in files if int(f[-6:]) >= int(self.first)]

    def initialOffset(self) -> dict:
        return {"file": "", "position": 4, "checksum": 0}

    def latestOffset(self) -> dict:
        """The place after the last whole event; the same as before while only part of an event has come. Looks at
        headers from the place of the last call on."""
        files = self._numbered()
        if not files:
            return self.initialOffset()
        known = self.reached if self.reached.get("file") == files[-1] else {"position": 4, "checksum": 0}
        at, checksum = end_of(files[-1], known["position"], known["checksum"])
        self.reached = {"file": files[-1], "position": at, "checksum": checksum}
        return dict(self.reached)

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        files = self._numbered()
        if start["file"] and start["file"] not in files:
            raise ValueError(f"{start['file']}, where reading is to go on, is gone")
        lo = files.index(start["file"]) if start["file"] else 0
        hi = files.index(end["file"]) if end["file"] else -1
        out = []
        for i, f in enumerate(files[lo : hi + 1], lo):
            from_ = (start["position"], start.get("checksum")) if f == start["file"] else (4, 0)
            stop = end["position"] if i == hi else None
            if stop is None or stop > from_[0]:
                out.append(_Piece(f, from_[0], stop, from_[1]))
        return out

    def read(self, partition: _Piece) -> Iterator[tuple]:
        return _events_between(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept: files stay with their owner."""
