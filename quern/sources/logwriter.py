"""Writes change logs for tests and examples."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

from quern.sources import binlog as B


class LogWriter:
    def __init__(self, checksum: bool = False, server: int = 1):
        self.data, self.checksum, self.server = bytearray(B.MAGIC), False, server
        self.format(checksum)

    def format(self, checksum: bool, **changed: int) -> None:
        """A format event; from it on bodies end in a checksum or not. changed: other values of version, header or type
        numbers (t19=7)."""
        self.checksum = False
        self._event(B.FORMAT, _format_body(checksum, **changed), force=checksum)
        self.checksum = checksum

    def _event(self, kind: int, body: bytes, force: bool = False) -> None:
        size = 19 + len(body) + 4 * (self.checksum or force)
        raw = B.HEADER.pack(1_400_000_000, kind, self.server, size, len(self.data) + size, 0) + body
        self.data += raw + (struct.pack("<I", zlib.crc32(raw)) if self.checksum or force else b"")

    def query(self, database: str, statement: str, status: bytes = b"") -> None:
        db = database.encode()
        self._event(B.QUERY, struct.pack("<IIBHH", 7, 0, len(db), 0, len(status)) + status + db + b"\0" + statement.encode())

    def xid(self, n: int) -> None:
        self._event(B.XID, struct.pack("<Q", n))

    def previous_gtids(self, intervals: dict[bytes, list[tuple[int, int]]]) -> None:
        self._event(B.PREVIOUS_GTIDS, struct.pack("<Q", len(intervals)) + b"".join(sid + struct.pack("<Q", len(x)) + b"".join(struct.pack("<qq", *i) for i in x) for sid, x in intervals.items()))

    def gtid(self, sid: bytes, n: int) -> None:
        self._event(B.GTID, b"\1" + sid + struct.pack("<Q", n))

    def rotate(self, name: str, position: int = 4) -> None:
        self._event(B.ROTATE, struct.pack("<Q", position) + name.encode())

    def stop(self) -> None:
        self._event(B.STOP, b"")

    def rows_query(self, statement: str) -> None:
        self._event(B.ROWS_QUERY, bytes([len(statement) & 255]) + statement.encode())

    def table_map(self, id_: int, database: str, table: str, kinds: list[int], meta: bytes, nullable: list[bool]) -> None:
        names = b"".join(bytes([len(x)]) + x.encode() + b"\0" for x in (database, table))
        self._event(B.TABLE_MAP, id_.to_bytes(6, "little") + b"\1\0" + names + bytes([len(kinds)]) + bytes(kinds) + bytes([len(meta)]) + meta + _bits(nullable))

    def rows(self, kind: int, id_: int, width: int, images: list[tuple[list[bool], bytes]], extra: bytes = b"") -> None:
        """images: nulls and the bytes of the other values, all columns used."""
        size = (2 + len(extra)).to_bytes(2, "little") + extra if kind >= B.WRITE_V2 else b""
        used = _bits([True] * width) * (2 if B.OPERATIONS[kind] == "update" else 1)
        self._event(kind, id_.to_bytes(6, "little") + b"\1\0" + size + bytes([width]) + used + b"".join(_bits(n) + v for n, v in images))


@lru_cache(maxsize=64)
def _format_body(checksum: bool, **changed: int) -> bytes:
    sizes = bytearray(35)
    for kind, size in {**B.FIXED_SIZES, B.FORMAT: B.FORMAT_SIZES[1]}.items():
        sizes[kind - 1] = changed.get(f"t{kind}", size)
    body = struct.pack("<H50sIB", changed.get("version", 4), b"5.6.20-log", 1_400_000_000, changed.get("header", 19)) + bytes(sizes)
    return body + bytes([changed.get("algorithm", int(checksum))]) + (b"" if checksum else bytes(4))


def _bits(flags: list[bool]) -> bytes:
    out = bytearray((len(flags) + 7) // 8)
    for i, f in enumerate(flags):
        out[i // 8] |= int(f) << i % 8
    return bytes(out)
