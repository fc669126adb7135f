import hashlib

import pytest

from quern.llm import warc as W

PAGES = "page_id long, url string, html string, digest string"


def make(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], PAGES).repartition(3)


def plain(rows):
    least = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= 100:
            least[p] = min(i, least.get(p, i))
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = p in least and least[p] != i and sum((x or "").encode() == p for _, _, x in rows) > 1
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", least[p] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("version", [1, 2])
def test_pages(spark, version):
    long_ = "<p>" + "ü" * 60
    rows = [(3, "http://a/ b\n", long_), (1, None, long_), (2, "http://c", long_), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", long_), (9, "http://é", "x" * 99), (10, "v", "x" * 99), (11, "v", "x" * 100), (11, "v", "x" * 100), (12, "w", "x" * 100), (13, "w", "y" * 9_000_000)]
    got = W.archived(make(spark, rows), version).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    assert W.archived(make(spark, [])).count() == 0


def test_formats():
    data = W.arc_bytes([(1, "http://a", b"x\ny"), (2, None, b"")], 2, "20200102030405", "n.arc")
    records = list(W.arc_records(data))
    assert [r["url"] for r, _ in records] == ["http://a", "urn:none"] and records[0][0]["result-code"] == "200"
    assert W.split_http(records[0][1])[1] == b"x\ny"
    for bad in (data.replace(b"2 0 quern", b"9 0 quern"), data[:-1], data.replace(b" 200 - - ", b" 200 - ", 5)):
        with pytest.raises(ValueError):
            list(W.arc_records(bad))
    one = W.warc_record("http://a", "20200102030405", 1, b"abc", "d", None, False)
    fields, block = next(W.warc_records(W._gzip(one)))
    assert fields["warc-date"] == "2020-01-02T03:04:05Z" and block.endswith(b"abc") and fields["warc-record-id"] == W.record_id(1, "d")


def test_declared_digest_is_checked(spark):
    broken = W._gzip(W.warc_record("u", "20200102030405", 1, b"abc", "0" * 64, None, False))
    with pytest.raises(Exception, match="does not have the payload"):
        W.read_warc(spark.createDataFrame([(bytearray(broken),)], "archive binary")).collect()


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "http://a", "x" * 200), (1, "http://a", "x" * 200), (2, None, "x" * 200), (3, "http://c", None), (None, "http://d", "y" * 200)]
    pages = spark.createDataFrame([(*x, "archive", "d", 7) for x in rows], "page_id long, url string, html string, archive string, digest string, size long").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.archived(pages).collect()), key=repr)
    assert got == sorted([(1, 200, "response", None)] * 2 + [(2, 200, "revisit", 1), (3, 0, "response", None), (None, 200, "response", None)], key=repr)


def test_reading_takes_windows(monkeypatch):
    monkeypatch.setattr(W, "_WINDOW", 7)
    records = [W.warc_record("http://a", "20240101000000", i, b"p" * i * 50, "d", None, False) for i in range(9)]
    data = b"".join(map(W._gzip, records))
    assert [f["content-length"] for f, _ in W.warc_records(data)] == [str(len(W._http(i, i * 50)) + i * 50) for i in range(9)]
    with pytest.raises(ValueError, match="cut short"):
        list(W.warc_records(data[:-3]))
