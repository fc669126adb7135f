import duckdb
import pytest

from quern.llm import line_dedup as L


def plain(rows):
    """First windows stay, in order of id and line; the lines of later ones go."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    seen, out = {}, {}
    for i, t in sorted(set(rows), key=key):
        lines = (t or "").split("\n")
        norm = [x.strip(" \t\r") for x in lines]
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(norm[p : p + 3])
            if any(w) and seen.setdefault(w, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        out[(i, t)] = (0 if t is None else len(lines), len(gone), None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone))
    return out


def test_equals_plain(frame, odd):
    rows = [*odd, (30, "a\nb\nc\nd"), (31, "z\na \n\tb\nc\r\ny"), (32, "q\nq\nq\nq\nq"), (33, "\n\n\n\n"), (34, "a\nb\nc\nd")]
    want = plain(rows)
    got = L.dedup_lines(frame(rows)).collect()
    assert len(got) == len(rows)
    source = dict((i, t) for i, t in rows if i is not None)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_lines, r.n_removed, r.text) == want[(r.doc_id, source[r.doc_id])]
    assert {r.doc_id: r.text for r in got}[34] == ""


def test_sql(frame):
    rows = [(i, "\n".join("abcab"[(i * j) % 5] for j in range(1, 9 + i % 3))) for i in range(40)] + [(99, None)]
    import pandas as pd

    docs = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = duckdb.sql(L.SQL.format(docs="docs")).fetchall()
    got = [(r.doc_id, r.n_lines, r.n_removed, r.text) for r in L.dedup_lines(frame(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_native_and_empty(frame):
    out = L.dedup_lines(frame([]))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("copies", [50])
def test_hot_passage(frame, copies):
    rows = [(i, f"own {i}\nshared one\nshared two\nshared three\ntail {i}") for i in range(copies)]
    got = {r.doc_id: r.text for r in L.dedup_lines(frame(rows)).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own {i}\ntail {i}" for i in range(1, copies))
