"""The pipeline over a small corpus, stage by stage, against plain versions of what the stages decide."""

import random

import corpus_pipeline
import __spark_entry__ as entry


WORDS = (
    "committee river morning several proposal winter garden window people letter market silver before after between without yellow mountain teacher kitchen bridge forest music paper engine harbour island "
    "village summer answer question doctor farmer picture number family story water stone road house table chair night light green heavy simple quiet early late always never often maybe under above behind "
    "carried opened closed started finished wanted thought brought turned walked followed remembered found called asked helped moved waited watched built broken painted written spoken given taken shown "
    "every another little large small round narrow wide deep high young ancient modern common special general local foreign public private second third last next other same own whole half many few some"
).split()


def corpus(r):
    prose = lambda n: "\n".join(" ".join(r.choice(WORDS) for _ in range(14)) for _ in range(n))
    rows = [(i, prose(6)) for i in range(30)]
    boiler = "shared line one here\nshared line two here\nshared line three here"
    rows += [(100 + i, prose(6) + "\n" + boiler) for i in range(4)]
    base = prose(10).split()  # on one line, so that no windows repeat
    rows += [(200 + i, " ".join([*base[:-1], f"edit{i}"])) for i in range(3)]
    rows += [(300, "too short"), (301, "word " * 200), (302, prose(6) + " write to jane.doe@mail.org now")]
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(random.Random(2))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, kept = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if n < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / f"s{n}"))
        kept = spark.read.parquet(str(tmp_path / f"s{n}"))
        seen[name] = {r.doc_id: r for r in kept.collect()}
    ids = {i for i, _ in rows}
    assert set(seen["quality rules"]) == ids - {300, 301}
    lines = seen["line dedup"]
    assert "shared line two" in lines[100].text and all("shared line" not in lines[i].text for i in (101, 102, 103))
    assert lines[200].n_chars == len(lines[200].text)
    near = set(seen["n-gram Jaccard join"])
    assert 200 in near and {201, 202}.isdisjoint(near) and near >= set(range(30))
    private = seen["PII"]
    assert "[EMAIL]" in private[302].text and "jane" not in private[302].text and set(private) == near
    assert set(seen["best-fit packing"]) == near
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == near


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, empty and very long texts, ids of several texts, further columns and empty
    tables go through every stage."""
    r = random.Random(6)
    prose = lambda n: "\n".join(" ".join(r.choice(WORDS) for _ in range(14)) for _ in range(n))
    twice, long_ = prose(6), prose(4000)
    rows = [(1, twice, "en", "s"), (1, twice, "en", "s"), (1, prose(6), None, None), (None, prose(6), "en", None), (None, None, None, None), (2, None, "en", "s"), (3, "", "en", "s"), (4, long_, "en", "s"), (5, twice, "en", "t"), (6, prose(6), "xx", "s"), (7, prose(6) + "\n" + prose(6), "en", "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, at string, node long, bin long, _a long, moved long, n_tokens long"
    clash = ("kept", "spans", "at", 1, 2, 3, 4, 5)
    docs = spark.createDataFrame([(*x, len(x[1] or ""), *clash) for x in rows], schema)
    for start in (docs, docs.limit(0)):
        kept, seen = start, {}
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, kept, str(tmp_path))
            if n < 4:
                assert out.columns == docs.columns
            path = str(tmp_path / f"o{n}_{start is docs}")
            out.write.parquet(path)
            kept = spark.read.parquet(path)
            seen[name] = sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect())
        if start is not docs:
            assert all(not x for x in seen.values())
            continue
        # no words and too few of them go; rows that repeat are one document, which has its twin under another id
        assert seen["quality rules"] == [(False, i) for i in (1, 1, 1, 4, 5, 6, 7)] + [(True, 0)]
        assert seen["n-gram Jaccard join"] == [(False, i) for i in (1, 1, 4, 6, 7)] + [(True, 0)] == seen["PII"]
        assert set(seen["best-fit packing"]) == set(seen["PII"])


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_ten_operators_against_sql(spark):
    import duckdb

    from quern.llm.queries import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        rel = c.sql(sql)
        got = QUERIES[name](spark, data).select(*rel.columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall())), name
