import datetime as dt

import pytest

from quern.operators import expressions as E
from quern.operators import statements as S
from quern.operators.tables import Table, datetime_field, int_field, str_field

T = Table("t", int_field("a"), int_field("b"), str_field("s"), datetime_field("d"))
U = Table("u", int_field("b"), int_field("c"))


@pytest.fixture(scope="module")
def source(spark):
    t = spark.createDataFrame([(1, 10, "x", None), (2, 20, "y_%", None), (3, None, None, None), (4, 20, "z", None)], "a long, b long, s string, d timestamp_ntz")
    u = spark.createDataFrame([(10, 100), (20, 200), (30, 300)], "b long, c long")
    return {"t": t, "u": u}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sql_text():
    j = T.left_join(U, E.eq(T.b, U.b))
    q = S.select(j, T.a, E.Func("sum", U.c).alias("total")).where(E.and_(E.gt(T.a, 1), E.neq(T.s, None))).group_by(T.a).order_by(T.a.desc()).limit(5).offset(2)
    assert q.sql("db") == "SELECT `t`.`a`, (sum(`u`.`c`)) AS `total` FROM `db`.`t` LEFT JOIN `db`.`u` ON `t`.`b` = `u`.`b` WHERE (`t`.`a` > 1 AND `t`.`s` IS NOT null) GROUP BY `t`.`a` ORDER BY `t`.`a` DESC LIMIT 2, 5"
    assert S.select(T.force_index("i"), T.a).for_update().with_shared_lock().sql("db").endswith("`t` FORCE INDEX (`i`) FOR UPDATE")
    assert S.update(T).set(T.b, E.add(T.b, 1)).where(E.eq(T.a, 1)).order_by(T.a).limit(1).sql("db") == "UPDATE `db`.`t` SET `t`.`b`=(`t`.`b` + 1) WHERE `t`.`a` = 1 ORDER BY `t`.`a` ASC LIMIT 1"
    assert S.insert(T, T.a, T.s).add(1, "it's").on_duplicate_key(T.s, E.ColumnValue(T.s)).sql("db") == "INSERT INTO `db`.`t` (`t`.`a`, `t`.`s`) VALUES (1, 'it\\'s') ON DUPLICATE KEY UPDATE `t`.`s`=VALUES(`t`.`s`)"
    assert E.Interval(-dt.timedelta(hours=50, microseconds=50)).sql() == "INTERVAL '-50:00:00:000050' HOUR_MICROSECOND"
    assert E.quote('a\0\'"\b\n\r\t\x1a\\\\%') == "'a\\0\\'\\\"\\b\\n\\r\\t\\Z\\\\\\%'"
    assert E.Literal(b"\x01\xab").sql() == "X'01AB'"
    assert S.set_gtid_next(bytes(range(16)), 5) == "SET GTID_NEXT='00010203-0405-0607-0809-0a0b0c0d0e0f:5'"
    assert S.lock_tables((T, "r"), (U, "w")) == "LOCK TABLES `t` READ, `u` WRITE"


@pytest.mark.parametrize(
    "build",
    [
        lambda: Table("t"), lambda: Table("1t", int_field("a")), lambda: int_field("a b"), lambda: E.and_(), lambda: E.add(), lambda: E.Tuple(), lambda: E.Literal(1 << 64), lambda: E.In(T.a, "abc"),
        lambda: S.select(T).sql("db"), lambda: S.update(T).set(T.a, 1).sql("db"), lambda: S.update(T).where(E.eq(T.a, 1)).sql("db"), lambda: S.delete(T).sql("db"), lambda: S.insert(T, T.a).sql("db"),
        lambda: S.insert(T, T.a).add(1, 2).sql("db"), lambda: S.update(T).set(T.col("no"), 1).where(E.eq(T.a, 1)).sql("db"), lambda: S.union().sql("db"), lambda: S.lock_tables(), lambda: T.inner_join(None, E.eq(T.a, 1)),
        lambda: S.union(S.select(T, T.a), S.select(T, T.a, T.b)).sql("db"), lambda: S.union(S.select(T, T.a).order_by(T.a), S.select(T, T.b)).sql("db"), lambda: S.select(T, T.a).comment("*/"), lambda: S.set_gtid_next(b"1", 1),
    ],
)
def test_refused(build):
    with pytest.raises(E.StatementError):
        build()


def test_unknown_column_is_an_error_when_built(source):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        S.select(T, T.col("nope")).frame(source)


def test_nulls_and_likes(source):
    assert rows(S.select(T, T.a).where(E.eq(T.b, None)).frame(source)) == [(3,)]
    assert rows(S.select(T, T.a).where(E.eq(T.b, T.b)).frame(source)) == [(1,), (2,), (4,)]
    assert rows(S.select(T, T.a).where(E.like(T.s, "y" + E.escape_for_like("_%"))).frame(source)) == [(2,)]
    assert rows(S.select(T, E.div(T.a, 0).alias("x")).frame(source)) == [(None,)] * 4
    assert rows(S.select(T, T.a).where(E.eq(T.a, 1)).where(E.eq(T.a, 2)).frame(source)) == [(2,)]


def test_union_of_one_keeps_outer_clauses(source):
    one = S.union(S.select(T, T.a.alias("k"))).order_by(E.ColumnRef(None, "k").desc()).limit(2)
    assert [r.k for r in one.frame(source).collect()] == [4, 3]


def test_offset_needs_limit(source):
    assert S.select(T, T.a).order_by(T.a).offset(2).frame(source).count() == 4


def test_dml(source):
    t = source["t"]
    done = S.update(T).set(T.a, E.add(T.a, 100)).set(T.b, T.a).where(E.gt(T.b, 5)).order_by(T.a.desc()).limit(2).frame(t)
    assert sorted(r.a for r in done.collect()) == [1, 3, 102, 104]
    assert {r.a: r.b for r in done.collect()}[104] == 4  # assignments see the old row
    assert rows(S.delete(T).where(E.gt(T.b, 15)).frame(t).select("a")) == [(1,), (3,)]  # NULL does not match
    more = S.insert(T, T.a, T.b).add(1, 5).add(9, 6).add(9, 7)
    up = more.on_duplicate_key(T.b, E.add(T.b, E.ColumnValue(T.b))).frame(t, key=["a"])
    assert {r.a: r.b for r in up.collect()} == {1: 15, 2: 20, 3: None, 4: 20, 9: 13}
    assert {r.a: r.b for r in more.ignore_duplicates().frame(t, key=["a"]).collect()} == {1: 10, 2: 20, 3: None, 4: 20, 9: 6}
    assert more.frame(t).count() == 7


def test_upsert_of_busy_keys_against_a_loop(spark, monkeypatch):
    import random

    r = random.Random(4)
    t = Table("t", int_field("k"), int_field("a"), int_field("b"))
    schema = "k long, a long, b long"
    stored = [(k, r.randrange(9), r.randrange(9)) for k in range(6)] + [(None, 1, 1)]
    rows = [(i, r.choice([None, *range(9)]) if i % 3 else 2, r.randrange(9), r.choice([None, r.randrange(9)])) for i in range(300)]
    target, given = spark.createDataFrame(stored, schema), spark.createDataFrame(rows, f"_seq long, {schema}")
    cases = [
        ({"a": E.ColumnValue(t.a)}, lambda old, new: (old[0], new[1], old[2])),
        ({"a": E.add(t.a, E.ColumnValue(t.a)), "b": E.If(E.gt(t.a, 50), E.ColumnValue(t.b), t.a)}, lambda old, new: (old[0], old[1] + new[1], new[2] if old[1] > 50 else old[1])),
    ]
    for folded in (1000, 7):
        monkeypatch.setattr(S, "FOLDED", folded)
        for updates, apply in cases:
            held, alone = {x[0]: x for x in stored if x[0] is not None}, [x for x in stored if x[0] is None]
            for _, *new in rows:
                if new[0] is None:
                    alone.append(tuple(new))
                else:
                    held[new[0]] = apply(held[new[0]], new) if new[0] in held else tuple(new)
            got = S.upsert(target, given, ["k"], updates)
            assert sorted(map(tuple, got.collect()), key=repr) == sorted([*held.values(), *alone], key=repr)
    plan = S.upsert(target, given, ["k"], cases[0][0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("HashJoin") == 1  # a busy key costs no further join


def test_limits_with_nulls_ties_and_equal_rows(spark):
    import random

    r = random.Random(6)
    t = Table("t", int_field("a"), int_field("b"))
    data = [(r.choice([None, 1, 2, 3]), r.choice([None, 5, 6])) for _ in range(60)]
    df = spark.createDataFrame(data, "a long, b long").repartition(5)
    place = lambda up: (lambda v: (v is not None, v or 0)) if up else (lambda v: (v is None, -(v or 0)))
    for n in (0, 1, 7, 20, 100):
        for up in (True, False):
            d = S.delete(t).where(E.neq(t.b, 5)).order_by(t.a.asc() if up else t.a.desc()).limit(n)
            matching = sorted((x for x in data if x[1] is not None and x[1] != 5), key=lambda x: place(up)(x[0]))
            left = d.frame(df).collect()
            assert len(left) == 60 - min(n, len(matching))
            gone = [x for x in data]
            for x in left:
                gone.remove(tuple(x))
            assert sorted((place(up)(x[0]) for x in gone)) == [place(up)(x[0]) for x in matching[:n]] and all(x in matching for x in gone)
        u = S.update(t).set(t.a, 99).where(E.eq(t.b, 6)).order_by(t.a).limit(n).frame(df)
        assert u.count() == 60 and u.where("a = 99").count() == min(n, sum(x[1] == 6 for x in data))
