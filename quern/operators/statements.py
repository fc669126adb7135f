"""SELECT, UNION and DML as immutable statements over declared tables.

A statement is checked, then built into a DataFrame (``frame``) or shown as SQL text (``sql``). DML is a pure
function from the table's DataFrame to its new contents. All assignments of an UPDATE see the old row.

Deviations, on purpose: a union of one select keeps its outer clauses; assigning a column that the table
does not have is an error; locks and index hints only show in SQL text. OFFSET counts only with LIMIT.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.expressions import Alias, ColumnRef, ColumnValue, Condition, Expression, Order, StatementError, and_, lift
from quern.operators.tables import Relation, Source, Table

_COMMENT = re.compile(r"^[\w .?]*$")


def _order(items: Sequence[Expression | Order]) -> tuple[Order, ...]:
    return tuple(x if isinstance(x, Order) else Order(x, True) for x in items)


@dataclass(frozen=True)
class _Clauses:
    filter: Condition | None = None
    groups: tuple[Expression, ...] = ()
    orders: tuple[Order, ...] = ()
    count: int = -1
    skip: int = -1

    def where(self, condition: Condition):
        """Replaces the filter."""
        if not isinstance(condition, Condition):
            raise StatementError("a filter must be boolean")
        return replace(self, filter=condition)

    def and_where(self, condition: Condition):
        return replace(self, filter=condition if self.filter is None else and_(self.filter, condition))

    def group_by(self, *expressions: Expression):
        if not expressions:
            raise StatementError("GROUP BY needs expressions")
        return replace(self, groups=expressions)

    def order_by(self, *items: Expression | Order):
        return replace(self, orders=_order(items))

    def limit(self, n: int):
        return replace(self, count=n)

    def offset(self, n: int):
        return replace(self, skip=n)

    def _window(self, df: DataFrame) -> DataFrame:
        if self.count < 0:
            return df
        return (df.offset(self.skip) if self.skip > 0 else df).limit(self.count)

    def _tail(self) -> str:
        out = ""
        if self.filter is not None:
            out += f" WHERE {self.filter.sql()}"
        if self.groups:
            out += " GROUP BY " + ", ".join(g.sql() for g in self.groups)
        if self.orders:
            out += " ORDER BY " + ", ".join(o.sql() for o in self.orders)
        if self.count >= 0:
            out += f" LIMIT {f'{self.skip}, ' if self.skip > 0 else ''}{self.count}"
        return out


@dataclass(frozen=True)
class Select(_Clauses):
    relation: Relation | None = None
    projections: tuple[Expression, ...] = ()
    unique: bool = False
    shared_lock: bool = False
    write_lock: bool = False
    note: str = ""

    def distinct(self) -> Select:
        return replace(self, unique=True)

    def copy(self) -> Select:
        return replace(self)

    def comment(self, text: str) -> Select:
        if not _COMMENT.match(text):
            raise StatementError(f"invalid comment: {text!r}")
        return replace(self, note=text)

    def with_shared_lock(self) -> Select:
        return replace(self, shared_lock=True)

    def for_update(self) -> Select:
        return replace(self, write_lock=True)

    def _check(self) -> None:
        if not self.projections or any(p is None for p in self.projections):
            raise StatementError("a select needs projections, none of them missing")

    def frame(self, source: Source) -> DataFrame:
        self._check()
        if self.shared_lock or self.write_lock:
            warnings.warn("row locks have no meaning for DataFrames", stacklevel=2)
        df = self.relation.frame(source)
        if self.note:
            df.sparkSession.sparkContext.setJobDescription(self.note)
        if self.filter is not None:
            df = df.where(self.filter.column())
        columns = [p.column() for p in self.projections]
        if self.groups:
            df = self._grouped(df)
        elif self.orders and not self.unique:
            # may order by what is not selected; names of the projections win
            names = [p.name for p in self.projections if isinstance(p, Alias)]
            keys = [o for o in self.orders if not (isinstance(o.inner, Alias) and o.inner.name in names)]
            df = df.orderBy(*(o.column() for o in self.orders)).select(*columns) if len(keys) == len(self.orders) else df.select(*columns).orderBy(*(o.column() for o in self.orders))
            return self._window(df)
        else:
            df = df.select(*columns)
        if self.unique:
            df = df.distinct()
        if self.orders:
            df = df.orderBy(*(F.col(f"`{_name(o.inner)}`").asc_nulls_first() if o.ascending else F.col(f"`{_name(o.inner)}`").desc_nulls_last() for o in self.orders))
        return self._window(df)

    def _grouped(self, df: DataFrame) -> DataFrame:
        """Projections that are grouping expressions come from the keys, the others are aggregates."""
        plain = [g.inner if isinstance(g, Alias) else g for g in self.groups]
        at = {g.sql(): i for i, g in enumerate(plain)}
        place = [at.get((p.inner if isinstance(p, Alias) else p).sql()) for p in self.projections]
        named = [(p.inner if isinstance(p, Alias) else p).column().alias(f"_p{n}") for n, p in enumerate(self.projections) if place[n] is None]
        grouped = df.groupBy(*(g.column().alias(f"_g{i}") for i, g in enumerate(plain))).agg(*(named or [F.lit(1).alias("_one")]))
        return grouped.select(*(F.col(f"_p{n}" if place[n] is None else f"_g{place[n]}").alias(_name(p)) for n, p in enumerate(self.projections)))

    def sql(self, database: str) -> str:
        self._check()
        lock = " FOR UPDATE" if self.write_lock else " LOCK IN SHARE MODE" if self.shared_lock else ""
        note = f"/* {self.note} */ " if self.note else ""
        return f"SELECT {note}{'DISTINCT ' if self.unique else ''}{', '.join(p.sql() for p in self.projections)} FROM {self.relation.sql(database)}{self._tail()}{lock}"


def _name(e: Expression) -> str:
    if isinstance(e, Alias | ColumnRef):
        return e.name
    raise StatementError("grouped or distinct results are named: give an alias")


def select(relation: Relation, *projections: Expression) -> Select:
    return Select(relation=relation, projections=projections)


@dataclass(frozen=True)
class Union(_Clauses):
    selects: tuple[Select, ...] = ()
    every: bool = False

    def _check(self) -> None:
        if not self.selects:
            raise StatementError("a union needs selects")
        if len({len(s.projections) for s in self.selects}) > 1:
            raise StatementError("all selects of a union need as many projections")
        if len(self.selects) > 1 and any(s.orders and s.count < 0 for s in self.selects):
            raise StatementError("a select that is ordered inside a union needs a limit")

    def frame(self, source: Source) -> DataFrame:
        self._check()
        df = self.selects[0].frame(source)
        for s in self.selects[1:]:
            df = df.union(s.frame(source))
        if not self.every and len(self.selects) > 1:
            df = df.distinct()
        if self.filter is not None:
            df = df.where(self.filter.column())
        if self.groups:
            df = df.groupBy(*(g.column() for g in self.groups)).agg(F.lit(1).alias("_one")).drop("_one")
        if self.orders:
            df = df.orderBy(*(o.column() for o in self.orders))
        return self._window(df)

    def sql(self, database: str) -> str:
        self._check()
        parts = (" UNION ALL " if self.every else " UNION ").join(f"({s.sql(database)})" for s in self.selects)
        return f"SELECT * FROM ({parts}) AS `u`{self._tail()}"


def union(*selects: Select) -> Union:
    return Union(selects=selects)


def union_all(*selects: Select) -> Union:
    return Union(selects=selects, every=True)


@dataclass(frozen=True)
class Insert:
    """Rows for some columns of a table; the others become NULL."""

    table: Table
    columns: tuple[ColumnRef, ...]
    rows: tuple[tuple[Expression, ...], ...] = ()
    ignore: bool = False
    updates: tuple[tuple[ColumnRef, Expression], ...] = ()

    def add(self, *values: Any) -> Insert:
        return replace(self, rows=(*self.rows, tuple(lift(v) for v in values)))

    def ignore_duplicates(self) -> Insert:
        return replace(self, ignore=True)

    def on_duplicate_key(self, ref: ColumnRef, value: Any) -> Insert:
        return replace(self, updates=(*self.updates, (ref, lift(value))))

    def _check(self) -> None:
        if not self.columns or not self.rows:
            raise StatementError("an insert needs columns and rows")
        if any(len(r) != len(self.columns) for r in self.rows):
            raise StatementError("a row has more or fewer values than there are columns")
        _known(self.table, [c for c, _ in self.updates] + list(self.columns))

    def incoming(self, like: DataFrame) -> DataFrame:
        """The given rows with a running number _seq, in the table's types."""
        one = like.sparkSession.range(1)
        named = {c.name: i for i, c in enumerate(self.columns)}
        rows = F.array(*(F.struct(F.lit(n).alias("_seq"), *((r[named[f]].column() if f in named else F.lit(None)).cast(like.schema[f].dataType).alias(f) for f in self.table.fields)) for n, r in enumerate(self.rows)))
        return one.select(F.explode(rows).alias("r")).select("r.*")

    def frame(self, target: DataFrame, key: Sequence[str] = ()) -> DataFrame:
        self._check()
        given = self.incoming(target)
        if (self.ignore or self.updates) and not key:
            raise StatementError("duplicates need a key")
        if self.updates:
            return upsert(target, given, key, {c.name: e for c, e in self.updates})
        if self.ignore:
            return insert_ignore(target, given, key)
        return target.unionByName(given.drop("_seq"))

    def sql(self, database: str) -> str:
        self._check()
        out = f"INSERT {'IGNORE ' if self.ignore else ''}INTO {self.table.sql(database)} ({', '.join(c.sql() for c in self.columns)}) VALUES "
        out += ", ".join("(" + ", ".join(v.sql() for v in r) + ")" for r in self.rows)
        return out + (" ON DUPLICATE KEY UPDATE " + ", ".join(f"{c.sql()}={e.sql()}" for c, e in self.updates) if self.updates else "")


def insert(table: Table, *columns: ColumnRef) -> Insert:
    return Insert(table, columns)


def _known(table: Table, refs: Sequence[ColumnRef]) -> None:
    unknown = [r.name for r in refs if r.name not in table.fields]
    if unknown:
        raise StatementError(f"{table.name} has no column {', '.join(unknown)}")


def first_of_key(given: DataFrame, key: Sequence[str], order: str = "_seq") -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(*key).orderBy(order)
    return given.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def insert_ignore(target: DataFrame, given: DataFrame, key: Sequence[str], order: str = "_seq") -> DataFrame:
    """target and the rows of given whose keys it lacks, the first of each key; NULL keys never collide."""
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    once = first_of_key(given.where(whole), key, order).unionByName(given.where(~whole))
    return target.unionByName(once.join(target.select(*key), list(key), "left_anti").select(*target.columns))


#: Incoming rows of one key that an upsert folds together before it joins them to the table.
FOLDED = 1000


class _Bound(Expression):
    def __init__(self, c: F.Column):
        self.c = c

    def column(self) -> F.Column:
        return self.c


def _walk(e: Any, put: Callable[[Expression], Expression | None]) -> Any:
    """e with the expressions in it for which put has one replaced."""
    if isinstance(e, list | tuple):
        return type(e)(_walk(x, put) for x in e)
    if not isinstance(e, Expression):
        return e
    if (new := put(e)) is not None:
        return new
    out = object.__new__(type(e))
    for k, v in vars(e).items():
        object.__setattr__(out, k, _walk(v, put))
    return out


def _reads_stored(e: Expression) -> bool:
    found = []

    def put(x: Expression) -> Expression | None:
        if isinstance(x, ColumnRef):
            found.append(x)
        return x if isinstance(x, ColumnRef | ColumnValue) else None

    _walk(e, put)
    return bool(found)


def _bound(e: Expression, stored: F.Column, incoming: F.Column) -> F.Column:
    """e with table columns taken from the stored row and ColumnValue from the incoming one, both structs."""
    put = lambda x: _Bound(incoming[x.ref.name]) if isinstance(x, ColumnValue) else _Bound(stored[x.name]) if isinstance(x, ColumnRef) else None
    return _walk(e, put).column()


def upsert(target: DataFrame, given: DataFrame, key: Sequence[str], updates: dict[str, Expression], order: str = "_seq") -> DataFrame:
    """target after given was inserted in order; a row whose key is there already updates it instead.

    updates may refer to the stored row by columns of the table and to the incoming one by ColumnValue. Where they
    read nothing stored, the first and the last incoming row of a key tell its end, and one aggregate, combined
    before its shuffle, and one join do. Else the rows of a key are folded in order, FOLDED at a time, with one join
    for each such share of the busiest key: one for nearly all inputs, and never more rows together. Rows with a NULL
    in the key never meet others.
    """
    columns, whole = target.columns, F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    kinds = {c: target.schema[c].dataType for c in columns}
    row = F.struct(*(F.col(c).cast(kinds[c]).alias(c) for c in columns))
    after = lambda old, new: F.struct(*((_bound(updates[c], old, new).cast(kinds[c]) if c in updates else old[c]).alias(c) for c in columns))
    alone = given.where(~whole).select(*(F.col(c).cast(kinds[c]).alias(c) for c in columns))
    given = given.where(whole)
    if not any(_reads_stored(e) for e in updates.values()):
        some = given.groupBy(*key).agg(F.min_by(row, order).alias("_first"), F.max_by(row, order).alias("_last"), F.count("*").alias("_n"))
        held = target.select(F.struct(*columns).alias("_old"), *key)
        both = held.join(some, list(key), "full")
        old = F.coalesce("_old", "_first")
        changed = F.when(F.col("_n").isNull() | (F.col("_old").isNull() & (F.col("_n") == 1)), old).otherwise(after(old, F.col("_last")))
        return both.select(changed.alias("_row")).select("_row.*").unionByName(alone)
    ranked = given.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    rounds = ((ranked.agg(F.max("_nth")).first()[0] or 0) + FOLDED - 1) // FOLDED
    out = target
    for n in range(rounds):
        share = ranked.where(F.col("_nth").between(n * FOLDED + 1, (n + 1) * FOLDED))
        some = share.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_nth", row.alias("_row")))).alias("_rows"))
        both = out.select(F.struct(*columns).alias("_old"), *key).join(some, list(key), "full")
        rows = F.transform("_rows", lambda x: x["_row"])
        rest = F.when(F.col("_old").isNull(), F.slice(rows, F.lit(2), F.size("_rows"))).otherwise(rows)
        folded = F.aggregate(rest, F.coalesce("_old", rows[0]), after)
        out = both.select(F.when(F.col("_rows").isNull(), F.col("_old")).otherwise(folded).alias("_row")).select("_row.*")
    return out.unionByName(alone)


@dataclass(frozen=True)
class _Changing:
    table: Table
    filter: Condition | None = None
    orders: tuple[Order, ...] = ()
    count: int = -1

    def where(self, condition: Condition):
        return replace(self, filter=condition)

    def order_by(self, *items: Expression | Order):
        return replace(self, orders=_order(items))

    def limit(self, n: int):
        return replace(self, count=n)

    def _chosen(self, target: DataFrame) -> DataFrame:
        """target with _hit: whether the statement changes the row.

        With a limit, the last of the first n matching rows, by the order and then by hashes of the whole row, is
        fetched, and rows are compared with its values: nothing that a task numbers decides, so a task that runs
        again changes nothing. Rows equal to that last one, which are alike, are counted and made again.
        """
        if self.filter is None:
            raise StatementError("an update or delete needs a filter")
        name, columns = self.table.name, target.columns
        df = target.alias(name)
        hit = F.coalesce(self.filter.column(), F.lit(False))
        if self.count < 0:
            return df.withColumn("_hit", hit)
        if self.count == 0:
            return df.withColumn("_hit", F.lit(False))
        hashes = [F.xxhash64(F.lit(i), *(F.col(f"`{c}`") for c in columns)) for i in (1, 2)]
        keys = [(o.inner.column(), o.ascending) for o in self.orders] + [(h, True) for h in hashes]
        named = [f"_o{i}" for i in range(len(keys))]
        marked = df.withColumn("_hit", hit).withColumns({n: k for n, (k, _) in zip(named, keys, strict=True)})
        order = lambda back: [F.col(n).asc_nulls_first() if up != back else F.col(n).desc_nulls_last() for n, (_, up) in zip(named, keys, strict=True)]
        first = marked.where("_hit").select(*named).orderBy(*order(False)).limit(self.count)
        last = first.orderBy(*order(True)).limit(1).collect()  # one row
        if not last:
            return df.withColumn("_hit", F.lit(False))
        before, same = F.lit(False), F.lit(True)
        for (n, (_, up)), value in zip(zip(named, keys, strict=True), last[0], strict=True):
            v = F.lit(value).cast(marked.schema[n].dataType)
            less = (F.col(n).isNull() & v.isNotNull() | (F.col(n) < v)) if up else (v.isNull() & F.col(n).isNotNull() | (F.col(n) > v))
            before, same = before | (same & F.coalesce(less, F.lit(False))), same & F.col(n).eqNullSafe(v)
        taken = marked.where(F.col("_hit") & before).count()
        apart = marked.where(~(F.col("_hit") & same)).select(*columns, (F.col("_hit") & before).alias("_hit"))
        alike = marked.where(F.col("_hit") & same).groupBy(*columns).agg(F.count("*").alias("_c"))
        again = alike.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_c")).alias("_i")).select(*columns, (F.col("_i") <= self.count - taken).alias("_hit"))
        return apart.unionByName(again).alias(name)

    def _tail(self) -> str:
        if self.filter is None:
            raise StatementError("an update or delete needs a filter")
        out = f" WHERE {self.filter.sql()}"
        if self.orders:
            out += " ORDER BY " + ", ".join(o.sql() for o in self.orders)
        return out + (f" LIMIT {self.count}" if self.count >= 0 else "")


@dataclass(frozen=True)
class Update(_Changing):
    assignments: tuple[tuple[ColumnRef, Expression], ...] = field(default=())

    def set(self, ref: ColumnRef, value: Any) -> Update:
        return replace(self, assignments=(*self.assignments, (ref, lift(value))))

    def _check(self) -> None:
        if not self.assignments:
            raise StatementError("an update needs assignments")
        _known(self.table, [c for c, _ in self.assignments])

    def frame(self, target: DataFrame) -> DataFrame:
        self._check()
        new = {c.name: e for c, e in self.assignments}
        df = self._chosen(target)
        return df.select(*(F.when(F.col("_hit"), new[c].column().cast(target.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns))

    def sql(self, database: str) -> str:
        self._check()
        new = {c.name: e for c, e in self.assignments}
        sets = ", ".join(f"`{self.table.name}`.`{f}`={new[f].sql()}" for f in self.table.fields if f in new)
        return f"UPDATE {self.table.sql(database)} SET {sets}{self._tail()}"


@dataclass(frozen=True)
class Delete(_Changing):
    def frame(self, target: DataFrame) -> DataFrame:
        return self._chosen(target).where(~F.col("_hit")).select(*target.columns)

    def sql(self, database: str) -> str:
        return f"DELETE FROM {self.table.sql(database)}{self._tail()}"


def update(table: Table) -> Update:
    return Update(table)


def delete(table: Table) -> Delete:
    return Delete(table)


def lock_tables(*locks: tuple[Table, str]) -> str:
    """LOCK TABLES as text; DataFrames have no locks."""
    if not locks:
        raise StatementError("a lock needs tables")
    return "LOCK TABLES " + ", ".join(f"`{t.name}` {({'r': 'READ', 'w': 'WRITE'})[kind]}" for t, kind in locks)


def unlock_tables() -> str:
    return "UNLOCK TABLES"


def set_gtid_next(sid: bytes, number: int) -> str:
    if len(sid) != 16:
        raise StatementError("a server id has 16 bytes")
    return f"SET GTID_NEXT='{uuid.UUID(bytes=sid)}:{number}'"
