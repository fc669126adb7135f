"""Typed expressions that become Spark columns, or SQL text.

Every node has ``column()`` for execution and ``sql()`` for display. Columns are late bound: a name that no
table declares is an error when the statement is built into a DataFrame.

Choices where MySQL and Spark differ: division by zero is NULL; ``=`` and ``!=`` with a literal NULL on the right
mean IS NULL and IS NOT NULL; comparisons between columns stay three-valued; an empty IN list is false.
Nested arithmetic keeps the grouping of the tree in both forms.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

#: Names, aliases, functions, databases and indexes.
IDENTIFIER = re.compile(r"^[a-zA-Z_]\w*$")
_ESCAPES = {"\0": "\\0", "'": "\\'", '"': '\\"', "\b": "\\b", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\x1a": "\\Z", "\\": "\\\\"}
_INT64, _UINT64 = (-(1 << 63), (1 << 63) - 1), (1 << 64) - 1


class StatementError(ValueError):
    """A statement or expression that cannot be built."""


def identifier(name: str) -> str:
    if not IDENTIFIER.match(name or ""):
        raise StatementError(f"invalid name: {name!r}")
    return name


def escape_for_like(text: str) -> str:
    """Escapes the wildcards _ and %, and nothing else."""
    return text.replace("_", "\\_").replace("%", "\\%")


def quote(text: str) -> str:
    """A quoted SQL string; the LIKE escapes \\% and \\_ stay as they are."""
    out, i = [], 0
    while i < len(text):
        if text[i] == "\\" and text[i + 1 : i + 2] in ("%", "_"):
            out.append(text[i : i + 2])
            i += 2
            continue
        out.append(_ESCAPES.get(text[i], text[i]))
        i += 1
    return "'" + "".join(out) + "'"


class Expression:
    def column(self) -> SparkColumn:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def alias(self, name: str) -> Alias:
        return Alias(name, self)

    def asc(self) -> Order:
        return Order(self, True)

    def desc(self) -> Order:
        return Order(self, False)


class Condition(Expression):
    """An expression that may filter or join."""


class Alias(Expression):
    def __init__(self, name: str, inner: Expression):
        self.name, self.inner = identifier(name), inner

    def column(self) -> SparkColumn:
        return self.inner.column().alias(self.name)

    def sql(self) -> str:
        return f"({self.inner.sql()}) AS `{self.name}`"


class Order:
    def __init__(self, inner: Expression, ascending: bool):
        self.inner, self.ascending = inner, ascending

    def column(self) -> SparkColumn:
        c = F.col(f"`{self.inner.name}`") if isinstance(self.inner, Alias) else self.inner.column()
        return c.asc_nulls_first() if self.ascending else c.desc_nulls_last()

    def sql(self) -> str:
        name = f"`{self.inner.name}`" if isinstance(self.inner, Alias) else self.inner.sql()
        return f"{name} {'ASC' if self.ascending else 'DESC'}"


class ColumnRef(Expression):
    def __init__(self, table: str | None, name: str):
        self.table, self.name = table, identifier(name)

    def column(self) -> SparkColumn:
        return F.col(f"`{self.table}`.`{self.name}`" if self.table else f"`{self.name}`")

    def sql(self) -> str:
        return f"`{self.table}`.`{self.name}`" if self.table else f"`{self.name}`"


class Literal(Expression):
    """None, bool, integers up to unsigned 64 bits, float, str, bytes, datetime or Decimal."""

    def __init__(self, value: Any):
        if isinstance(value, int) and not isinstance(value, bool) and not _INT64[0] <= value <= _UINT64:
            raise StatementError(f"integer out of range: {value}")
        if not (value is None or isinstance(value, bool | int | float | str | bytes | dt.datetime | Decimal)):
            raise TypeError(f"no literal for {type(value).__name__}")
        self.value = value

    def column(self) -> SparkColumn:
        v = self.value
        if isinstance(v, int) and not isinstance(v, bool):
            return F.lit(v).cast("long") if v <= _INT64[1] else F.lit(Decimal(v)).cast("decimal(20,0)")
        if isinstance(v, dt.datetime):
            return F.lit(v.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
        return F.lit(v)

    def sql(self) -> str:
        v = self.value
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, str):
            return quote(v)
        if isinstance(v, bytes):
            return f"X'{v.hex().upper()}'"
        if isinstance(v, dt.datetime):
            return v.strftime("'%Y-%m-%d %H:%M:%S.%f'")
        return repr(v) if isinstance(v, float) else str(v)


def lift(x: Any) -> Expression:
    return x if isinstance(x, Expression) else Literal(x)


class _Binary(Expression):
    def __init__(self, op: str, build, left: Any, right: Any):
        self.op, self.build, self.left, self.right = op, build, lift(left), lift(right)

    def column(self) -> SparkColumn:
        return self.build(self.left.column(), self.right.column())

    def sql(self) -> str:
        inner = [f"({x.sql()})" if isinstance(x, _Binary) and not isinstance(self, _Comparison) else x.sql() for x in (self.left, self.right)]
        return f"{inner[0]} {self.op} {inner[1]}"


class _Comparison(_Binary, Condition):
    pass


class _IsNull(Condition):
    def __init__(self, inner: Expression, wanted: bool):
        self.inner, self.wanted = inner, wanted

    def column(self) -> SparkColumn:
        return self.inner.column().isNull() if self.wanted else self.inner.column().isNotNull()

    def sql(self) -> str:
        return f"{self.inner.sql()} IS {'' if self.wanted else 'NOT '}null"


def _null(x: Expression) -> bool:
    return isinstance(x, Literal) and x.value is None


def eq(left: Any, right: Any) -> Condition:
    a, b = lift(left), lift(right)
    return _IsNull(a, True) if _null(b) else _Comparison("=", lambda x, y: x == y, a, b)


def neq(left: Any, right: Any) -> Condition:
    a, b = lift(left), lift(right)
    return _IsNull(a, False) if _null(b) else _Comparison("!=", lambda x, y: x != y, a, b)


def lt(left: Any, right: Any) -> Condition:
    return _Comparison("<", lambda x, y: x < y, left, right)


def lte(left: Any, right: Any) -> Condition:
    return _Comparison("<=", lambda x, y: x <= y, left, right)


def gt(left: Any, right: Any) -> Condition:
    return _Comparison(">", lambda x, y: x > y, left, right)


def gte(left: Any, right: Any) -> Condition:
    return _Comparison(">=", lambda x, y: x >= y, left, right)


def like(left: Any, pattern: Any) -> Condition:
    return _Comparison("LIKE", lambda x, y: F.like(x, y), left, pattern)


def _posix(pattern: Expression) -> Expression:
    """The word marks of POSIX patterns as word boundaries, which Java patterns know."""
    if isinstance(pattern, Literal) and isinstance(pattern.value, str):
        return Literal(pattern.value.replace("[[:<:]]", r"\b").replace("[[:>:]]", r"\b"))
    return pattern


def regexp(left: Any, pattern: Any) -> Condition:
    return _Comparison("REGEXP", lambda x, y: F.rlike(x, y), left, _posix(lift(pattern)))


class _Fold(Expression):
    """One or more operands under one operator, left to right."""

    def __init__(self, op: str, build, operands: Sequence[Any]):
        if not operands or any(x is None for x in operands):
            raise StatementError(f"{op.strip()} needs operands, none of them missing")
        self.op, self.build, self.operands = op, build, [lift(x) for x in operands]

    def column(self) -> SparkColumn:
        return reduce(self.build, (x.column() for x in self.operands))

    def sql(self) -> str:
        if len(self.operands) == 1:
            return self.operands[0].sql()
        return "(" + f" {self.op} ".join(x.sql() for x in self.operands) + ")"


class _FoldedCondition(_Fold, Condition):
    pass


def and_(*operands: Condition) -> Condition:
    return _FoldedCondition("AND", lambda x, y: x & y, operands)


def or_(*operands: Condition) -> Condition:
    return _FoldedCondition("OR", lambda x, y: x | y, operands)


def add(*operands: Any) -> Expression:
    return _Fold("+", lambda x, y: x + y, operands)


def sub(*operands: Any) -> Expression:
    return _Fold("-", lambda x, y: x - y, operands)


def mul(*operands: Any) -> Expression:
    return _Fold("*", lambda x, y: x * y, operands)


def div(*operands: Any) -> Expression:
    return _Fold("/", F.try_divide, operands)


def bit_or(left: Any, right: Any) -> Expression:
    return _Binary("|", lambda x, y: x.bitwiseOR(y), left, right)


def bit_and(left: Any, right: Any) -> Expression:
    return _Binary("&", lambda x, y: x.bitwiseAND(y), left, right)


def bit_xor(left: Any, right: Any) -> Expression:
    return _Binary("^", lambda x, y: x.bitwiseXOR(y), left, right)


def plus(left: Any, right: Any) -> Expression:
    return _Binary("+", lambda x, y: x + y, left, right)


def minus(left: Any, right: Any) -> Expression:
    return _Binary("-", lambda x, y: x - y, left, right)


class Not(Condition):
    def __init__(self, inner: Condition):
        self.inner = inner

    def column(self) -> SparkColumn:
        return ~self.inner.column()

    def sql(self) -> str:
        return f"NOT ({self.inner.sql()})"


class In(Condition):
    def __init__(self, left: Any, values: Sequence[Any]):
        if isinstance(values, str | bytes) or not isinstance(values, Sequence):
            raise StatementError(f"IN needs a list, not {type(values).__name__}")
        self.left, self.values = lift(left), [lift(v) for v in values]

    def column(self) -> SparkColumn:
        return self.left.column().isin(*(v.column() for v in self.values)) if self.values else F.lit(False)

    def sql(self) -> str:
        return f"{self.left.sql()} IN ({', '.join(v.sql() for v in self.values)})" if self.values else "FALSE"


class Tuple(Expression):
    def __init__(self, *items: Any):
        if not items:
            raise StatementError("a tuple needs items")
        self.items = [lift(x) for x in items]

    def column(self) -> SparkColumn:
        return F.struct(*(x.column().alias(f"_{i}") for i, x in enumerate(self.items)))

    def sql(self) -> str:
        return "(" + ",".join(x.sql() for x in self.items) + ")"


class Func(Expression):
    """A call of any function that Spark knows, aggregates included; unknown names fail at analysis."""

    def __init__(self, name: str, *args: Any):
        self.name, self.args = identifier(name), [lift(a) for a in args]

    def column(self) -> SparkColumn:
        return F.call_function(self.name, *(a.column() for a in self.args))

    def sql(self) -> str:
        return f"{self.name}({','.join(a.sql() for a in self.args)})"


class If(Expression):
    def __init__(self, condition: Condition, then: Any, other: Any):
        self.condition, self.then, self.other = condition, lift(then), lift(other)

    def column(self) -> SparkColumn:
        return F.when(self.condition.column(), self.then.column()).otherwise(self.other.column())

    def sql(self) -> str:
        return f"IF({self.condition.sql()},{self.then.sql()},{self.other.sql()})"


class Interval(Expression):
    """A span of time, in whole microseconds."""

    def __init__(self, span: dt.timedelta):
        self.span = span

    def _parts(self) -> tuple[bool, int, int, int, int]:
        total = abs(self.span) // dt.timedelta(microseconds=1)
        return self.span < dt.timedelta(0), total // 3_600_000_000, total // 60_000_000 % 60, total // 1_000_000 % 60, total % 1_000_000

    def column(self) -> SparkColumn:
        negative, h, m, s, us = self._parts()
        sign = -1 if negative else 1
        return F.make_dt_interval(F.lit(0), F.lit(sign * h), F.lit(sign * m), F.lit(Decimal(sign * (s * 1_000_000 + us)) / 1_000_000).cast("decimal(18,6)"))

    def sql(self) -> str:
        negative, h, m, s, us = self._parts()
        return f"INTERVAL '{'-' if negative else ''}{h}:{m:02d}:{s:02d}:{us:06d}' HOUR_MICROSECOND"


class ColumnValue(Expression):
    """The incoming value of a column in ON DUPLICATE KEY UPDATE."""

    def __init__(self, ref: ColumnRef):
        self.ref = ref

    def column(self) -> SparkColumn:
        return F.col(f"`_incoming`.`{self.ref.name}`")

    def sql(self) -> str:
        return f"VALUES({self.ref.sql()})"
