"""Declared tables and joins of them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from quern.operators.expressions import ColumnRef, Condition, StatementError, identifier

#: Spark collations of the collations that string columns declare.
COLLATIONS = {"utf8_unicode_ci": "UNICODE_CI", "utf8_unicode": "UNICODE", "utf8_bin": "UTF8_BINARY"}


@dataclass(frozen=True)
class Field:
    name: str
    type: DataType
    nullable: bool = True


def bytes_field(name: str, nullable: bool = True) -> Field:
    return Field(identifier(name), BinaryType(), nullable)


def str_field(name: str, collation: str = "utf8_bin", nullable: bool = True) -> Field:
    kind = COLLATIONS[collation]
    return Field(identifier(name), StringType() if kind == "UTF8_BINARY" else StringType(kind), nullable)


def datetime_field(name: str, nullable: bool = True) -> Field:
    return Field(identifier(name), TimestampNTZType(), nullable)


def int_field(name: str, nullable: bool = True) -> Field:
    return Field(identifier(name), LongType(), nullable)


def double_field(name: str, nullable: bool = True) -> Field:
    return Field(identifier(name), DoubleType(), nullable)


def bool_field(name: str, nullable: bool = True) -> Field:
    return Field(identifier(name), BooleanType(), nullable)


class Relation:
    """What can be selected from: a table or a join."""

    def columns(self) -> list[ColumnRef]:
        raise NotImplementedError

    def frame(self, source: Source) -> DataFrame:
        raise NotImplementedError

    def sql(self, database: str) -> str:
        raise NotImplementedError

    def inner_join(self, other: Relation, on: Condition) -> Join:
        return Join("inner", self, other, on)

    def left_join(self, other: Relation, on: Condition) -> Join:
        return Join("left", self, other, on)

    def right_join(self, other: Relation, on: Condition) -> Join:
        return Join("right", self, other, on)


#: DataFrames by table name, or a function from name to DataFrame.
Source = Mapping[str, DataFrame]


class Parquet(dict):
    """Tables by name from the Parquet files of a folder, read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__()
        self.spark, self.folder = spark, folder

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self[name]


class Table(Relation):
    def __init__(self, name: str, *fields: Field, index: str | None = None):
        if not fields:
            raise StatementError("a table needs columns")
        self.name, self.fields, self.index = identifier(name), {f.name: f for f in fields}, index

    def __getattr__(self, name: str) -> ColumnRef:
        fields = self.__dict__.get("fields", {})
        if name in fields:
            return ColumnRef(self.__dict__["name"], name)
        raise AttributeError(name)

    def col(self, name: str) -> ColumnRef:
        """A column that is looked up when the statement is built."""
        return ColumnRef(self.name, name)

    def schema(self) -> StructType:
        return StructType([StructField(f.name, f.type, f.nullable) for f in self.fields.values()])

    def columns(self) -> list[ColumnRef]:
        return [ColumnRef(self.name, f) for f in self.fields]

    def force_index(self, name: str) -> Table:
        """A copy with an index hint, which only shows in SQL text: Spark prunes by files and statistics."""
        return Table(self.name, *self.fields.values(), index=identifier(name))

    def frame(self, source: Source) -> DataFrame:
        return source[self.name].select(*self.fields).alias(self.name)

    def sql(self, database: str) -> str:
        hint = f" FORCE INDEX (`{self.index}`)" if self.index else ""
        return f"`{identifier(database)}`.`{self.name}`{hint}"


class Join(Relation):
    """A join reads like a table, but cannot be written to; its columns are those of both sides."""

    def __init__(self, kind: str, left: Relation, right: Relation, on: Condition):
        if left is None or right is None or on is None:
            raise StatementError("a join needs two sides and a condition")
        if not isinstance(on, Condition):
            raise StatementError("a join condition must be boolean")
        self.kind, self.left, self.right, self.on = kind, left, right, on

    def columns(self) -> list[ColumnRef]:
        return self.left.columns() + self.right.columns()

    def frame(self, source: Source) -> DataFrame:
        return self.left.frame(source).join(self.right.frame(source), self.on.column(), self.kind)

    def sql(self, database: str) -> str:
        word = "JOIN" if self.kind == "inner" else f"{self.kind.upper()} JOIN"
        return f"{self.left.sql(database)} {word} {self.right.sql(database)} ON {self.on.sql()}"
