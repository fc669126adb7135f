"""Dynamically typed SQL values: numbers from text, checked conversion, and a binary codec."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Tags of the codec, fixed by the format.
NULL, NUMERIC, FRACTIONAL, STRING, UTF8 = range(5)
_RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def parse_number(text: str) -> int:
    """An integer in decimal, hexadecimal (0x) or octal (leading 0); signed 64 bits with a sign, else unsigned."""
    body = text[1:] if text.startswith(("+", "-")) else text
    if not body or not body[0].isdigit():
        raise ValueError(f"no number: {text!r}")
    base = 16 if body[:2].lower() == "0x" else 8 if len(body) > 1 and body[0] == "0" else 10
    value = int(body, base) * (-1 if text[0] == "-" else 1)
    signed = text[0] in "+-"
    if not (-(1 << 63) <= value < 1 << 63 if signed else value < 1 << 64):
        raise ValueError(f"out of range: {text}")
    return value


def converted(c: Column, kind: str, nullable: bool = False) -> Column:
    """c as kind; a value that does not fit is an error, and so is NULL unless nullable. Numbers become booleans by
    being other than 0."""
    out = (c.try_cast("decimal(38,0)") != 0) if kind == "boolean" else c.try_cast(kind)
    bad = F.raise_error(F.concat(F.lit(f"not a {kind}: "), F.coalesce(c.cast("string"), F.lit("NULL"))))
    if nullable:
        return F.when(c.isNull(), F.lit(None).cast(kind)).when(out.isNull(), bad).otherwise(out)
    return F.when(out.isNull(), bad).otherwise(out)


def converted_or(c: Column, kind: str, default: Column) -> Column:
    """c as kind, and default where it is NULL; a value that does not fit is an error."""
    return F.when(c.isNull(), default.cast(kind)).otherwise(converted(F.coalesce(c, default.cast("string")), kind))


def converted_row(df: DataFrame, kinds: Sequence[str], nullable: bool = False) -> DataFrame:
    if len(kinds) != len(df.columns):
        raise ValueError("as many kinds as columns are needed")
    return df.select(*(converted(F.col(c), k, nullable).alias(c) for c, k in zip(df.columns, kinds, strict=True)))


def kind_of(c: Column) -> Column:
    """The value tag of a column: null, numeric, fractional, bytes or text."""
    t = F.typeof(c)
    tag = F.when(t.isin("tinyint", "smallint", "int", "bigint", "boolean"), NUMERIC).when(t.isin("float", "double") | t.startswith("decimal"), FRACTIONAL).when(t == "binary", STRING).otherwise(UTF8)
    return F.when(c.isNull(), NULL).otherwise(tag)


def encode_ascii(c: Column) -> Column:
    return F.concat(F.lit("'"), F.base64(c.cast("binary")), F.lit("'"))


def encoded(c: Column) -> Column:
    """tag byte, length as a base-128 number, bytes; NULL is its tag alone."""
    tag, data = kind_of(c), c.cast("string").cast("binary")  # binary keeps its bytes through string
    n = F.octet_length(data)
    low = lambda shift: F.shiftright(n, shift).bitwiseAND(127)
    parts, more = F.lit(b""), None
    for shift in range(0, 35, 7):
        here = low(shift) + F.when(F.shiftright(n, shift + 7) > 0, 128).otherwise(0) if shift < 28 else low(shift)
        byte = F.unhex(F.lpad(F.hex(here), 2, "0"))
        more = F.lit(True) if shift == 0 else F.shiftright(n, shift) > 0
        parts = F.concat(parts, F.when(more, byte).otherwise(F.lit(b"")))
    head = F.unhex(F.lpad(F.hex(tag), 2, "0"))
    return F.when(c.isNull(), F.lit(bytes([NULL]))).otherwise(F.concat(head, parts, data))


def decoded(c: Column) -> Column:
    """struct(kind, value) of an encoded value; bad input is an error."""

    @pandas_udf("kind int, value binary")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = []
        for v in x:
            kind, n, shift, at = v[0], 0, 0, 1
            if kind > UTF8:
                raise ValueError(f"unknown tag {kind}")
            if kind == NULL:
                rows.append((NULL, None))
                continue
            while True:
                n, shift, at = n | (v[at] & 127) << shift, shift + 7, at + 1
                if v[at - 1] < 128:
                    break
            if len(v) - at != n:
                raise ValueError("the length does not fit")
            rows.append((kind, v[at:]))
        return pd.DataFrame(rows, columns=["kind", "value"])

    return run(c)
