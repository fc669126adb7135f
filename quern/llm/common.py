"""Small helpers shared by the operators: row keys, table access, and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.durable import checkpointed, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until docs has none of them."""
    while {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        names = tuple(f"_{n}" for n in names)
    return list(names)


def row_hash(*cols: str) -> list[Column]:
    """Two 64-bit hashes over the columns; equal rows and only they (but for 2^-128) get equal pairs."""
    parts = [F.col(c) for c in cols]
    nulls = [F.col(c).isNull() for c in cols]
    return [F.xxhash64(F.lit(s), *nulls, *parts) for s in (1, 2)]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def rebatch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows without empty batches."""
    for batch in batches:
        if batch.num_rows:
            yield batch
