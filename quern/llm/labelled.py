"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of ids, one in so many, that no label is learnt from.
FOLDS = 5


def held_out(key: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS, is 0; null ids are held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sampled(ids: DataFrame, most: int, salt: int) -> DataFrame:
    """At most `most` rows of ids (column doc_id, each id once): those of the smallest hashes.

    A bound on the hash that about a tenth more than `most` rows pass comes first, so that no more than these meet.
    """
    place = F.xxhash64(F.lit(salt), "doc_id")
    total = ids.count()
    if total > most:
        share = 1.1 * most / total
        ids = ids.where(place <= int((min(share, 1.0) - 0.5) * (1 << 64) * (1 - 1e-12)))
    return ids.orderBy(place, "doc_id").limit(most)


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) of the rows to learn from, one for each id."""
    rows = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.where(F.col("doc_id").isNotNull())
