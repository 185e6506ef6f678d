"""A bounded sample of labelled documents for classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 5 is 0, and rows without id, are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled ids outside the held-out fold, chosen by hash of the id.

    `most` bounds the sample, whatever the input, so it is broadcast to the scan of the
    documents. An id with several labels has the largest; null labels and ids are left out.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
