"""Labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from percepta.shared import freed, written


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest` when divided by parts; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == rest, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, rest: int, most: int, text: str = "text") -> DataFrame:
    """(doc_id, text, y) of up to `most` labelled documents that aren't held out, in the order of a hash of their ids.

    Labels that are null, or of documents that docs lacks, don't count; the largest label of an id counts. Of several
    documents with one id the one with the least hash of its text is the row, so there are at most `most` rows,
    however often an id repeats.
    """
    y = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id"), parts, rest))
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    y = written(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    out = written(found.select("doc_id", "text", "y"), "labelled-sample")
    freed(y)
    return out
