"""Bounded samples of labelled documents for training. The bounds are the parameters here; nothing else samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most so many training rows of each class, none with a text of more characters than this.
ROWS_PER_CLASS = 1500
MAX_CHARS = 60_000


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per doc_id; rows without either are left out, contradicting rows count as 1."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_rows(
    docs: DataFrame, labels: DataFrame, column: str, where: Column | None = None, rows: int = ROWS_PER_CLASS,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, text, label, _order of the rows with the smallest hashes in each class; repeated ids come as they are."""
    marks = clean_labels(labels, column)
    if where is not None:
        marks = marks.filter(where)
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).filter(F.length("text") <= MAX_CHARS)
    order = F.xxhash64(F.lit(column), "doc_id")
    # Only rows that have a usable text count towards the bound.
    there = marks.join(small.select("doc_id"), "doc_id", "left_semi").withColumn("_order", order)
    chosen = [there.filter(F.col("label") == label).orderBy("_order", "doc_id").limit(rows) for label in (0, 1)]
    # At most 2 * ``rows`` rows, so sending them to every task is bounded.
    return small.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")


def in_order(found: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``labelled_rows`` in hash order, one for each doc_id: the one whose text is first."""
    found = found.sort_values(["_order", "doc_id", "text"]).drop_duplicates("doc_id")
    return found.drop(columns="_order").reset_index(drop=True)


def labelled(
    docs: DataFrame, labels: DataFrame, column: str, where: Column | None = None, rows: int = ROWS_PER_CLASS,
    extra: tuple[str, ...] = (),
) -> pd.DataFrame:
    """``labelled_rows`` at the driver, in order."""
    return in_order(labelled_rows(docs, labels, column, where, rows, extra).toPandas())
