"""Keep one row per key without gathering a key's rows in one task.

``row_number() = 1`` gets a partial group limit, so every map task sends at
most one row per key to the shuffle, however many copies a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return keep_first(rows, keys, *[F.col(c).desc_nulls_last() for c in order])


def sample_per_key(rows: DataFrame, keys: list[str], size: int, *order: Column) -> DataFrame:
    """The first rows of every key and how many more the key has."""
    window = Window.partitionBy(*keys).orderBy(*order)
    head = rows.withColumn("sample_no", F.row_number().over(window)).filter(F.col("sample_no") <= size)
    left_out = rows.groupBy(*keys).agg(F.greatest(F.count("*") - size, F.lit(0)).alias("left_out"))
    return head.join(left_out, keys)
