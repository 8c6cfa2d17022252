"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospan.llm.common import fresh_name, materialize, prepared, unit_hash

SEED = 6
# Rows of a shard that are numbered by one task.
BIN_ROWS = 50_000


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Sizes at most one apart that add up to ``total``; the first shards are the larger ones."""
    return total // shards + (np.arange(shards) < total % shards)


def communication_matrix(parts: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows every part sends to every shard.

    Row sums are the part sizes, column sums the exact shard sizes, and the matrix
    is drawn as the one of a uniform permutation: each part draws its shards
    without replacement from the places still free.
    """
    random = np.random.default_rng(seed)
    free = shard_sizes(int(sum(parts)), shards).astype(np.int64)
    matrix = np.zeros((len(parts), shards), np.int64)
    for i, size in enumerate(parts):
        matrix[i] = random.multivariate_hypergeometric(free, size, method="marginals")
        free -= matrix[i]
    return matrix


def assign(rows: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (position in the shard, gapless from 0).

    The rows are written once, so that the part and position of every row are
    fixed whatever executor is lost later; parts are those of the scan or exchange
    that made the rows, so their size does not depend on any value of a row. The
    driver sees part sizes and draws part sizes by shards, nothing else.
    """
    spark = prepared(rows.sparkSession)
    part, place, rank, ends, group, start = (
        fresh_name(rows, n) for n in ("_part", "_place", "_rank", "_ends", "_bin", "_start"))
    fixed = materialize(
        rows.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "placed")
    sizes = sorted((r[0], r[1]) for r in fixed.groupBy(part).count().collect())
    matrix = communication_matrix([n for _, n in sizes], shards, seed)
    bounds = spark.createDataFrame(
        [(p, row.tolist()) for (p, _), row in zip(sizes, np.cumsum(matrix, axis=1))],
        f"`{part}` INT, `{ends}` ARRAY<BIGINT>")
    # First permutation, within each part: the first rows go to shard 0, the next to shard 1, and so on.
    local = Window.partitionBy(part).orderBy(F.xxhash64(F.lit(seed), place), place)
    dealt = fixed.withColumn(rank, F.row_number().over(local)).join(bounds, part)
    dealt = dealt.withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(rank)))).drop(rank, ends)
    # Second permutation, within each shard, in bins of a uniform hash that one task can sort.
    total = sum(n for _, n in sizes)
    bins = max(1, -(-total // (shards * BIN_ROWS)))
    draw = unit_hash(seed + 1, F.col(place))
    dealt = materialize(dealt.withColumn(group, F.floor(draw * bins).cast("int")), "dealt")
    counts = dealt.groupBy("shard", group).agg(F.count("*").alias(start))
    before = Window.partitionBy("shard").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(start, F.coalesce(F.sum(start).over(before), F.lit(0)))
    inner = Window.partitionBy("shard", group).orderBy(draw, place)
    slot = F.col(start) + F.row_number().over(inner) - 1
    return dealt.join(counts, ["shard", group]).withColumn("slot", slot).drop(part, place, group, start)


def shard_documents(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` with its shard and slot; counts of shards are at most one apart.

    Returns doc_id, size (UTF-8 bytes of the text plus 16; a null text has none),
    text_crc32 (of the UTF-8 bytes; a null text counts as empty), law ("rows"),
    shard, slot, grown_shard (null: only a law of keys has one). Rows are dealt by
    place and not by value, so repeated rows, equal texts and null ids are spread
    like any other. An empty table gives no rows. Extra columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(rows, shards, seed)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def into_shards(docs: DataFrame, shards: int = 40, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``; columns of those names are replaced."""
    return assign(docs.drop("shard", "slot"), shards, seed)
