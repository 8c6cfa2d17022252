"""Stored tables, CRM extracts, the station filter and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions.numbers import first_truthy

BYTE_ORDER_MARK = "\ufeff"


def pick(table: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Chosen columns, with the long station field renamed."""
    if schemas.LONG_STATION_FIELD in table.columns and "station_id" not in table.columns:
        table = table.withColumnRenamed(schemas.LONG_STATION_FIELD, "station_id")
    return table.select(*columns)


def read_dimensions(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """Chosen columns of a stored table; ``ord``, when asked for and not stored, is the order of its rows."""
    table, columns = spark.read.parquet(path), list(columns)
    return pick(with_ordinal(table) if "ord" in columns and "ord" not in table.columns else table, columns)


def read_crm_leads(spark: SparkSession, path: str) -> DataFrame:
    """CRM leads with ``ord``, their order in the extract."""
    return with_ordinal(spark.read.schema(schemas.CRM_LEAD).json(path))


def read_crm_stages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CRM_STAGE).json(path)


def station_filter(rows: DataFrame) -> DataFrame:
    """Distinct trimmed station ids of a table with either id column."""
    for name in rows.columns:
        rows = rows.withColumnRenamed(name, name.lstrip(BYTE_ORDER_MARK).strip())
    present = [F.col(c) for c in ("station_id", schemas.LONG_STATION_FIELD) if c in rows.columns]
    return rows.select(F.trim(first_truthy(*present)).alias("station_id")).filter("station_id <> ''").distinct()


def read_station_filter_csv(spark: SparkSession, path: str) -> DataFrame:
    return station_filter(spark.read.option("header", True).csv(path))


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON folder per section, written by the executors."""
    for name, rows in sections.items():
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def read_match_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The exact matches of a report, in report order.

    A folder written by ``write_report`` holds one match per line with its
    ordinal; a single report document holds them as an array.
    """
    if path.endswith(".json"):
        document = spark.read.option("multiLine", True).schema(f"exact_matches ARRAY<STRUCT<{schema}>>").json(path)
        return document.select(F.posexplode("exact_matches").alias("ord", "item")).select("ord", "item.*")
    lines = spark.read.schema(f"ord BIGINT, {schema.replace(':', '')}").json(f"{path.rstrip('/')}/exact_matches")
    return lines.orderBy("ord")


def overwrite_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``rows``.

    Dynamic overwrite stages the new files and swaps them in at commit, so the
    rows may have been read from the same table, and repeating the write gives
    the same table. Rebalancing puts a partition's rows together and splits the
    large ones, so neither many small files nor one long task results.
    """
    (
        rows.hint("rebalance", F.col(partition)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


@dataclass(frozen=True)
class Commit:
    """One committed version: its number, who wrote it, and its data folder."""

    number: int
    source: str
    batch: int
    folder: str


# Committed versions that stay readable after a newer one is committed.
KEPT_VERSIONS = 3
COMMITS = "_commits"


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """Committed versions, oldest first, from the file names of a folder that holds a few of them."""
    files, where = _hadoop(spark, f"{path.rstrip('/')}/{COMMITS}")
    if not files.exists(where):
        return []
    found = []
    for status in files.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("v"):
            number, source, batch, folder = name[1:].split(".")
            found.append(Commit(int(number), source, int(batch), folder))
    return sorted(found, key=lambda c: c.number)


def is_committed(spark: SparkSession, path: str, source: str, batch: int) -> bool:
    """True when this batch of this source has a version, so that a replay has nothing to do."""
    return any(c.source == source and c.batch == batch for c in commits(spark, path))


def stage_version(rows: DataFrame, path: str, source: str, batch: int) -> str:
    """Write the data of a version that is not committed yet; a replayed batch finds what it staged before."""
    spark, folder = rows.sparkSession, f"data-{source}-{batch}"
    if not exists(spark, f"{path.rstrip('/')}/{folder}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{folder}")
    return folder


def commit_version(
    spark: SparkSession, path: str, folder: str, source: str, batch: int, keep: int = KEPT_VERSIONS
) -> int:
    """Make a staged version the newest one; its number is returned.

    An empty file whose name tells number, writer and folder commits it, so readers see
    a version whole or not at all. Numbers grow by one whoever writes, so a new
    checkpoint goes on after the old one. All but the last ``keep`` are deleted.
    """
    root, before = path.rstrip("/"), commits(spark, path)
    number = before[-1].number + 1 if before else 1
    files, mark = _hadoop(spark, f"{root}/{COMMITS}/v{number:012d}.{source}.{batch}.{folder}")
    files.create(mark, False).close()
    for old in before[:max(len(before) + 1 - keep, 0)]:
        for name in (f"{COMMITS}/v{old.number:012d}.{old.source}.{old.batch}.{old.folder}", old.folder):
            files.delete(_hadoop(spark, f"{root}/{name}")[1], True)
    return number


def write_version(rows: DataFrame, path: str, source: str | None = None, batch: int = 0, keep: int = KEPT_VERSIONS) -> int:
    """Write a whole table as the next version and commit it; the number is returned."""
    source = source or f"job-{uuid.uuid4().hex}"
    return commit_version(rows.sparkSession, path, stage_version(rows, path, source, batch), source, batch, keep)


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest committed version; None when there is none. Only its own files are listed and read."""
    known = commits(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/{known[-1].folder}") if known else None


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def with_ordinal(rows: DataFrame) -> DataFrame:
    """Rows of a file scan with ``ord``, a BIGINT that grows in file and row order.

    It packs the rank of the file, the start of the split and the row in the split,
    so no window over the table is needed. A row takes a byte or more, so the start
    of a split plus a row number stays below the start of the next split. Call it on
    the scan itself.
    """
    columns = [c for c in rows.columns if c != "ord"]
    placed = rows.select(
        *columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    splits = placed.groupBy("_file", "_start").agg(F.min("_row").alias("_first"))
    # One row for every split of the files.
    ranks = splits.select("_file", "_start", "_first", (F.dense_rank().over(Window.orderBy("_file")) - 1).alias("_rank"))
    return placed.join(ranks, ["_file", "_start"]).select(
        *columns, (F.shiftleft(F.col("_rank").cast("bigint"), 44) + F.col("_start") + F.col("_row") - F.col("_first")).alias("ord")
    )
