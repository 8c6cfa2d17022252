"""Micro-batch jobs over landed payload files.

The batch functions do the work; a stream only decides when they run. A batch is
known by the id of its query and its own number, and what it wrote is found again
under both: a replayed batch repeats nothing, and a new checkpoint goes on from the
newest version. Interval readings keep one local day, so each batch writes that day
as a new version. Daily readings keep all history, so each batch rewrites only the
months it touches.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliospan import schemas
from heliospan.functions import clock
from heliospan.operators import live as live_ops
from heliospan.operators import readings
from heliospan.operators.keep import keep_last
from heliospan.plans import pipelines
from heliospan.sources import landed
from heliospan.sources.tables import (
    commit_version, exists, is_committed, latest_version, overwrite_partitions, stage_version, write_version,
)

Clock = Callable[[], datetime]


def landed_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.LANDED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _source(batch: DataFrame) -> str:
    """Id of the running query, which its checkpoint keeps over restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _write_aside(rows: DataFrame, path: str, source: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/source={source}/batch={batch_id}")


def keep_good(batch: DataFrame, batch_id: int, rejects: str | None) -> DataFrame:
    """Good envelopes of a batch; the others are written aside."""
    good, bad = landed.split_envelopes(batch)
    if rejects:
        _write_aside(bad, rejects, _source(batch), batch_id)
    return good


def stream_intervals(
    spark: SparkSession, path: str, table: str, checkpoint: str, profiles: DataFrame, systems: DataFrame,
    totals: DataFrame, now: Clock, initial: DataFrame, every: str | None = None, files_per_batch: int | None = None,
    rejects: str | None = None, rejected_points: str | None = None,
) -> StreamingQuery:
    """Merge landed day curves into the versioned table of today's intervals.

    ``initial`` gives the schema and rows before the first version. Error
    envelopes go to ``rejects`` when it is given, points with numbers that do not
    parse or are out of range to ``rejected_points``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        source = _source(batch)
        if is_committed(spark, table, source, batch_id):
            return
        stored = latest_version(spark, table)
        stored = initial if stored is None else stored
        good = keep_good(batch, batch_id, rejects)
        points = landed.in_order(landed.parse_day_points(good))
        if rejected_points:
            _write_aside(readings.bad_points(points), rejected_points, source, batch_id)
        job = pipelines.interval_sync(profiles, systems, points, totals, stored, now())
        write_version(job.table, table, source, batch_id)

    return _start(landed_stream(spark, path, files_per_batch), step, checkpoint, every)


def stream_daily(
    spark: SparkSession, path: str, table: str, checkpoint: str, profiles: DataFrame, systems: DataFrame,
    detail: DataFrame, battery: DataFrame, now: Clock, every: str | None = None, files_per_batch: int | None = None,
    rejects: str | None = None, systems_table: str | None = None, rejected_days: str | None = None,
) -> StreamingQuery:
    """Merge landed month payloads into the daily table, partitioned by local month.

    The first batch may find no table. ``systems_table`` is a versioned table of the
    systems, which begins with ``systems``; ``rejected_days`` takes the day records
    that do not parse, ``rejects`` the error envelopes. The new systems are staged
    before the daily rows are merged and committed after all else is written: their
    commit is that of the whole batch, and a replay before it repeats the same writes.
    """
    month = F.date_format(clock.local_date(F.col("timestamp")), "yyyy-MM")

    def step(batch: DataFrame, batch_id: int) -> None:
        source = _source(batch)
        if systems_table and is_committed(spark, systems_table, source, batch_id):
            return
        days = landed.in_order(landed.parse_month_days(keep_good(batch, batch_id, rejects)))
        # The months of a batch are few; they prune the scan of the stored table.
        months = days.select(F.date_format(clock.iso_date(F.col("dateStr")), "yyyy-MM").alias("m")).distinct()
        touched = [r.m for r in months.collect() if r.m]
        if exists(spark, table):
            history = spark.read.parquet(table)
        else:
            history = spark.createDataFrame([], f"{schemas.DAILY_READING}, local_month STRING")
        stored = history.filter(F.col("local_month").isin(touched)).drop("local_month")
        before = latest_version(spark, systems_table) if systems_table else None
        job = pipelines.daily_sync(profiles, systems if before is None else before, detail, battery, days, stored, now(),
                                   history=history, order=("seq", "month", "pos"))
        if rejected_days:
            _write_aside(job.rejected, rejected_days, source, batch_id)
        staged = stage_version(job.systems, systems_table, source, batch_id) if systems_table else None
        overwrite_partitions(job.table.withColumn("local_month", month), table, "local_month")
        if staged:
            commit_version(spark, systems_table, staged, source, batch_id)

    return _start(landed_stream(spark, path, files_per_batch), step, checkpoint, every)


def stream_live_buckets(
    spark: SparkSession, path: str, table: str, checkpoint: str, now: Clock, every: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Keep the sums behind the two-hour buckets up to date, by station, day, fetch and page.

    The table is the state of the stream, partitioned by day; a batch rewrites the days
    it touches. Fetches are told apart by ``seq`` and not by arrival: a late older one
    is dropped, and one whose pages arrive in several batches is shown once it is whole.
    ``current_buckets`` reads the buckets. A replayed page replaces itself.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        good, _ = landed.split_envelopes(batch)
        lines = good.withColumn("seq", F.coalesce("seq", F.lit(-1))).withColumn("page_no", F.coalesce("page_no", F.lit(0)))
        lines = keep_last(lines.filter("station_id is not null and day is not null"), live_ops.PAGE, "data")
        incoming = live_ops.page_sums(lines, landed.parse_day_points(lines), now())
        # The days of a batch are few; they prune the scan of the state.
        days = [r.day for r in lines.select("day").distinct().collect()]
        if exists(spark, table):
            stored = spark.read.schema(live_ops.PAGE_SUMS).parquet(table).filter(F.col("day").isin(days))
        else:
            stored = spark.createDataFrame([], live_ops.PAGE_SUMS)
        overwrite_partitions(live_ops.merge_pages(stored, incoming), table, "day")

    return _start(landed_stream(spark, path, files_per_batch), step, checkpoint, every)


def current_buckets(spark: SparkSession, table: str) -> DataFrame:
    return live_ops.buckets_of_pages(spark.read.schema(live_ops.PAGE_SUMS).parquet(table))
