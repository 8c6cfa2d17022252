"""Plans: no all-pairs joins, no whole-key gathering, filters and columns reach the scan."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from heliospan.functions import clock
from heliospan.operators import keep, live, merge, readings
from heliospan.plans import pipelines
from heliospan.sources import landed
from heliospan.standins import AS_OF, DAYS_AS_OF, Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


STREAMS = ("stream_", "day_retention")


@pytest.mark.parametrize("name", [n for n in entry.queries() if not n.startswith(STREAMS)])
def test_no_all_pairs_join(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "Python" not in text and "InPandas" not in text


def test_keep_one_is_limited_before_the_shuffle(spark):
    t = Tables(spark, FOLDER)
    text = plan(keep.keep_last(t.table("lineitem"), ["l_orderkey"], "l_shipdate"))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_day_filter_is_pushed(spark, tmp_path):
    path = str(tmp_path / "t")
    Tables(spark, FOLDER).stored_intervals.write.parquet(path)
    stored = spark.read.parquet(path)
    for rows in (readings.readings_of_day(stored, AS_OF), merge.purge_before_day(stored, AS_OF)):
        assert "GreaterThanOrEqual(timestamp" in plan(rows)


def test_only_needed_columns_are_read(spark):
    text = plan(readings.lifetime_earning(Tables(spark, FOLDER).totals))
    assert "o_orderdate" not in text and "o_orderpriority" not in text


def landed_lines(spark, path, **request):
    names = {"station_id": "'s'", "day": "'2024-01-30'", "month": "'2024-01'", "seq": "1L", "page_no": "0L", **request}
    rows = spark.range(1).selectExpr(*[f"{v} AS {k}" for k, v in names.items()], "true AS success", "'0' AS code", "'[]' AS data")
    rows.write.json(path)
    return path


def test_last_and_first_positions_hash_on_landed_data(spark, tmp_path):
    points = landed.in_order(landed.read_day_points(spark, landed_lines(spark, str(tmp_path / "d"))))
    text = plan(live.latest_point(live.live_points(points)))
    assert "HashAggregate" in text and "SortAggregate" not in text
    listed, _ = landed.read_inverters(spark, landed_lines(spark, str(tmp_path / "i")), landed_lines(spark, str(tmp_path / "e")))
    assert "SortAggregate" not in plan(readings.first_inverter(listed))


def test_incoming_intervals_are_parsed_once(spark):
    t = Tables(spark, FOLDER)
    job = pipelines.interval_sync(t.profiles, t.systems, t.points, t.totals, t.stored_intervals, AS_OF)
    # Both uses of the incoming side read the written table; its payload fields are no longer in the plan.
    assert "batteryCapacitySoc" not in plan(job.changes) and "props" not in plan(job.changes)


def partitioned(spark, frame, path, column):
    frame.write.partitionBy(column).parquet(path)
    return spark.read.parquet(path)


def test_literal_bounds_prune_landed_partitions(spark, tmp_path):
    t = Tables(spark, FOLDER)
    points = partitioned(spark, t.points, str(tmp_path / "points"), "day")
    seen = plan(pipelines.live_view(t.auth_users, t.profiles, points, t.details.drop("station_id"), AS_OF))
    assert "PartitionFilters: [isnotnull(day" in seen and clock.local_calendar(AS_OF)["today"] in seen
    days = partitioned(spark, t.days.withColumn("pos", F.col("pos.l_orderkey")), str(tmp_path / "days"), "month")
    job = pipelines.history_backfill(t.profiles, t.systems, days, t.stored_days, DAYS_AS_OF)
    scans = [x for x in plan(job.changes).split("\n") if "PartitionFilters: [" in x and "month" in x]
    assert scans and all(">= " in x and "<= " in x for x in scans)
    synced = pipelines.daily_sync(t.profiles, t.systems, t.details.drop("station_id"), readings.station_battery(t.inverter_list, t.inverters), days,
                                  t.stored_days, DAYS_AS_OF, months=pipelines.months_to_sync(DAYS_AS_OF))
    assert "PartitionFilters: [isnotnull(month" in plan(synced.changes) and "2001-08" in plan(synced.changes)
