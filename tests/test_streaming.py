"""Streams with fixed batch boundaries: one landed file per batch."""

import json
import os

from pyspark.sql import functions as F

from heliospan.functions import clock
from heliospan.sources import tables
from heliospan.streaming import files

NOW = clock.local_time("2026-04-08 14:30")
INTERVALS = ("user_id STRING, system_id STRING, timestamp TIMESTAMP, production_kwh DOUBLE, consumption_kwh DOUBLE, battery_level DOUBLE, "
             "battery_status STRING, grid_import_kwh DOUBLE, grid_export_kwh DOUBLE, daily_earning DOUBLE, lifetime_earning DOUBLE")
DAYS = ("user_id STRING, system_id STRING, timestamp TIMESTAMP, production_kwh DOUBLE, consumption_kwh DOUBLE, battery_level DOUBLE, "
        "battery_status STRING, grid_import_kwh DOUBLE, grid_export_kwh DOUBLE, daily_earning DOUBLE, battery_charge_kwh DOUBLE, battery_discharge_kwh DOUBLE")


def ms(text):
    return int(clock.local_time(text).timestamp() * 1000)


def point(clock_text, kwh, day="2026-04-08"):
    return {"time": ms(f"{day} {clock_text}"), "power": kwh * 12000}


class Landing:
    """Writes landed files with growing modification times, so batches are in order."""

    def __init__(self, folder):
        self.folder, self.count = folder, 0
        folder.mkdir()

    def fetch(self, *payloads, **request):
        self.count += 1
        lines = [json.dumps({"station_id": "s", "day": "2026-04-08", "month": "2026-04", "success": True, "code": "0", "seq": self.count, "page_no": 0,
                             "data": p, **request}) for p in payloads]
        path = self.folder / f"{self.count}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1000 + self.count, 1000 + self.count))


def people(spark):
    profiles = spark.createDataFrame([("u", "s")], "id STRING, station_id STRING")
    systems = spark.createDataFrame([("sys", "u", "active", None, 1)], "id STRING, user_id STRING, status STRING, installation_date DATE, ord BIGINT")
    return profiles, systems


def run_intervals(spark, tmp_path, landing, name="t", initial=None, rejects=None, **aside):
    profiles, systems = people(spark)
    totals = spark.createDataFrame([("s", "5")], "station_id STRING, money STRING")
    initial = spark.createDataFrame([], INTERVALS) if initial is None else initial
    stream = files.stream_intervals(spark, str(landing.folder), str(tmp_path / name), str(tmp_path / f"{name}-state"), profiles, systems, totals,
                                    lambda: NOW, initial, files_per_batch=1, rejects=rejects, **aside)
    stream.awaitTermination()
    return tables.latest_version(spark, str(tmp_path / name))


def by_time(rows):
    stamp = F.date_format(F.col("timestamp") + F.expr("interval 8 hours"), "HH:mm")
    return {r[0]: r[1] for r in rows.select(stamp, "production_kwh").collect()}


def test_late_rule_over_batches(spark, tmp_path):
    landing = Landing(tmp_path / "in")
    landing.fetch([point("10:00", 1), point("10:05", 2)])
    # A late interval comes in, an old one is frozen, and 10:10 is the newest of this batch.
    landing.fetch([point("09:55", 7), point("10:00", 9), point("10:05", 9), point("10:10", 3)])
    # 10:10 is stored and newest, so it changes.
    landing.fetch([point("10:05", 8), point("10:10", 4)])
    table = run_intervals(spark, tmp_path, landing)
    assert by_time(table) == {"09:55": 7, "10:00": 1, "10:05": 2, "10:10": 4}
    assert {r.lifetime_earning for r in table.collect()} == {5.0}
    # Running on with nothing new changes nothing; a replay into the merged table neither.
    assert by_time(run_intervals(spark, tmp_path, landing)) == by_time(table)
    again = Landing(tmp_path / "again")
    again.fetch([point("10:05", 8), point("10:10", 4)])
    assert by_time(run_intervals(spark, tmp_path, again, "t2", initial=table)) == by_time(table)


def test_retention_and_rejects(spark, tmp_path):
    landing = Landing(tmp_path / "in")
    landing.fetch([point("23:55", 1, "2026-04-07"), point("00:00", 2)])
    landing.fetch("oops", success=False, code="B0001")
    old = spark.createDataFrame([("u", "sys")], "user_id STRING, system_id STRING").select(
        "*", clock.moment(clock.local_time("2026-04-07 23:00")).alias("timestamp"), *[
            F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in INTERVALS.split(", ")[3:]])
    table = run_intervals(spark, tmp_path, landing, initial=old, rejects=str(tmp_path / "bad"))
    assert by_time(table) == {"00:00": 2}
    assert [(r.code, r.data) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("B0001", "oops")]


def test_points_with_impossible_numbers_are_set_aside(spark, tmp_path):
    landing = Landing(tmp_path / "in")
    landing.fetch([point("10:00", 1), {**point("10:05", 1), "power": "1e30"}, {**point("10:10", 1), "power": "nan"}, {**point("10:15", 1), "psum": "inf"}])
    table = run_intervals(spark, tmp_path, landing, rejected_points=str(tmp_path / "bad"))
    assert by_time(table) == {"10:00": 1, "10:05": 0, "10:10": 0, "10:15": 1}
    assert sorted(r.bad_fields[0] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["power", "power", "psum"]


def test_daily_stream_rewrites_only_touched_months(spark, tmp_path):
    landing, path = Landing(tmp_path / "in"), str(tmp_path / "daily")
    landing.fetch([{"dateStr": "2026-04-01", "energy": "1"}, {"dateStr": "2026-04-02", "energy": "2"}])
    landing.fetch([{"dateStr": "2026-04-02", "energy": "5"}, {"dateStr": "2026-04-03", "energy": "bad"}])
    march = clock.moment(clock.local_time("2026-03-05 12:00"))
    stored = spark.range(1).select(F.lit("u").alias("user_id"), F.lit("sys").alias("system_id"), march.alias("timestamp"), *[
        F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in DAYS.split(", ")[3:]])
    stored.withColumn("local_month", F.lit("2026-03")).write.partitionBy("local_month").parquet(path)
    before = sorted(os.listdir(f"{path}/local_month=2026-03"))
    profiles, systems = people(spark)
    systems = systems.selectExpr("id", "user_id", "'n' AS system_name", "1D AS capacity_kwp", "1D AS battery_capacity_kwh", "installation_date",
                                 "'-' AS address", "status", "ord")
    detail = spark.createDataFrame([("s", "S", "", "5")], "id STRING, stationName STRING, sno STRING, capacity STRING")
    battery = spark.createDataFrame([], "station_id STRING, battery_capacity_kwh DOUBLE")
    files.stream_daily(spark, str(landing.folder), path, str(tmp_path / "state"), profiles, systems, detail, battery, lambda: NOW,
                       files_per_batch=1).awaitTermination()
    day = F.date_format("timestamp", "MM-dd")
    assert {r[0]: r[1] for r in spark.read.parquet(path).select(day, "production_kwh").collect()} == {"03-05": None, "04-01": 1, "04-02": 5}
    assert sorted(os.listdir(f"{path}/local_month=2026-03")) == before


def test_first_daily_batch_writes_all_outputs_once(spark, tmp_path):
    landing, path = Landing(tmp_path / "in"), str(tmp_path / "daily")
    landing.fetch([{"dateStr": "2026-04-01", "energy": "1"}, {"dateStr": "2026-04-03", "energy": "bad"}])
    landing.fetch([{"dateStr": "2026-04-02", "energy": "2"}])
    profiles, _ = people(spark)
    systems = spark.createDataFrame([], "id STRING, user_id STRING, system_name STRING, capacity_kwp DOUBLE, battery_capacity_kwh DOUBLE, "
                                        "installation_date DATE, address STRING, status STRING, ord BIGINT")
    detail = spark.createDataFrame([("s", "S", "", "5")], "id STRING, stationName STRING, sno STRING, capacity STRING")
    battery = spark.createDataFrame([], "station_id STRING, battery_capacity_kwh DOUBLE")
    out = {k: str(tmp_path / k) for k in ("systems_table", "rejected_days", "rejects")}

    def run():
        files.stream_daily(spark, str(landing.folder), path, str(tmp_path / "state"), profiles, systems, detail, battery, lambda: NOW,
                           files_per_batch=1, **out).awaitTermination()
        rows = spark.read.parquet(path)
        day = F.date_format("timestamp", "MM-dd")
        return ({r[0]: (r[1], r[2]) for r in rows.select(day, "production_kwh", "system_id").collect()},
                [tuple(r) for r in tables.latest_version(spark, out["systems_table"]).select("system_name", "status", "capacity_kwp").collect()],
                [r.energy for r in spark.read.parquet(out["rejected_days"]).collect()])

    first = run()
    system = first[0]["04-01"][1]
    assert first == ({"04-01": (1.0, system), "04-02": (2.0, system)}, [("S", "active", 5.0)], ["bad"])
    assert system is not None
    # The last batch again: its commit is taken back as if the job had stopped before it, then all is replayed.
    last = tables.commits(spark, out["systems_table"])[-1]
    os.remove(f"{out['systems_table']}/{tables.COMMITS}/v{last.number:012d}.{last.source}.{last.batch}.{last.folder}")
    for name in ("commits/1", "commits/.1.crc"):
        (tmp_path / "state" / name).unlink(missing_ok=True)
    assert run() == first
    assert [c.batch for c in tables.commits(spark, out["systems_table"])] == [0, 1]


def test_new_checkpoint_goes_on_from_the_newest_version(spark, tmp_path):
    landing = Landing(tmp_path / "in")
    landing.fetch([point("10:00", 1)])
    landing.fetch([point("10:05", 2)])
    run_intervals(spark, tmp_path, landing)
    more = Landing(tmp_path / "more")
    more.fetch([point("10:10", 3)])
    profiles, systems = people(spark)
    totals = spark.createDataFrame([("s", "5")], "station_id STRING, money STRING")
    files.stream_intervals(spark, str(more.folder), str(tmp_path / "t"), str(tmp_path / "new-state"), profiles, systems, totals,
                           lambda: NOW, spark.createDataFrame([], INTERVALS)).awaitTermination()
    assert by_time(tables.latest_version(spark, str(tmp_path / "t"))) == {"10:00": 1, "10:05": 2, "10:10": 3}


def test_late_and_split_fetches(spark, tmp_path):
    landing, path = Landing(tmp_path / "in"), str(tmp_path / "buckets")

    def shown():
        files.stream_live_buckets(spark, str(landing.folder), path, str(tmp_path / "state"), lambda: NOW, files_per_batch=1).awaitTermination()
        return {r.slot: r.production_kwh for r in files.current_buckets(spark, path).collect()}

    landing.fetch([point("10:00", 1)], [point("10:05", 1)], seq=5)  # two pages of one number: the repeated one counts once
    assert set(shown().values()) == {1.0}
    landing.fetch([point("10:00", 50)], seq=4)  # late and older
    assert shown() == {9: 1.0}
    landing.fetch([point("10:00", 2)], seq=6, page_no=1, pages=2)  # half a fetch waits
    assert shown() == {9: 1.0}
    landing.fetch([point("13:00", 3)], seq=6, page_no=0, pages=2)  # now it is whole
    assert shown() == {9: 2.0, 13: 3.0}
    landing.fetch([point("13:00", 3)], seq=6, page_no=0, pages=2)  # the same page again
    landing.fetch([point("10:00", 9)], seq=7, page_no=0, pages=2)
    assert shown() == {9: 2.0, 13: 3.0}
    # Only the newest whole fetch and what is newer are kept.
    assert {r.seq for r in spark.read.parquet(path).select("seq").collect()} == {6, 7}


def test_live_buckets_replace_per_fetch(spark, tmp_path):
    landing, path = Landing(tmp_path / "in"), str(tmp_path / "buckets")
    landing.fetch([point("10:00", 1)])
    landing.fetch([point("10:00", 1), point("10:05", 2), point("13:00", 4), point("14:40", 1), point("15:00", 9)])
    files.stream_live_buckets(spark, str(landing.folder), path, str(tmp_path / "state"), lambda: NOW, files_per_batch=1).awaitTermination()
    rows = files.current_buckets(spark, path)
    assert {r.slot: r.production_kwh for r in rows.collect()} == {9: 3.0, 13: 5.0}
