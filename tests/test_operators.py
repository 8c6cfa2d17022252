"""Hand-worked cases of the row operators."""

import datetime as dt

from pyspark.sql import functions as F

from heliospan.functions import clock
from heliospan.operators import keep, live, merge, people, readings, views
from heliospan.plans import pipelines

DAY = ("dateStr", "energy", "homeGridEnergy", "backUpEnergy", "backup2Energy", "homeLoadEnergy", "consumeEnergy",
       "gridPurchasedEnergy", "gridSellEnergy", "money", "batteryChargeEnergy", "batteryDischargeEnergy")
POINT = ("time", "dataTimestamp", "power", "familyLoadPower", "bypassLoadPower", "psum", "batteryPower", "batteryCapacitySoc")
NOON = dt.datetime(2026, 4, 8, 4, 0)


def frame(spark, fields, rows, **typed):
    names = list(fields) + list(typed)
    schema = ", ".join([f"{f} STRING" for f in fields] + [f"{n} {kind}" for n, kind in typed.items()])
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def days(spark, *rows):
    return frame(spark, DAY, rows, user_id="STRING", month="STRING", pos="INT")


def points(spark, *rows):
    return frame(spark, POINT, [{"station_id": "s", "day": "2026-04-08", "user_id": "u", **r} for r in rows],
                 station_id="STRING", day="STRING", user_id="STRING", pos="INT", lifetime_earning="DOUBLE")


def local_ms(text):
    return str(int(clock.local_time(text).timestamp() * 1000))


def as_of(text):
    return clock.local_time(text)


def test_daily_reading(spark):
    good = {"dateStr": "2026-04-08", "energy": "10.12344", "homeGridEnergy": "3", "money": "1.239"}
    bad = {"dateStr": "2026-04-09", "energy": "abc"}
    source = days(spark, good, bad, {"dateStr": ""}, {"energy": "1"})
    row, = readings.daily_reading(source).collect()
    assert (row.production_kwh, row.consumption_kwh, row.daily_earning) == (10.1234, 3, 1.24)
    assert row.battery_level is None and row.battery_status is None and row.timestamp == NOON
    assert [r.dateStr for r in readings.bad_days(source).collect()] == ["2026-04-09"]


def test_dedup_days_later_month_wins(spark):
    rows = [{"user_id": "u", "dateStr": "2026-03-31", "energy": e, "month": m, "pos": p} for e, m, p in
            (("1", "2026-03", 9), ("2", "2026-04", 0), ("3", "2026-03", 10))]
    row, = readings.dedup_days_last(readings.daily_reading(days(spark, *rows), "user_id", "month", "pos")).collect()
    assert row.production_kwh == 2


def test_interval_reading(spark):
    rows = readings.interval_reading(points(spark, {"power": "1"}, {"time": local_ms("2026-04-08 12:00"), "power": "3000"}), "user_id", lifetime=False)
    row, = rows.collect()
    assert "lifetime_earning" not in rows.columns and row.daily_earning == 0 and row.production_kwh == 0.25


def test_dedup_points_last(spark):
    t = local_ms("2026-04-08 12:00")
    rows = readings.interval_reading(points(spark, {"time": t, "power": "12000", "pos": 1}, {"time": str(int(t) + 900), "power": "24000", "pos": 2}), "user_id", "pos")
    assert [r.production_kwh for r in readings.dedup_points_last(rows).collect()] == [2]


def intervals(spark, *epochs):
    return spark.createDataFrame([("u", e) for e in epochs], "user_id STRING, epoch BIGINT").withColumn("timestamp", F.timestamp_seconds("epoch"))


def actions(spark, stored, incoming):
    rows = readings.classify_intervals(intervals(spark, *incoming), intervals(spark, *stored).drop("epoch"))
    return {r.epoch: r.action for r in rows.collect()}


def test_late_interval_rule(spark):
    assert actions(spark, [1, 2], [0, 1, 2, 3]) == {0: "insert", 1: "skip", 2: "skip", 3: "insert"}
    assert actions(spark, [1, 2], [1, 2]) == {1: "skip", 2: "update"}


STORED = "user_id STRING, timestamp TIMESTAMP, battery_level DOUBLE, lifetime_earning DOUBLE"


def test_upsert_overwrites_with_null_and_keeps_other_columns(spark):
    stored = spark.createDataFrame([("u", NOON, 50.0, 7.0), ("v", NOON, 1.0, 2.0)], STORED)
    incoming = spark.createDataFrame([("u", NOON, None)], "user_id STRING, timestamp TIMESTAMP, battery_level DOUBLE")
    merged = merge.upsert_readings(stored, incoming)
    once = sorted(tuple(r) for r in merged.collect())
    assert once == [("u", NOON, None, 7.0), ("v", NOON, 1.0, 2.0)]
    assert sorted(tuple(r) for r in merge.upsert_readings(merged, incoming).collect()) == once


def test_upsert_by_local_day(spark):
    late, early = dt.datetime(2026, 4, 8, 15, 59, 59), dt.datetime(2026, 4, 8, 1, 0)
    incoming = spark.createDataFrame([("u", NOON, dt.date(2026, 4, 8), 9.0)], "user_id STRING, timestamp TIMESTAMP, reading_date DATE, production_kwh DOUBLE")

    def merged(*stamps):
        stored = spark.createDataFrame([("u", s, 1.0) for s in stamps], "user_id STRING, timestamp TIMESTAMP, production_kwh DOUBLE")
        return sorted((r.timestamp, r.production_kwh) for r in merge.upsert_by_local_day(stored, incoming).collect())

    assert merged(late) == [(NOON, 9.0), (late, 1.0)]
    assert merged(early) == [(NOON, 9.0)]
    assert merged(early, NOON) == [(early, 1.0), (NOON, 9.0)]


SYSTEM = ("id STRING, user_id STRING, system_name STRING, capacity_kwp DOUBLE, battery_capacity_kwh DOUBLE, installation_date DATE, "
          "address STRING, status STRING, ord BIGINT")
FACTS = "user_id STRING, station_name STRING, capacity_kwp DOUBLE, battery_capacity_kwh DOUBLE, oldest_date DATE"


def test_upsert_solar_system(spark):
    now, oldest = as_of("2026-04-10 12:00"), dt.date(2025, 1, 1)
    systems = spark.createDataFrame([
        ("a", "u", "old", 1.0, 5.0, dt.date(2026, 3, 31), "-", "active", 1),
        ("b", "v", "old", 1.0, 5.0, dt.date(2026, 2, 9), "-", "active", 2),
        ("c", "w", "old", 1.0, 5.0, None, "-", "retired", 3),
    ], SYSTEM)
    facts = spark.createDataFrame([(u, "new", 2.0, None, oldest) for u in "uvw"], FACTS)
    rows = {(r.user_id, r.status): r for r in merge.upsert_solar_system(systems, facts, now).collect()}
    assert (rows["u", "active"].installation_date, rows["u", "active"].battery_capacity_kwh, rows["u", "active"].system_name) == (oldest, 5.0, "new")
    assert rows["v", "active"].installation_date == dt.date(2026, 2, 9)
    assert rows["w", "active"].installation_date == oldest and rows["w", "retired"].system_name == "old"
    only = merge.created_systems(systems, facts.select("user_id", "station_name", "capacity_kwp"), now, "-")
    rows = {(r.user_id, r.status): r for r in only.collect()}
    new = rows["w", "active"]
    assert (new.installation_date, new.address, new.battery_capacity_kwh) == (dt.date(2026, 4, 10), "-", None)
    assert rows["u", "active"].system_name == "old" and len(rows) == 4


def test_numbers_out_of_range_are_set_aside(spark):
    bad = ["nan", "inf", "-Infinity", "1e30", "1e300"]
    rows = [{"time": local_ms("2026-04-08 10:00"), "power": x, "pos": i} for i, x in enumerate([*bad, "12000"])]
    some = points(spark, *rows)
    found = readings.bad_points(some).select("power", "bad_fields").collect()
    assert [(r.power, r.bad_fields) for r in found] == [(x, ["power"]) for x in bad]
    totals = live.today_totals(live.live_points(some)).first()
    assert totals.production_kwh == 1.0
    day = days(spark, *[{"dateStr": "2026-04-01", "energy": x, "user_id": "u"} for x in [*bad, "5"]])
    assert [r.production_kwh for r in readings.daily_reading(day, "user_id").collect()] == [5.0]
    assert readings.bad_days(day).count() == len(bad)


def test_live_view(spark):
    auth = spark.createDataFrame([("u", {"solis_station_id": " s "}), ("v", {}), ("w", {})], "id STRING, user_metadata MAP<STRING, STRING>")
    profiles = spark.createDataFrame([("v", "empty"), ("w", None)], "id STRING, station_id STRING")
    detail = spark.createDataFrame([("s", "S"), ("empty", "E")], "id STRING, stationName STRING")
    detail = detail.select("*", *[F.lit("1").alias(c) for c in ("power", "capacity", "allEnergy", "allEnergyStr", "monthEnergy", "monthEnergyStr")])
    rows = [{"time": local_ms("2026-04-08 10:00"), "power": "12000", "pos": 1}, {"time": local_ms("2026-04-08 10:05"), "power": "0", "pos": 2},
            {"time": local_ms("2026-04-07 10:05"), "day": "2026-04-07", "power": "12000", "pos": 3}]
    seen = {r.user_id: r for r in pipelines.live_view(auth, profiles, points(spark, *rows), detail, as_of("2026-04-08 12:00")).collect()}
    assert (seen["u"].found, seen["u"].today_production_kwh, [r.production_kw for r in seen["u"].readings]) == (True, 1.0, [12.0])
    assert (seen["v"].found, seen["v"].station_name, seen["v"].today_production_kwh, seen["v"].readings) == (True, "E", 0.0, None)
    assert (seen["w"].found, seen["w"].station_id) == (False, None)


def test_purge_and_evolve(spark):
    stored = spark.createDataFrame([("u", dt.datetime(2026, 4, 7, 15, 59)), ("u", dt.datetime(2026, 4, 7, 16, 0))], "user_id STRING, timestamp TIMESTAMP")
    now = as_of("2026-04-08 09:00")
    assert merge.purge_before_day(stored, now).count() == 1 and merge.purged_count(stored, now).first().purged == 1
    added = merge.evolve_add_column(stored, "lifetime_earning", "decimal(18,2)")
    assert added.schema["lifetime_earning"].dataType.simpleString() == "decimal(18,2)"
    assert merge.evolve_add_column(added, "lifetime_earning", "decimal(18,2)") is added
    assert merge.without_missing_column(added, stored, "lifetime_earning").columns == stored.columns


def test_two_hour_buckets(spark):
    hours = (4, 5, 6, 7, 15, 22, 23)
    source = points(spark, *[{"time": local_ms(f"2026-04-08 {h:02d}:30"), "power": "12000", "pos": h} for h in hours])

    def slots(now):
        return {r.slot: (r.hour, r.production_kwh) for r in live.two_hour_buckets(live.live_points(source), as_of(now)).collect()}

    assert slots("2026-04-08 23:10") == {5: (7, 2.0), 7: (9, 1.0), 15: (17, 1.0), 21: (23, 2.0)}
    assert 15 not in slots("2026-04-08 14:59")


def test_totals_count_points_without_time(spark):
    source = live.live_points(points(spark, {"power": "12000", "familyLoadPower": "6000", "bypassLoadPower": "-7000", "pos": 1}))
    row = live.today_totals(source).first()
    assert (row.production_kwh, row.consumption_kwh) == (1.0, -0.0833)
    assert live.two_hour_buckets(source, as_of("2026-04-08 20:00")).count() == 0


def test_nonzero_points_after_rounding(spark):
    t = local_ms("2026-04-08 12:00")
    kept = live.nonzero_points(live.live_points(points(spark, {"time": t, "power": "0.4"}, {"time": t, "power": "0.6"}, {"power": "900"})))
    assert [r.production_kw for r in kept.collect()] == [0.001]


def test_latest_point_by_position(spark):
    rows = [{"time": local_ms("2026-04-08 13:00"), "batteryPower": "5", "batteryCapacitySoc": "10", "pos": 1},
            {"time": local_ms("2026-04-08 12:00"), "batteryPower": "-5", "batteryCapacitySoc": "20", "pos": 2}]
    row = live.latest_point(live.live_points(points(spark, *rows))).first()
    assert (row.battery_level, row.battery_status) == (20, "discharging")
    row = live.latest_point(live.live_points(points(spark, *rows, {"batteryPower": "5", "pos": 3}))).first()
    assert (row.battery_level, row.battery_status) == (None, None)


def test_live_snapshot(spark):
    detail = frame(spark, ("id", "power", "capacity", "stationName", "allEnergy", "allEnergyStr", "monthEnergy", "monthEnergyStr"),
                   [{"id": "s", "power": "5", "allEnergy": "1.5", "allEnergyStr": "MWh"}])
    source = points(spark, {"power": "12000", "pos": 1}, *[{"time": local_ms(f"2026-04-08 {h:02d}:00"), "power": "12000", "pos": h} for h in (5, 6, 9)])
    row = pipelines.live_snapshot(source, detail, as_of("2026-04-08 12:00")).first()
    assert row.today_production_kwh == 4.0 and row.alltime_production_kwh == 1500 and row.station_name == ""
    assert [(b.hour, b.production_kwh) for b in row.today_hourly] == [(7, 2.0), (11, 1.0)]


def test_backfill_days_and_months(spark):
    now = as_of("2026-04-01 08:00")
    users = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id STRING, station_id STRING")
    rows = [("x", "b", None, 0.0, None, dt.date(2026, 4, 1), "-", "active", 1), ("y", "c", None, 0.0, None, dt.date(2026, 1, 31), "-", "retired", 2)]
    windows = readings.backfill_days(users, spark.createDataFrame(rows, SYSTEM), now)
    assert {r.id: r.backfill_days for r in windows.collect()} == {"a": 90, "b": 0, "c": 60}
    assert sorted(r.id for r in readings.positive_window_users(windows).collect()) == ["a", "c"]
    months = [r.month for r in readings.months_needed(windows, now).filter("id = 'c'").orderBy("month").collect()]
    assert months == ["2026-01", "2026-02", "2026-03"]
    assert {r.backfill_days for r in readings.backfill_days(users, spark.createDataFrame(rows, SYSTEM), now, 7).collect()} == {7}


def test_months_to_sync():
    assert pipelines.months_to_sync(as_of("2026-01-01 02:00")) == ["2025-12", "2026-01"]
    assert pipelines.months_to_sync(as_of("2026-05-02 02:00")) == ["2026-05"]


def test_lifetime_earning(spark):
    rows = spark.createDataFrame([("a", "1.111"), ("a", "2.222"), ("b", "3"), ("c", None)], "station_id STRING, money STRING")
    assert {r.station_id: r.lifetime_earning for r in readings.lifetime_earning(rows).collect()} == {"a": 3.33, "b": 3.0, "c": 0.0}


def test_trim_series(spark):
    rows = [("a", i, v) for i, v in enumerate((0.0, 0.0, 3.0, 0.0, 0.0))] + [("b", i, v) for i, v in enumerate((3.0, 0.0, 0.0))] + [("c", 0, 0.0), ("c", 1, 0.0)]
    trimmed = views.trim_series(spark.createDataFrame(rows, "k STRING, pos INT, value DOUBLE"), ["k"])
    got = {}
    for r in trimmed.orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.value)
    assert got == {"a": [0, 3, 0], "b": [3, 0, 0], "c": [0, 0]}


def test_station_page(spark):
    stations = spark.range(21).selectExpr("id AS ord")
    assert views.page_count(stations.limit(0)).first().pages == 1 and views.page_count(stations).first().pages == 2
    assert [r.ord for r in views.station_page(stations, 2).collect()] == [20]


def test_search(spark):
    rows = spark.createDataFrame([("1", "Casa ANA", "x"), ("2", None, "ana9"), ("3", "b", None)], "id STRING, stationName STRING, sno STRING")
    assert [r.id for r in views.search_stations(rows, " Ana ").orderBy("id").collect()] == ["1", "2"]
    assert views.search_stations(rows, " ").count() == 3


def test_energy_by_period_bounds(spark):
    stamps = [dt.datetime(2026, 3, 31, 15, 59), dt.datetime(2026, 3, 31, 16, 0), dt.datetime(2026, 4, 30, 16, 0)]
    rows = spark.createDataFrame([("u", s, 1.0, 1.0, 1.0) for s in stamps], "user_id STRING, timestamp TIMESTAMP, production_kwh DOUBLE, consumption_kwh DOUBLE, daily_earning DOUBLE")
    month = views.energy_by_period(rows, "user_id", "month", "2026-04")
    assert [str(r.period_start) for r in month.collect()] == ["2026-04-01"]
    assert len(views.energy_by_period(rows, "user_id", "year", as_of=as_of("2026-06-01 00:00")).collect()) == 3
    assert [r.production_kwh for r in views.energy_by_period(rows, "user_id", "all").collect()] == [3.0]


LEAD = "id BIGINT, email_from STRING, contact_name STRING, partner_name STRING, phone STRING, x_studio_complete_address STRING, x_studio_customer_referral_code STRING, ord BIGINT"


def test_dedup_email_first(spark):
    leads = spark.createDataFrame([(i, e, None, None, None, None, None, i) for i, e in enumerate(("A@x", " a@X ", "False", ""))], LEAD)
    matches = spark.createDataFrame([(i, i, f"s{i}", "S") for i in range(4)], "ord BIGINT, lead_id BIGINT, station_id STRING, station_name STRING")
    rows = people.dedup_email_first(people.matches_with_contact(matches, leads))
    assert {r.ord: r.outcome for r in rows.collect()} == {0: "provision", 1: "duplicate", 2: "no_email", 3: "no_email"}
    assert [r.full_name for r in people.provision_list(rows).collect()] == ["S"]


def referrals(spark, leads, profiles, auth):
    leads = spark.createDataFrame([(i, e, c, p, None, None, code, i) for i, (e, c, p, code) in enumerate(leads)], LEAD)
    profiles = spark.createDataFrame([(i, n, code, o) for o, (i, n, code) in enumerate(profiles)], "id STRING, full_name STRING, referral_code STRING, ord BIGINT")
    auth = spark.createDataFrame([(i, e, o) for o, (i, e) in enumerate(auth)], "id STRING, email STRING, ord BIGINT")
    return pipelines.referral_sync(leads, profiles, auth)


def test_referral_targets(spark):
    job = referrals(spark, [("a@x", "Ana M.", "", "N"), ("", "False", "BOB  b", "N"), ("c@x", "", "", "N"), ("", "", "", " ")],
                    [("1", " ana m. ", "O"), ("2", "Bob B", "N")], [("ghost", "A@x"), ("1", "c@X ")])
    assert {(r.lead_id, r.profile_id, r.outcome) for r in job.outcomes.collect()} == {(0, "1", "updated"), (1, "2", "already_set"), (2, "1", "updated")}


def test_referral_final_code(spark):
    job = referrals(spark, [("a@x", "", "", c) for c in "BCA"], [("1", "n", "A")], [("1", "a@x")])
    assert {r.outcome: r.n for r in job.summary.collect()} == {"updated": 2, "already_set": 1}
    assert [r.referral_code for r in job.profiles.collect()] == ["C"]


def test_resolve_station(spark):
    auth = spark.createDataFrame([("a", {"k": " 7 "}), ("b", {"k": ""}), ("c", None)], "id STRING, user_metadata MAP<STRING,STRING>")
    profiles = spark.createDataFrame([("a", "1"), ("b", "2")], "id STRING, station_id STRING")
    assert {r.id: r.station_id for r in live.resolve_station(auth, profiles, "k").collect()} == {"a": "7", "b": "2", "c": None}


def test_sample_per_key(spark):
    rows = spark.range(5).selectExpr("'u' AS user_id", "id AS timestamp")
    got = keep.sample_per_key(rows, ["user_id"], 3, F.col("timestamp")).collect()
    assert [(r.timestamp, r.left_out) for r in sorted(got)] == [(0, 2), (1, 2), (2, 2)]
