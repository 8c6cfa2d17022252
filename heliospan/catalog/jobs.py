"""Queries over whole jobs, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospan.catalog.operators import BUCKETS, DAY_OUT, LIVE, NONZERO, SERIES, TOTALS, WINDOW_SQL, summary_sql, trim_sql
from heliospan.catalog.oracle import LEVEL, STATE, STATUS, rnd, xsum
from heliospan.catalog.registry import query
from heliospan.catalog.sources import (
    DAY_START, DAY_VALUES, SYSTEM_COLUMNS, SYSTEM_SQL, crm_extract, land, station_pages, stored_profiles, with_epoch, write_landed,
)
from heliospan.operators import readings, views
from heliospan.plans import pipelines
from heliospan.session import scratch_dir
from heliospan.sources import landed, tables
from heliospan.standins import AS_OF, DAYS_AS_OF, Tables
from heliospan.streaming import files

C = F.col

SNAPSHOT = f"""SELECT d.id AS station_id, t.day, coalesce(t.production_kwh, 0) AS today_production_kwh, coalesce(t.consumption_kwh, 0) AS today_consumption_kwh,
 coalesce(t.grid_import_kwh, 0) AS today_grid_import_kwh, coalesce(t.grid_export_kwh, 0) AS today_grid_export_kwh, l.battery_level, l.battery_status, b.hour, b.production_kwh AS bucket_production_kwh, b.consumption_kwh AS bucket_consumption_kwh,
 d.power AS current_power_w, d.capacity AS capacity_kwp, d.station_name, CASE d.all_unit WHEN 'GWh' THEN d.all_energy * 1000000 ELSE d.all_energy END AS alltime_production_kwh,
 CASE trim(d.month_unit) WHEN 'MWh' THEN d.month_energy * 1000 WHEN 'GWh' THEN d.month_energy * 1000000 ELSE d.month_energy END AS month_production_kwh
 FROM details d LEFT JOIN (SELECT station_id, day, {TOTALS} FROM ({LIVE}) GROUP BY 1, 2) t ON t.station_id = d.id
 LEFT JOIN (SELECT station_id, day, CASE WHEN soc IS NOT NULL THEN {LEVEL} END AS battery_level, CASE WHEN soc IS NOT NULL THEN {STATUS} END AS battery_status
 FROM ({LIVE} QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY pos DESC) = 1)) l ON l.station_id = t.station_id AND l.day = t.day
 LEFT JOIN ({BUCKETS}) b ON b.station_id = t.station_id AND b.day = t.day"""


@query("live_snapshot", SNAPSHOT)
def _(t):
    rows = pipelines.live_snapshot(t.points, t.details, AS_OF)
    flat = rows.select("*", F.explode_outer("today_hourly").alias("b")).drop("today_hourly")
    return flat.select(*[c for c in flat.columns if c != "b"], C("b.hour").cast("bigint").alias("hour"),
                       C("b.production_kwh").alias("bucket_production_kwh"), C("b.consumption_kwh").alias("bucket_consumption_kwh"))


@query("live_view", f"""SELECT a.id AS user_id, s.station_id, s.station_id IS NOT NULL AS found, v.today_production_kwh, v.battery_level, coalesce(v.buckets, 0) AS buckets,
 coalesce(r.n, 0) AS readings, coalesce(r.production_kw, 0) AS reading_kw FROM auth a LEFT JOIN (SELECT a.id, coalesce(a.meta, p.station_id) AS station_id FROM auth a LEFT JOIN profiles p ON p.id = a.id) s ON s.id = a.id
 LEFT JOIN (SELECT d.id, coalesce(max(x.today_production_kwh), 0) AS today_production_kwh, max(x.battery_level) AS battery_level, count(x.hour) AS buckets
 FROM details d LEFT JOIN ({SNAPSHOT}) x ON x.station_id = d.id AND x.day = '2024-01-30' GROUP BY 1) v ON v.id = s.station_id
 LEFT JOIN (SELECT station_id, count(*) AS n, CAST(sum(CAST(production_kw AS DECIMAL(28,9))) AS DOUBLE) AS production_kw FROM ({NONZERO}) WHERE day = '2024-01-30' GROUP BY 1) r
 ON r.station_id = s.station_id""")
def _(t):
    seen = pipelines.live_view(t.auth_users, t.profiles, t.points, t.details.drop("station_id"), AS_OF)
    size = lambda c: F.coalesce(F.when(C(c).isNotNull(), F.size(c)), F.lit(0)).cast("bigint")
    total = F.aggregate(F.transform("readings", lambda r: r["production_kw"].cast("decimal(28,9)")), F.lit(0).cast("decimal(38,9)"),
                        lambda a, x: (a + x).cast("decimal(38,9)"))
    return seen.select("user_id", "station_id", "found", "today_production_kwh", "battery_level", size("today_hourly").alias("buckets"),
                       size("readings").alias("readings"), F.coalesce(total.cast("double"), F.lit(0.0)).alias("reading_kw"))


def daily(t: Tables) -> pipelines.Job:
    battery = readings.station_battery(t.inverter_list, t.inverters)
    return pipelines.daily_sync(t.profiles, t.systems, t.details.drop("station_id"), battery, t.days, t.stored_days, DAYS_AS_OF)


SYNC_DAYS = """(SELECT u.*, coalesce(s.system_id, 'S-' || md5(u.user_id)) AS system_id, t.target FROM (SELECT * FROM udr QUALIFY row_number() OVER
 (PARTITION BY user_id, d ORDER BY month DESC, o1 DESC, o2 DESC, o3 DESC, o4 DESC, o5 DESC) = 1) u LEFT JOIN last_system s ON s.user_id = u.user_id
 LEFT JOIN day_target t ON t.user_id = u.user_id AND t.d = u.d)"""


@query("daily_sync", f"""SELECT s.user_id, CASE WHEN u.user_id IS NULL THEN s.epoch ELSE u.epoch END AS epoch, CASE WHEN u.user_id IS NULL THEN s.system_id ELSE u.system_id END AS system_id,
 {', '.join(f'CASE WHEN u.user_id IS NULL THEN s.{c} ELSE u.{c} END AS {c}' for c in DAY_VALUES)} FROM stored_days s LEFT JOIN {SYNC_DAYS} u ON u.user_id = s.user_id AND u.target = s.epoch
 UNION ALL SELECT user_id, epoch, system_id, {', '.join(DAY_VALUES)} FROM {SYNC_DAYS} WHERE target IS NULL""")
def _(t):
    return with_epoch(daily(t).table, "user_id", "system_id", *DAY_VALUES)


@query("daily_sync_systems", SYSTEM_SQL.replace("JOIN profiles p ON p.station_id = d.id", "JOIN profiles p ON p.station_id = d.id AND p.station_id IN (SELECT station_id FROM dy)"))
def _(t):
    return daily(t).systems.withColumn("installation_date", C("installation_date").cast("string")).select(*SYSTEM_COLUMNS)


@query("daily_sync_report", f"""SELECT user_id, count(*) AS parsed, count(*) FILTER (target IS NULL) AS inserts, count(*) FILTER (target IS NOT NULL) AS updates, CAST(0 AS BIGINT) AS skipped
 FROM {SYNC_DAYS} GROUP BY 1""")
def _(t):
    return daily(t).report


NEWEST = f"""(SELECT i.*, coalesce(i.system_id, 'S-' || md5(i.user_id)) AS sid, s.user_id IS NULL AS fresh, i.epoch = max(i.epoch) OVER (PARTITION BY i.user_id) AS newest
 FROM (SELECT * FROM ivd WHERE epoch >= {DAY_START}) i LEFT JOIN stored_iv s ON s.user_id = i.user_id AND s.epoch = i.epoch)"""
INTERVAL_TABLE = f"""SELECT coalesce(n.user_id, s.user_id) AS user_id, coalesce(n.epoch, s.epoch) AS epoch, CASE WHEN n.user_id IS NULL THEN 'old' ELSE n.sid END AS system_id,
 CASE WHEN n.user_id IS NULL THEN s.production_kwh ELSE n.production_kwh END AS production_kwh, CASE WHEN n.user_id IS NULL THEN 50 ELSE n.battery_level END AS battery_level,
 CASE WHEN n.user_id IS NULL THEN 7 ELSE n.lifetime_earning END AS lifetime_earning
 FROM (SELECT * FROM {NEWEST} WHERE fresh OR newest) n FULL JOIN (SELECT * FROM stored_iv WHERE epoch >= {DAY_START}) s ON s.user_id = n.user_id AND s.epoch = n.epoch"""
INTERVAL_OUT = ("user_id", "system_id", "production_kwh", "battery_level", "lifetime_earning")


def intervals(t: Tables) -> pipelines.Job:
    return pipelines.interval_sync(t.profiles, t.systems, t.points, t.totals, t.stored_intervals, AS_OF)


@query("interval_sync", INTERVAL_TABLE)
def _(t):
    return with_epoch(intervals(t).table, *INTERVAL_OUT)


def created(address: str, users: str) -> str:
    """SQL of the systems after a job that only adds those that are missing."""
    return f"""SELECT id, user_id, system_name, capacity_kwp, battery_capacity_kwh, CAST(installation_date AS VARCHAR) AS installation_date, status, address FROM systems
 UNION ALL SELECT 'S-' || md5(u.id), u.id, coalesce(nullif(d.station_name, ''), d.id), d.capacity, NULL, {{today}}, 'active', '{address}'
 FROM ({users}) u JOIN details d ON d.id = u.station_id WHERE u.id NOT IN (SELECT user_id FROM last_system)"""


def system_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("installation_date", C("installation_date").cast("string")).select(*SYSTEM_COLUMNS, "address")


@query("interval_sync_systems", created("-", "SELECT id, station_id FROM profiles WHERE station_id IS NOT NULL").format(today="'2024-01-30'"))
def _(t):
    job = pipelines.interval_sync(t.profiles, t.systems, t.points, t.totals, t.stored_intervals, AS_OF, t.details.drop("station_id"))
    return system_rows(job.systems)


@query("interval_sync_report", f"""SELECT user_id, count(*) AS parsed, count(*) FILTER (fresh) AS inserts, count(*) FILTER (NOT fresh AND newest) AS updates,
 count(*) FILTER (NOT fresh AND NOT newest) AS skipped FROM {NEWEST} GROUP BY 1""")
def _(t):
    return intervals(t).report


BACKFILL = f"""(SELECT u.*, coalesce(s.system_id, 'S-' || md5(u.user_id)) AS system_id FROM udr u JOIN ({WINDOW_SQL}) w ON w.id = u.user_id LEFT JOIN last_system s ON s.user_id = u.user_id
 WHERE w.days > 0 AND u.d >= DATE '2001-08-15' - CAST(w.days AS INT) AND u.d < DATE '2001-08-15'
 AND u.month >= strftime(DATE '2001-08-15' - CAST(w.days AS INT), '%Y-%m') AND u.month <= '2001-08'
 QUALIFY row_number() OVER (PARTITION BY u.user_id, u.epoch ORDER BY u.month DESC, o1 DESC, o2 DESC, o3 DESC, o4 DESC, o5 DESC) = 1)"""


@query("history_backfill", f"""SELECT coalesce(b.user_id, s.user_id) AS user_id, coalesce(b.epoch, s.epoch) AS epoch, CASE WHEN b.user_id IS NULL THEN s.system_id ELSE b.system_id END AS system_id,
 {', '.join(f'CASE WHEN b.user_id IS NULL THEN s.{c} ELSE b.{c} END AS {c}' for c in DAY_OUT)} FROM stored_days s FULL JOIN {BACKFILL} b ON b.user_id = s.user_id AND b.epoch = s.epoch""")
def _(t):
    job = pipelines.history_backfill(t.profiles, t.systems, t.days, t.stored_days, DAYS_AS_OF)
    return with_epoch(job.table, "user_id", "system_id", *DAY_OUT)


@query("history_backfill_systems", created("—", f"SELECT p.id, p.station_id FROM profiles p JOIN ({WINDOW_SQL}) w ON w.id = p.id WHERE w.days > 0").format(today="'2001-08-15'"))
def _(t):
    job = pipelines.history_backfill(t.profiles, t.systems, t.days, t.stored_days, DAYS_AS_OF, detail=t.details.drop("station_id"))
    return system_rows(job.systems)


@query("history_backfill_report", f"SELECT user_id, count(*) AS planned FROM {BACKFILL} GROUP BY 1")
def _(t):
    return pipelines.history_backfill(t.profiles, t.systems, t.days, t.stored_days, DAYS_AS_OF).report


STAGED = "(SELECT * FROM routed WHERE lead_id IN (SELECT id FROM leads WHERE stage_id IN (SELECT id FROM stages WHERE (name ILIKE '%installed%' OR name ILIKE '%permitting%') AND NOT contains(name, 'DEPRECATED'))))"


@query("lead_matching", f"SELECT lead_id, match_type, match_score, station_id, matched_on FROM {STAGED}")
def _(t):
    return pipelines.lead_matching(t.leads, t.stages, t.stations).routed.select("lead_id", "match_type", "match_score", "station_id", "matched_on")


def landed_stations(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "stations")
    station_pages(t).write.json(path)
    return landed.read_station_pages(t.spark, path)


@query("lead_matching_landed", f"SELECT lead_id, match_type, match_score, station_id, matched_on FROM {STAGED}")
def _(t):
    found = pipelines.lead_matching(crm_extract(t, t.leads), t.stages, landed_stations(t))
    return found.routed.select("lead_id", "match_type", "match_score", "station_id", "matched_on")


@query("station_page_landed", "SELECT id, sno FROM stations ORDER BY ord LIMIT 20 OFFSET 20")
def _(t):
    return views.station_page(landed_stations(t), 2).select("id", "sno")


@query("lead_matching_summary", summary_sql(STAGED))
def _(t):
    return pipelines.lead_matching(t.leads, t.stages, t.stations).summary


@query("user_provisioning", """SELECT coalesce(a.id, md5(p.email)) AS id, p.phone, p.address, p.station_id, coalesce(p.crm_contact, p.crm_partner, p.station_name) AS full_name,
 CASE WHEN a.id IS NULL THEN 'created' ELSE 'existing' END AS outcome FROM prov p LEFT JOIN auth a ON a.email = p.email WHERE p.outcome = 'provision'""")
def _(t):
    return pipelines.user_provisioning(t.report, t.leads, t.auth_users).profiles


@query("referral_sync", """SELECT p.id, p.full_name, coalesce(c.code, p.referral_code) AS referral_code FROM profiles p LEFT JOIN
 (SELECT profile_id, arg_max(code, ord) AS code FROM ref_outcomes WHERE outcome = 'updated' GROUP BY 1) c ON c.profile_id = p.id""")
def _(t):
    return pipelines.referral_sync(t.coded_leads, t.profiles, t.auth_users).profiles.select("id", "full_name", "referral_code")


@query("referral_sync_landed", """SELECT p.id, p.full_name, coalesce(c.code, p.referral_code) AS referral_code FROM profiles p LEFT JOIN
 (SELECT profile_id, arg_max(code, ord) AS code FROM ref_outcomes WHERE outcome = 'updated' GROUP BY 1) c ON c.profile_id = p.id""")
def _(t):
    merged = pipelines.referral_sync(crm_extract(t, t.coded_leads), stored_profiles(t), t.auth_users).profiles
    return merged.select("id", "full_name", "referral_code")


@query("dashboard_views", f"""SELECT 'card' AS view, id, {STATE} AS label, {rnd('power', 2)} AS value FROM stations
 UNION ALL SELECT 'info', id, coalesce(weather, '-'), CAST(0 AS DOUBLE) FROM details
 UNION ALL SELECT 'summary', 'fleet', CAST(count(*) FILTER (state = 1) AS VARCHAR), {rnd(xsum('power'), 1)} FROM stations
 UNION ALL SELECT 'day', station_id || ' ' || day, CAST(count(*) AS VARCHAR), max(value) FROM ({trim_sql(SERIES)}) GROUP BY station_id, day
 UNION ALL SELECT 'month', station_id || ' ' || month, CAST(count(*) AS VARCHAR), max(q) FROM dy GROUP BY station_id, month""")
def _(t):
    shown = pipelines.dashboard_views(t.stations, t.details, t.points, t.days)
    cards = shown["cards"].select(F.lit("card").alias("view"), "id", C("status").alias("label"), C("power_kw").alias("value"))
    info = shown["info"].select(F.lit("info").alias("view"), "id", C("weather").alias("label"), F.lit(0.0).alias("value"))
    one = shown["summary"].select(F.lit("summary").alias("view"), F.lit("fleet").alias("id"), C("online").cast("string").alias("label"), C("power_kw").alias("value"))

    def chart(view: str, period: str) -> DataFrame:
        rows = shown[f"{view}_chart"].groupBy("station_id", period).agg(F.count("*").cast("string").alias("label"), F.max("value").alias("value"))
        return rows.select(F.lit(view).alias("view"), F.concat_ws(" ", "station_id", period).alias("id"), "label", "value")

    return cards.unionByName(info).unionByName(one).unionByName(chart("day", "day")).unionByName(chart("month", "month"))


# Streams: payload files derived from the tables, run to the end, final state returned.

def land_points(t: Tables) -> str:
    """Landed day curves: one fetch, every point on its own line."""
    path = scratch_dir(t.spark, "curves")
    point = F.struct(*[c for c in t.points.columns if c not in ("station_id", "day", "pos")])
    lines = land(t.points, F.to_json(F.array(point)), station_id=C("station_id"), day=C("day"), seq=F.lit(1).cast("bigint"), page_no=C("pos"))
    write_landed(lines, path)
    return path


def run_interval_stream(t: Tables, path: str, table: str, checkpoint: str) -> DataFrame:
    stream = files.stream_intervals(t.spark, path, table, checkpoint, t.profiles, t.systems, t.totals, lambda: AS_OF, t.stored_intervals)
    stream.awaitTermination()
    return tables.latest_version(t.spark, table)


@query("stream_intervals", INTERVAL_TABLE)
def _(t):
    final = run_interval_stream(t, land_points(t), scratch_dir(t.spark, "intervals"), scratch_dir(t.spark, "state"))
    return with_epoch(final, *INTERVAL_OUT)


@query("stream_dedup", f"SELECT user_id, epoch, count(*) AS n FROM ({INTERVAL_TABLE}) GROUP BY 1, 2")
def _(t):
    path, table = land_points(t), scratch_dir(t.spark, "intervals")
    run_interval_stream(t, path, table, scratch_dir(t.spark, "state"))
    # The same files again, as a second stream over the merged table.
    again = scratch_dir(t.spark, "intervals")
    stream = files.stream_intervals(t.spark, path, again, scratch_dir(t.spark, "state"), t.profiles, t.systems, t.totals,
                                    lambda: AS_OF, tables.latest_version(t.spark, table))
    stream.awaitTermination()
    return with_epoch(tables.latest_version(t.spark, again), "user_id").groupBy("user_id", "epoch").agg(F.count("*").alias("n"))


@query("day_retention", f"SELECT count(*) FILTER (epoch < {DAY_START}) AS old_rows, count(*) AS n FROM ({INTERVAL_TABLE})")
def _(t):
    final = run_interval_stream(t, land_points(t), scratch_dir(t.spark, "intervals"), scratch_dir(t.spark, "state"))
    return with_epoch(final).agg(F.count_if(C("epoch") < DAY_START).alias("old_rows"), F.count("*").alias("n"))


@query("stream_daily", f"SELECT user_id, epoch, {', '.join(DAY_VALUES)} FROM udl WHERE NOT EXISTS (SELECT 1 FROM day_target x WHERE x.user_id = udl.user_id AND x.d = udl.d)"
       f""" UNION ALL SELECT s.user_id, CASE WHEN u.user_id IS NULL THEN s.epoch ELSE u.epoch END, {', '.join(f'CASE WHEN u.user_id IS NULL THEN s.{c} ELSE u.{c} END' for c in DAY_VALUES)}
 FROM stored_days s LEFT JOIN udc u ON u.user_id = s.user_id AND u.target = s.epoch""")
def _(t):
    path, table = scratch_dir(t.spark, "months"), scratch_dir(t.spark, "daily")
    record = F.struct(*[c for c in t.days.columns if c not in ("station_id", "month", "pos")])
    # Order, line and part number as one page number.
    page = (C("pos.l_orderkey") * 10 + C("pos.l_linenumber")) * 10000000 + C("pos.l_partkey")
    lines = land(t.days, F.to_json(F.array(record)), station_id=C("station_id"), month=C("month"), seq=F.lit(1).cast("bigint"), page_no=page)
    write_landed(lines, path)
    local_month = F.date_format(files.clock.local_date(C("timestamp")), "yyyy-MM")
    t.stored_days.withColumn("local_month", local_month).write.partitionBy("local_month").parquet(table)
    battery = readings.station_battery(t.inverter_list, t.inverters)
    stream = files.stream_daily(t.spark, path, table, scratch_dir(t.spark, "state"), t.profiles, t.systems,
                                t.details.drop("station_id"), battery, lambda: DAYS_AS_OF)
    stream.awaitTermination()
    return with_epoch(t.spark.read.parquet(table), "user_id", *DAY_VALUES)


@query("stream_live_buckets", BUCKETS)
def _(t):
    table = scratch_dir(t.spark, "buckets")
    files.stream_live_buckets(t.spark, land_points(t), table, scratch_dir(t.spark, "state"), lambda: AS_OF).awaitTermination()
    rows = files.current_buckets(t.spark, table)
    return rows.select("station_id", "day", C("slot").cast("bigint").alias("slot"), C("hour").cast("bigint").alias("hour"), "production_kwh", "consumption_kwh")


@query("stream_late_buckets", BUCKETS)
def _(t):
    """The same curves as halves of one fetch, with an older fetch between them and an unfinished newer one after them."""
    path, table, state = (scratch_dir(t.spark, n) for n in ("curves", "buckets", "state"))
    point = F.struct(*[c for c in t.points.columns if c not in ("station_id", "day", "pos")])
    doubled = F.struct(*[(C(c).try_cast("double") * 2).cast("string").alias(c) if c == "power" else C(c) for c in t.points.columns
                         if c not in ("station_id", "day", "pos")])
    half = F.pmod(C("pos"), F.lit(2))

    def arrive(points: DataFrame, item, seq: int, page: int, pages: int) -> None:
        curves = points.groupBy("station_id", "day").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(F.to_json(item))), F.lit("]")).alias("data"))
        numbers = {k: F.lit(v).cast("bigint") for k, v in (("seq", seq), ("page_no", page), ("pages", pages))}
        write_landed(land(curves, C("data"), station_id=C("station_id"), day=C("day"), **numbers), path)
        files.stream_live_buckets(t.spark, path, table, state, lambda: AS_OF).awaitTermination()

    # Items of the other half are nulls, which the array of a page leaves out; a page may be empty.
    arrive(t.points, F.when(half == 0, point), 2, 0, 2)
    arrive(t.points, doubled, 1, 0, 1)
    arrive(t.points, F.when(half == 1, point), 2, 1, 2)
    arrive(t.points, F.when(half == 2, point), 3, 0, 2)
    rows = files.current_buckets(t.spark, table)
    return rows.select("station_id", "day", C("slot").cast("bigint").alias("slot"), C("hour").cast("bigint").alias("hour"), "production_kwh", "consumption_kwh")
