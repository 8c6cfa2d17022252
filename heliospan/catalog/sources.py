"""Queries over sources and sinks. Landed payloads are derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.catalog.oracle import STATE
from heliospan.catalog.registry import query
from heliospan.operators import matching, merge, readings, views
from heliospan.plans import pipelines
from heliospan.session import scratch_dir
from heliospan.sources import landed, tables
from heliospan.standins import AS_OF, DAYS_AS_OF, Tables

C = F.col


def land(rows: DataFrame, data: Column, success=None, code=None, **request) -> DataFrame:
    """Landed rows: request fields and the envelope around ``data``."""
    fields = {n: request.get(n, F.lit(None).cast(kind)) for n, kind in
              (("station_id", "string"), ("entity_id", "string"), ("day", "string"), ("month", "string"), ("seq", "bigint"), ("page_no", "bigint"), ("pages", "bigint"))}
    return rows.select(
        *[c.alias(n) for n, c in fields.items()],
        (F.lit(True) if success is None else success).alias("success"),
        (F.lit("0") if code is None else code).alias("code"),
        F.lit("m").alias("msg"), data.alias("data"),
    )


def write_landed(lines: DataFrame, path: str) -> None:
    """Landed lines as gzip files, which repeat field names at little cost; a file is read by one task, so its lines are bounded."""
    lines.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", 250000).json(path)


def station_pages(t: Tables) -> DataFrame:
    fields = ("id", "stationName", "sno", "state", "capacity", "power", "dayEnergy", "allEnergy")
    page = F.struct((C("ord") + 1).alias("total"), F.array(F.struct(*fields)).alias("records"))
    return land(t.stations, F.to_json(F.struct(page.alias("page"))), page_no=C("ord"))


@query("read_station_pages", f"SELECT ord AS page_no, id, station_name, sno, {STATE} AS status, power FROM stations")
def _(t):
    rows = landed.parse_station_pages(station_pages(t))
    status = F.when(C("state") == 1, "Online").when(C("state") == 3, "Alarm").otherwise("Offline")
    return rows.select(C("page_no").cast("bigint").alias("page_no"), "id", C("stationName").alias("station_name"), "sno",
                       status.alias("status"), C("power").cast("double").alias("power"))


@query("read_completeness", """SELECT count(*) AS fetched, max(ord) + 1 AS reported, CAST(0 AS BIGINT) AS missing_pages, CAST(0 AS BIGINT) AS repeated_pages,
 count(*) >= max(ord) + 1 AS complete FROM stations""")
def _(t):
    return landed.read_completeness(station_pages(t))


@query("read_station_detail", "SELECT id, station_name, power, month_unit, weather FROM details")
def _(t):
    rows = land(t.details, F.to_json(F.struct(*[c for c in t.details.columns if c != "station_id"])), station_id=C("station_id"))
    return landed.parse_station_detail(rows).select(
        "id", C("stationName").alias("station_name"), C("power").cast("double").alias("power"),
        C("monthEnergyStr").alias("month_unit"), C("condTxtD").alias("weather"))


def day_curves(t: Tables) -> DataFrame:
    """One landed line per event: a list of two points, or a lone object for signups."""
    point = F.struct(*[c for c in t.points.columns if c not in ("station_id", "day", "pos")])
    signup = (C("batteryCapacitySoc").isNull())
    return land(t.points, F.when(signup, F.to_json(point)).otherwise(F.to_json(F.array(point, point))),
                station_id=C("station_id"), entity_id=C("pos").cast("string"), day=C("day"))


@query("read_day_points", """SELECT CAST(pos AS VARCHAR) AS entity_id, day, p AS pos, coalesce(ms // 1000, -1) AS epoch, fam
 FROM pt, (SELECT 0 AS p UNION ALL SELECT 1) WHERE kind <> 'signup'""")
def _(t):
    rows = readings.point_times(landed.parse_day_points(day_curves(t), key="entity_id"))
    return rows.select("entity_id", "day", C("pos").cast("bigint").alias("pos"),
                       F.coalesce(F.unix_seconds("timestamp"), F.lit(-1)).alias("epoch"), C("familyLoadPower").cast("double").alias("fam"))


@query("read_month_days", "SELECT station_id, month, date_str, q AS energy, o1, o2, o3, o5 FROM dy")
def _(t):
    fields = [c for c in t.days.columns if c not in ("station_id", "month", "pos")]
    key = F.concat_ws("|", *[C(f"pos.{n}") for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")])
    rows = land(t.days, F.to_json(F.array(F.struct(*fields))), station_id=C("station_id"), entity_id=key, month=C("month"))
    parts = F.split("entity_id", r"\|")
    path = scratch_dir(t.spark, "months")
    write_landed(rows, path)
    # One fetch of each entity, which stands for a station and record here.
    days = landed.read_month_days(t.spark, path, key="entity_id").join(rows.select("entity_id", "station_id"), "entity_id")
    return days.select("station_id", "month", C("dateStr").alias("date_str"), C("energy").cast("double").alias("energy"),
                       *[parts[i].cast(kind).alias(n) for i, (n, kind) in enumerate((("o1", "bigint"), ("o2", "bigint"), ("o3", "bigint"), ("o5", "double")))])


@query("read_station_all", """SELECT CAST(o_custkey AS VARCHAR) AS station_id, CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END = 'n/a' AS bad, count(*) AS n
 FROM orders GROUP BY 1, 2""")
def _(t):
    one = F.struct("money")
    data = F.when(C("money") == "n/a", F.to_json(one)).otherwise(F.to_json(F.array(one)))
    rows = landed.parse_station_all(land(t.totals, data, station_id=C("station_id")))
    return rows.groupBy("station_id", (C("money") == "n/a").alias("bad")).agg(F.count("*").alias("n"))


@query("read_inverters", """SELECT CAST(p_partkey AS VARCHAR) AS station_id, CASE WHEN p_size <= 10 THEN 'X' || p_partkey ELSE 'I' || p_partkey END AS inverter_id, i.capacity
 FROM part LEFT JOIN inv i ON i.inverter_id = 'I' || p_partkey""")
def _(t):
    part = t.table("part")
    key, size = C("p_partkey").cast("string"), C("p_size")
    row = F.struct(F.when(size > 10, F.concat(F.lit("I"), key)).alias("id"), F.concat(F.lit("X"), key).alias("sn"))
    paged = F.to_json(F.struct(F.struct(F.array(row).alias("records")).alias("page")))
    flat = F.to_json(F.struct(F.struct(F.filter(F.array(row), lambda r: F.lit(False)).alias("records")).alias("page"), F.array(row).alias("records")))
    listed = landed.parse_inverters(land(part, F.when(size > 30, paged).otherwise(flat), station_id=key))
    details = t.inverters
    raw = land(details, F.to_json(F.struct(*[c for c in details.columns if c != "inverter_id"])), entity_id=C("inverter_id"))
    parsed = landed.parse_inverter_detail(raw)
    capacity = parsed.select("inverter_id", readings.energy.battery_capacity(parsed).alias("capacity"))
    own = F.concat(F.lit("I"), C("station_id"))
    return listed.join(capacity.withColumnRenamed("inverter_id", "_i"), own == C("_i"), "left").select("station_id", "inverter_id", "capacity")


def stored_profiles(t: Tables) -> DataFrame:
    """Profiles as a stored table without ordinals, in row order, and read back with them."""
    path = scratch_dir(t.spark, "profiles")
    rows = t.profiles.orderBy("ord").drop("ord").withColumnRenamed("station_id", schemas.LONG_STATION_FIELD)
    rows.write.parquet(path)
    return tables.read_dimensions(t.spark, path, (*schemas.PROFILE_COLUMNS, "ord"))


@query("read_dimensions", "SELECT id, full_name, station_id, row_number() OVER (ORDER BY ord) AS place FROM profiles")
def _(t):
    rows = stored_profiles(t)
    place = F.row_number().over(Window.orderBy("ord"))
    return rows.select("id", "full_name", "station_id", place.cast("bigint").alias("place"))


def crm_extract(t: Tables, leads: DataFrame) -> DataFrame:
    """Leads as a CRM extract without ordinals, read back with them."""
    path = scratch_dir(t.spark, "crm")
    leads.orderBy("ord").drop("ord").write.json(path)
    return tables.read_crm_leads(t.spark, path)


@query("read_crm_leads", "SELECT id, name, partner_name, contact_name, email_from, stage_id, stage FROM leads")
def _(t):
    return crm_extract(t, t.leads).select("id", "name", "partner_name", "contact_name", "email_from", C("stage_id.id").alias("stage_id"), C("stage_id.name").alias("stage"))


@query("read_station_filter_csv", "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS station_id FROM lineitem WHERE l_linenumber > 1")
def _(t):
    ids = F.when(C("l_linenumber") > 1, F.concat(F.lit(" "), C("l_suppkey").cast("string"), F.lit(" "))).otherwise("")
    path = scratch_dir(t.spark, "filter")
    t.table("lineitem").select(ids.alias(tables.BYTE_ORDER_MARK + schemas.LONG_STATION_FIELD)).write.option("header", True).csv(path)
    return tables.read_station_filter_csv(t.spark, path)


REPORT_FIELDS = "lead_id: BIGINT, station_id: STRING, station_name: STRING, partner_name: STRING"


@query("write_report", "SELECT ord, lead_id, station_id, station_name, partner_name FROM report")
def _(t):
    path = scratch_dir(t.spark, "report")
    tables.write_report({"exact_matches": t.report}, path)
    return tables.read_match_report(t.spark, path, REPORT_FIELDS)


@query("read_match_report", "SELECT count(*) AS n, sum(ord) AS ords FROM report")
def _(t):
    path = scratch_dir(t.spark, "report")
    tables.write_report({"exact_matches": t.report}, path)
    return tables.read_match_report(t.spark, path, REPORT_FIELDS).agg(F.count("*").alias("n"), F.sum("ord").alias("ords"))


def enveloped(t: Tables) -> DataFrame:
    kind = C("event_type")
    return land(t.table("events"), F.concat(F.lit("["), C("value").cast("string"), F.lit("]")),
                success=F.when(kind == "purchase", F.lit(None)).otherwise(kind != "error").cast("boolean"),
                code=F.when(C("value") > 20, "0").when(C("value") > 10, "1"), entity_id=C("event_id").cast("string"))


@query("split_envelopes", """SELECT CAST(event_id AS VARCHAR) AS entity_id, event_type NOT IN ('error', 'purchase') OR value > 20 AS good FROM events""")
def _(t):
    good, bad = landed.split_envelopes(enveloped(t))
    return good.select("entity_id", F.lit(True).alias("good")).unionByName(bad.select("entity_id", F.lit(False).alias("good")))


IV_OUT = ("user_id", "system_id", "production_kwh", "consumption_kwh", "battery_level", "battery_status", "grid_import_kwh", "grid_export_kwh",
          "daily_earning", "lifetime_earning")


def with_epoch(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.unix_seconds("timestamp").alias("epoch"), *columns)


def incoming_intervals(t: Tables, lifetime: bool = True) -> DataFrame:
    return readings.dedup_points_last(readings.interval_reading(t.user_points, "user_id", "system_id", "pos", lifetime=lifetime))


@query("upsert_readings", """SELECT coalesce(i.user_id, s.user_id) AS user_id, coalesce(i.epoch, s.epoch) AS epoch,
 CASE WHEN i.user_id IS NULL THEN 'old' ELSE i.system_id END AS system_id, CASE WHEN i.user_id IS NULL THEN s.production_kwh ELSE i.production_kwh END AS production_kwh,
 CASE WHEN i.user_id IS NULL THEN 50 ELSE i.battery_level END AS battery_level, CASE WHEN i.user_id IS NULL THEN 'idle' ELSE i.battery_status END AS battery_status,
 CASE WHEN s.user_id IS NOT NULL THEN CAST(7 AS DOUBLE) END AS lifetime_earning, coalesce(s.batch_no, -1) AS batch_no
 FROM ivd i FULL JOIN stored_iv s ON s.user_id = i.user_id AND s.epoch = i.epoch""")
def _(t):
    merged = merge.upsert_readings(t.stored_intervals, incoming_intervals(t, lifetime=False).drop("pos", "epoch"))
    return with_epoch(merged.withColumn("batch_no", F.coalesce("batch_no", F.lit(-1))), "user_id", "system_id", "production_kwh", "battery_level",
                      "battery_status", "lifetime_earning", "batch_no")


DAY_VALUES = ("production_kwh", "consumption_kwh", "grid_import_kwh", "grid_export_kwh", "daily_earning")


@query("upsert_by_local_day", f"""SELECT s.user_id, CASE WHEN u.user_id IS NULL THEN s.epoch ELSE u.epoch END AS epoch,
 {', '.join(f'CASE WHEN u.user_id IS NULL THEN s.{c} ELSE u.{c} END AS {c}' for c in DAY_VALUES)},
 CASE WHEN u.user_id IS NULL THEN s.battery_level END AS battery_level, s.batch_no
 FROM stored_days s LEFT JOIN udc u ON u.user_id = s.user_id AND u.target = s.epoch
 UNION ALL SELECT user_id, epoch, {', '.join(DAY_VALUES)}, NULL, -1 FROM udc WHERE target IS NULL""")
def _(t):
    rows = readings.dedup_days_last(readings.daily_reading(t.user_days, "user_id", "month", "pos")).drop("month", "pos")
    merged = merge.upsert_by_local_day(t.stored_days, rows)
    return with_epoch(merged.withColumn("batch_no", F.coalesce("batch_no", F.lit(-1))), "user_id", *DAY_VALUES, "battery_level", "batch_no")


SYSTEM_SQL = """SELECT s.id, s.user_id, CASE WHEN g.id IS NULL THEN s.system_name ELSE coalesce(nullif(g.station_name, ''), g.sno) END AS system_name,
 CASE WHEN g.id IS NULL THEN s.capacity_kwp ELSE g.capacity END AS capacity_kwp, coalesce(b.capacity, s.battery_capacity_kwh) AS battery_capacity_kwh,
 CAST(CASE WHEN g.id IS NOT NULL AND s.installation_date >= DATE '2001-07-16' THEN coalesce(o.d, DATE '2001-08-15') ELSE s.installation_date END AS VARCHAR) AS installation_date, s.status
 FROM systems s LEFT JOIN last_system l ON l.system_id = s.id LEFT JOIN (SELECT d.* FROM details d JOIN profiles p ON p.station_id = d.id) g ON g.id = l.user_id
 LEFT JOIN first_inv f ON f.station_id = g.id LEFT JOIN inv b ON b.inverter_id = f.inverter_id
 LEFT JOIN (SELECT user_id, min(d) AS d FROM stored_days GROUP BY 1) o ON o.user_id = g.id
 UNION ALL SELECT 'S-' || md5(g.id), g.id, coalesce(nullif(g.station_name, ''), g.sno), g.capacity, b.capacity, CAST(coalesce(o.d, DATE '2001-08-15') AS VARCHAR), 'active'
 FROM (SELECT d.* FROM details d JOIN profiles p ON p.station_id = d.id) g LEFT JOIN first_inv f ON f.station_id = g.id LEFT JOIN inv b ON b.inverter_id = f.inverter_id
 LEFT JOIN (SELECT user_id, min(d) AS d FROM stored_days GROUP BY 1) o ON o.user_id = g.id WHERE g.id NOT IN (SELECT user_id FROM last_system)"""
SYSTEM_COLUMNS = ("id", "user_id", "system_name", "capacity_kwp", "battery_capacity_kwh", "installation_date", "status")


@query("upsert_solar_system", SYSTEM_SQL)
def _(t):
    users = readings.mapped_users(t.profiles)
    oldest = readings.oldest_reading_date(users, t.stored_days, DAYS_AS_OF)
    facts = pipelines.station_facts(users, t.details.drop("station_id"), readings.station_battery(t.inverter_list, t.inverters), oldest)
    merged = merge.upsert_solar_system(t.systems, facts, DAYS_AS_OF)
    return merged.withColumn("installation_date", C("installation_date").cast("string")).select(*SYSTEM_COLUMNS)


DAY_START = 1706544000


@query("purge_before_day", f"SELECT user_id, epoch, production_kwh FROM stored_iv WHERE epoch >= {DAY_START}")
def _(t):
    return with_epoch(merge.purge_before_day(t.stored_intervals, AS_OF), "user_id", "production_kwh")


@query("purged_count", f"SELECT count(*) AS purged FROM stored_iv WHERE epoch < {DAY_START}")
def _(t):
    return merge.purged_count(t.stored_intervals, AS_OF)


@query("evolve_add_column", "SELECT user_id, epoch, CAST(0 AS DOUBLE) AS lifetime_earning FROM stored_iv")
def _(t):
    added = merge.evolve_add_column(t.stored_intervals.drop("lifetime_earning"), "lifetime_earning", "decimal(18,2)")
    return with_epoch(added, "user_id", C("lifetime_earning").cast("double").alias("lifetime_earning"))


PERIOD_SQL = """SELECT user_id, {} AS period_start, {}, {} FROM udl GROUP BY 1, 2"""


def _period(t: Tables, period: str) -> DataFrame:
    rows = readings.dedup_days_last(readings.daily_reading(t.user_days, "user_id", "month", "pos"))
    series = views.energy_by_period(rows, "user_id", period)
    return series.select("user_id", C("period_start").cast("string").alias("period_start"), "production_kwh", "earning")


def _period_sql(step: str) -> str:
    from heliospan.catalog.oracle import rnd, xsum

    return PERIOD_SQL.format(f"CAST({step} AS VARCHAR)", rnd(xsum("production_kwh"), 4) + " AS production_kwh", rnd(xsum("daily_earning"), 2) + " AS earning")


query("energy_by_period", _period_sql("CAST(date_trunc('year', d) AS DATE)"))(lambda t: _period(t, "all"))
query("energy_by_period_year", _period_sql("CAST(date_trunc('month', d) AS DATE)"))(lambda t: _period(t, "year"))
query("energy_by_period_month", _period_sql("d"))(lambda t: _period(t, "month"))


@query("entity_page", "SELECT alarm_id, station_id FROM (SELECT event_id AS alarm_id, CAST(user_id AS VARCHAR) AS station_id FROM events WHERE event_type = 'error') ORDER BY alarm_id LIMIT 20 OFFSET 40")
def _(t):
    return views.entity_page(t.alarms.select("alarm_id", "station_id"), page=3, size=20, order="alarm_id")


@query("plan_only", """SELECT user_id, epoch, n AS sample_no, greatest(total - 3, 0) AS left_out FROM (SELECT user_id, epoch, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS n,
 count(*) OVER (PARTITION BY user_id) AS total FROM ivc WHERE action <> 'skip') WHERE n <= 3""")
def _(t):
    changes = readings.late_interval_rule(incoming_intervals(t), t.stored_intervals)
    shown = pipelines.plan_only(pipelines.Job(changes, changes, changes))
    return shown.select("user_id", "epoch", C("sample_no").cast("bigint").alias("sample_no"), C("left_out").cast("bigint").alias("left_out"))


@query("installed_stages", """SELECT id, name FROM stages WHERE (name ILIKE '%installed%' OR name ILIKE '%project closed%' OR name ILIKE '%permitting%') AND NOT contains(name, 'DEPRECATED')""")
def _(t):
    return matching.installed_stages(t.stages).select("id", "name")
