"""Queries that apply one column expression to a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from heliospan.catalog.oracle import HOUR, LEVEL, LOAD, STATE, STATUS, crm, email, kwh, norm, rnd, squash
from heliospan.catalog.registry import query
from heliospan.functions import clock, energy, numbers, text
from heliospan.standins import AS_OF

P, C = "SELECT pos, {} FROM pt", F.col


def on_points(name, sql, **columns):
    query(name, P.format(sql))(lambda t: t.points.select("pos", *[c().alias(n) for n, c in columns.items()]))


on_points("to_float", "power, " + "CASE WHEN soc IN ('', 'x') OR soc IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(soc AS DOUBLE) END AS soc",
          power=lambda: numbers.to_float(C("power")), soc=lambda: numbers.to_float(C("batteryCapacitySoc")))
on_points("strict_float", "power, fam, coalesce(soc = 'x', false) AS bad_soc",
          power=lambda: numbers.strict_float(C("power")), fam=lambda: numbers.strict_float(C("familyLoadPower")),
          bad_soc=lambda: numbers.bad_number(C("batteryCapacitySoc")))
on_points("first_truthy", "CASE kind WHEN 'error' THEN v * 39 WHEN 'view' THEN v * 41 WHEN 'signup' THEN v * 39 ELSE v * 40 END AS watts",
          watts=lambda: numbers.parse_double(numbers.first_nonzero(C("pow"), C("power"), C("pac"))))
on_points("interval_energy", f"{rnd(kwh('power'), 6)} AS production_kwh, {rnd(kwh(LOAD), 6)} AS consumption_kwh",
          production_kwh=lambda: energy.interval_energy(numbers.to_float(C("power"))),
          consumption_kwh=lambda: energy.interval_energy(energy.interval_load(C("familyLoadPower"), C("bypassLoadPower"))))
on_points("grid_split", "abs(least(net, 0)) AS import_w, greatest(net, 0) AS export_w",
          import_w=lambda: energy.import_w(numbers.to_float(C("psum"))), export_w=lambda: energy.export_w(numbers.to_float(C("psum"))))
on_points("battery_status", f"{STATUS} AS status",
          status=lambda: energy.battery_status(C("batteryPower"), C("batteryCapacitySoc")))
on_points("battery_status_live", f"CASE WHEN soc IS NOT NULL THEN {STATUS} END AS status",
          status=lambda: energy.battery_status_live(C("batteryPower"), C("batteryCapacitySoc")))
on_points("battery_level", f"{LEVEL} AS level", level=lambda: energy.battery_level(C("batteryCapacitySoc")))
on_points("point_timestamp", f"coalesce(ms // 1000, -1) AS epoch, coalesce({HOUR}, -1) AS local_hour, ms IS NULL AS missing",
          epoch=lambda: F.coalesce(F.unix_seconds(_ts()), F.lit(-1)),
          local_hour=lambda: F.coalesce(clock.local_hour(_ts()).cast("bigint"), F.lit(-1)), missing=lambda: _ts().isNull())
on_points("epoch_key", "coalesce(ms // 1000, -1) AS epoch",
          epoch=lambda: F.coalesce(clock.epoch_key(F.concat(F.date_format(_ts(), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))), F.lit(-1)))
on_points("power_kw", f"{rnd('power / 1000', 3)} AS kw", kw=lambda: energy.power_kw(numbers.to_float(C("power"))))
on_points("round_n", ", ".join(f"{rnd('net / 7', n)} AS r{n}" for n in (1, 2, 3, 4, 6)),
          **{f"r{n}": (lambda n=n: numbers.round_n(numbers.to_float(C("psum")) / 7, n)) for n in (1, 2, 3, 4, 6)})
on_points("clock_label", """CAST(CASE WHEN CAST(split_part(time_str, ':', 1) AS INT) % 12 = 0 THEN 12 ELSE CAST(split_part(time_str, ':', 1) AS INT) % 12 END AS VARCHAR)
 || ':' || split_part(time_str, ':', 2) || CASE WHEN CAST(split_part(time_str, ':', 1) AS INT) >= 12 THEN ' PM' ELSE ' AM' END AS label""",
          label=lambda: clock.clock_label(C("timeStr")))
on_points("local_calendar", f"""day = '{clock.local_calendar(AS_OF)["today"]}' AS is_today, substr(day, 1, 7) = '{clock.local_calendar(AS_OF)["month"]}' AS is_month""",
          is_today=lambda: C("day") == clock.local_calendar(AS_OF)["today"],
          is_month=lambda: F.substring("day", 1, 7) == clock.local_calendar(AS_OF)["month"])


def _ts():
    return clock.point_timestamp(C("time"), C("dataTimestamp"))


DAY_KEY = "SELECT o1, o2, o3, o4, o5, {} FROM dy"


def day_keys():
    return [C(f"pos.{n}").alias(f"o{i}") for i, n in enumerate(("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), 1)]


@query("daily_consumption", DAY_KEY.format("CASE WHEN home_grid + back_up > 0 THEN home_grid + back_up WHEN home_load > 0 THEN home_load ELSE consume END AS kwh"))
def _(t):
    return t.days.select(*day_keys(), energy.daily_consumption(t.days).alias("kwh"))


@query("local_noon", DAY_KEY.format("CASE WHEN date_str = '' THEN -1 ELSE (d - DATE '1970-01-01') * 86400 + 14400 END AS epoch"))
def _(t):
    noon = F.unix_seconds(clock.local_noon(clock.iso_date(C("dateStr"))))
    return t.days.select(*day_keys(), F.coalesce(noon, F.lit(-1)).alias("epoch"))


@query("month_day_label", DAY_KEY.format("CASE WHEN date_str = '' THEN '' ELSE strftime(d, '%b') || ' ' || day(d) END AS label"))
def _(t):
    return t.days.select(*day_keys(), clock.month_day_label(C("dateStr")).alias("label"))


@query("energy_to_kwh", """SELECT id, CASE trim(month_unit) WHEN 'MWh' THEN month_energy * 1000 WHEN 'GWh' THEN month_energy * 1000000 ELSE month_energy END AS month_kwh,
 CASE all_unit WHEN 'GWh' THEN all_energy * 1000000 ELSE all_energy END AS all_kwh FROM details""")
def _(t):
    def kwh_of(field):
        return energy.energy_to_kwh(numbers.strict_float(C(field)), C(f"{field}Str"))

    return t.details.select("id", kwh_of("monthEnergy").alias("month_kwh"), kwh_of("allEnergy").alias("all_kwh"))


@query("battery_capacity", "SELECT inverter_id, capacity FROM inv")
def _(t):
    return t.inverters.select("inverter_id", energy.battery_capacity(t.inverters).alias("capacity"))


@query("station_status", f"SELECT id, {STATE} AS status FROM stations")
def _(t):
    return t.stations.select("id", energy.station_status(C("state")).alias("status"))


_INCOME = """CASE WHEN income_unit = 'K PHP' THEN 'PHP ' || n || 'K' WHEN income_unit = 'MYR' THEN 'YR ' || n || 'M' WHEN income_unit = ' m usd' THEN 'usd ' || n || 'M' ELSE 'PHP ' || n END"""
_GROUPED = r"""CASE WHEN income < 0 THEN '-' ELSE '' END || regexp_replace(CAST(CAST(abs(income) AS BIGINT) AS VARCHAR), '(\d)(\d{3})$', '\1,\2')"""


@query("format_income", f"SELECT id, {_INCOME} AS label FROM (SELECT *, {_GROUPED} AS n FROM details)")
def _(t):
    return t.details.select("id", text.format_income(numbers.parse_double(C("allInCome")), C("allInComeUnit")).alias("label"))


@query("location_text", "SELECT id, city || CASE WHEN region = '' THEN '' ELSE ', ' || region END || ', ' || country AS place FROM details")
def _(t):
    return t.details.select("id", text.location_text(C("cityStr"), C("regionStr"), C("countryStr")).alias("place"))


@query("normalize_name", f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents")
def _(t):
    return t.table("documents").select("doc_id", F.md5(text.normalize_name(C("text"))).alias("digest"))


@query("squash_name", f"SELECT doc_id, md5({squash('text')}) AS digest FROM documents")
def _(t):
    return t.table("documents").select("doc_id", F.md5(text.squash_name(C("text"))).alias("digest"))


@query("token_set", f"SELECT doc_id, CAST(len(list_filter(list_distinct(string_split({norm('text')}, ' ')), lambda w: w <> '')) AS BIGINT) AS words FROM documents")
def _(t):
    words = text.token_set(text.normalize_name(C("text")))
    return t.table("documents").select("doc_id", F.size(words).cast("bigint").alias("words"))


@query("token_overlap", f"""SELECT id, CASE WHEN a IS NULL OR b IS NULL THEN CAST(0 AS DOUBLE) ELSE
 len(list_intersect(a, b)) / least(len(a), len(b)) END AS overlap FROM (SELECT id, list_distinct(string_split({norm('partner_name')}, ' ')) AS a,
 list_distinct(string_split({norm('contact_name')}, ' ')) AS b FROM leads)""")
def _(t):
    left, right = (text.token_set(text.normalize_name(C(c))) for c in ("partner_name", "contact_name"))
    return t.leads.select("id", text.token_overlap(left, right).alias("overlap"))


@query("clean_crm_text", f"SELECT id, {crm('email_from')} AS email, {crm('phone')} AS phone FROM leads")
def _(t):
    return t.leads.select("id", text.clean_crm_text(C("email_from")).alias("email"), text.clean_crm_text(C("phone")).alias("phone"))


@query("clean_email", f"SELECT id, {email('email_from')} AS email FROM leads")
def _(t):
    return t.leads.select("id", text.clean_email(C("email_from")).alias("email"))


@query("display_name", f"SELECT ord, coalesce(crm_contact, crm_partner, station_name) AS label FROM report")
def _(t):
    joined = t.report.select("ord", "lead_id", "station_name").join(t.leads.select(C("id").alias("lead_id"), "contact_name", C("partner_name").alias("p")), "lead_id", "left")
    return joined.select("ord", text.display_name(C("contact_name"), C("p"), C("station_name"), "Solar User").alias("label"))
