"""Queries over filters, joins, aggregates, ranking, paging and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.catalog.oracle import HOUR, LEVEL, STATE, STATUS, crm, kwh, norm, rnd, xsum
from heliospan.catalog.registry import query
from heliospan.catalog.sources import DAY_START, IV_OUT, incoming_intervals, with_epoch
from heliospan.functions import clock
from heliospan.functions.text import normalize_name
from heliospan.operators import keep, live, matching, merge, people, readings, views
from heliospan.session import materialize
from heliospan.standins import AS_OF, DAYS_AS_OF, Tables

C = F.col
ORDER_COLUMNS = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
DAY_OUT = ("production_kwh", "consumption_kwh", "grid_import_kwh", "grid_export_kwh", "daily_earning")


def order_keys(source: str = "pos"):
    return [C(f"{source}.{n}").alias(f"o{i}") for i, n in enumerate(ORDER_COLUMNS, 1)]


# Readings

@query("daily_reading", f"SELECT o1, o2, o3, o4, o5, epoch, {', '.join(DAY_OUT)} FROM dr")
def _(t):
    return with_epoch(readings.daily_reading(t.days, "pos"), *order_keys(), *DAY_OUT)


@query("bad_days", "SELECT o1, o2, o3, o4, o5 FROM dy WHERE date_str <> '' AND money IS NULL")
def _(t):
    return readings.bad_days(t.days).select(*order_keys())


@query("has_date", "SELECT o1, o2, o3, o4, o5, date_str FROM dy WHERE date_str <> ''")
def _(t):
    return readings.has_date(t.days).select(*order_keys(), C("dateStr").alias("date_str"))


@query("interval_reading", f"SELECT pos, epoch, {', '.join(IV_OUT)} FROM iv")
def _(t):
    return readings.interval_reading(t.user_points, "user_id", "system_id", "pos").select("pos", "epoch", *IV_OUT)


@query("dedup_points_last", f"SELECT epoch, {', '.join(IV_OUT)} FROM ivd")
def _(t):
    return incoming_intervals(t).select("epoch", *IV_OUT)


@query("dedup_days_last", f"SELECT user_id, epoch, month, {', '.join(DAY_OUT)} FROM udl")
def _(t):
    rows = readings.dedup_days_last(readings.daily_reading(t.user_days, "user_id", "month", "pos"))
    return with_epoch(rows, "user_id", "month", *DAY_OUT)


@query("merge_months", "SELECT user_id, month, count(*) AS n FROM udr GROUP BY 1, 2")
def _(t):
    rows = readings.daily_reading(t.user_days, "user_id", "month", "pos")
    return rows.groupBy("user_id", "month").agg(F.count("*").alias("n"))


# Filters

@query("mapped_users", "SELECT id, station_id FROM profiles WHERE station_id IS NOT NULL")
def _(t):
    return readings.mapped_users(t.profiles).select("id", "station_id")


@query("active_systems", "SELECT id, user_id FROM systems WHERE status = 'active'")
def _(t):
    return readings.active_systems(t.systems).select("id", "user_id")


@query("readings_of_day", f"SELECT user_id, epoch, production_kwh FROM stored_iv WHERE epoch >= {DAY_START} AND epoch < {DAY_START + 86400}")
def _(t):
    return with_epoch(readings.readings_of_day(t.stored_intervals, AS_OF), "user_id", "production_kwh")


WINDOW_SQL = """SELECT p.id, CASE WHEN d.installation_date IS NULL THEN 90 ELSE DATE '2001-08-15' - d.installation_date END AS days
 FROM profiles p LEFT JOIN last_date d ON d.user_id = p.id WHERE p.station_id IS NOT NULL"""


def windows(t: Tables) -> DataFrame:
    return readings.backfill_days(readings.mapped_users(t.profiles), t.systems, DAYS_AS_OF)


@query("backfill_days", f"SELECT id, CAST(days AS BIGINT) AS days FROM ({WINDOW_SQL})")
def _(t):
    return windows(t).select("id", C("backfill_days").cast("bigint").alias("days"))


@query("backfill_days_fixed", "SELECT id, CAST(30 AS BIGINT) AS days FROM profiles WHERE station_id IS NOT NULL")
def _(t):
    rows = readings.backfill_days(readings.mapped_users(t.profiles), t.systems, DAYS_AS_OF, fixed_days=30)
    return rows.select("id", C("backfill_days").cast("bigint").alias("days"))


@query("positive_window_users", f"SELECT id FROM ({WINDOW_SQL}) WHERE days > 0")
def _(t):
    return readings.positive_window_users(windows(t)).select("id")


@query("months_needed", f"""SELECT id, strftime(m, '%Y-%m') AS month FROM (SELECT id, unnest(generate_series(date_trunc('month', DATE '2001-08-15' - CAST(days AS INT)),
 CAST(DATE '2001-08-14' AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM ({WINDOW_SQL}) WHERE days > 0)""")
def _(t):
    return readings.months_needed(readings.positive_window_users(windows(t)), DAYS_AS_OF)


@query("backfill_window", f"""SELECT u.user_id, u.epoch, u.month, u.production_kwh, u.o1 FROM udr u JOIN ({WINDOW_SQL}) w ON w.id = u.user_id
 WHERE u.d >= DATE '2001-08-15' - CAST(w.days AS INT) AND u.d < DATE '2001-08-15'""")
def _(t):
    start = windows(t).select(C("id").alias("user_id"), "start_date")
    # Users meet their windows first and payloads are parsed before the one join that moves them.
    users = readings.mapped_users(t.profiles).select(C("id").alias("user_id"), "station_id").join(start, "user_id")
    rows = readings.daily_reading(t.days, "station_id", "month", "pos").join(users, "station_id")
    return with_epoch(readings.backfill_window(rows, DAYS_AS_OF), "user_id", "month", "production_kwh", C("pos.l_orderkey").alias("o1"))


LIVE = "SELECT station_id, day, pos, ms, power, fam + byp AS load_w, net, bat, soc FROM pt"
OPEN = f"ms IS NOT NULL AND {HOUR} >= 5 AND (day < '2024-01-30' OR (day = '2024-01-30' AND {HOUR} <= 14))"


def live_points(t: Tables) -> DataFrame:
    return live.live_points(t.points)


NONZERO = f"""SELECT * FROM (SELECT station_id, day, pos, ms // 1000 AS epoch, {rnd('power / 1000', 3)} AS production_kw,
 {rnd('load_w / 1000', 3)} AS consumption_kw, {LEVEL} AS battery_level FROM ({LIVE}) WHERE ms IS NOT NULL) WHERE production_kw > 0 OR consumption_kw > 0"""


@query("nonzero_points", NONZERO)
def _(t):
    return with_epoch(live.nonzero_points(live_points(t)), "station_id", "day", "pos", "production_kw", "consumption_kw", "battery_level")


@query("daytime_points", f"SELECT pos, {HOUR} AS hour FROM pt WHERE {OPEN}")
def _(t):
    return live.daytime_points(live_points(t), AS_OF).select("pos", C("hour").cast("bigint").alias("hour"))


@query("search_stations", "SELECT id FROM stations WHERE contains(lower(station_name), 'ring') OR contains(lower(sno), 'ring')")
def _(t):
    return views.search_stations(t.stations, " RING ").select("id")


@query("leads_with_code", "SELECT id, code FROM coded")
def _(t):
    return people.leads_with_code(t.leads).select("id", "code")


@query("valid_email_matches", "SELECT ord, email IS NOT NULL AS valid FROM report")
def _(t):
    good, bad = people.valid_email_matches(people.matches_with_contact(t.report, t.leads))
    return good.select("ord", F.lit(True).alias("valid")).unionByName(bad.select("ord", F.lit(False).alias("valid")))


@query("alarms_in_range", """SELECT event_id AS alarm_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-09 16:00:00' AND ts < TIMESTAMP '2024-01-19 16:00:00'""")
def _(t):
    begin, end = clock.local_time("2024-01-10"), clock.local_time("2024-01-20")
    return views.alarms_in_range(t.alarms, begin, end).select("alarm_id")


# Joins

@query("users_with_system", "SELECT user_id AS id, station_id, system_id FROM users")
def _(t):
    return readings.users_with_system(readings.mapped_users(t.profiles), t.systems).select("id", "station_id", "system_id")


@query("users_in_csv", "SELECT id FROM profiles WHERE station_id IN (SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_quantity > 25)")
def _(t):
    wanted = t.table("lineitem").filter("l_quantity > 25").select(C("l_suppkey").cast("string").alias("station_id"))
    return readings.users_in_csv(readings.mapped_users(t.profiles), wanted).select("id")


@query("leads_in_stages", "SELECT l.id FROM leads l WHERE l.stage_id IN (SELECT id FROM stages WHERE (name ILIKE '%installed%' OR name ILIKE '%permitting%') AND NOT contains(name, 'DEPRECATED'))")
def _(t):
    return matching.leads_in_stages(t.leads, matching.installed_stages(t.stages)).select("id")


@query("classify_intervals", "SELECT user_id, epoch, action FROM ivc")
def _(t):
    return readings.classify_intervals(incoming_intervals(t), t.stored_intervals).select("user_id", "epoch", "action")


@query("late_interval_rule", "SELECT user_id, epoch, production_kwh, action FROM ivc WHERE action <> 'skip'")
def _(t):
    return readings.late_interval_rule(incoming_intervals(t), t.stored_intervals).select("user_id", "epoch", "production_kwh", "action")


@query("matches_with_contact", "SELECT ord, lead_id, station_id, email FROM report")
def _(t):
    return people.matches_with_contact(t.report, t.leads).select("ord", "lead_id", "station_id", "email")


def referral_outcomes(t: Tables) -> DataFrame:
    targets = people.referral_targets(people.leads_with_code(t.coded_leads), t.profiles, t.auth_users)
    return people.referral_outcomes(targets, t.profiles)


@query("referral_targets", "SELECT lead_id, code, profile_id FROM targets")
def _(t):
    return people.referral_targets(people.leads_with_code(t.coded_leads), t.profiles, t.auth_users).select("lead_id", "code", "profile_id")


@query("resolve_station", "SELECT a.id, coalesce(a.meta, p.station_id) AS station_id FROM auth a LEFT JOIN profiles p ON p.id = a.id")
def _(t):
    return live.resolve_station(t.auth_users, t.profiles, schemas.LONG_STATION_FIELD).select("id", "station_id")


def provisioned(t: Tables) -> DataFrame:
    return people.dedup_email_first(people.matches_with_contact(t.report, t.leads))


@query("existing_profile_by_email", """SELECT coalesce(a.id, md5(p.email)) AS id, coalesce(p.crm_contact, p.crm_partner, p.station_name) AS full_name, p.phone, p.address, p.station_id,
 CASE WHEN a.id IS NULL THEN 'created' ELSE 'existing' END AS outcome FROM prov p LEFT JOIN auth a ON a.email = p.email WHERE p.outcome = 'provision'""")
def _(t):
    return people.existing_profile_by_email(people.provision_list(provisioned(t)), t.auth_users)


# Aggregates

TOTALS = f"""{rnd(kwh(xsum('power')), 4)} AS production_kwh, {rnd(kwh(xsum('load_w')), 4)} AS consumption_kwh,
 {rnd(kwh(xsum('abs(least(net, 0))')), 4)} AS grid_import_kwh, {rnd(kwh(xsum('greatest(net, 0)')), 4)} AS grid_export_kwh"""


@query("today_totals", f"SELECT station_id, day, {TOTALS} FROM ({LIVE}) GROUP BY 1, 2")
def _(t):
    return live.today_totals(live_points(t))


BUCKETS = f"""SELECT station_id, day, CAST(slot AS BIGINT) AS slot, CAST(slot + 2 AS BIGINT) AS hour, {rnd(kwh(xsum('power')), 4)} AS production_kwh, {rnd(kwh(xsum('load_w')), 4)} AS consumption_kwh
 FROM (SELECT *, least(5 + (({HOUR} - 5) // 2) * 2, 21) AS slot FROM ({LIVE}) WHERE {OPEN}) GROUP BY station_id, day, slot"""


def buckets(t: Tables) -> DataFrame:
    rows = live.two_hour_buckets(live_points(t), AS_OF)
    return rows.withColumn("slot", C("slot").cast("bigint")).withColumn("hour", C("hour").cast("bigint"))


query("two_hour_buckets", BUCKETS)(buckets)
query("buckets_in_order", f"SELECT * FROM ({BUCKETS}) ORDER BY station_id, day, slot")(lambda t: live.buckets_in_order(buckets(t)))


@query("fleet_summary", f"""SELECT count(*) AS stations, count(*) FILTER (state = 1) AS online, {rnd(xsum('coalesce(capacity, 0)'), 1)} AS capacity_kwp, {rnd(xsum('power'), 1)} AS power_kw,
 {rnd(xsum('day_energy'), 1)} AS day_kwh, {rnd(xsum('all_energy') + ' / 1000', 2)} AS all_mwh FROM stations""")
def _(t):
    return views.fleet_summary(t.stations)


@query("lifetime_earning", "SELECT station_id, lifetime_earning FROM earning")
def _(t):
    return readings.lifetime_earning(t.totals)


@query("oldest_reading_date", """SELECT p.id, CAST(coalesce(min(s.d), DATE '2001-08-15') AS VARCHAR) AS oldest_date FROM profiles p
 LEFT JOIN stored_days s ON s.user_id = p.id WHERE p.station_id IS NOT NULL GROUP BY 1""")
def _(t):
    rows = readings.oldest_reading_date(readings.mapped_users(t.profiles), t.stored_days, DAYS_AS_OF)
    return rows.select("id", C("oldest_date").cast("string").alias("oldest_date"))


@query("sync_report", """SELECT user_id, count(*) AS parsed, count(*) FILTER (action = 'insert') AS inserts, count(*) FILTER (action = 'update') AS updates,
 count(*) FILTER (action = 'skip') AS skipped FROM ivc GROUP BY 1""")
def _(t):
    return merge.sync_report(readings.classify_intervals(incoming_intervals(t), t.stored_intervals))


@query("latest_interval_key", "SELECT user_id, max(epoch) AS latest_epoch FROM ivd GROUP BY 1")
def _(t):
    return readings.latest_interval_key(incoming_intervals(t))


@query("distinct_keys", """SELECT DISTINCT 'stage' AS kind, CAST(stage_id AS VARCHAR) AS key FROM leads UNION ALL SELECT DISTINCT 'listed', CAST(l_suppkey AS VARCHAR) FROM lineitem
 UNION ALL SELECT DISTINCT 'matched', station_id FROM report""")
def _(t):
    listed = t.table("lineitem").select(F.concat(F.lit(" "), C("l_suppkey").cast("string")).alias("station_id"))
    return views.distinct_keys(t.leads, listed, t.report)


@query("provision_summary", "SELECT outcome, count(*) AS n FROM prov GROUP BY 1")
def _(t):
    return people.provision_summary(provisioned(t))


@query("referral_summary", "SELECT outcome, count(*) AS n FROM ref_outcomes GROUP BY 1")
def _(t):
    return people.referral_summary(referral_outcomes(t))


# Ranking

@query("dedup_email_first", "SELECT ord, outcome FROM prov")
def _(t):
    return provisioned(t).select("ord", "outcome")


@query("provision_list", f"SELECT ord, email, coalesce(crm_contact, crm_partner, station_name) AS full_name, phone, address, station_id, station_name, lead_id FROM prov WHERE outcome = 'provision'")
def _(t):
    return people.provision_list(provisioned(t))


@query("last_by_key", "SELECT lower(full_name) AS name_key, arg_max(id, ord) AS profile_id FROM profiles GROUP BY 1")
def _(t):
    return people.last_by_key(t.profiles)


@query("last_system", "SELECT user_id, system_id FROM last_system")
def _(t):
    return readings.last_system(t.systems)


@query("latest_point", f"""SELECT station_id, day, CASE WHEN soc IS NOT NULL THEN {LEVEL} END AS battery_level, CASE WHEN soc IS NOT NULL THEN {STATUS} END AS battery_status
 FROM ({LIVE} QUALIFY row_number() OVER (PARTITION BY station_id, day ORDER BY pos DESC) = 1)""")
def _(t):
    return live.latest_point(live_points(t))


SERIES = f"SELECT station_id, day, pos, {rnd('v * 39 / 1000', 3)} AS value0, {rnd('CASE kind WHEN ' + chr(39) + 'error' + chr(39) + ' THEN v * 39 WHEN ' + chr(39) + 'view' + chr(39) + ' THEN v * 41 WHEN ' + chr(39) + 'signup' + chr(39) + ' THEN v * 39 ELSE v * 40 END / 1000', 3)} AS value, time_str FROM pt"


@query("day_series", f"SELECT station_id, day, pos, value FROM ({SERIES})")
def _(t):
    return views.day_series(t.points).select("station_id", "day", "pos", "value")


def trim_sql(series: str) -> str:
    return f"""SELECT station_id, day, pos, value FROM (SELECT *, lag(f, 1) OVER w AS f0, min(pos) OVER s AS start, min(CASE WHEN value > 0 THEN pos END) OVER s AS first,
 max(CASE WHEN value > 0 THEN pos END) OVER s AS last, lead(pos) OVER w AS next_pos, lag(pos) OVER w AS prev_pos
 FROM (SELECT station_id, day, pos, value, 0 AS f FROM ({series}))
 WINDOW s AS (PARTITION BY station_id, day), w AS (PARTITION BY station_id, day ORDER BY pos))
 WHERE first IS NULL OR first = start OR (coalesce(next_pos, pos) >= first AND coalesce(prev_pos, pos) <= last)"""


# Values below the mean are taken as zero, so that series have flat ends.
TRIM = trim_sql("SELECT station_id, day, pos, CASE WHEN v > 20 THEN v ELSE CAST(0 AS DOUBLE) END AS value FROM pt")


@query("trim_series", TRIM)
def _(t):
    value = F.when(C("pac").cast("double") / 39 > 20, C("value")).otherwise(F.lit(0.0))
    events = t.table("events").select(C("event_id").alias("pos"), "value")
    rows = t.points.select("station_id", "day", "pos").join(events, "pos")
    rows = rows.withColumn("value", F.when(C("value") > 20, C("value")).otherwise(F.lit(0.0)))
    return views.trim_series(rows, ["station_id", "day"])


@query("referral_final_code", "SELECT profile_id, arg_max(code, ord) AS referral_code FROM ref_outcomes WHERE outcome = 'updated' GROUP BY 1")
def _(t):
    return people.referral_final_code(referral_outcomes(t))


@query("first_inverter", "SELECT station_id, inverter_id FROM first_inv")
def _(t):
    return readings.first_inverter(t.inverter_list)


@query("station_battery", "SELECT f.station_id, i.capacity AS battery_capacity_kwh FROM first_inv f JOIN inv i USING (inverter_id)")
def _(t):
    return readings.station_battery(t.inverter_list, t.inverters)


# Order and paging

@query("intervals_in_order", "SELECT user_id, epoch, production_kwh FROM ivd ORDER BY user_id, epoch")
def _(t):
    return readings.intervals_in_order(incoming_intervals(t)).select("user_id", "epoch", "production_kwh")


@query("oldest_row", "SELECT user_id, min(epoch) AS epoch, arg_min(production_kwh, epoch) AS production_kwh FROM stored_days GROUP BY 1")
def _(t):
    return with_epoch(readings.oldest_row(t.stored_days), "user_id", "production_kwh")


@query("station_page", "SELECT ord, id FROM stations ORDER BY ord LIMIT 20 OFFSET 20")
def _(t):
    return views.station_page(t.stations, 2).select("ord", "id")


@query("page_count", "SELECT CAST(greatest(ceil(count(*) / 20), 1) AS BIGINT) AS pages FROM stations")
def _(t):
    return views.page_count(t.stations)


@query("sample_rows_per_user", """SELECT user_id, epoch, n AS sample_no, greatest(total - 3, 0) AS left_out FROM (SELECT user_id, epoch, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS n,
 count(*) OVER (PARTITION BY user_id) AS total FROM stored_days) WHERE n <= 3""")
def _(t):
    rows = keep.sample_per_key(t.stored_days, ["user_id"], 3, C("timestamp"))
    return with_epoch(rows, "user_id", C("sample_no").cast("bigint").alias("sample_no"), C("left_out").cast("bigint").alias("left_out"))


# Dashboard

@query("station_cards", f"""SELECT id, coalesce(nullif(station_name, ''), sno) AS name, {STATE} AS status, {rnd('coalesce(capacity, 0)', 1)} AS capacity_kwp,
 {rnd('power', 2)} AS power_kw, {rnd('day_energy', 1)} AS day_kwh, {rnd('all_energy', 1)} AS all_kwh FROM stations""")
def _(t):
    return views.station_cards(t.stations).drop("ord", "serial")


@query("station_info", "SELECT id, coalesce(nullif(station_name, ''), sno) AS name, city || CASE WHEN region = '' THEN '' ELSE ', ' || region END || ', ' || country AS location, coalesce(weather, '-') AS weather FROM details")
def _(t):
    return views.station_info(t.details).drop("income")


@query("month_series", "SELECT o1, o2, o3, o4, o5, CASE WHEN date_str = '' THEN '' ELSE strftime(d, '%b') || ' ' || day(d) END AS label, q AS value FROM dy")
def _(t):
    return views.month_series(t.days).select(*order_keys(), "label", "value")


# Matching

@query("union_stage_hits", "SELECT DISTINCT id, name FROM stages WHERE name ILIKE '%installed%' OR name ILIKE '%project closed%' OR name ILIKE '%permitting%'")
def _(t):
    return matching.union_stage_hits(t.stages).select("id", "name")


def route(t: Tables) -> DataFrame:
    return materialize(matching.route_matches(t.leads, t.stations, matching.best_match(t.leads, t.stations)), "routed")


@query("match_candidates", """SELECT ln AS lname, coalesce(c, '') AS city_key, max(score) AS score, arg_min(st, -score * 1000000 + st) AS ord FROM
 (SELECT p.ln, l.c, p.st, p.score FROM pair_score p JOIN lead_name l ON l.id = p.id AND l.ord = p.name_ord) WHERE score > 0 GROUP BY 1, 2""")
def _(t):
    return matching.name_candidates(matching.lead_names(t.leads), matching.station_names(t.stations)).drop("is_equal")


LONG_NAME = """p_name || ' ' || p_type || ' brand ' || split_part(p_brand, '#', 2) || ' size ' || p_size || ' lot ' || p_partkey % 97 || ' row ' || p_partkey % {n}
 || ' house ' || split_part(p_name, ' ', 1) || p_size % 3 || ' roof'"""


@query("match_long_names", f"""WITH a AS (SELECT DISTINCT {norm(LONG_NAME.format(n=13))} AS n FROM part),
 b AS (SELECT min(p_partkey) AS ord, {norm(LONG_NAME.format(n=11))} || ' plant' AS n FROM part WHERE p_partkey % 7 = 0 GROUP BY 2),
 s AS (SELECT a.n AS lname, ord, CASE WHEN a.n = b.n THEN CAST(1 AS DOUBLE) WHEN contains(b.n, a.n) OR contains(a.n, b.n) THEN CAST(0.85 AS DOUBLE)
 ELSE len(list_intersect(list_distinct(string_split(a.n, ' ')), list_distinct(string_split(b.n, ' '))))
 / least(len(list_distinct(string_split(a.n, ' '))), len(list_distinct(string_split(b.n, ' ')))) END AS score FROM a, b)
 SELECT lname, score, ord FROM s QUALIFY row_number() OVER (PARTITION BY lname ORDER BY score DESC, ord) = 1""")
def _(t):
    # Names of eleven words and more; every other name shares most of them.
    part = t.table("part")

    def name(rows: DataFrame, n: int):
        return normalize_name(F.concat_ws(
            " ", "p_name", "p_type", F.lit("brand"), F.split("p_brand", "#")[1], F.lit("size"), "p_size", F.lit("lot"), C("p_partkey") % 97,
            F.lit("row"), C("p_partkey") % n, F.lit("house"), F.concat(F.split("p_name", " ")[0], C("p_size") % 3), F.lit("roof")))

    leads = part.select(name(part, 13).alias("lname"), F.lit("").alias("city_key"))
    stations = part.filter("p_partkey % 7 = 0").select(F.concat(name(part, 11), F.lit(" plant")).alias("sname"), C("p_partkey").alias("ord"))
    found = matching.name_candidates(leads, stations.groupBy("sname").agg(F.min("ord").alias("ord")))
    return found.select("lname", "score", "ord")


@query("best_match", "SELECT id AS lead_id, score, st AS station_ord, raw AS matched_on FROM best")
def _(t):
    return matching.best_match(t.leads, t.stations)


ROUTED = ("lead_id", "match_type", "match_score", "station_id", "station_name", "station_sn", "station_status", "matched_on", "city", "stage")


@query("route_matches", f"SELECT {', '.join(ROUTED)} FROM routed")
def _(t):
    return route(t).select(*ROUTED)


@query("all_matches", "SELECT lead_id, station_id FROM routed WHERE match_type <> 'unmatched'")
def _(t):
    return matching.all_matches(route(t)).select("lead_id", "station_id")


@query("matches_by_score", "SELECT lead_id, match_score FROM routed ORDER BY match_score DESC, lead_id")
def _(t):
    return matching.matches_by_score(route(t)).select("lead_id", "match_score")


@query("unmatched_leads", "SELECT lead_id, match_score FROM routed WHERE match_type = 'unmatched'")
def _(t):
    return matching.unmatched_leads(route(t)).select("lead_id", "match_score")


@query("unmatched_stations", f"SELECT id AS station_id, sno AS station_sn, {STATE} AS status FROM stations WHERE id NOT IN (SELECT station_id FROM routed WHERE station_id IS NOT NULL)")
def _(t):
    return matching.unmatched_stations(t.stations, route(t)).select("station_id", "station_sn", "status")


def summary_sql(routed: str) -> str:
    def pct(part: str, whole: str) -> str:
        return rnd(f"{part} / CAST(greatest({whole}, 1) AS DOUBLE) * 100", 2)

    return f"""SELECT *, {pct('exact_matches', 'leads')} AS exact_pct, {pct('partial_matches', 'leads')} AS partial_pct, {pct('unmatched_leads', 'leads')} AS unmatched_pct,
 {pct('unmatched_stations', 'stations')} AS unmatched_stations_pct, {pct('(exact_matches + partial_matches)', 'leads')} AS coverage_pct FROM (
 SELECT count(*) AS leads, count(*) FILTER (match_type IN ('exact', 'high')) AS exact_matches, count(*) FILTER (match_type = 'partial') AS partial_matches,
 count(*) FILTER (match_type = 'unmatched') AS unmatched_leads, (SELECT count(*) FROM stations) AS stations,
 (SELECT count(*) FROM stations WHERE id NOT IN (SELECT station_id FROM {routed} WHERE station_id IS NOT NULL)) AS unmatched_stations FROM {routed})"""


@query("match_summary", summary_sql("routed"))
def _(t):
    return matching.match_summary(route(t), t.stations)
