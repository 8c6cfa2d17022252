"""SQL side of the stand-ins: common table expressions for the check engine."""

from __future__ import annotations

import re


def rnd(x: str, n: int) -> str:
    p = f"CAST({10**n} AS DOUBLE)"
    return f"(CASE WHEN ({x}) < 0 THEN CAST(0 AS DOUBLE) - floor(abs({x}) * {p} + 0.5) / {p} ELSE floor(abs({x}) * {p} + 0.5) / {p} END)"


def xsum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,9))) AS DOUBLE)"


def kwh(x: str) -> str:
    return f"(({x}) * (5 / 60) / CAST(1000 AS DOUBLE))"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def squash(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def crm(x: str) -> str:
    return f"nullif(nullif({x}, 'False'), '')"


def email(x: str) -> str:
    return f"nullif(nullif(lower(trim({x})), ''), 'false')"


LOAD = "(CASE WHEN fam + byp <= 0 THEN fam ELSE fam + byp END)"
STATUS = "(CASE WHEN bat > 0 THEN 'charging' WHEN bat < 0 THEN 'discharging' WHEN soc IS NOT NULL THEN 'idle' END)"
SOC_NUMBER = "(CASE WHEN soc = 'x' THEN CAST(0 AS DOUBLE) ELSE CAST(nullif(soc, '') AS DOUBLE) END)"
LEVEL = rnd(SOC_NUMBER, 1)
HOUR = "CAST(((ms // 1000 + 28800) % 86400) // 3600 AS BIGINT)"
STATE = "CASE WHEN state = 1 THEN 'Online' WHEN state = 3 THEN 'Alarm' ELSE 'Offline' END"
CAPACITY = """CASE WHEN a NOT IN ('', '0', 'x') THEN CAST(a AS DOUBLE) WHEN b NOT IN ('', '0') THEN CAST(b AS DOUBLE)
 WHEN c NOT IN ('', '0') THEN CAST(c AS DOUBLE) WHEN ah * volt / 1000 > 0 THEN ah * volt / 1000 END"""

CTES = {
    "pt": """SELECT CAST(user_id AS VARCHAR) AS station_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, event_id AS pos,
 CASE WHEN event_type = 'signup' AND value > 40 THEN NULL ELSE (epoch_ms(ts) // 300000) * 300000 END AS ms,
 strftime(ts + INTERVAL 8 HOUR, '%H:%M:%S') AS time_str, event_type AS kind, value AS v,
 CASE WHEN event_type IN ('error', 'signup') THEN CAST(0 AS DOUBLE) ELSE value * 40 END AS power,
 value * 25 AS fam, CASE event_type WHEN 'purchase' THEN value * 5 WHEN 'view' THEN value * -26 ELSE CAST(0 AS DOUBLE) END AS byp,
 (value - 20) * 30 AS net, CASE event_type WHEN 'click' THEN value WHEN 'view' THEN -value ELSE CAST(0 AS DOUBLE) END AS bat,
 CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'signup' THEN NULL WHEN regexp_extract(props, '([0-9]+)', 1) = '13' THEN 'x'
 ELSE regexp_extract(props, '([0-9]+)', 1) END AS soc FROM events""",
    "dy": """SELECT CAST(l_suppkey AS VARCHAR) AS station_id, strftime(l_shipdate + to_days(l_linenumber), '%Y-%m') AS month,
 CASE WHEN l_returnflag = 'N' AND l_tax = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date_str,
 CAST(l_shipdate AS DATE) AS d, l_quantity AS q,
 CASE WHEN l_linestatus = 'F' THEN l_quantity * 0.5 ELSE CAST(0 AS DOUBLE) END AS home_grid,
 CASE WHEN l_returnflag = 'A' THEN l_quantity * 0.25 ELSE CAST(0 AS DOUBLE) END AS back_up,
 CASE WHEN l_returnflag = 'N' THEN l_quantity * 0.75 ELSE CAST(0 AS DOUBLE) END AS home_load,
 l_quantity * 0.9 AS consume, l_tax * 10 AS buy, l_discount * 100 AS sell,
 CASE WHEN l_returnflag = 'R' AND l_tax = 0.08 THEN NULL ELSE l_extendedprice / 1000 END AS money,
 l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_quantity AS o4, l_extendedprice AS o5 FROM lineitem""",
    "dr": f"""SELECT dy.*, (d - DATE '1970-01-01') * 86400 + 14400 AS epoch, {rnd('q', 4)} AS production_kwh,
 {rnd('CASE WHEN home_grid + back_up > 0 THEN home_grid + back_up WHEN home_load > 0 THEN home_load ELSE consume END', 4)} AS consumption_kwh,
 {rnd('buy', 4)} AS grid_import_kwh, {rnd('sell', 4)} AS grid_export_kwh, {rnd('money', 2)} AS daily_earning
 FROM dy WHERE date_str <> '' AND money IS NOT NULL""",
    "profiles": """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS full_name, c_mktsegment AS phone,
 CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN CAST(c_custkey AS VARCHAR) END AS station_id,
 'RC' || c_nationkey AS referral_code, c_custkey AS ord FROM customer""",
    "auth": """SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS id,
 'u' || c_custkey || '@mail.test' AS email,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'M' || c_custkey END AS meta, c_custkey AS ord FROM customer""",
    "systems": """SELECT 'S' || o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS user_id, 'Array ' || o_orderkey AS system_name,
 o_totalprice / 10000 AS capacity_kwp, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice / 100000 END AS battery_capacity_kwh,
 CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS installation_date, '-' AS address,
 CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'retired' END AS status, o_orderkey AS ord FROM orders""",
    "last_system": "SELECT user_id, arg_max(id, ord) AS system_id FROM systems WHERE status = 'active' GROUP BY user_id",
    "last_date": "SELECT user_id, arg_max(installation_date, ord) AS installation_date FROM systems WHERE installation_date IS NOT NULL GROUP BY user_id",
    "stored_days": """SELECT CAST(o_custkey AS VARCHAR) AS user_id, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') * 86400
 + CASE o_orderstatus WHEN 'F' THEN 43200 WHEN 'O' THEN 28800 ELSE 86399 END - 28800 AS epoch, CAST(o_orderdate AS DATE) AS d,
 'S' || max(o_orderkey) AS system_id, max(o_totalprice / 1000) AS production_kwh, min(o_totalprice / 2000) AS consumption_kwh,
 CAST(50 AS DOUBLE) AS battery_level, 'idle' AS battery_status, max(o_totalprice / 4000) AS grid_import_kwh,
 min(o_totalprice / 8000) AS grid_export_kwh, max(o_totalprice / 500) AS daily_earning, CAST(1 AS DOUBLE) AS battery_charge_kwh,
 CAST(2 AS DOUBLE) AS battery_discharge_kwh, max(o_orderkey) AS batch_no FROM orders GROUP BY 1, 2, 3""",
    "stations": """SELECT s_suppkey AS ord, CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN p_size <= 12 THEN upper(p_name) || '.'
 WHEN p_size <= 25 THEN p_name || ' ' || p_type WHEN p_size <= 37 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ' house'
 ELSE '' END AS station_name, s_name AS sno, CASE WHEN s_nationkey < 10 THEN 1 WHEN s_nationkey < 18 THEN 3 WHEN s_nationkey < 24 THEN 2 END AS state,
 CASE WHEN p_size > 3 THEN p_size * CAST(0.5 AS DOUBLE) END AS capacity, s_acctbal AS power, p_size * CAST(1.5 AS DOUBLE) AS day_energy,
 p_retailprice AS all_energy FROM supplier JOIN part ON s_suppkey = p_partkey""",
    "stages": """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE n_regionkey WHEN 0 THEN 'INSTALLED ' || n_name WHEN 1 THEN 'permitting - ' || n_name
 WHEN 2 THEN 'Project Closed DEPRECATED ' || n_name ELSE n_name END AS name, n_regionkey = 4 AS is_won FROM nation""",
    "leads": """SELECT p_partkey AS id, p_brand AS name, CASE WHEN p_size > 5 THEN p_name END AS partner_name,
 CASE WHEN p_size > 25 THEN p_type || ' ' || p_name END AS contact_name, CASE WHEN p_size <= 10 THEN 'False' WHEN p_size <= 14 THEN ' False'
 WHEN p_size <= 45 THEN ' U' || p_partkey || '@Mail.test ' ELSE '' END AS email_from, CASE WHEN p_size <= 20 THEN 'False' ELSE '+63' || p_partkey END AS phone,
 CASE WHEN p_size <= 30 THEN lower(p_type) WHEN p_size <= 35 THEN 'Hot!' WHEN p_size <= 45 THEN 'ring' ELSE '' END AS city,
 CASE WHEN p_size <= 25 THEN 'False' ELSE p_type END AS address, CASE WHEN p_size <= 8 THEN ' ' WHEN p_size <= 40 THEN ' RC' || (p_size // 2) END AS code0,
 p_size // 2 AS stage_id, 'stage ' || (p_size // 2) AS stage FROM part""",
    "coded": """SELECT p_partkey AS id, p_partkey AS ord, lower(trim(CASE WHEN p_size <= 10 THEN 'False' WHEN p_size <= 14 THEN ' False'
 WHEN p_size <= 45 THEN ' U' || p_partkey || '@Mail.test ' ELSE '' END)) AS email,
 CASE WHEN p_size > 30 THEN 'customer#' || lpad(CAST(p_partkey // 2 AS VARCHAR), 9, '0') END AS contact,
 'customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS partner, 'RC' || (p_size // 2) AS code FROM part WHERE p_size > 8 AND p_size <= 40""",
    "targets": f"""SELECT c.id AS lead_id, c.ord, c.code, coalesce(pe.id, n1.id, n2.id) AS profile_id FROM coded c
 LEFT JOIN auth a ON a.email = c.email LEFT JOIN profiles pe ON pe.id = a.id
 LEFT JOIN (SELECT {squash('full_name')} AS k, arg_max(id, ord) AS id FROM profiles GROUP BY 1) n1 ON n1.k = c.contact
 LEFT JOIN (SELECT {squash('full_name')} AS k, arg_max(id, ord) AS id FROM profiles GROUP BY 1) n2 ON n2.k = c.partner""",
    "ref_outcomes": """SELECT t.*, p.referral_code AS old_code, CASE WHEN t.profile_id IS NULL THEN 'no_match'
 WHEN p.referral_code = t.code THEN 'already_set' ELSE 'updated' END AS outcome FROM targets t LEFT JOIN profiles p ON p.id = t.profile_id""",
    "report": f"""SELECT o_orderkey AS ord, o_custkey AS lead_id, CAST(o_orderkey AS VARCHAR) AS station_id, 'Station ' || o_orderkey AS station_name,
 o_orderpriority AS partner_name, {email('l.email_from')} AS email, {crm('l.partner_name')} AS crm_partner, {crm('l.contact_name')} AS crm_contact,
 {crm('l.phone')} AS phone, {crm('l.address')} AS address FROM orders LEFT JOIN leads l ON l.id = o_custkey""",
    "prov": """SELECT r.*, CASE WHEN email IS NULL THEN 'no_email' WHEN ord = min(ord) OVER (PARTITION BY email) THEN 'provision' ELSE 'duplicate' END AS outcome
 FROM report r""",
    "details": """SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_name END AS station_name, 'SN' || c_custkey AS sno,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(0 AS DOUBLE) ELSE c_acctbal / 100 END AS capacity, c_acctbal * 10 AS power, c_acctbal / 7 AS month_energy,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'MWh' WHEN 'FURNITURE' THEN ' GWh ' WHEN 'HOUSEHOLD' THEN 'mwh' END AS month_unit, c_acctbal AS all_energy,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'GWh' ELSE 'kWh' END AS all_unit, floor(c_acctbal) AS income,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'K PHP' WHEN 'FURNITURE' THEN 'MYR' WHEN 'HOUSEHOLD' THEN ' m usd' END AS income_unit,
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Rain' END AS weather, c_mktsegment AS city, CASE WHEN c_nationkey < 12 THEN '' ELSE 'R' END AS region,
 CAST(c_nationkey AS VARCHAR) AS country FROM customer""",
    "inv": f"""SELECT 'I' || p_partkey AS inverter_id, {rnd(CAPACITY, 2)} AS capacity FROM (SELECT p_partkey,
 CASE WHEN p_size <= 10 THEN '0' WHEN p_size <= 20 THEN '0.0' WHEN p_size <= 30 THEN 'x' END AS a,
 CASE WHEN p_size <= 5 THEN CAST(p_size * CAST(1.005 AS DOUBLE) AS VARCHAR) WHEN p_size <= 8 THEN '' END AS b,
 CASE WHEN p_size > 20 AND p_size <= 25 THEN CAST(p_size * CAST(2.25 AS DOUBLE) AS VARCHAR) END AS c,
 CAST(CASE WHEN p_brand = 'Brand#1' THEN p_size * 5 ELSE p_size * 10 END AS DOUBLE) AS ah,
 CASE WHEN p_size > 12 THEN CAST(51.2 AS DOUBLE) WHEN p_size <= 40 THEN CAST(48 AS DOUBLE) END AS volt FROM part)""",
    "first_inv": """SELECT CAST(l_suppkey AS VARCHAR) AS station_id, 'I' || l_partkey AS inverter_id FROM lineitem
 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) = 1""",
    "earning": f"""SELECT CAST(o_custkey AS VARCHAR) AS station_id, {rnd(xsum("CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END"), 2)} AS lifetime_earning
 FROM orders GROUP BY 1""",
    "users": "SELECT p.id AS user_id, p.station_id, p.full_name, s.system_id FROM profiles p LEFT JOIN last_system s ON s.user_id = p.id WHERE p.station_id IS NOT NULL",
    "iv": f"""SELECT u.user_id, u.system_id, ms // 1000 AS epoch, pos, {rnd(kwh('power'), 6)} AS production_kwh, {rnd(kwh(LOAD), 6)} AS consumption_kwh,
 {LEVEL} AS battery_level, {STATUS} AS battery_status, {rnd(kwh('abs(least(net, 0))'), 6)} AS grid_import_kwh, {rnd(kwh('greatest(net, 0)'), 6)} AS grid_export_kwh,
 CAST(0 AS DOUBLE) AS daily_earning, coalesce(e.lifetime_earning, 0) AS lifetime_earning
 FROM pt JOIN users u USING (station_id) LEFT JOIN earning e USING (station_id) WHERE ms IS NOT NULL""",
    "ivd": "SELECT * FROM iv QUALIFY row_number() OVER (PARTITION BY user_id, epoch ORDER BY pos DESC) = 1",
    "stored_iv": f"""SELECT CAST(user_id AS VARCHAR) AS user_id, (epoch_ms(ts) // 300000) * 300 AS epoch, {xsum('value')} AS production_kwh, max(event_id) AS batch_no
 FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""",
    "ivc": """SELECT i.*, CASE WHEN s.user_id IS NULL THEN 'insert' WHEN i.epoch = max(i.epoch) OVER (PARTITION BY i.user_id) THEN 'update' ELSE 'skip' END AS action
 FROM ivd i LEFT JOIN stored_iv s ON s.user_id = i.user_id AND s.epoch = i.epoch""",
    "udr": "SELECT p.id AS user_id, dr.* FROM dr JOIN profiles p ON p.station_id = dr.station_id",
    "udl": "SELECT * FROM udr QUALIFY row_number() OVER (PARTITION BY user_id, epoch ORDER BY month DESC, o1 DESC, o2 DESC, o3 DESC, o4 DESC, o5 DESC) = 1",
    "day_target": """SELECT user_id, d, coalesce(min(CASE WHEN (epoch + 28800) % 86400 = 43200 THEN epoch END), min(epoch)) AS target FROM stored_days
 WHERE (epoch + 28800) % 86400 < 86399 GROUP BY 1, 2""",
    "udc": "SELECT u.*, t.target FROM udl u LEFT JOIN day_target t ON t.user_id = u.user_id AND t.d = u.d",
    "lead_name": f"""SELECT id, ord, raw, n, c FROM (SELECT id, x.o AS ord, trim(x.v) AS raw, {norm('x.v')} AS n, {norm('city')} AS c FROM
 (SELECT id, city, unnest([{{'o': 0, 'v': partner_name}}, {{'o': 1, 'v': contact_name}}, {{'o': 2, 'v': name}}]) AS x FROM leads)) WHERE n <> ''""",
    "st_name": f"SELECT ord, n FROM (SELECT ord, {norm("coalesce(nullif(station_name, ''), sno)")} AS n FROM stations) WHERE n <> ''",
    "pair_score": """SELECT l.id, l.ord AS name_ord, l.raw, l.n AS ln, s.n AS sn, s.ord AS st, CASE WHEN l.n = s.n THEN CAST(1 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE),
 CASE WHEN contains(s.n, l.n) OR contains(l.n, s.n) THEN CAST(0.85 AS DOUBLE) ELSE len(list_intersect(list_distinct(string_split(l.n, ' ')), list_distinct(string_split(s.n, ' '))))
 / least(len(list_distinct(string_split(l.n, ' '))), len(list_distinct(string_split(s.n, ' ')))) END
 + CASE WHEN l.c <> '' AND contains(s.n, l.c) THEN CAST(0.15 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) END AS score FROM lead_name l, st_name s""",
    "best": "SELECT id, score, st, raw FROM pair_score WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, st, (ln = sn) DESC, name_ord) = 1",
    "routed": f"""SELECT l.id AS lead_id, l.name AS lead_name, l.partner_name, l.contact_name, l.email_from AS email, l.phone, l.city, l.stage,
 coalesce(b.score, 0) AS score, CASE WHEN b.score >= 1 THEN 'exact' WHEN b.score >= 0.8 THEN 'high' WHEN b.score >= 0.3 THEN 'partial' ELSE 'unmatched' END AS match_type,
 {rnd('coalesce(b.score, 0)', 2)} AS match_score, s.id AS station_id, s.station_name, s.sno AS station_sn, s.capacity AS station_capacity_kw,
 CASE WHEN s.id IS NOT NULL THEN {STATE} END AS station_status, CASE WHEN b.score >= 0.3 THEN b.raw END AS matched_on
 FROM leads l LEFT JOIN best b ON b.id = l.id LEFT JOIN stations s ON s.ord = b.st AND b.score >= 0.3""",
}

ORDER = list(CTES)


def _used(sql: str) -> list[str]:
    names = set(re.findall(r"\b[a-z_]+\b", sql))
    return [n for n in ORDER if n in names]


def with_ctes(sql: str) -> str:
    """Prefix a query with the expressions it uses, in dependency order."""
    needed: set[str] = set()
    todo = _used(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _used(CTES[name]) if n != name]
    if not needed:
        return sql
    body = ",\n".join(f"{n} AS ({CTES[n]})" for n in ORDER if n in needed)
    return f"WITH {body}\n{sql}"
