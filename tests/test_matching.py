"""Matching against a plain nested loop on small random names."""

import random
import re

import pytest

from heliospan.operators import matching as m

LEADS = "id BIGINT, partner_name STRING, contact_name STRING, name STRING, city STRING, x_studio_city_municipality STRING, ord BIGINT"
STATIONS = "id STRING, stationName STRING, sno STRING, state INT, capacity STRING, ord BIGINT"


def norm(text):
    return " ".join(re.sub(r"[^\w\s]", " ", text.lower()).split())


def pair_score(lead, station, city):
    a, b = norm(lead), norm(station)
    if a == b:
        return 1.0
    if a in b or b in a:
        score = 0.85
    else:
        x, y = set(a.split()), set(b.split())
        score = len(x & y) / min(len(x), len(y))
    return min(1.0, score + 0.15) if city and city in b else score


def nested_loop(leads, stations):
    """Maximum score, earliest station, equal name, field order."""
    out = {}
    for lead in leads:
        names = [n.strip() for n in lead[1:4] if n and norm(n)]
        city = norm((lead[4] or lead[5] or "").strip())
        best = None
        for station in stations:
            sname = station[1] or station[2]
            if not sname or not norm(sname):
                continue
            for i, name in enumerate(names):
                score = pair_score(name, sname, city)
                rank = (score, -station[5], norm(name) == norm(sname), -i)
                if score > 0 and (best is None or rank > best[0]):
                    best = (rank, name)
        if best:
            out[lead[0]] = (round(best[0][0], 9), -best[0][1], best[1])
    return out


def random_name(rng, words, low, high):
    return " ".join(rng.choice(words) for _ in range(rng.randint(low, high)))


def make(rng, n_leads, n_stations, words, low, high):
    cities = ["manila", "cebu", "a", "an", "ana cruz", None, ""]

    def maybe(text):
        return rng.choice([text, text, text.upper() + ".", None, ""])

    leads = [
        (i, maybe(random_name(rng, words, low, high)), maybe(random_name(rng, words, low, high)),
         random_name(rng, words, low, high), rng.choice(cities), rng.choice(cities), i)
        for i in range(n_leads)
    ]
    stations = [
        (f"s{i}", maybe(random_name(rng, words, low, high)), random_name(rng, words, low, high), i % 5, "5", i)
        for i in range(n_stations)
    ]
    return leads, stations


SHORT = ["juan", "cruz", "ana", "joana", "dela", "house", "a", "an", "manila", "cebu", "residence", "Peña", "bo", "boston"]


@pytest.mark.parametrize("seed,low,high", [(1, 1, 2), (2, 1, 4), (3, 2, 5), (4, 6, 9), (5, 8, 12), (6, 1, 15), (7, 12, 18)])
def test_same_as_nested_loop(spark, seed, low, high):
    rng = random.Random(seed)
    words = SHORT if seed < 4 else SHORT + [f"w{i}" for i in range(4 if seed < 6 else 20)]
    leads, stations = make(rng, 120, 90, words, low, high)
    got = m.best_match(spark.createDataFrame(leads, LEADS), spark.createDataFrame(stations, STATIONS))
    rows = {r.lead_id: (round(r.score, 9), r.station_ord, r.matched_on) for r in got.collect()}
    assert rows == nested_loop(leads, stations)


def match(spark, leads, stations):
    leads = [(i, n, None, "", c, None, i) for i, (n, c) in enumerate(leads)]
    stations = [(f"s{i}", n, "", 1, "5", i) for i, n in enumerate(stations)]
    lead_rows = spark.createDataFrame(leads, LEADS)
    best = m.best_match(lead_rows, spark.createDataFrame(stations, STATIONS))
    return {r.lead_id: (round(r.score, 3), r.station_ord) for r in best.collect()}


def test_worked_pairs(spark):
    got = match(
        spark,
        [("Juan Cruz", None), ("Juan Cruz", "residence"), ("Cruz Juan", None), ("Anna", None), ("Bo", None), ("Zed", None)],
        ["Juan Cruz Residence", "Juan Cruz Residence.", "Joanna", "Boston"],
    )
    assert got == {0: (0.85, 0), 1: (1.0, 0), 2: (1.0, 0), 3: (0.85, 2), 4: (0.85, 3)}


def test_contained_station_does_not_hide_a_later_full_overlap(spark):
    contained = [f"Juan Cruz {i}" for i in range(20)]
    got = match(spark, [("Juan Cruz", None)], contained + ["Cruz and Juan", "Juan of Cruz"])
    assert got == {0: (1.0, 20)}


def test_routes(spark):
    rows = spark.createDataFrame([(1.0,), (0.8,), (0.7999,), (0.3,), (0.2999,)], "score DOUBLE")
    kinds = [r[0] for r in rows.select(m.match_type(rows.score)).collect()]
    assert kinds == ["exact", "high", "partial", "partial", "unmatched"]


def test_installed_stages(spark):
    rows = [(1, "Installed", False), (2, "Installed DEPRECATED", False), (3, "permitting - X", False), (4, "Won", True)]
    schema = "id BIGINT, name STRING, is_won BOOLEAN"
    hit = m.installed_stages(spark.createDataFrame(rows, schema))
    assert sorted(r.id for r in hit.collect()) == [1, 3]
    assert sorted(r.id for r in m.installed_stages(spark.createDataFrame([rows[1], rows[3]], schema)).collect()) == [4]
    assert sorted(r.id for r in m.union_stage_hits(spark.createDataFrame(rows, schema)).collect()) == [1, 2, 3]


def test_no_pair_explosion_in_plan(spark):
    rng = random.Random(9)
    leads, stations = make(rng, 5, 5, SHORT, 1, 3)
    plan = m.best_match(spark.createDataFrame(leads, LEADS), spark.createDataFrame(stations, STATIONS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_steps_past_contained_stations_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(m, "ORDINAL_RANGE", 7)
    rng = random.Random(11)
    leads, stations = make(rng, 120, 90, SHORT, 1, 4)
    got = m.best_match(spark.createDataFrame(leads, LEADS), spark.createDataFrame(stations, STATIONS))
    rows = {r.lead_id: (round(r.score, 9), r.station_ord, r.matched_on) for r in got.collect()}
    assert rows == nested_loop(leads, stations)


def long_names(rng, n):
    """Twelve words each: ten from a family of names, of which each name changes some, and two of its own."""
    families = [[f"f{i}x{j}" for j in range(10)] for i in range(max(n // 8, 1))]
    out = []
    for i in range(n):
        words = list(rng.choice(families))
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(10)] = f"r{rng.randrange(10 * n)}"
        out.append(" ".join(words + [f"own{rng.randrange(10 * n)}", "house"]))
    return out


def test_candidates_of_long_names_grow_with_the_names(spark, monkeypatch):
    counts = []
    compare = m._prefix_pairs

    def counted(*args):
        rows = compare(*args)
        counts.append(rows.count())
        return rows

    monkeypatch.setattr(m, "_prefix_pairs", counted)
    for n in (200, 400):
        rng = random.Random(n)
        leads = [(i, x, None, None, None, None, i) for i, x in enumerate(long_names(rng, n))]
        stations = [(f"s{i}", x, "", 1, "5", i) for i, x in enumerate(long_names(random.Random(n + 1), n))]
        got = m.best_match(spark.createDataFrame(leads, LEADS), spark.createDataFrame(stations, STATIONS))
        rows = {r.lead_id: (round(r.score, 9), r.station_ord, r.matched_on) for r in got.collect()}
        assert rows == nested_loop(leads, stations)
    assert 0 < counts[1] < 3 * counts[0] and counts[1] < 0.1 * 400 * 400
