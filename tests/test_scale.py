"""Large inputs: what a join moves, which task takes it, and what landing writes."""

import datetime as dt
import glob
from contextlib import contextmanager

from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.catalog import jobs, operators, sources  # noqa: F401
from heliospan.catalog.registry import runnable
from heliospan.functions import clock
from heliospan.operators import matching, people, readings
from heliospan.plans import pipelines
from heliospan.sources import landed
from test_matching import pair_score

DAY_FIELDS = ("energy", "homeGridEnergy", "backUpEnergy", "backup2Energy", "homeLoadEnergy", "consumeEnergy", "gridPurchasedEnergy",
              "gridSellEnergy", "money", "batteryChargeEnergy", "batteryDischargeEnergy")


@contextmanager
def settings(spark, **values):
    keys = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def optimized(rows) -> str:
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_matches_without_email_are_dealt_over_tasks(spark):
    rows = spark.range(400).select(F.col("id").alias("ord"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("u@"), (F.col("id") % 100).cast("string"))).alias("email"))
    with settings(spark, adaptive_enabled="false", autoBroadcastJoinThreshold="-1"):
        found = people.dedup_email_first(rows).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in found if r.email is None}) > 1
    assert sorted(r.ord for r in found if r.outcome == "provision") == [0, 50]
    assert sorted(r.outcome for r in found).count("no_email") == 392 and len(found) == 400


def profiles(spark):
    return spark.createDataFrame([("u", "s"), ("v", "s")], "id STRING, station_id STRING")


def systems(spark):
    schema = "id STRING, user_id STRING, installation_date DATE, status STRING, ord BIGINT"
    return spark.createDataFrame([("S1", "u", dt.date(2026, 2, 10), "active", 1)], schema)


def days(spark):
    rows = [("s", m, i, d, *["1"] * len(DAY_FIELDS)) for i, (m, d) in enumerate((
        ("2026-01", "2026-02-11"), ("2026-02", "2026-02-09"), ("2026-02", "2026-02-11"), ("2026-2", "2026-02-12"), ("2026-04", "2026-04-01"), ("2026-05", "2026-04-02")))]
    return spark.createDataFrame(rows, f"station_id STRING, month STRING, pos INT, dateStr STRING, {', '.join(f'{c} STRING' for c in DAY_FIELDS)}")


NOW = clock.local_time("2026-04-10 10:00")


def test_backfill_parses_payloads_before_they_are_joined(spark):
    stored = spark.createDataFrame([], schemas.DAILY_READING)
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        job = pipelines.history_backfill(profiles(spark), systems(spark), days(spark), stored, NOW)
        plan = optimized(job.changes)
    assert plan.index("Join") < plan.index("Generate inline") and plan.count("Generate explode") == 0
    found = sorted((r.user_id, r.pos) for r in job.changes.collect())
    # The default window of user v begins 90 days before; months outside the windows and odd ones stay out.
    assert found == [("u", 2), ("u", 4), ("v", 1), ("v", 2), ("v", 4)]


def test_needed_months_are_those_of_the_window(spark):
    users = spark.createDataFrame([("u", dt.date(2026, 2, 10)), ("v", dt.date(2026, 4, 10)), ("w", dt.date(2025, 11, 30))], "id STRING, start_date DATE")
    months = [f"{y}-{m:02d}" for y in (2025, 2026) for m in range(0, 14)] + ["2026-3", "", "x"]
    rows = users.crossJoin(spark.createDataFrame([(m,) for m in months], "month STRING"))
    listed = rows.join(readings.months_needed(users, NOW), ["id", "month"], "left_semi")
    pairs = lambda found: sorted((r.id, r.month) for r in found.collect())
    assert pairs(readings.needed_months(rows.filter("start_date < '2026-04-10'"), NOW)) == pairs(listed)


def test_window_query_parses_payloads_before_they_are_joined(spark, tmp_path):
    day = dt.datetime(2001, 8, 1)
    tables = {
        "customer": spark.createDataFrame([(1, "c", "BUILDING", 2)], "c_custkey BIGINT, c_name STRING, c_mktsegment STRING, c_nationkey INT"),
        "orders": spark.createDataFrame([(5, 1, 10.0, "O", dt.datetime(2001, 7, 1))],
                                        "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING, o_orderdate TIMESTAMP"),
        "lineitem": spark.createDataFrame(
            [(7, 3, 1, 1, 2.0, 20.0, 0.1, 0.01, "A", "F", day), (8, 3, 1, 1, 2.0, 20.0, 0.1, 0.01, "A", "F", day.replace(month=6))],
            "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
            "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP"),
    }
    for name, rows in tables.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        rows = runnable()["backfill_window"](spark, str(tmp_path))
        plan = optimized(rows)
    assert plan.index("Join") < plan.index("Generate inline")
    assert [(r.user_id, r.month, r.o1) for r in rows.collect()] == [("1", "2001-08", 7)]


def test_landed_lines_are_compressed(spark, tmp_path):
    path = str(tmp_path / "landed")
    lines = sources.land(days(spark), F.to_json(F.array(F.struct("dateStr", *DAY_FIELDS))), station_id=F.col("station_id"), month=F.col("month"))
    sources.write_landed(lines, path)
    assert glob.glob(f"{path}/part-*") == glob.glob(f"{path}/part-*.json.gz")
    assert sorted(r.dateStr for r in landed.read_month_days(spark, path).collect()) == sorted(r.dateStr for r in days(spark).collect())


def test_exploded_names_are_not_broadcast(spark):
    leads = spark.createDataFrame([("a b c d e", "")], "lname STRING, city_key STRING")
    stations = spark.createDataFrame([("a b c d x", 1), ("b c", 2)], "sname STRING, ord BIGINT")
    needles, texts = leads.selectExpr("lname AS needle"), stations.selectExpr("sname AS text")
    plan = matching.contained_names(needles, texts)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [needle" in plan
    words = spark.createDataFrame([("a b c d e", ["a", "b", "c", "d"], 5)], "lname STRING, words ARRAY<STRING>, size INT")
    others = spark.createDataFrame([("a b c d x", ["a", "b", "c", "d"], 5, 1)], "sname STRING, words ARRAY<STRING>, size INT, ord BIGINT")
    bounds = spark.createDataFrame([("a b c d e", 0.5)], "lname STRING, bound DOUBLE")
    none = spark.createDataFrame([], "lname STRING, sname STRING")
    pairs = matching._prefix_pairs(words, others, bounds, none)
    assert "SortMergeJoin [probe" in pairs._jdf.queryExecution().sparkPlan().toString()
    assert [(r.sname, r.score) for r in pairs.collect()] == [("a b c d x", 0.8)]


def alike_names(n, size, last):
    """Names of thirteen words, seven of them in all names."""
    return [f"solar array brand b{i % 5} size s{i % size} lot l{i % 11} row r{i % 13} house h{i % 3} {last}" for i in range(n)]


def test_names_that_share_most_words_write_no_pairs(spark, monkeypatch):
    leads, stations = sorted(set(alike_names(150, 7, "roof"))), alike_names(60, 8, "plant")
    written, write = {}, matching.materialize

    def counted(rows, label):
        written[label] = write(rows, label)
        return written[label]

    monkeypatch.setattr(matching, "materialize", counted)
    rows = matching.name_candidates(
        spark.createDataFrame([(n, "") for n in leads], "lname STRING, city_key STRING"),
        spark.createDataFrame([(n, i) for i, n in enumerate(stations)], "sname STRING, ord BIGINT"),
    ).collect()
    best = {a: max((pair_score(a, b, ""), -i) for i, b in enumerate(stations)) for a in leads}
    assert {r.lname: (round(r.score, 9), -r.ord) for r in rows} == {a: (round(s, 9), o) for a, (s, o) in best.items()}
    # All 9,000 pairs share more than INDEXED words.
    assert max(table.count() for table in written.values()) <= len(leads) + len(stations)


def test_subsets_below_every_bound_are_not_made(spark):
    words = [str(i) for i in range(14)]
    leads = spark.createDataFrame([("low", words, 14, 0.0), ("high", words, 14, 0.9)], "lname STRING, words ARRAY<STRING>, size INT, bound DOUBLE")
    long, short = (spark.createDataFrame([("s", words[:n], n, 1)], "sname STRING, words ARRAY<STRING>, size INT, ord BIGINT") for n in (12, 2))
    count = lambda rows: sorted((r.lname, r["count"]) for r in rows.groupBy("lname").count().collect())
    assert count(matching._lead_subsets(leads, long)) == [("low", 14 + 91 + 364)]
    # A short station can be shared whole.
    assert count(matching._lead_subsets(leads, short)) == [("high", 91 + 364), ("low", 14 + 91 + 364)]
    high = leads.filter("bound > 0")
    assert matching._station_subsets(long, high).count() == 0 and matching._station_subsets(short, high).count() == 1
