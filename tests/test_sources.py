"""Landed files, CSV, reports and stored tables."""

import os
import json

from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.sources import landed, tables


def land(tmp_path, *lines):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(json.dumps({"success": True, "code": "0", **line}) for line in lines), encoding="utf-8")
    return str(folder)


def test_station_pages(spark, tmp_path):
    pages = [[{"id": 1, "stationName": "A", "power": "x"}, {"id": 2}], [{"id": 3, "capacity": 4.5}]]
    path = land(tmp_path, *[{"page_no": i, "data": {"page": {"total": 3, "records": p}}} for i, p in enumerate(pages, 1)],
                {"page_no": 3, "data": {"page": {"total": 3, "records": []}}})
    rows = landed.read_station_pages(spark, path).orderBy("page_no", "pos").collect()
    assert [(r.id, r.capacity, r.power) for r in rows] == [("1", None, "x"), ("2", None, None), ("3", "4.5", None)]
    assert landed.read_completeness(landed.read_landed(spark, path)).select("fetched", "reported", "complete").first().asDict() == {"fetched": 3, "reported": 3, "complete": True}


def test_incomplete_pages_use_the_other_total(spark, tmp_path):
    path = land(tmp_path, {"page_no": 1, "data": {"page": {"records": [{"id": 1}, {"id": 2}]}, "stationStatusVo": {"all": 3}}})
    assert landed.read_completeness(landed.read_landed(spark, path)).first().complete is False


def test_station_detail_keeps_text(spark, tmp_path):
    path = land(tmp_path, {"station_id": "1", "data": {"id": "1", "power": "12.5"}}, {"station_id": "2", "data": None})
    assert [r.power for r in landed.read_station_detail(spark, path).collect()] == ["12.5"]


def test_points_and_days(spark, tmp_path):
    path = land(tmp_path, {"station_id": "a", "day": "d", "month": "m", "data": [{"time": 1, "dateStr": "x"}, {"time": "2", "dateStr": "y"}]},
                {"station_id": "b", "data": {}}, {"station_id": "c", "data": None})
    assert [(r.station_id, r.pos, r.time) for r in landed.read_day_points(spark, path).orderBy("pos").collect()] == [("a", 0, "1"), ("a", 1, "2")]
    assert [(r.station_id, r.pos, r.dateStr) for r in landed.read_month_days(spark, path).orderBy("pos").collect()] == [("a", 0, "x"), ("a", 1, "y")]


def test_station_all_takes_list_and_object(spark, tmp_path):
    path = land(tmp_path, {"station_id": "a", "data": [{"money": 1.5}, {"money": ""}]}, {"station_id": "b", "data": {"money": "3"}})
    assert sorted((r.station_id, r.money) for r in landed.read_station_all(spark, path).collect()) == [("a", ""), ("a", "1.5"), ("b", "3")]


def test_inverters(spark, tmp_path):
    path = land(tmp_path, {"station_id": "a", "data": {"page": {"records": []}, "records": [{"id": None, "sn": "X"}]}},
                {"station_id": "b", "entity_id": "I", "data": {"page": {"records": [{"id": "I"}, {"id": "J"}]}, "records": [{"id": "no"}]}})
    listed, detail = landed.read_inverters(spark, path, path)
    assert sorted((r.station_id, r.inverter_id) for r in listed.collect()) == [("a", "X"), ("b", "I"), ("b", "J")]
    assert "I" in [r.inverter_id for r in detail.collect()]


def test_split_envelopes(spark):
    rows = [(False, "0"), (False, "1"), (True, "1"), (None, None)]
    good, bad = landed.split_envelopes(spark.createDataFrame(rows, "success BOOLEAN, code STRING"))
    assert sorted(tuple(r) for r in good.collect()) == [(False, "0"), (True, "1")]
    assert bad.count() == 2


def test_newest_fetch_replaces(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("b", 1, "w")], "station_id STRING, seq BIGINT, data STRING")
    assert sorted(r.data for r in landed.newest_fetch(rows, ["station_id"]).collect()) == ["w", "y", "z"]


def test_readers_take_the_newest_fetch(spark, tmp_path):
    curve = {"station_id": "a", "entity_id": "I", "day": "d", "month": "m"}
    path = land(
        tmp_path,
        curve | {"seq": 1, "page_no": 1, "data": [{"time": "1", "dateStr": "x"}, {"time": "2", "dateStr": "y"}]},
        curve | {"seq": 3, "page_no": 1, "data": [{"time": "3", "dateStr": "z"}]},
        curve | {"seq": 3, "page_no": 2, "data": [{"time": "4", "dateStr": "w"}]},
        {"station_id": "b", "day": "d", "month": "m", "seq": 2, "data": [{"time": "5", "dateStr": "v"}]},
        curve | {"seq": 4, "success": False, "code": "9", "data": None},
    )
    points = landed.read_day_points(spark, path)
    assert sorted((r.station_id, r.time) for r in points.collect()) == [("a", "3"), ("a", "4"), ("b", "5")]
    days = landed.read_month_days(spark, path, "entity_id")
    assert sorted((r.entity_id or "", r.dateStr) for r in days.collect()) == [("", "v"), ("I", "w"), ("I", "z")]
    assert landed.read_station_all(spark, path).count() == 3


def test_newest_listing_and_detail(spark, tmp_path):
    pages = [(1, 1, "A"), (1, 2, "B"), (2, 1, "C")]
    path = land(tmp_path, *[
        {"station_id": "s", "seq": seq, "page_no": page, "data": {"id": i, "page": {"total": 1, "records": [{"id": i}]}}}
        for seq, page, i in pages])
    assert [r.id for r in landed.read_station_pages(spark, path).collect()] == ["C"]
    assert [r.id for r in landed.read_station_detail(spark, path).collect()] == ["C"]
    assert [r.inverter_id for r in landed.read_inverters(spark, path, path)[0].collect()] == ["C"]


def test_station_filter_csv(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(tables.BYTE_ORDER_MARK + schemas.LONG_STATION_FIELD + ",x\n 12 ,1\n,2\n12,3\n", encoding="utf-8")
    assert [r.station_id for r in tables.read_station_filter_csv(spark, str(path)).collect()] == ["12"]


FIELDS = "lead_id: BIGINT, station_id: STRING"


def test_report_round_trip(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").alias("ord"), (9 - F.col("id")).alias("lead_id"), F.col("id").cast("string").alias("station_id"))
    path = str(tmp_path / "report")
    tables.write_report({"exact_matches": rows, "summary": rows.agg(F.count("*").alias("n"))}, path)
    assert tables.read_match_report(spark, path, FIELDS).collect() == rows.orderBy("ord").collect()


def test_single_report_document(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"exact_matches": [{"lead_id": 5, "station_id": "b"}, {"lead_id": 4, "station_id": "a"}]}, indent=2))
    assert [tuple(r) for r in tables.read_match_report(spark, str(path), FIELDS).collect()] == [(0, 5, "b"), (1, 4, "a")]


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.latest_version(spark, path) is None
    for n in range(1, 6):
        assert tables.write_version(spark.range(n), path, "query", n) == n
    assert tables.latest_version(spark, path).count() == 5
    assert tables.is_committed(spark, path, "query", 4) and not tables.is_committed(spark, path, "other", 4)
    # Another writer goes on with the numbers, whatever its own batches are.
    assert tables.write_version(spark.range(9), path, "other", 0) == 6
    assert [c.number for c in tables.commits(spark, path)] == [4, 5, 6]
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 3
    # A read lists and scans the files of one version.
    files = tables.latest_version(spark, path).inputFiles()
    assert files and all("/data-other-0/" in f for f in files)
    # Staged data are not seen before the commit, and staging again keeps them.
    folder = tables.stage_version(spark.range(1), path, "other", 1)
    assert tables.latest_version(spark, path).count() == 9
    assert tables.stage_version(spark.range(2), path, "other", 1) == folder
    tables.commit_version(spark, path, folder, "other", 1)
    assert tables.latest_version(spark, path).count() == 1


def test_ordinals_follow_the_rows_of_the_files(spark, tmp_path):
    path = tmp_path / "leads"
    path.mkdir()
    for f in range(3):
        (path / f"{f}.json").write_text("\n".join(json.dumps({"id": 100 * f + i, "name": "x" * (i % 7)}) for i in range(100)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = tables.read_crm_leads(spark, str(path)).select("id", "ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.id for r in sorted(rows, key=lambda r: r.ord)] == list(range(300))
    assert len({r.ord for r in rows}) == 300
    spark.range(0, 1000, 1, 4).selectExpr("cast(id AS STRING) AS id", "id AS n").write.parquet(str(tmp_path / "profiles"))
    rows = tables.read_dimensions(spark, str(tmp_path / "profiles"), ("id", "n", "ord")).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.ord)] == list(range(1000))


def test_a_second_partial_fetch_is_incomplete(spark):
    page = lambda total, n: json.dumps({"page": {"total": total, "records": [{"id": str(i)} for i in range(n)]}})
    rows = [(1, 1, page(3, 2)), (1, 2, page(3, 1)), (2, 1, page(3, 2)), (2, 1, page(3, 2)), (2, 3, page(3, 1))]
    lines = lambda k: spark.createDataFrame(rows[:k], "seq BIGINT, page_no BIGINT, data STRING")
    assert landed.read_completeness(lines(2)).first().complete is True
    assert tuple(landed.read_completeness(lines(4)).first()) == (2, 3, 0, 1, False)
    # All stations are there, but page 2 is not.
    assert tuple(landed.read_completeness(lines(5)).first()) == (3, 3, 1, 1, False)


def test_overwrite_partitions_touches_only_its_own(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v INT, k STRING")
    tables.overwrite_partitions(rows, path, "k")
    tables.overwrite_partitions(spark.read.parquet(path).filter("k = 'a'").withColumn("v", F.lit(9)), path, "k")
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("v", "k").collect()) == [(2, "b"), (9, "a")]
