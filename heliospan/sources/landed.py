"""Landed payload files: unwrap the envelope, then type each kind of payload.

``read_landed`` is the only scan. Each ``parse_*`` function takes landed rows
(request fields plus the ``data`` text) and returns flat rows, so the same code
serves batch reads and file streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions.numbers import first_truthy


# List positions of a page take the low bits of a station's ordinal.
PAGE_BITS = 20


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LANDED).json(path)


def is_good() -> Column:
    """An envelope is an error only when not successful and the code is not "0"."""
    return F.coalesce(F.col("success"), F.lit(False)) | F.coalesce(F.col("code") == "0", F.lit(False))


def split_envelopes(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and error rows that keep code, message and payload."""
    return landed.filter(is_good()), landed.filter(~is_good())


def _array_text(data: Column) -> Column:
    """The payload when it is a JSON array; a lone object counts as no data."""
    return F.when(F.ltrim(data).startswith("["), data)


def _exploded(landed: DataFrame, keys: list[str], schema: str) -> DataFrame:
    keys = [*keys, "seq", "page_no"]
    items = F.from_json(_array_text(F.col("data")), schema)
    return landed.select(*keys, F.posexplode(items).alias("pos", "item")).select(*keys, "pos", "item.*")


def in_order(rows: DataFrame) -> DataFrame:
    """Make ``pos`` comparable across lines: later fetch, then page, then list position.

    The three are digits of one DECIMAL: a fixed-width value, which hash aggregates
    take as ``max_by`` key, unlike a struct. A missing ``seq`` or page is before all others.
    """
    digits = "coalesce(seq + 1, 0) * 1000000000000000BD + coalesce(page_no + 1, 0)"
    return rows.withColumn("pos", F.expr(f"CAST(({digits}) * 1000000000BD + pos AS DECIMAL(38, 0))")).drop("page_no")


def newest_fetch(landed: DataFrame, keys: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Lines of the newest fetch of every key; without keys, of the newest fetch of all.

    A payload fetched again replaces the older one. All pages of a fetch share its
    ``seq``. A missing key or ``seq`` is a value of its own, older than any other.
    With ``rows``, parsed from the lines, those of the newest fetches are returned: the
    join then moves the columns that are read, not payload text.
    """
    rows = landed if rows is None else rows
    newest = landed.groupBy(*keys).agg(F.max("seq").alias("seq"))
    newest = newest.select(*[F.col(c).alias(f"_newest_{c}") for c in [*keys, "seq"]])
    same = [rows[c].eqNullSafe(newest[f"_newest_{c}"]) for c in [*keys, "seq"]]
    return rows.join(newest, same, "left_semi")


def parse_station_pages(landed: DataFrame) -> DataFrame:
    """Station pages to one row per station, in page order, which ``ord`` numbers."""
    body = F.from_json("data", schemas.STATION_PAGE)
    ordinal = F.shiftleft(F.coalesce("page_no", F.lit(0)).cast("bigint"), PAGE_BITS) + F.col("pos")
    return (
        landed.select("page_no", body.alias("body"))
        .select("page_no", F.posexplode("body.page.records").alias("pos", "item"))
        .select("page_no", "pos", ordinal.alias("ord"), "item.*")
    )


def read_completeness(landed: DataFrame) -> DataFrame:
    """Fetched station count of the newest fetch next to its reported total, and its gaps and repeats.

    Pages of different fetches are not added up. ``missing_pages`` counts the numbers
    left out between the first and the last page of the fetch; a page that landed more
    than once counts once. A fetch is complete when no page is missing and the stations
    reach the total. Without any line the totals are 0 and complete.
    """
    body = F.from_json("data", schemas.STATION_PAGE)
    total = F.coalesce(F.nullif(body["page"]["total"], F.lit(0)), body["stationStatusVo"]["all"], F.lit(0))
    lines = landed.select(
        F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("page_no", F.lit(0)).alias("page_no"),
        F.greatest(F.coalesce(F.size(body["page"]["records"]), F.lit(0)), F.lit(0)).alias("n"), total.alias("total"),
    )
    pages = lines.groupBy("seq", "page_no").agg(
        F.max("n").alias("n"), F.max("total").alias("total"), F.count("*").alias("lines"))
    fetches = pages.groupBy("seq").agg(
        F.sum("n").alias("fetched"), F.max("total").alias("reported"),
        (F.max("page_no") - F.min("page_no") + 1 - F.count("*")).alias("missing_pages"),
        F.sum(F.col("lines") - 1).alias("repeated_pages"))
    newest = fetches.agg(*[F.coalesce(F.max_by(c, "seq"), F.lit(0)).alias(c) for c in
                           ("fetched", "reported", "missing_pages", "repeated_pages")])
    complete = (F.col("fetched") >= F.col("reported")) & (F.col("missing_pages") == 0)
    return newest.withColumn("complete", complete)


def parse_station_detail(landed: DataFrame) -> DataFrame:
    detail = F.from_json("data", schemas.STATION_DETAIL)
    rows = landed.select("station_id", detail.alias("item")).filter("item is not null")
    return rows.select("station_id", "item.*")


def parse_day_points(landed: DataFrame, key: str = "station_id") -> DataFrame:
    """Power points of a day curve. ``key="entity_id"`` reads inverter curves."""
    return _exploded(landed, [key, "day"], schemas.DAY_CURVE)


def parse_month_days(landed: DataFrame, key: str = "station_id") -> DataFrame:
    return _exploded(landed, [key, "month"], schemas.MONTH_SUMMARY)


def parse_station_all(landed: DataFrame) -> DataFrame:
    """All-time totals; an array and a lone object are both accepted."""
    items = F.from_json("data", schemas.ALL_TIME)
    return landed.select("station_id", F.posexplode(items).alias("pos", "item")).select(
        "station_id", "pos", "item.*"
    )


def parse_inverters(landed: DataFrame) -> DataFrame:
    """Inverters of a station in list order: page records, else plain records."""
    body = F.from_json("data", schemas.INVERTER_LIST)
    paged = body["page"]["records"]
    records = F.coalesce(F.when(F.size(paged) > 0, paged), body["records"])
    return landed.select("station_id", F.posexplode(records).alias("pos", "item")).select(
        "station_id", "pos", first_truthy(F.col("item.id"), F.col("item.sn")).alias("inverter_id")
    )


def parse_inverter_detail(landed: DataFrame) -> DataFrame:
    detail = F.from_json("data", schemas.INVERTER_DETAIL)
    rows = landed.select(F.col("entity_id").alias("inverter_id"), detail.alias("item"))
    return rows.filter("item is not null").select("inverter_id", "item.*")


def _good(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Good lines of the newest fetch of every request key."""
    return newest_fetch(split_envelopes(read_landed(spark, path))[0], keys)


def read_station_pages(spark: SparkSession, path: str) -> DataFrame:
    return parse_station_pages(_good(spark, path, []))


def read_station_detail(spark: SparkSession, path: str) -> DataFrame:
    return parse_station_detail(_good(spark, path, ["station_id"]))


def read_day_points(spark: SparkSession, path: str, key: str = "station_id") -> DataFrame:
    return parse_day_points(_good(spark, path, [key, "day"]), key)


def read_month_days(spark: SparkSession, path: str, key: str = "station_id") -> DataFrame:
    lines = split_envelopes(read_landed(spark, path))[0]
    return newest_fetch(lines, [key, "month"], parse_month_days(lines, key))


def read_station_all(spark: SparkSession, path: str) -> DataFrame:
    return parse_station_all(_good(spark, path, ["station_id"]))


def read_inverters(spark: SparkSession, list_path: str, detail_path: str) -> tuple[DataFrame, DataFrame]:
    listed = parse_inverters(_good(spark, list_path, ["station_id"]))
    return listed, parse_inverter_detail(_good(spark, detail_path, ["entity_id"]))
