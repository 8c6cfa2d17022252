"""Live view of a day: totals, two-hour buckets, newest point, readings.

Everything is grouped by station and local day, so one pass serves all stations
and any number of days; filter ``day`` first to serve only today.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan.functions import clock, energy
from heliospan.functions.numbers import exact_sum, first_truthy, is_blank, round_n, strict_float, to_float
from heliospan.operators.readings import point_times

KEYS = ["station_id", "day"]


def live_points(points: DataFrame, *keep: str) -> DataFrame:
    """Parse the fields every live operator reads, once, to fixed-width columns.

    The load has no fallback here, unlike interval readings.
    """
    soc = F.col("batteryCapacitySoc")
    parsed = point_times(points).select(
        *KEYS, *keep, "pos", "timestamp",
        strict_float(F.col("power")).alias("watts"),
        strict_float(F.col("familyLoadPower")).alias("_family"),
        strict_float(F.col("bypassLoadPower")).alias("_bypass"),
        strict_float(F.col("psum")).alias("net_w"),
        strict_float(F.col("batteryPower")).alias("battery_w"),
        F.when(~is_blank(soc), to_float(soc)).alias("_soc"),
        soc.isNotNull().alias("has_soc"),
    )
    return parsed.select(
        *KEYS, *keep, "pos", "timestamp", "watts", (F.col("_family") + F.col("_bypass")).alias("load_w"), "net_w", "battery_w",
        round_n(F.col("_soc"), 1).alias("battery_level"), "has_soc",
    )


def _kwh(watts: Column) -> Column:
    return round_n(energy.kwh_of_point(exact_sum(watts)), 4)


def today_totals(live: DataFrame) -> DataFrame:
    """Energy of the day; points without a timestamp count too."""
    return live.groupBy(*KEYS).agg(
        _kwh(F.col("watts")).alias("production_kwh"),
        _kwh(F.col("load_w")).alias("consumption_kwh"),
        _kwh(energy.import_w(F.col("net_w"))).alias("grid_import_kwh"),
        _kwh(energy.export_w(F.col("net_w"))).alias("grid_export_kwh"),
    )


def daytime_points(live: DataFrame, as_of: datetime) -> DataFrame:
    """Points from 5:00 local up to the current hour of the current day."""
    now = as_of.astimezone(clock.LOCAL)
    hour, today = clock.local_hour(F.col("timestamp")), F.lit(now.strftime("%Y-%m-%d"))
    open_hour = (F.col("day") < today) | ((F.col("day") == today) & (hour <= now.hour))
    return live.filter("timestamp is not null").withColumn("hour", hour).filter((F.col("hour") >= 5) & open_hour)


def slot(hour: Column) -> Column:
    """Start of the two-hour bucket; the last one holds hours 21 to 23."""
    return F.least(F.lit(5) + F.floor((hour - 5) / 2) * 2, F.lit(21)).cast("int")


def two_hour_buckets(live: DataFrame, as_of: datetime) -> DataFrame:
    """Energy per bucket, labelled with its end hour."""
    open_points = daytime_points(live, as_of).withColumn("slot", slot(F.col("hour")))
    return open_points.groupBy(*KEYS, "slot").agg(
        _kwh(F.col("watts")).alias("production_kwh"), _kwh(F.col("load_w")).alias("consumption_kwh")
    ).withColumn("hour", F.col("slot") + 2)


PAGE = [*KEYS, "seq", "page_no"]
PAGE_SUMS = "station_id STRING, day STRING, seq BIGINT, page_no BIGINT, pages BIGINT, slot INT, watts DECIMAL(38,9), load_w DECIMAL(38,9)"


def page_sums(lines: DataFrame, points: DataFrame, as_of: datetime) -> DataFrame:
    """Sums by bucket of every page of landed day curves.

    ``points`` are the parsed points of ``lines``. A page without points in any bucket
    has one row with a null slot, so that it counts as landed.
    """
    open_points = daytime_points(live_points(points, "seq", "page_no"), as_of).withColumn("slot", slot(F.col("hour")))
    sums = open_points.groupBy(*PAGE, "slot").agg(*[
        F.sum(F.col(c).cast("decimal(28,9)")).alias(c) for c in ("watts", "load_w")
    ])
    landed = lines.groupBy(*PAGE).agg(F.max("pages").alias("pages"))
    rows = landed.join(sums, PAGE, "left")
    return rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in PAGE_SUMS.split(", ")])


def whole_fetches(pages: DataFrame) -> DataFrame:
    """Fetches of which all pages have landed; one that does not tell its number of pages counts as whole."""
    landed = pages.groupBy(*PAGE).agg(F.max("pages").alias("pages")).groupBy(*KEYS, "seq").agg(
        F.max("pages").alias("pages"), F.count("*").alias("n"))
    return landed.filter("pages is null or n >= pages").select(*KEYS, "seq")


def merge_pages(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Page sums after a batch: a page that lands again replaces itself, and fetches before the newest whole one go.

    So a late older fetch changes nothing, and pages of a newer fetch wait beside the
    whole one until they are complete.
    """
    kept = stored.join(incoming.select(*PAGE).distinct(), PAGE, "left_anti").unionByName(incoming)
    newest = whole_fetches(kept).groupBy(*KEYS).agg(F.max("seq").alias("_whole"))
    return kept.join(newest, KEYS, "left").filter("_whole is null or seq >= _whole").drop("_whole")


def buckets_of_pages(pages: DataFrame) -> DataFrame:
    """Two-hour buckets of the newest whole fetch of every station and day."""
    newest = whole_fetches(pages).groupBy(*KEYS).agg(F.max("seq").alias("seq"))
    shown = pages.join(newest, [*KEYS, "seq"], "left_semi").filter("slot is not null")

    def kwh(watts: str) -> Column:
        return round_n(energy.kwh_of_point(F.sum(watts).cast("double")), 4)

    return shown.groupBy(*KEYS, "slot").agg(
        kwh("watts").alias("production_kwh"), kwh("load_w").alias("consumption_kwh")
    ).withColumn("hour", F.col("slot") + 2)


def buckets_in_order(buckets: DataFrame) -> DataFrame:
    return buckets.orderBy(*KEYS, "slot")


def nonzero_points(live: DataFrame) -> DataFrame:
    """Readings of the day whose rounded production or load is above zero."""
    readings = live.filter("timestamp is not null").select(
        *KEYS, "pos", "timestamp",
        energy.power_kw(F.col("watts")).alias("production_kw"),
        energy.power_kw(F.col("load_w")).alias("consumption_kw"),
        "battery_level",
    )
    return readings.filter("production_kw > 0 or consumption_kw > 0")


def battery_of_last_point() -> list[Column]:
    """Aggregates for the battery state of the last point by list position.

    Three fixed-width values instead of one struct, so the aggregate hashes.
    """
    return [F.max_by(c, "pos").alias(c) for c in ("battery_level", "battery_w", "has_soc")]


def battery_state(last: DataFrame) -> list[Column]:
    known = F.when(last["has_soc"], last["battery_level"])
    return [
        known.alias("battery_level"),
        F.when(last["has_soc"], energy.status_of(last["battery_w"], last["has_soc"])).alias("battery_status"),
    ]


def latest_point(live: DataFrame) -> DataFrame:
    """Battery state of the last point in list order, not in time order."""
    last = live.groupBy(*KEYS).agg(*battery_of_last_point())
    return last.select(*KEYS, *battery_state(last))


def resolve_station(auth_users: DataFrame, profiles: DataFrame, metadata_key: str) -> DataFrame:
    """Station per signed-in user: sign-in metadata first, then the profile.

    A user with neither keeps a null station id.
    """
    own = profiles.select(F.col("id").alias("_id"), F.col("station_id").alias("_profile_station"))
    joined = auth_users.join(own, auth_users["id"] == own["_id"], "left")
    chosen = first_truthy(F.trim(F.col("user_metadata")[metadata_key]), F.col("_profile_station"))
    return joined.withColumn("station_id", chosen).drop("_id", "_profile_station")
