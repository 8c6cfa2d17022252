"""Keyed merges, retention, schema evolution and change reports.

All functions are pure: they return the merged rows or the change set, and the
caller writes them to a new version or to the touched partitions.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions import clock
from heliospan.operators.keep import keep_last
from heliospan.operators.readings import last_system

LAST_SECOND_OF_DAY = 23 * 3600 + 59 * 60 + 59


def upsert_rows(stored: DataFrame, incoming: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keyed upsert: given columns overwrite, also with null; other columns keep their value.

    The incoming side must hold each key once. A presence flag decides, not
    ``coalesce``, because an incoming null is a value.
    """
    keys = list(keys)
    old, new = stored.alias("old"), incoming.withColumn("_given", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    joined = old.join(new, on, "full_outer")
    given = F.col("new._given").isNotNull()
    columns: list[Column] = [F.coalesce(F.col(f"new.{k}"), F.col(f"old.{k}")).alias(k) for k in keys]
    for name in stored.columns:
        if name in keys:
            continue
        kept = F.col(f"old.{name}")
        columns.append((F.when(given, F.col(f"new.{name}")).otherwise(kept) if name in incoming.columns else kept).alias(name))
    columns += [F.col(f"new.{n}").alias(n) for n in incoming.columns if n not in stored.columns]
    return joined.select(*columns)


def upsert_readings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_rows(stored, incoming, schemas.READING_KEY)


def _in_day_window(ts: Column) -> Column:
    return clock.local_second_of_day(ts) < LAST_SECOND_OF_DAY


def day_targets(stored: DataFrame) -> DataFrame:
    """Stored timestamp a reading of each user and local day would replace.

    The last second of the day is outside the window. Where several rows match,
    the one at local noon is taken, else the earliest.
    """
    inside = stored.filter(_in_day_window(F.col("timestamp")))
    day = clock.local_date(F.col("timestamp"))
    at_noon = F.when(F.col("timestamp") == clock.local_noon(day), F.col("timestamp"))
    return inside.groupBy("user_id", day.alias("reading_date")).agg(
        F.coalesce(F.min(at_noon), F.min("timestamp")).alias("target")
    )


def classify_days(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming daily readings with the stored timestamp they update, if any."""
    joined = incoming.join(day_targets(stored), ["user_id", "reading_date"], "left")
    return joined.withColumn("action", F.when(F.col("target").isNull(), "insert").otherwise("update"))


def upsert_by_local_day(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge daily readings, one per user and local day, into the stored table."""
    # Stored rows come by their local day, which incoming rows are already dealt by.
    # The target is no join key: as one, it would deal both sides once more.
    old = stored.withColumn("_day", clock.local_date(F.col("timestamp"))).alias("old")
    new = classify_days(stored, incoming).withColumn("_given", F.lit(True)).alias("new")
    # An insert has no target, so it meets no stored row and comes out alone.
    on = (
        (F.col("old.user_id") == F.col("new.user_id")) & (F.col("old._day") == F.col("new.reading_date"))
        & (F.col("old.timestamp") >= F.col("new.target")) & (F.col("old.timestamp") <= F.col("new.target"))
    )
    given = F.col("new._given").isNotNull()
    return old.join(new, on, "full_outer").select(*[
        (F.when(given, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in incoming.columns else F.col(f"old.{c}")).alias(c)
        for c in stored.columns
    ])


def new_system_id(user_id: Column) -> Column:
    return F.concat(F.lit("S-"), F.md5(user_id))


def upsert_solar_system(
    systems: DataFrame, stations: DataFrame, as_of: datetime
) -> DataFrame:
    """Update the active system of every user, or insert one.

    ``stations`` holds user_id, station_name, capacity_kwp, battery_capacity_kwh
    and oldest_date. A recent placeholder installation date is replaced by the
    oldest reading date, which is also the date of a new system.
    """
    recent = F.lit((as_of.astimezone(clock.LOCAL) - timedelta(days=schemas.RECENT_INSTALL_DAYS)).strftime("%Y-%m-%d")).cast("date")
    targets = last_system(systems)
    given = stations.select(
        "user_id", F.col("station_name").alias("_name"), F.col("capacity_kwp").alias("_capacity"),
        F.col("battery_capacity_kwh").alias("_battery"), F.col("oldest_date").alias("_oldest"),
    )
    changes = targets.join(given, "user_id").drop("user_id").withColumn("_given", F.lit(True))
    joined = systems.join(changes, systems["id"] == changes["system_id"], "left")
    hit = F.col("_given").isNotNull()
    merged = joined.select(*[
        {
            "system_name": F.when(hit, F.col("_name")).otherwise(F.col("system_name")),
            "capacity_kwp": F.when(hit, F.col("_capacity")).otherwise(F.col("capacity_kwp")),
            "battery_capacity_kwh": F.coalesce(F.col("_battery"), F.col("battery_capacity_kwh")),
            "installation_date": F.when(hit & (F.col("installation_date") >= recent), F.col("_oldest")).otherwise(F.col("installation_date")),
        }.get(c, F.col(c)).alias(c)
        for c in systems.columns
    ])
    missing = given.join(targets, "user_id", "left_anti")
    created = missing.select(
        new_system_id(F.col("user_id")).alias("id"), "user_id", F.col("_name").alias("system_name"),
        F.col("_capacity").alias("capacity_kwp"), F.col("_battery").alias("battery_capacity_kwh"),
        F.col("_oldest").alias("installation_date"),
        F.lit(schemas.MISSING_ADDRESS).alias("address"), F.lit("active").alias("status"),
        F.lit(None).cast("bigint").alias("ord"),
    )
    return merged.unionByName(created.select(*systems.columns))


def created_systems(systems: DataFrame, stations: DataFrame, as_of: datetime, address: str) -> DataFrame:
    """New systems for the users without an active one, installed today.

    ``stations`` holds user_id, station_name and capacity_kwp. Unlike the daily job,
    the interval job and the backfill change no system that is there.
    """
    today = F.lit(clock.local_calendar(as_of)["today"]).cast("date")
    missing = stations.join(last_system(systems), "user_id", "left_anti")
    created = missing.select(
        new_system_id(F.col("user_id")).alias("id"), "user_id", F.col("station_name").alias("system_name"), "capacity_kwp",
        F.lit(None).cast("double").alias("battery_capacity_kwh"), today.alias("installation_date"),
        F.lit(address).alias("address"), F.lit("active").alias("status"), F.lit(None).cast("bigint").alias("ord"),
    )
    return systems.unionByName(created.select(*systems.columns))


def purge_before_day(readings: DataFrame, as_of: datetime) -> DataFrame:
    """Rows kept by retention: those from the start of the local day on."""
    start, _ = clock.day_bounds(as_of)
    return readings.filter(F.col("timestamp") >= clock.moment(start))


def purged_count(readings: DataFrame, as_of: datetime) -> DataFrame:
    start, _ = clock.day_bounds(as_of)
    return readings.agg(F.count_if(F.col("timestamp") < clock.moment(start)).alias("purged"))


def evolve_add_column(table: DataFrame, name: str, type_name: str, default: object = 0) -> DataFrame:
    """Add a column with a default when it is missing."""
    return table if name in table.columns else table.withColumn(name, F.lit(default).cast(type_name))


def without_missing_column(rows: DataFrame, stored: DataFrame, name: str) -> DataFrame:
    """Leave the column out of a write while the stored table does not have it."""
    return rows if name in stored.columns else rows.drop(name)


def sync_report(changes: DataFrame) -> DataFrame:
    """Parsed, inserted, updated and skipped rows per user."""
    action = F.col("action")
    return changes.groupBy("user_id").agg(
        F.count("*").alias("parsed"),
        F.count_if(action == "insert").alias("inserts"),
        F.count_if(action == "update").alias("updates"),
        F.count_if(action == "skip").alias("skipped"),
    )


def last_per_day(incoming: DataFrame, order: Iterable[str]) -> DataFrame:
    """One incoming reading per user and local day: the last one in payload order."""
    return keep_last(incoming, ["user_id", "reading_date"], *order)
