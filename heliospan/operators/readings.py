"""Daily and interval readings, their filters, and the backfill window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions import clock, energy
from heliospan.functions.numbers import bad_number, exact_sum, is_blank, round_n, strict_float, to_float
from heliospan.operators.keep import keep_first, keep_last, sample_per_key
from heliospan.session import materialize

# Output column, payload field, decimals.
STRICT_DAY_FIELDS = (
    ("production_kwh", "energy", 4),
    ("grid_import_kwh", "gridPurchasedEnergy", 4),
    ("grid_export_kwh", "gridSellEnergy", 4),
    ("daily_earning", "money", 2),
    ("battery_charge_kwh", "batteryChargeEnergy", 4),
    ("battery_discharge_kwh", "batteryDischargeEnergy", 4),
)


# Lenient payload fields that add up to the consumption of a day.
LENIENT_DAY_FIELDS = ("homeGridEnergy", "backUpEnergy", "backup2Energy", "homeLoadEnergy", "consumeEnergy")


def has_date(days: DataFrame) -> DataFrame:
    return days.filter(~is_blank(F.col("dateStr")))


def _parsed_days(days: DataFrame, *keep: str) -> DataFrame:
    """Each payload field parsed once; a later step uses plain columns.

    One long expression per output would repeat the parsing and grow the
    generated method past what the JVM compiles.
    """
    dated = has_date(days)
    return dated.select(
        *keep,
        clock.iso_date(F.col("dateStr")).alias("reading_date"),
        *[strict_float(F.col(field)).alias(out) for out, field, _ in STRICT_DAY_FIELDS],
        *[to_float(F.col(field)).alias(field) for field in LENIENT_DAY_FIELDS],
    )


def _is_bad_day() -> Column:
    """A date or strict number that did not parse is null by now."""
    bad = F.col("reading_date").isNull()
    for out, _, _ in STRICT_DAY_FIELDS:
        bad = bad | F.col(out).isNull()
    return bad


def bad_days(days: DataFrame) -> DataFrame:
    """Dated day records with a number or date that does not parse."""
    record = F.struct(*days.columns).alias("_record")
    return _parsed_days(days.withColumn("_record", record), "_record").filter(_is_bad_day()).select("_record.*")


def daily_reading(days: DataFrame, *keep: str) -> DataFrame:
    """Day records to daily readings at local noon; bad records are left out."""
    parsed = _parsed_days(days, *keep)
    used = parsed.withColumn("consumption_kwh", energy.consumption_of(parsed))
    strict = {out: round_n(F.col(out), digits).alias(out) for out, _, digits in STRICT_DAY_FIELDS}
    reading = F.struct(
        "reading_date",
        clock.local_noon(F.col("reading_date")).alias("timestamp"),
        strict.pop("production_kwh"),
        round_n(F.col("consumption_kwh"), 4).alias("consumption_kwh"),
        F.lit(None).cast("double").alias("battery_level"),
        F.lit(None).cast("string").alias("battery_status"),
        *strict.values(),
    )
    # One row or none per record. A filter would be pushed below the parsing and
    # parse every field a second time.
    return used.select(*keep, F.inline(F.when(~_is_bad_day(), F.array(reading))))


def dedup_days_last(readings: DataFrame) -> DataFrame:
    """One row per user and timestamp; the later month, then the later position wins."""
    return keep_last(readings, ["user_id", "timestamp"], "month", "pos")


def point_times(points: DataFrame) -> DataFrame:
    millis = clock.point_millis(F.col("time"), F.col("dataTimestamp"))
    return points.withColumn("_millis", millis).withColumn("timestamp", clock.millis_timestamp(F.col("_millis"))).drop("_millis")


POINT_NUMBERS = ("power", "familyLoadPower", "bypassLoadPower", "psum", "batteryPower", "batteryCapacitySoc")


def bad_points(points: DataFrame) -> DataFrame:
    """Points with a number that does not parse or is out of range, and the fields it stands in.

    Readings take such a number as 0, live sums leave it out; this is the record of it.
    """
    fields = F.array_compact(F.array(*[F.when(bad_number(F.col(c)), c) for c in POINT_NUMBERS]))
    return points.withColumn("bad_fields", fields).filter(F.size("bad_fields") > 0)


def interval_reading(points: DataFrame, *keep: str, lifetime: bool = True) -> DataFrame:
    """Points to interval readings; points without a timestamp are dropped."""
    soc = F.col("batteryCapacitySoc")
    parsed = point_times(points).filter("timestamp is not null").select(
        *keep, "timestamp", *(["lifetime_earning"] if lifetime else []),
        to_float(F.col("power")).alias("_watts"), to_float(F.col("psum")).alias("_net"),
        to_float(F.col("familyLoadPower")).alias("_family"), to_float(F.col("bypassLoadPower")).alias("_bypass"),
        to_float(F.col("batteryPower")).alias("_battery"),
        F.when(~is_blank(soc), to_float(soc)).alias("_soc"), soc.isNotNull().alias("_has_soc"),
    )
    net = F.col("_net")
    kwh = parsed.select(
        *keep, "timestamp", *(["lifetime_earning"] if lifetime else []), "_battery", "_soc", "_has_soc",
        energy.kwh_of_point(F.col("_watts")).alias("_production"),
        energy.kwh_of_point(energy.load_of(F.col("_family"), F.col("_bypass"))).alias("_consumption"),
        energy.kwh_of_point(energy.import_w(net)).alias("_import"),
        energy.kwh_of_point(energy.export_w(net)).alias("_export"),
    )
    return kwh.select(
        *keep,
        "timestamp",
        F.unix_seconds("timestamp").alias("epoch"),
        round_n(F.col("_production"), 6).alias("production_kwh"),
        round_n(F.col("_consumption"), 6).alias("consumption_kwh"),
        round_n(F.col("_soc"), 1).alias("battery_level"),
        energy.status_of(F.col("_battery"), F.col("_has_soc")).alias("battery_status"),
        round_n(F.col("_import"), 6).alias("grid_import_kwh"),
        round_n(F.col("_export"), 6).alias("grid_export_kwh"),
        F.lit(0.0).alias("daily_earning"),
        *(["lifetime_earning"] if lifetime else []),
    )


def dedup_points_last(readings: DataFrame) -> DataFrame:
    """One row per user and whole second; the last in list order wins."""
    return keep_last(readings, ["user_id", "epoch"], "pos")


def readings_of_day(readings: DataFrame, as_of: datetime) -> DataFrame:
    """Readings of the local day; a plain range, so it reaches the scan."""
    start, end = clock.day_bounds(as_of)
    return readings.filter(
        (F.col("timestamp") >= clock.moment(start)) & (F.col("timestamp") < clock.moment(end))
    )


def intervals_in_order(readings: DataFrame) -> DataFrame:
    return readings.orderBy("user_id", "epoch")


def mapped_users(profiles: DataFrame) -> DataFrame:
    return profiles.filter("station_id is not null")


def active_systems(systems: DataFrame) -> DataFrame:
    return systems.filter("status = 'active'")


def last_system(systems: DataFrame) -> DataFrame:
    """The last active system of every user."""
    last = active_systems(systems).groupBy("user_id").agg(F.max_by("id", "ord").alias("system_id"))
    return last


def last_install_date(systems: DataFrame) -> DataFrame:
    """The last known installation date of every user, over systems of any status."""
    dated = systems.filter("installation_date is not null")
    return dated.groupBy("user_id").agg(F.max_by("installation_date", "ord").alias("installation_date"))


def users_with_system(users: DataFrame, systems: DataFrame) -> DataFrame:
    return users.join(last_system(systems), users["id"] == F.col("user_id"), "left").drop("user_id")


def users_in_csv(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Users whose trimmed station id is listed."""
    ids = wanted.select(F.col("station_id").alias("_wanted"))
    return users.join(ids, F.trim(users["station_id"]) == ids["_wanted"], "left_semi")


def backfill_days(users: DataFrame, systems: DataFrame, as_of: datetime, fixed_days: int = 0) -> DataFrame:
    """Days to fetch per user: a fixed number, else since installation, else the default."""
    today = F.lit(clock.local_calendar(as_of)["today"]).cast("date")
    dates = last_install_date(systems).withColumnRenamed("user_id", "_user")
    joined = users.join(dates, users["id"] == F.col("_user"), "left").drop("_user")
    known = F.coalesce(F.datediff(today, "installation_date"), F.lit(schemas.DEFAULT_BACKFILL_DAYS))
    days = F.lit(fixed_days) if fixed_days else known
    return joined.withColumn("backfill_days", days).withColumn(
        "start_date", F.date_sub(today, F.col("backfill_days"))
    )


def positive_window_users(users: DataFrame) -> DataFrame:
    return users.filter("backfill_days > 0")


def months_needed(users: DataFrame, as_of: datetime) -> DataFrame:
    """Months touching [start, today) per user; at most one row per month of history."""
    today = F.lit(clock.local_calendar(as_of)["today"]).cast("date")
    months = F.sequence(F.trunc("start_date", "MM"), F.date_sub(today, 1), F.expr("interval 1 month"))
    ahead = users.filter(F.col("start_date") < today)
    return ahead.select("id", F.explode(months).alias("_m")).select(
        "id", F.date_format("_m", "yyyy-MM").alias("month")
    )


def backfill_window(readings: DataFrame, as_of: datetime) -> DataFrame:
    """Readings with start_date <= date < today."""
    today = F.lit(clock.local_calendar(as_of)["today"]).cast("date")
    return readings.filter((F.col("reading_date") >= F.col("start_date")) & (F.col("reading_date") < today))


def needed_months(readings: DataFrame, as_of: datetime) -> DataFrame:
    """Rows whose payload month is one of ``months_needed`` of their ``start_date``."""
    last = F.date_format(F.date_sub(F.lit(clock.local_calendar(as_of)["today"]).cast("date"), 1), "yyyy-MM")
    month = F.col("month")
    return readings.filter((month >= F.date_format("start_date", "yyyy-MM")) & (month <= last) & month.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"))


def sample_rows_per_user(readings: DataFrame, size: int = 3) -> DataFrame:
    return sample_per_key(readings, ["user_id"], size, F.col("timestamp"))


def latest_interval_key(readings: DataFrame) -> DataFrame:
    return readings.groupBy("user_id").agg(F.max("epoch").alias("latest_epoch"))


def classify_intervals(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert, update or skip every incoming interval.

    A missing interval is inserted however late it is. A stored one changes only
    when it is the newest interval of this batch for its user. The newest key is
    an aggregate joined back, not a window, so a user with very many rows is
    split by the skew join. The incoming side is written once, so that its payloads
    are parsed once for both uses.
    """
    incoming = materialize(incoming, "incoming")
    known = stored.select("user_id", clock.epoch_key(F.col("timestamp")).alias("epoch")).distinct()
    known = known.withColumn("_stored", F.lit(True))
    joined = incoming.join(known, ["user_id", "epoch"], "left").join(latest_interval_key(incoming), "user_id")
    action = (
        F.when(F.col("_stored").isNull(), "insert")
        .when(F.col("epoch") == F.col("latest_epoch"), "update")
        .otherwise("skip")
    )
    return joined.withColumn("action", action).drop("_stored", "latest_epoch")


def late_interval_rule(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The intervals to write: inserts and newest updates."""
    return classify_intervals(incoming, stored).filter("action <> 'skip'")


def lifetime_earning(totals: DataFrame) -> DataFrame:
    """All-time earning per station from its all-time payload rows."""
    return totals.groupBy("station_id").agg(
        round_n(exact_sum(to_float(F.col("money"))), 2).alias("lifetime_earning")
    )


def oldest_reading_date(users: DataFrame, readings: DataFrame, as_of: datetime) -> DataFrame:
    """Local date of the first reading per user; today when there is none."""
    today = F.lit(clock.local_calendar(as_of)["today"]).cast("date")
    first = readings.groupBy(F.col("user_id").alias("_user")).agg(F.min("timestamp").alias("_first"))
    joined = users.join(first, users["id"] == F.col("_user"), "left")
    oldest = F.coalesce(clock.local_date(F.col("_first")), today)
    return joined.withColumn("oldest_date", oldest).drop("_user", "_first")


def oldest_row(readings: DataFrame) -> DataFrame:
    """The first reading of every user."""
    return keep_first(readings, ["user_id"], F.col("timestamp"))


def first_inverter(inverters: DataFrame) -> DataFrame:
    """First inverter of every station in list order.

    The first position is a fixed-width aggregate, which hashes; the inverter's text
    is joined back to it.
    """
    known = inverters.filter("inverter_id is not null")
    first = known.groupBy(F.col("station_id").alias("_station")).agg(F.min("pos").alias("_pos"))
    return known.join(first, (F.col("station_id") == F.col("_station")) & (F.col("pos") == F.col("_pos"))).select(
        "station_id", "inverter_id")


def station_battery(inverters: DataFrame, detail: DataFrame) -> DataFrame:
    """Battery capacity per station from its first inverter."""
    joined = first_inverter(inverters).join(detail, "inverter_id")
    return joined.select("station_id", energy.battery_capacity(joined).alias("battery_capacity_kwh"))
