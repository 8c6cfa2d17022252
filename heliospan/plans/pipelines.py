"""Whole jobs composed of the operators.

A job returns its change set, merged table and report; nothing is written
here, so running a job without writing is a dry run.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions import clock, energy
from heliospan.functions.numbers import first_truthy, round_n, strict_float, to_float
from heliospan.operators import live as live_ops
from heliospan.operators import matching, merge, people, readings, views
from heliospan.session import materialize


@dataclass
class Job:
    """Outcome of a job. ``table`` is the merged target, ``changes`` what to write."""

    changes: DataFrame
    table: DataFrame
    report: DataFrame
    systems: DataFrame | None = None
    rejected: DataFrame | None = None


def plan_only(job: Job) -> DataFrame:
    """Dry run: three sample rows per user and how many more are planned."""
    return readings.sample_rows_per_user(job.changes)


def live_snapshot(points: DataFrame, detail: DataFrame, as_of: datetime) -> DataFrame:
    """One row per station and day: totals, battery, two-hour buckets and metadata.

    A station without points has one row with a null day, zeros and no buckets. Points are aggregated once, by bucket; totals roll the at most ten bucket
    rows of a station and day up, so the only large shuffle carries partial sums.
    """
    live = live_ops.live_points(points)
    now = as_of.astimezone(clock.LOCAL)
    hour, today = clock.local_hour(F.col("timestamp")), now.strftime("%Y-%m-%d")
    shown = (hour >= 5) & ((F.col("day") < today) | ((F.col("day") == today) & (hour <= now.hour)))
    net = F.col("net_w")

    def exact(watts: Column) -> Column:
        return F.sum(watts.cast("decimal(28,9)"))

    last = F.max_by(F.struct("battery_level", "battery_w", "has_soc"), "last_pos").alias("last")
    sums = ("watts", "load_w", "import_w", "export_w")
    by_slot = live.withColumn("slot", F.when(shown, live_ops.slot(hour))).groupBy(*live_ops.KEYS, "slot").agg(
        exact(F.col("watts")).alias("watts"), exact(F.col("load_w")).alias("load_w"),
        exact(energy.import_w(net)).alias("import_w"), exact(energy.export_w(net)).alias("export_w"),
        F.max("pos").alias("last_pos"), *live_ops.battery_of_last_point(),
    )

    def kwh(watts: Column) -> Column:
        return round_n(energy.kwh_of_point(watts.cast("double")), 4)

    bucket = F.when(F.col("slot").isNotNull(), F.struct(
        (F.col("slot") + 2).alias("hour"), kwh(F.col("watts")).alias("production_kwh"), kwh(F.col("load_w")).alias("consumption_kwh")
    ))
    # At most nine buckets per station and day, whatever the number of points.
    rolled = by_slot.withColumn("bucket", bucket).groupBy(*live_ops.KEYS).agg(
        *[F.sum(c).alias(c) for c in sums], last, F.sort_array(F.collect_list("bucket")).alias("today_hourly")
    )
    flat = rolled.select(*live_ops.KEYS, *[kwh(F.col(c)).alias(c) for c in sums], "last.*", "today_hourly")
    state = flat.select(
        *live_ops.KEYS,
        F.col("watts").alias("today_production_kwh"), F.col("load_w").alias("today_consumption_kwh"),
        F.col("import_w").alias("today_grid_import_kwh"), F.col("export_w").alias("today_grid_export_kwh"),
        *live_ops.battery_state(flat), "today_hourly",
    )
    meta = detail.select(
        F.col("id").alias("station_id"),
        strict_float(F.col("power")).alias("current_power_w"),
        strict_float(F.col("capacity")).alias("capacity_kwp"),
        F.coalesce("stationName", F.lit("")).alias("station_name"),
        energy.energy_to_kwh(strict_float(F.col("allEnergy")), F.col("allEnergyStr")).alias("alltime_production_kwh"),
        energy.energy_to_kwh(strict_float(F.col("monthEnergy")), F.col("monthEnergyStr")).alias("month_production_kwh"),
    )
    joined = meta.join(state, "station_id", "left")
    totals = [c for c in state.columns if c.startswith("today_") and c != "today_hourly"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in totals}).select(*state.columns, *[c for c in meta.columns if c != "station_id"])


def live_readings(points: DataFrame) -> DataFrame:
    """Readings list of the live view, in long form."""
    return live_ops.nonzero_points(live_ops.live_points(points))


def live_view(
    auth_users: DataFrame, profiles: DataFrame, points: DataFrame, detail: DataFrame, as_of: datetime,
    metadata_key: str = schemas.LONG_STATION_FIELD,
) -> DataFrame:
    """What every signed-in user sees now: the snapshot of today of their station and its readings.

    A user without a station has ``found = false`` and nothing else; one whose station
    has no points today has zeros. Today is a literal bound, which prunes points that
    landed by day. The readings of a station and day are bounded by its 288 intervals.
    """
    mine = points.filter(F.col("day") == clock.local_calendar(as_of)["today"])
    snapshot = live_snapshot(mine, detail, as_of).drop("day")
    fields = ("pos", "timestamp", "production_kw", "consumption_kw", "battery_level")
    listed = live_readings(mine).groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("readings"))
    listed = listed.withColumn("readings", F.transform("readings", lambda r: r.dropFields("pos")))
    users = live_ops.resolve_station(auth_users, profiles, metadata_key).select(F.col("id").alias("user_id"), "station_id")
    shown = users.join(snapshot, "station_id", "left").join(listed, "station_id", "left")
    return shown.withColumn("found", F.col("station_id").isNotNull())


def station_facts(users: DataFrame, detail: DataFrame, battery: DataFrame | None, oldest: DataFrame) -> DataFrame:
    """Per user: what the dimension merge needs to know about the station."""
    station = detail.select(
        F.col("id").alias("station_id"),
        first_truthy(F.col("stationName"), F.col("sno"), F.col("id")).alias("station_name"),
        to_float(F.col("capacity")).alias("capacity_kwp"),
    )
    joined = users.select(F.col("id").alias("user_id"), "station_id").join(station, "station_id")
    if battery is None:
        joined = joined.withColumn("battery_capacity_kwh", F.lit(None).cast("double"))
    else:
        joined = joined.join(battery, "station_id", "left")
    return joined.join(oldest.select(F.col("id").alias("user_id"), "oldest_date"), "user_id")


def station_names(users: DataFrame, detail: DataFrame) -> DataFrame:
    """Per user: name and capacity for a new system of the interval job and the backfill."""
    station = detail.select(
        F.col("id").alias("station_id"), F.coalesce(first_truthy(F.col("stationName")), F.col("id")).alias("station_name"),
        to_float(F.col("capacity")).alias("capacity_kwp"),
    )
    return users.select(F.col("id").alias("user_id"), "station_id").join(station, "station_id")


def months_to_sync(as_of: datetime) -> list[str]:
    """The current local month and, on its first day, the one before."""
    now = as_of.astimezone(clock.LOCAL)
    months = [now.strftime("%Y-%m")]
    if now.day == 1:
        months.insert(0, f"{now.year - (now.month == 1)}-{(now.month - 2) % 12 + 1:02d}")
    return months


def owners(users: DataFrame, systems: DataFrame) -> DataFrame:
    """User and system per station; a user without a system gets the id of the one to insert."""
    owner = readings.users_with_system(users, systems)
    return owner.select(
        F.col("id").alias("user_id"), "station_id",
        F.coalesce("system_id", merge.new_system_id(F.col("id"))).alias("system_id"),
    )


def daily_sync(
    profiles: DataFrame, systems: DataFrame, detail: DataFrame, battery: DataFrame, days: DataFrame,
    stored: DataFrame, as_of: datetime, months: list[str] | None = None, history: DataFrame | None = None,
    order: tuple[str, ...] = ("month", "pos"),
) -> Job:
    """Daily readings of the given payload months merged into the stored table.

    ``stored`` may be only the partitions of those months, as older ones do not
    change; ``history`` is then the whole table, read for the oldest dates only.
    ``months_to_sync`` gives the months of a scheduled run.
    ``order`` says which copy of a day is the last.
    """
    users = readings.mapped_users(profiles)
    # Months are literals, so they prune payloads that landed by month.
    wanted = days if months is None else days.filter(F.col("month").isin(months))
    # A station whose months hold no record is left alone.
    active = users.join(wanted.select("station_id").distinct(), "station_id", "left_semi")
    oldest = readings.oldest_reading_date(active, stored if history is None else history, as_of)
    merged_systems = merge.upsert_solar_system(systems, station_facts(active, detail, battery, oldest), as_of)
    owner = owners(users, systems)
    mine = wanted.join(owner, "station_id")
    # Payloads are parsed before the join, which then moves numbers of good records only.
    rows = readings.daily_reading(wanted, "station_id", *order).join(owner, "station_id").drop("station_id")
    incoming = merge.last_per_day(rows, order)
    changes = merge.classify_days(stored, incoming)
    table = merge.upsert_by_local_day(stored, incoming.drop(*order))
    return Job(changes, table, merge.sync_report(changes), merged_systems, readings.bad_days(mine))


def interval_sync(
    profiles: DataFrame, systems: DataFrame, points: DataFrame, totals: DataFrame, stored: DataFrame, as_of: datetime,
    detail: DataFrame | None = None,
) -> Job:
    """Interval readings merged under the late-interval rule, older days dropped.

    With ``detail``, every mapped user without an active system gets one. Points of
    request days before yesterday cannot reach today: a literal bound, which prunes
    curves that landed by day. The day of the reading itself is tested before the
    copies of an interval are compared.
    """
    users, systems_before = readings.mapped_users(profiles), systems
    if detail is not None:
        systems = merge.created_systems(systems, station_names(users, detail), as_of, schemas.MISSING_ADDRESS_INTERVAL)
    yesterday = (as_of.astimezone(clock.LOCAL) - timedelta(days=1)).strftime("%Y-%m-%d")
    recent = points.filter(F.col("day").isNull() | (F.col("day") >= yesterday))
    mine = recent.join(owners(users, systems_before), "station_id").join(
        readings.lifetime_earning(totals), "station_id", "left"
    ).withColumn("lifetime_earning", F.coalesce("lifetime_earning", F.lit(0.0)))
    kept = merge.purge_before_day(stored, as_of)
    rows = readings.interval_reading(mine, "user_id", "system_id", "pos")
    rows = merge.without_missing_column(rows, stored, "lifetime_earning")
    incoming = readings.dedup_points_last(merge.purge_before_day(rows, as_of))
    classified = readings.classify_intervals(incoming, kept)
    changes = classified.filter("action <> 'skip'")
    table = merge.upsert_readings(kept, changes.drop("pos", "epoch", "action"))
    return Job(changes, table, merge.sync_report(classified), systems)


def history_backfill(
    profiles: DataFrame, systems: DataFrame, days: DataFrame, stored: DataFrame, as_of: datetime,
    wanted: DataFrame | None = None, fixed_days: int = 0, detail: DataFrame | None = None,
) -> Job:
    """Readings of every user since installation, or of a fixed number of days.

    With ``detail``, every user in the window without an active system gets one. The
    first and last month of all windows are literal bounds on the payloads, which prune
    those that landed by month; each user's own months follow.
    """
    users = readings.mapped_users(profiles)
    if wanted is not None:
        users = readings.users_in_csv(users, wanted)
    windowed = readings.positive_window_users(readings.backfill_days(users, systems, as_of, fixed_days))
    months = readings.months_needed(windowed, as_of).withColumnRenamed("id", "user_id")
    start = windowed.select(F.col("id").alias("user_id"), "start_date")
    owner = owners(windowed, systems).join(start, "user_id")
    first, last = months.agg(F.min("month"), F.max("month")).first()
    near = days.filter(F.col("month").between(first, last)) if first else days.filter(F.lit(False))
    mine = near.join(owner, "station_id").join(months, ["user_id", "month"], "left_semi")
    # Payloads are parsed before the join, which then moves numbers of good records only.
    rows = readings.daily_reading(near, "station_id", "month", "pos").join(owner, "station_id").drop("station_id")
    rows = readings.backfill_window(readings.needed_months(rows, as_of), as_of)
    changes = readings.dedup_days_last(rows).drop("start_date")
    table = merge.upsert_readings(stored, changes.drop("month", "pos", "reading_date"))
    report = changes.groupBy("user_id").agg(F.count("*").alias("planned"))
    if detail is not None:
        systems = merge.created_systems(systems, station_names(windowed, detail), as_of, schemas.MISSING_ADDRESS)
    return Job(changes, table, report, systems, readings.bad_days(mine))


@dataclass
class Matches:
    routed: DataFrame
    unmatched_stations: DataFrame
    summary: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        """Report sections, ready for ``write_report``."""
        return {
            "summary": self.summary,
            "exact_matches": matching.exact_matches(self.routed),
            "partial_matches": matching.partial_matches(self.routed),
            "unmatched_leads": matching.unmatched_leads(self.routed),
            "unmatched_stations": self.unmatched_stations,
        }


def lead_matching(leads: DataFrame, stages: DataFrame, stations: DataFrame) -> Matches:
    """Leads in installed stages matched to stations."""
    used = matching.installed_stages(stages)
    if used.isEmpty():
        raise ValueError("no installed or won stage")
    chosen = matching.leads_in_stages(leads, used)
    routed = matching.route_matches(chosen, stations, matching.best_match(chosen, stations))
    routed = materialize(routed, "routed")
    return Matches(routed, matching.unmatched_stations(stations, routed), matching.match_summary(routed, stations))


@dataclass
class Provisioning:
    outcomes: DataFrame
    users: DataFrame
    profiles: DataFrame
    summary: DataFrame


def user_provisioning(matches: DataFrame, leads: DataFrame, auth_users: DataFrame) -> Provisioning:
    """Clean user list of a match report, with the profile rows to upsert."""
    outcomes = people.dedup_email_first(people.matches_with_contact(matches, leads))
    users = people.provision_list(outcomes)
    profiles = people.existing_profile_by_email(users, auth_users)
    return Provisioning(outcomes, users, profiles, people.provision_summary(outcomes))


@dataclass
class Referrals:
    outcomes: DataFrame
    profiles: DataFrame
    summary: DataFrame


def referral_sync(leads: DataFrame, profiles: DataFrame, auth_users: DataFrame) -> Referrals:
    """Profiles with the referral code of their leads."""
    targets = people.referral_targets(people.leads_with_code(leads), profiles, auth_users)
    outcomes = people.referral_outcomes(targets, profiles)
    codes = people.referral_final_code(outcomes).withColumnRenamed("profile_id", "id")
    merged = merge.upsert_rows(profiles, codes, ["id"])
    return Referrals(outcomes, merged, people.referral_summary(outcomes))


def dashboard_views(stations: DataFrame, detail: DataFrame, points: DataFrame, days: DataFrame) -> dict[str, DataFrame]:
    """Everything the dashboard shows."""
    return {
        "summary": views.fleet_summary(stations),
        "cards": views.station_cards(stations),
        "info": views.station_info(detail),
        "day_chart": views.trim_series(views.day_series(points), ["station_id", "day"]),
        "month_chart": views.month_series(days),
    }
