"""Dashboard and listing views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions import clock, energy
from heliospan.functions.numbers import exact_sum, first_nonzero, first_truthy, parse_double, round_n
from heliospan.functions.text import format_income, location_text

# Series step within each period: days of a month, months of a year, all years.
PERIOD_STEPS = {"month": "day", "year": "month", "all": "year"}


def energy_by_period(
    readings: DataFrame, entity: str, period: str, value: str | None = None, as_of: datetime | None = None
) -> DataFrame:
    """Energy series of every entity.

    ``period`` is month, year or all. ``value`` (``2024-01`` or ``2024``) or
    ``as_of`` keeps one month or year; with neither, every one is served.
    """
    if value is None and as_of is not None and period != "all":
        value = clock.local_calendar(as_of)[period]
    date = clock.local_date(F.col("timestamp"))
    if value is not None:
        first = datetime.strptime(value, "%Y-%m" if period == "month" else "%Y")
        last = first.replace(year=first.year + 1) if period == "year" else (
            first.replace(year=first.year + first.month // 12, month=first.month % 12 + 1)
        )
        # A plain timestamp range, so it reaches the scan.
        start, end = (clock.moment(d.replace(tzinfo=clock.LOCAL)) for d in (first, last))
        readings = readings.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    step = F.trunc(date, PERIOD_STEPS[period]) if period != "month" else date
    return readings.groupBy(entity, step.alias("period_start")).agg(
        round_n(exact_sum(F.col("production_kwh")), 4).alias("production_kwh"),
        round_n(exact_sum(F.col("consumption_kwh")), 4).alias("consumption_kwh"),
        round_n(exact_sum(F.col("daily_earning")), 2).alias("earning"),
    )


def page_of(rows: DataFrame, page: int, size: int, *order: str) -> DataFrame:
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size is 1 to 100")
    return rows.orderBy(*order).offset((page - 1) * size).limit(size)


def entity_page(entities: DataFrame, station_id: str | None = None, page: int = 1, size: int = 20, order: str = "id") -> DataFrame:
    """One page of the inverters, collectors or alarms of a station."""
    mine = entities if station_id is None else entities.filter(F.col("station_id") == station_id)
    return page_of(mine, page, size, order)


def alarms_in_range(alarms: DataFrame, begin: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Alarms that began in [begin, end); either bound may be missing."""
    if begin is not None:
        alarms = alarms.filter(F.col("begin_time") >= clock.moment(begin))
    if end is not None:
        alarms = alarms.filter(F.col("begin_time") < clock.moment(end))
    return alarms


def distinct_keys(leads: DataFrame, wanted: DataFrame, matches: DataFrame) -> DataFrame:
    """Distinct stage ids, listed station ids and matched station ids, as (kind, key), in one aggregate."""
    keys = leads.select(F.lit("stage").alias("kind"), F.col("stage_id.id").cast("string").alias("key")).unionByName(
        wanted.select(F.lit("listed").alias("kind"), F.trim("station_id").alias("key"))).unionByName(
        matches.select(F.lit("matched").alias("kind"), F.col("station_id").alias("key")))
    return keys.filter("key <> ''").distinct()


def search_stations(stations: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring of the name or the serial; an empty query keeps all."""
    text = query.lower().strip()
    if not text:
        return stations
    hit = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text) for c in ("stationName", "sno")]
    return stations.filter(hit[0] | hit[1])


def station_page(stations: DataFrame, page: int = 1) -> DataFrame:
    return page_of(stations, page, schemas.STATION_PAGE_SIZE, "ord")


def page_count(stations: DataFrame) -> DataFrame:
    pages = F.greatest(F.ceil(F.count("*") / schemas.STATION_PAGE_SIZE), F.lit(1)).cast("bigint")
    return stations.agg(pages.alias("pages"))


def _kwh_of(stations: DataFrame, field: str) -> Column:
    value = F.coalesce(parse_double(F.col(field)), F.lit(0.0))
    unit = f"{field}Str"
    return energy.energy_to_kwh(value, F.col(unit)) if unit in stations.columns else value


def fleet_summary(stations: DataFrame) -> DataFrame:
    """Counts and totals of the fleet; energy units are applied where known."""
    return stations.agg(
        F.count("*").alias("stations"),
        F.count_if(F.col("state") == 1).alias("online"),
        round_n(exact_sum(_kwh_of(stations, "capacity")), 1).alias("capacity_kwp"),
        round_n(exact_sum(_kwh_of(stations, "power")), 1).alias("power_kw"),
        round_n(exact_sum(_kwh_of(stations, "dayEnergy")), 1).alias("day_kwh"),
        round_n(exact_sum(_kwh_of(stations, "allEnergy")) / 1000.0, 2).alias("all_mwh"),
    )


def station_cards(stations: DataFrame) -> DataFrame:
    """What the dashboard prints for each station."""

    def number(field: str, digits: int) -> Column:
        return round_n(F.coalesce(parse_double(F.col(field)), F.lit(0.0)), digits)

    return stations.select(
        "ord", "id",
        F.coalesce(first_truthy(F.col("stationName"), F.col("sno")), F.lit("Unnamed")).alias("name"),
        first_truthy(F.col("sno"), F.lit("-")).alias("serial"),
        energy.station_status(F.col("state")).alias("status"),
        number("capacity", 1).alias("capacity_kwp"), number("power", 2).alias("power_kw"),
        number("dayEnergy", 1).alias("day_kwh"), number("allEnergy", 1).alias("all_kwh"),
    )


def station_info(detail: DataFrame) -> DataFrame:
    """Name, place, income and weather of the detail panel."""
    return detail.select(
        "id",
        F.coalesce(first_truthy(F.col("stationName"), F.col("sno")), F.lit("Station")).alias("name"),
        location_text(F.col("cityStr"), F.col("regionStr"), F.col("countryStr")).alias("location"),
        format_income(parse_double(F.col("allInCome")), F.col("allInComeUnit")).alias("income"),
        F.coalesce(first_truthy(F.col("condTxtD")), F.lit("-")).alias("weather"),
    )


def day_series(points: DataFrame) -> DataFrame:
    """Chart points of a day: clock label and power in kW."""
    watts = parse_double(first_nonzero(F.col("pow"), F.col("power"), F.col("pac")))
    return points.select(
        "station_id", "day", "pos",
        clock.clock_label(F.col("timeStr")).alias("label"),
        energy.power_kw(F.coalesce(watts, F.lit(0.0))).alias("value"),
    )


def month_series(days: DataFrame) -> DataFrame:
    value = parse_double(first_nonzero(F.col("energy"), F.col("eg")))
    return days.select(
        "station_id", "month", "pos",
        clock.month_day_label(F.col("dateStr")).alias("label"),
        F.coalesce(value, F.lit(0.0)).alias("value"),
    )


def trim_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """Cut the flat ends of every series.

    Kept: one point before the first positive value to one after the last, but
    only when the series does not start positive. Positions need not be
    consecutive. Bounds are aggregates joined back, so a long series is never
    gathered in one task.
    """
    positive = F.when(F.col("value") > 0, F.col("pos"))
    core = series.groupBy(*keys).agg(
        F.min("pos").alias("_start"), F.min(positive).alias("_first"), F.max(positive).alias("_last")
    ).filter("_first > _start")
    edges = series.join(core, keys).groupBy(*keys).agg(
        F.max(F.when(F.col("pos") < F.col("_first"), F.col("pos"))).alias("_from"),
        F.coalesce(F.min(F.when(F.col("pos") > F.col("_last"), F.col("pos"))), F.max("pos")).alias("_to"),
    )
    joined = series.join(edges, keys, "left")
    return joined.filter("_from is null or pos between _from and _to").drop("_from", "_to")
