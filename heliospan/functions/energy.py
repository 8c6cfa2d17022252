"""Energy, grid and battery expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospan.functions.numbers import is_blank, parse_double, round_n, to_float

# One power point stands for exactly five minutes.
HOURS_PER_POINT = 5 / 60


def kwh_of_point(watts: Column) -> Column:
    """Energy of one five-minute point, not rounded."""
    return watts * F.lit(HOURS_PER_POINT) / F.lit(1000.0)


def interval_energy(watts: Column) -> Column:
    return round_n(kwh_of_point(watts), 6)


def load_of(family: Column, bypass: Column) -> Column:
    """House load in watts; the family load alone when the sum is not positive."""
    return F.when(family + bypass <= 0, family).otherwise(family + bypass)


def interval_load(family: Column, bypass: Column) -> Column:
    return load_of(to_float(family), to_float(bypass))


def export_w(net: Column) -> Column:
    return F.greatest(net, F.lit(0.0))


def import_w(net: Column) -> Column:
    return F.abs(F.least(net, F.lit(0.0)))


def status_of(watts: Column, has_soc: Column) -> Column:
    """Charging, discharging, idle when a charge level is present, else null."""
    return F.when(watts > 0, "charging").when(watts < 0, "discharging").when(has_soc, "idle")


def battery_status(power: Column, soc: Column) -> Column:
    return status_of(to_float(power), soc.isNotNull())


def battery_status_live(power: Column, soc: Column) -> Column:
    """Like ``battery_status`` but null whenever the charge level is missing."""
    return F.when(soc.isNotNull(), status_of(to_float(power), soc.isNotNull()))


def battery_level(soc: Column) -> Column:
    """Charge level to one decimal; text that is not a number is 0."""
    return F.when(~is_blank(soc), round_n(to_float(soc), 1))


def consumption_of(day) -> Column:
    """Split loads if they add up to more than 0, else home load, else consumption."""
    split = day["homeGridEnergy"] + (day["backUpEnergy"] + day["backup2Energy"])
    home = day["homeLoadEnergy"]
    return F.when(split > 0, split).when(home > 0, home).otherwise(day["consumeEnergy"])


def daily_consumption(day) -> Column:
    """Consumption of a day record from its payload text."""
    fields = ("homeGridEnergy", "backUpEnergy", "backup2Energy", "homeLoadEnergy", "consumeEnergy")
    return consumption_of({field: to_float(day[field]) for field in fields})


def energy_to_kwh(value: Column, unit: Column) -> Column:
    """Scale MWh and GWh to kWh; a missing unit is kWh and case matters."""
    name = F.trim(unit)
    return F.when(name == "MWh", value * 1000.0).when(name == "GWh", value * 1000000.0).otherwise(value)


def battery_capacity(detail) -> Column:
    """Rated capacity in kWh: the first usable direct field, else Ah x V."""

    def usable(name: str) -> Column:
        text = detail[name]
        return F.when(~text.isin("", "0"), parse_double(text))

    def first_set(first: str, second: str) -> Column:
        return F.coalesce(F.when(~detail[first].isin("", "0"), detail[first]), detail[second])

    charge = parse_double(first_set("storageBatteryCapacity", "batteryCapacity"))
    volts = parse_double(first_set("storageBatteryVoltage", "batteryVoltage"))
    derived = charge * volts / 1000.0
    return round_n(
        F.coalesce(
            usable("batteryCapacityKwh"),
            usable("batteryCapacityEnergy"),
            usable("batteryTotalCapacity"),
            F.when(derived > 0, derived),
        ),
        2,
    )


def power_kw(watts: Column) -> Column:
    return round_n(watts / 1000.0, 3)


def station_status(state: Column) -> Column:
    return F.when(state == 1, "Online").when(state == 3, "Alarm").otherwise("Offline")
