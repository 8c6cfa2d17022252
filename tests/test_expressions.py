"""Hand-worked cases of the column expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from heliospan.functions import clock, energy, numbers, text

C = F.col


def values(spark, schema, rows, column):
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i INT, {schema}")
    return [r[1] for r in numbered.select("i", column).orderBy("i").collect()]


def test_to_float(spark):
    cells = [None, "", "abc", " 12 ", "0", "1d", "-1.5e2"]
    assert values(spark, "v STRING", cells, numbers.to_float(C("v"))) == [0, 0, 0, 12, 0, 0, -150]


def test_strict_float(spark):
    cells = [None, "", "7.5", "abc"]
    assert values(spark, "v STRING", cells, numbers.strict_float(C("v"))) == [0, 0, 7.5, None]
    assert values(spark, "v STRING", cells, numbers.bad_number(C("v"))) == [False, False, False, True]


def test_first_truthy(spark):
    assert values(spark, "a STRING, b STRING", [("", "S1"), (None, "S2"), ("x", "y")], numbers.first_truthy(C("a"), C("b"))) == ["S1", "S2", "x"]


def test_round_n(spark):
    got = [values(spark, "v DOUBLE", [v], numbers.round_n(C("v"), n))[0] for v, n in ((1.005, 2), (-0.125, 2), (2.4, 0), (-0.0001, 2))]
    assert got == [1.0, -0.13, 2.0, 0.0]
    assert str(got[3]) == "0.0"


DAY_FIELDS = "homeGridEnergy STRING, backUpEnergy STRING, backup2Energy STRING, homeLoadEnergy STRING, consumeEnergy STRING"


def test_daily_consumption(spark):
    rows = [("5", "2", "1", "99", None), ("0", None, None, "4", "9"), ("-1", None, None, "0", "9")]
    columns = {c.split()[0]: C(c.split()[0]) for c in DAY_FIELDS.split(", ")}
    assert values(spark, DAY_FIELDS, rows, energy.daily_consumption(columns)) == [8, 4, 9]


def test_interval_energy(spark):
    rows = [("1500", "250"), ("100", "-300")]
    load = energy.interval_energy(energy.interval_load(C("f"), C("b")))
    assert values(spark, "f STRING, b STRING", rows, load) == [0.145833, 0.008333]
    assert values(spark, "w DOUBLE", [3000.0], energy.interval_energy(C("w"))) == [0.25]


def test_grid_split(spark):
    cells = [-1200.0, 0.0, 600.0]
    assert values(spark, "p DOUBLE", cells, energy.interval_energy(energy.import_w(C("p")))) == [0.1, 0, 0]
    assert values(spark, "p DOUBLE", cells, energy.interval_energy(energy.export_w(C("p")))) == [0, 0, 0.05]


def test_battery(spark):
    rows = [("5", None), ("-5", "40"), ("0", "40"), ("0", None), ("0", "")]
    schema = "p STRING, s STRING"
    assert values(spark, schema, rows, energy.battery_status(C("p"), C("s"))) == ["charging", "discharging", "idle", None, "idle"]
    assert values(spark, schema, [rows[0], rows[2]], energy.battery_status_live(C("p"), C("s"))) == [None, "idle"]
    assert values(spark, "s STRING", [None, "", "55.26", "x"], energy.battery_level(C("s"))) == [None, None, 55.3, 0.0]


def test_point_timestamp(spark):
    rows = [("1775623500123", None), ("0", "1775623500123"), ("x", None), ("99999999999999999", None)]
    stamp = clock.point_timestamp(C("t"), C("d"))
    assert values(spark, "t STRING, d STRING", rows, F.unix_millis(stamp)) == [1775623500123, 1775623500123, None, None]
    assert values(spark, "t STRING, d STRING", rows[:1], clock.local_hour(stamp)) == [12]
    assert values(spark, "t STRING, d STRING", rows[:1], clock.local_date(stamp)) == [dt.date(2026, 4, 8)]


def test_epoch_key_and_noon(spark):
    assert values(spark, "t STRING", ["2026-04-08T04:00:00Z", "2026-04-08T12:00:00+08:00", "x"], clock.epoch_key(C("t"))) == [1775620800, 1775620800, None]
    noon = F.unix_seconds(clock.local_noon(clock.iso_date(C("t"))))
    assert values(spark, "t STRING", ["2026-04-08", "2026-04"], noon) == [1775620800, None]


def test_calendar():
    as_of = dt.datetime(2026, 3, 31, 17, 30, tzinfo=dt.timezone.utc)
    assert clock.local_calendar(as_of) == {"today": "2026-04-01", "month": "2026-04", "year": "2026"}
    start, end = clock.day_bounds(as_of)
    assert (start.isoformat(), (end - start).days) == ("2026-04-01T00:00:00+08:00", 1)


def test_energy_to_kwh(spark):
    rows = [(1.5, "MWh"), (2.0, " GWh "), (3.0, None), (4.0, "mwh")]
    assert values(spark, "v DOUBLE, u STRING", rows, energy.energy_to_kwh(C("v"), C("u"))) == [1500, 2000000, 3, 4]


CAPACITY = ("batteryCapacityKwh", "batteryCapacityEnergy", "batteryTotalCapacity", "storageBatteryCapacity", "batteryCapacity",
            "storageBatteryVoltage", "batteryVoltage")


@pytest.mark.parametrize("given,expected", [
    ({"batteryCapacityKwh": "0", "storageBatteryCapacity": "100", "storageBatteryVoltage": "51.2"}, 5.12),
    ({"batteryCapacityKwh": "0.0", "storageBatteryCapacity": "100", "storageBatteryVoltage": "51.2"}, 0.0),
    ({"batteryCapacityKwh": "x", "batteryCapacityEnergy": "10.239"}, 10.24),
    ({"batteryCapacity": "100", "batteryVoltage": "48"}, 4.8),
    ({}, None),
])
def test_battery_capacity(spark, given, expected):
    row = tuple(given.get(c) for c in CAPACITY)
    schema = ", ".join(f"{c} STRING" for c in CAPACITY)
    assert values(spark, schema, [row], energy.battery_capacity({c: C(c) for c in CAPACITY})) == [expected]


def test_labels(spark):
    assert values(spark, "v DOUBLE, u STRING", [(1.5, "K PHP"), (2.0, None), (3.0, "MYR"), (1234.5, "usd")], text.format_income(C("v"), C("u"))) == [
        "PHP 1.5K", "PHP 2", "YR 3M", "usd 1,234.5"]
    assert values(spark, "t STRING", ["00:05:00", "13:07", "x", None], clock.clock_label(C("t"))) == ["12:05 AM", "1:07 PM", "x", ""]
    assert values(spark, "t STRING", ["2026-04-08", "2026-04"], clock.month_day_label(C("t"))) == ["Apr 8", "2026-04"]
    assert values(spark, "a STRING, b STRING, c STRING", [("Cebu", "", "PH")], text.location_text(C("a"), C("b"), C("c"))) == ["Cebu, PH"]
    assert values(spark, "s INT", [1, 3, 2, None], energy.station_status(C("s"))) == ["Online", "Alarm", "Offline", "Offline"]


def test_names(spark):
    assert values(spark, "n STRING", ["Peña,  J.R._x"], text.normalize_name(C("n"))) == ["peña j r _x"]
    assert values(spark, "n STRING", [" Ana  M. "], text.squash_name(C("n"))) == ["ana m."]
    sets = [text.token_set(text.normalize_name(C(c))) for c in "ab"]
    assert values(spark, "a STRING, b STRING", [("Juan Cruz", "Cruz Residence"), ("", "a")], text.token_overlap(*sets)) == [0.5, 0]


def test_crm_text(spark):
    cells = ["False", "false", "", None, "Ana"]
    assert values(spark, "v STRING", cells, text.clean_crm_text(C("v"))) == [None, "false", None, None, "Ana"]
    assert values(spark, "v STRING", [" Ana@X.ph ", "False", ""], text.clean_email(C("v"))) == ["ana@x.ph", None, None]
    assert values(spark, "c STRING, p STRING, s STRING", [("False", "", "S")], text.display_name(C("c"), C("p"), C("s"), "d")) == ["S"]
