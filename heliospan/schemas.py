"""Field names and shapes of landed payloads and stored tables.

Payload numbers may arrive as numbers, text, empty text or null, so every one
of them lands as STRING and is parsed by an expression.
"""

# One landed line: the request fields, then the response envelope. ``seq`` grows
# from fetch to fetch; a long payload may be split over several lines of one
# fetch, numbered by ``page_no``; ``pages`` tells their number where the writer
# knows it. ``data`` is STRING so that Spark keeps the nested JSON as raw text until
# it is typed.
LANDED = (
    "station_id STRING, entity_id STRING, day STRING, month STRING, seq BIGINT, page_no BIGINT, pages BIGINT, "
    "success BOOLEAN, code STRING, msg STRING, data STRING"
)

STATION = (
    "id: STRING, stationName: STRING, sno: STRING, state: INT, capacity: STRING, "
    "power: STRING, dayEnergy: STRING, allEnergy: STRING"
)
STATION_PAGE = (
    f"page STRUCT<total: BIGINT, records: ARRAY<STRUCT<{STATION}>>>, "
    "stationStatusVo STRUCT<all: BIGINT>"
)

STATION_DETAIL = (
    "id STRING, stationName STRING, sno STRING, capacity STRING, power STRING, "
    "dayEnergy STRING, monthEnergy STRING, monthEnergyStr STRING, yearEnergy STRING, "
    "allEnergy STRING, allEnergyStr STRING, allInCome STRING, allInComeUnit STRING, "
    "condTxtD STRING, cityStr STRING, regionStr STRING, countryStr STRING"
)

POINT = (
    "time: STRING, dataTimestamp: STRING, timeStr: STRING, power: STRING, pow: STRING, "
    "pac: STRING, familyLoadPower: STRING, bypassLoadPower: STRING, psum: STRING, "
    "batteryPower: STRING, batteryCapacitySoc: STRING"
)
DAY_CURVE = f"ARRAY<STRUCT<{POINT}>>"

DAY = (
    "dateStr: STRING, energy: STRING, eg: STRING, homeGridEnergy: STRING, "
    "backUpEnergy: STRING, backup2Energy: STRING, homeLoadEnergy: STRING, "
    "consumeEnergy: STRING, gridPurchasedEnergy: STRING, gridSellEnergy: STRING, "
    "money: STRING, batteryChargeEnergy: STRING, batteryDischargeEnergy: STRING"
)
MONTH_SUMMARY = f"ARRAY<STRUCT<{DAY}>>"

ALL_TIME = "ARRAY<STRUCT<money: STRING>>"

INVERTER_REF = "ARRAY<STRUCT<id: STRING, sn: STRING>>"
INVERTER_LIST = f"page STRUCT<records: {INVERTER_REF}>, records {INVERTER_REF}"
INVERTER_DETAIL = (
    "id STRING, sn STRING, batteryCapacityKwh STRING, batteryCapacityEnergy STRING, "
    "batteryTotalCapacity STRING, storageBatteryCapacity STRING, batteryCapacity STRING, "
    "storageBatteryVoltage STRING, batteryVoltage STRING"
)

CRM_LEAD = (
    "id BIGINT, name STRING, partner_name STRING, contact_name STRING, email_from STRING, "
    "phone STRING, city STRING, x_studio_city_municipality STRING, x_studio_province STRING, "
    "x_studio_complete_address STRING, x_studio_customer_referral_code STRING, "
    "stage_id STRUCT<id: BIGINT, name: STRING>"
)
CRM_STAGE = "id BIGINT, name STRING, is_won BOOLEAN"

# Columns read from each stored dimension table.
PROFILE_COLUMNS = ("id", "full_name", "phone", "address", "station_id", "referral_code")
SYSTEM_COLUMNS = (
    "id", "user_id", "system_name", "capacity_kwp", "battery_capacity_kwh",
    "installation_date", "address", "status", "ord",
)

# Stored dimension tables, CSV headers and sign-in metadata may use the longer
# field name; it is renamed to ``station_id`` on reading.
LONG_STATION_FIELD = "solis_station_id"

READING_KEY = ("user_id", "timestamp")
DAILY_READING = (
    "user_id STRING, system_id STRING, timestamp TIMESTAMP, production_kwh DOUBLE, consumption_kwh DOUBLE, "
    "battery_level DOUBLE, battery_status STRING, grid_import_kwh DOUBLE, grid_export_kwh DOUBLE, "
    "daily_earning DOUBLE, battery_charge_kwh DOUBLE, battery_discharge_kwh DOUBLE"
)
DAILY_VALUES = (
    "system_id", "production_kwh", "consumption_kwh", "battery_level", "battery_status",
    "grid_import_kwh", "grid_export_kwh", "daily_earning", "battery_charge_kwh",
    "battery_discharge_kwh",
)
INTERVAL_VALUES = (
    "system_id", "production_kwh", "consumption_kwh", "battery_level", "battery_status",
    "grid_import_kwh", "grid_export_kwh", "daily_earning", "lifetime_earning",
)

# Stage names that count as installed, in any case; the marker excludes a
# stage and is case-sensitive.
INSTALLED_KEYWORDS = ("Installed", "Project Closed", "Permitting")
DEPRECATED_MARKER = "DEPRECATED"

MISSING_ADDRESS = "—"
# The interval job writes this one.
MISSING_ADDRESS_INTERVAL = "-"
DEFAULT_DISPLAY_NAME = "Solar User"
STATION_PAGE_SIZE = 20
DEFAULT_BACKFILL_DAYS = 90
RECENT_INSTALL_DAYS = 30
EXACT_SCORE = 1.0
HIGH_SCORE = 0.8
PARTIAL_SCORE = 0.3
CONTAINED_SCORE = 0.85
CITY_BONUS = 0.15
