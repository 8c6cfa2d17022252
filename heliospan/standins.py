"""The given tables in the shape of the data model.

Each stand-in is a projection or join of whole tables. Payload numbers become
text, as they land. ``catalog/oracle.py`` states the same in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions import clock
from heliospan.functions.numbers import exact_sum
from heliospan.session import apply_settings

AS_OF = clock.local_time("2024-01-30 14:30")
DAYS_AS_OF = clock.local_time("2001-08-15 10:00")


def text(value: Column) -> Column:
    return value.cast("string")


def ordered_struct(*names: str) -> Column:
    return F.struct(*names)


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a test table over all cores; its one row group would be read, and parsed, by one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


class Tables:
    """Lazy stand-ins over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = apply_settings(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        """Five-minute power points; station is the user of the event."""
        kind, value = F.col("event_type"), F.col("value")
        events = spread(self.table("events")).withColumn("ts", F.col("ts").cast("timestamp"))
        millis = text(F.floor(F.unix_millis("ts") / 300000) * 300000)
        charge = F.regexp_extract("props", "([0-9]+)", 1)
        return events.select(
            text(F.col("user_id")).alias("station_id"),
            text(clock.local_date(F.col("ts"))).alias("day"),
            F.col("event_id").alias("pos"),
            F.when(kind == "error", "0").when((kind == "signup") & (value > 40), "x").otherwise(millis).alias("time"),
            F.when(kind == "error", millis).alias("dataTimestamp"),
            F.date_format(F.col("ts") + F.expr("interval 8 hours"), "HH:mm:ss").alias("timeStr"),
            F.when(kind == "signup", "").when(kind != "error", text(value * 40)).alias("power"),
            F.when(kind == "click", "0").when(kind == "view", text(value * 41)).alias("pow"),
            text(value * 39).alias("pac"),
            text(value * 25).alias("familyLoadPower"),
            F.when(kind == "purchase", text(value * 5)).when(kind == "view", text(value * -26)).alias("bypassLoadPower"),
            text((value - 20) * 30).alias("psum"),
            F.when(kind == "click", text(value)).when(kind == "view", text(-value)).otherwise("0").alias("batteryPower"),
            F.when(kind == "error", "").when((kind != "signup") & (charge == "13"), "x").when(kind != "signup", charge)
            .alias("batteryCapacitySoc"),
        )

    @cached_property
    def days(self) -> DataFrame:
        """Day records of monthly payloads; station is the supplier."""
        line = spread(self.table("lineitem")).withColumn("d", F.col("l_shipdate").cast("date"))
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        nothing = F.lit(None).cast("string")
        quantity = F.col("l_quantity")
        return line.select(
            text(F.col("l_suppkey")).alias("station_id"),
            F.date_format(F.date_add("d", F.col("l_linenumber")), "yyyy-MM").alias("month"),
            ordered_struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("pos"),
            F.when((flag == "N") & (F.col("l_tax") == 0), "").otherwise(text(F.col("d"))).alias("dateStr"),
            text(quantity).alias("energy"),
            text(quantity * 2).alias("eg"),
            F.when(status == "F", text(quantity * 0.5)).otherwise("0").alias("homeGridEnergy"),
            F.when(flag == "A", text(quantity * 0.25)).otherwise("bad").alias("backUpEnergy"),
            nothing.alias("backup2Energy"),
            F.when(flag == "N", text(quantity * 0.75)).alias("homeLoadEnergy"),
            text(quantity * 0.9).alias("consumeEnergy"),
            text(F.col("l_tax") * 10).alias("gridPurchasedEnergy"),
            text(F.col("l_discount") * 100).alias("gridSellEnergy"),
            F.when((flag == "R") & (F.col("l_tax") == 0.08), "n/a").otherwise(text(F.col("l_extendedprice") / 1000)).alias("money"),
            nothing.alias("batteryChargeEnergy"),
            F.lit("").alias("batteryDischargeEnergy"),
        )

    @cached_property
    def profiles(self) -> DataFrame:
        key = text(F.col("c_custkey"))
        return self.table("customer").select(
            key.alias("id"), F.col("c_name").alias("full_name"),
            F.col("c_mktsegment").alias("phone"), F.lit(None).cast("string").alias("address"),
            F.when(F.col("c_mktsegment") != "HOUSEHOLD", key).alias("station_id"),
            F.concat(F.lit("RC"), text(F.col("c_nationkey"))).alias("referral_code"),
            F.col("c_custkey").alias("ord"),
        )

    @cached_property
    def auth_users(self) -> DataFrame:
        key, segment = text(F.col("c_custkey")), F.col("c_mktsegment")
        own = F.when(segment == "BUILDING", F.concat(F.lit(" M"), key)).when(segment == "MACHINERY", "")
        return self.table("customer").select(
            F.when(segment == "FURNITURE", F.concat(F.lit("x"), key)).otherwise(key).alias("id"),
            F.concat(F.lit(" U"), key, F.lit("@mail.test")).alias("email"),
            F.create_map(F.lit(schemas.LONG_STATION_FIELD), own).alias("user_metadata"),
            F.col("c_custkey").alias("ord"),
        )

    @cached_property
    def systems(self) -> DataFrame:
        """Several systems per user; the last active one counts."""
        price, status = F.col("o_totalprice"), F.col("o_orderstatus")
        return self.table("orders").select(
            F.concat(F.lit("S"), text(F.col("o_orderkey"))).alias("id"),
            text(F.col("o_custkey")).alias("user_id"),
            F.concat(F.lit("Array "), text(F.col("o_orderkey"))).alias("system_name"),
            (price / 10000).alias("capacity_kwp"),
            F.when(status != "F", price / 100000).alias("battery_capacity_kwh"),
            F.when(status != "P", F.col("o_orderdate").cast("date")).alias("installation_date"),
            F.lit("-").alias("address"),
            F.when(status == "O", "active").otherwise("retired").alias("status"),
            F.col("o_orderkey").alias("ord"),
        )

    @cached_property
    def stored_days(self) -> DataFrame:
        """Stored daily readings, at noon, in the morning or in the last second of the day."""
        status = F.col("o_orderstatus")
        local = F.when(status == "F", 43200).when(status == "O", 28800).otherwise(86399)
        ts = F.timestamp_seconds(F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint") * 86400 + local - 28800)
        price = F.col("o_totalprice")
        rows = self.table("orders").groupBy(text(F.col("o_custkey")).alias("user_id"), ts.alias("timestamp"))
        return rows.agg(
            F.concat(F.lit("S"), text(F.max("o_orderkey"))).alias("system_id"),
            F.max(price / 1000).alias("production_kwh"), F.min(price / 2000).alias("consumption_kwh"),
            F.lit(50.0).alias("battery_level"), F.lit("idle").alias("battery_status"),
            F.max(price / 4000).alias("grid_import_kwh"), F.min(price / 8000).alias("grid_export_kwh"),
            F.max(price / 500).alias("daily_earning"), F.lit(1.0).alias("battery_charge_kwh"),
            F.lit(2.0).alias("battery_discharge_kwh"), F.max("o_orderkey").alias("batch_no"),
        )

    @cached_property
    def stations(self) -> DataFrame:
        part = self.table("part")
        joined = self.table("supplier").join(part, F.col("s_suppkey") == F.col("p_partkey"))
        size, name = F.col("p_size"), F.col("p_name")
        words = F.split(name, " ")
        nation = F.col("s_nationkey")
        return joined.select(
            F.col("s_suppkey").alias("ord"), text(F.col("s_suppkey")).alias("id"),
            F.when(size <= 12, F.concat(F.upper(name), F.lit(".")))
            .when(size <= 25, F.concat_ws(" ", name, "p_type"))
            .when(size <= 37, F.concat(words[1], F.lit(" "), words[0], F.lit(" house")))
            .otherwise("").alias("stationName"),
            F.col("s_name").alias("sno"),
            F.when(nation < 10, 1).when(nation < 18, 3).when(nation < 24, 2).alias("state"),
            F.when(size > 3, text(size * 0.5)).otherwise("").alias("capacity"),
            text(F.col("s_acctbal")).alias("power"), text(size * 1.5).alias("dayEnergy"),
            text(F.col("p_retailprice")).alias("allEnergy"),
        )

    @cached_property
    def stages(self) -> DataFrame:
        region = F.col("n_regionkey")
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.when(region == 0, F.concat(F.lit("INSTALLED "), "n_name"))
            .when(region == 1, F.concat(F.lit("permitting - "), "n_name"))
            .when(region == 2, F.concat(F.lit("Project Closed DEPRECATED "), "n_name"))
            .otherwise(F.col("n_name")).alias("name"),
            (region == 4).alias("is_won"),
        )

    @cached_property
    def leads(self) -> DataFrame:
        size, key = F.col("p_size"), text(F.col("p_partkey"))
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("name"),
            F.when(size > 5, F.col("p_name")).alias("partner_name"),
            F.when(size > 25, F.concat_ws(" ", "p_type", "p_name")).alias("contact_name"),
            F.when(size <= 10, "False").when(size <= 14, " False").when(size <= 45, F.concat(F.lit(" U"), key, F.lit("@Mail.test ")))
            .otherwise("").alias("email_from"),
            F.when(size <= 20, "False").otherwise(F.concat(F.lit("+63"), key)).alias("phone"),
            F.when(size <= 30, F.lower("p_type")).when(size <= 40, "").alias("city"),
            F.when(size <= 35, "Hot!").when(size <= 45, " ring ").alias("x_studio_city_municipality"),
            F.lit(None).cast("string").alias("x_studio_province"),
            F.when(size <= 25, "False").otherwise(F.col("p_type")).alias("x_studio_complete_address"),
            F.when(size <= 8, " ").when(size <= 40, F.concat(F.lit(" RC"), text(F.floor(size / 2)))).alias("x_studio_customer_referral_code"),
            F.struct(F.floor(size / 2).alias("id"), F.concat(F.lit("stage "), text(F.floor(size / 2))).alias("name")).alias("stage_id"),
        )

    @cached_property
    def coded_leads(self) -> DataFrame:
        """Leads whose names hit profiles, for the referral operators."""
        size, key = F.col("p_size"), F.col("p_partkey")
        padded = F.lpad(text(key), 9, "0")
        half = F.lpad(text(F.floor(key / 2)), 9, "0")
        return self.leads.select("id", "ord", "email_from", "x_studio_customer_referral_code").join(
            self.table("part").select(
                key.alias("id"),
                F.when(size <= 30, "False").otherwise(F.concat(F.lit(" customer#"), half)).alias("contact_name"),
                F.concat(F.lit("CUSTOMER#"), padded, F.lit("  ")).alias("partner_name"),
            ), "id",
        )

    @cached_property
    def report(self) -> DataFrame:
        """Exact matches of a saved report; the lead of an order is its customer key."""
        key = text(F.col("o_orderkey"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("lead_id"), key.alias("station_id"),
            F.concat(F.lit("Station "), key).alias("station_name"), F.col("o_orderpriority").alias("partner_name"),
        )

    @cached_property
    def details(self) -> DataFrame:
        """Station detail payloads of the customers."""
        key, segment, balance = text(F.col("c_custkey")), F.col("c_mktsegment"), F.col("c_acctbal")
        return self.table("customer").select(
            key.alias("id"), key.alias("station_id"),
            F.when(segment == "BUILDING", "").otherwise(F.col("c_name")).alias("stationName"),
            F.concat(F.lit("SN"), key).alias("sno"),
            F.when(segment == "MACHINERY", "").otherwise(text(balance / 100)).alias("capacity"),
            text(balance * 10).alias("power"), text(balance / 50).alias("dayEnergy"),
            text(balance / 7).alias("monthEnergy"),
            F.when(segment == "BUILDING", "MWh").when(segment == "FURNITURE", " GWh ").when(segment == "HOUSEHOLD", "mwh").alias("monthEnergyStr"),
            text(balance / 3).alias("yearEnergy"), text(balance).alias("allEnergy"),
            F.when(segment == "BUILDING", "GWh").otherwise("kWh").alias("allEnergyStr"),
            text(F.floor(balance)).alias("allInCome"),
            F.when(segment == "BUILDING", "K PHP").when(segment == "FURNITURE", "MYR").when(segment == "HOUSEHOLD", " m usd").alias("allInComeUnit"),
            F.when(segment == "MACHINERY", "Rain").alias("condTxtD"),
            segment.alias("cityStr"), F.when(F.col("c_nationkey") < 12, "").otherwise("R").alias("regionStr"),
            text(F.col("c_nationkey")).alias("countryStr"),
        )

    @cached_property
    def inverters(self) -> DataFrame:
        """Inverter details: the parts a supplier ships."""
        brand, size = F.col("p_brand"), F.col("p_size")
        return self.table("part").select(
            F.concat(F.lit("I"), text(F.col("p_partkey"))).alias("inverter_id"),
            F.when(size <= 10, "0").when(size <= 20, "0.0").when(size <= 30, "x").alias("batteryCapacityKwh"),
            F.when(size <= 5, text(size * 1.005)).when(size <= 8, "").alias("batteryCapacityEnergy"),
            F.when((size > 20) & (size <= 25), text(size * 2.25)).alias("batteryTotalCapacity"),
            F.when(brand == "Brand#1", "0").otherwise(text(size * 10)).alias("storageBatteryCapacity"),
            text(size * 5).alias("batteryCapacity"),
            F.when(size > 12, "51.2").alias("storageBatteryVoltage"),
            F.when(size <= 40, "48").alias("batteryVoltage"),
        )

    @cached_property
    def inverter_list(self) -> DataFrame:
        """Inverters of a station in list order."""
        line = self.table("lineitem")
        return line.select(
            text(F.col("l_suppkey")).alias("station_id"),
            ordered_struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").alias("pos"),
            F.concat(F.lit("I"), text(F.col("l_partkey"))).alias("inverter_id"),
        )

    @cached_property
    def alarms(self) -> DataFrame:
        return self.table("events").filter("event_type = 'error'").select(
            text(F.col("user_id")).alias("station_id"), F.col("event_id").alias("alarm_id"),
            F.col("ts").cast("timestamp").alias("begin_time"),
        )

    @cached_property
    def totals(self) -> DataFrame:
        """All-time payload rows: the order values of a customer."""
        return self.table("orders").select(
            text(F.col("o_custkey")).alias("station_id"),
            F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(text(F.col("o_totalprice"))).alias("money"),
        )

    @cached_property
    def user_points(self) -> DataFrame:
        """Points of mapped users with their system and lifetime earning."""
        from heliospan.operators import readings as r

        users = r.users_with_system(r.mapped_users(self.profiles), self.systems)
        earning = r.lifetime_earning(self.totals)
        joined = self.points.join(
            users.select(F.col("id").alias("user_id"), "station_id", "system_id"), "station_id"
        ).join(earning, "station_id", "left")
        return joined.withColumn("lifetime_earning", F.coalesce("lifetime_earning", F.lit(0.0)))

    @cached_property
    def user_days(self) -> DataFrame:
        users = self.profiles.filter("station_id is not null").select(F.col("id").alias("user_id"), "station_id")
        return self.days.join(users, "station_id")

    @cached_property
    def stored_intervals(self) -> DataFrame:
        """Intervals already stored: those of clicks and views, with their own values."""
        kind = F.col("event_type")
        seconds = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300
        return self.table("events").filter(kind.isin("click", "view")).groupBy(
            text(F.col("user_id")).alias("user_id"), F.timestamp_seconds(seconds).alias("timestamp")
        ).agg(
            F.lit("old").alias("system_id"), exact_sum(F.col("value")).alias("production_kwh"),
            F.lit(0.0).alias("consumption_kwh"), F.lit(50.0).alias("battery_level"), F.lit("idle").alias("battery_status"),
            F.lit(0.0).alias("grid_import_kwh"), F.lit(0.0).alias("grid_export_kwh"), F.lit(0.0).alias("daily_earning"),
            F.lit(7.0).alias("lifetime_earning"), F.max("event_id").alias("batch_no"),
        )
