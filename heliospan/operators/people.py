"""Provisioning of user profiles and referral codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions.text import clean_crm_text, clean_email, display_name, squash_name


def leads_with_code(leads: DataFrame) -> DataFrame:
    code = F.trim("x_studio_customer_referral_code")
    return leads.withColumn("code", code).filter("code <> ''")


def matches_with_contact(matches: DataFrame, leads: DataFrame) -> DataFrame:
    """Report rows with the CRM contact of their lead."""
    contact = leads.select(
        F.col("id").alias("lead_id"), "email_from",
        F.col("partner_name").alias("crm_partner"), F.col("contact_name").alias("crm_contact"),
        "phone", "x_studio_complete_address",
    )
    joined = matches.join(contact, "lead_id", "left")
    return joined.withColumn("email", clean_email(F.col("email_from")))


def valid_email_matches(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches with a usable e-mail, and those without one."""
    return matches.filter("email is not null"), matches.filter("email is null")


def dedup_email_first(matches: DataFrame) -> DataFrame:
    """Outcome of every match: provision, duplicate or no_email.

    The first match of an e-mail is kept. The first ordinal is an aggregate
    joined back, so one e-mail on very many matches is split by the skew join.
    Matches without an e-mail meet nothing; they are dealt by their ordinal, as one
    task would hold all of them under a null key.
    """
    first = matches.filter("email is not null").groupBy("email").agg(F.min("ord").alias("_first"))
    # A clean e-mail is trimmed, so none begins with a blank.
    key = F.coalesce("email", F.concat(F.lit(" "), F.col("ord").cast("string")))
    joined = matches.withColumn("_key", key).join(first.withColumnRenamed("email", "_key"), "_key", "left").drop("_key")
    joined = joined.select("email", *[c for c in matches.columns if c != "email"], "_first")
    outcome = (
        F.when(F.col("email").isNull(), "no_email")
        .when(F.col("ord") == F.col("_first"), "provision")
        .otherwise("duplicate")
    )
    return joined.withColumn("outcome", outcome).drop("_first")


def provision_list(outcomes: DataFrame) -> DataFrame:
    """Clean user rows of the kept matches."""
    # A kept match has an e-mail; saying so drops the others before they are joined.
    return outcomes.filter("outcome = 'provision' and email is not null").select(
        "ord", "email",
        display_name(F.col("crm_contact"), F.col("crm_partner"), F.col("station_name"), schemas.DEFAULT_DISPLAY_NAME).alias("full_name"),
        clean_crm_text(F.col("phone")).alias("phone"),
        clean_crm_text(F.col("x_studio_complete_address")).alias("address"),
        F.col("station_id").cast("string").alias("station_id"),
        "station_name", "lead_id",
    )


def provision_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def existing_profile_by_email(users: DataFrame, auth_users: DataFrame) -> DataFrame:
    """Profile rows to upsert, on the first existing account with the e-mail or a new id."""
    accounts = (
        auth_users.withColumn("email", clean_email(F.col("email"))).filter("email is not null")
        .groupBy("email").agg(F.min_by("id", "ord").alias("_existing"))
    )
    joined = users.join(accounts, "email", "left")
    return joined.select(
        F.coalesce("_existing", F.md5("email")).alias("id"), "full_name", "phone", "address", "station_id",
        F.when(F.col("_existing").isNull(), "created").otherwise("existing").alias("outcome"),
    )


def _last_id(rows: DataFrame, key: Column, value: str) -> DataFrame:
    keyed = rows.withColumn("_key", key).filter("_key is not null and _key <> ''")
    return keyed.groupBy("_key").agg(F.max_by(value, "ord").alias("_hit"))


def last_by_key(profiles: DataFrame) -> DataFrame:
    """Last profile per collapsed full name."""
    last = _last_id(profiles, squash_name(F.col("full_name")), "id")
    return last.select(F.col("_key").alias("name_key"), F.col("_hit").alias("profile_id"))


def referral_targets(leads: DataFrame, profiles: DataFrame, auth_users: DataFrame) -> DataFrame:
    """Profile of every coded lead: by e-mail, else contact name, else partner name.

    An e-mail that hits an account without a profile falls through to the names.
    """
    accounts = _last_id(auth_users, F.lower(F.trim("email")), "id")
    by_email = accounts.join(profiles.select(F.col("id").alias("_hit")), "_hit", "left_semi")
    by_name = last_by_key(profiles)
    keyed = leads.select(
        F.col("id").alias("lead_id"), "ord", "code",
        F.lower(F.trim("email_from")).alias("_email"),
        squash_name(clean_crm_text(F.col("contact_name"))).alias("_contact"),
        squash_name(clean_crm_text(F.col("partner_name"))).alias("_partner"),
    )
    for column, lookup, key, value in (
        ("_email", by_email, "_key", "_hit"),
        ("_contact", by_name, "name_key", "profile_id"),
        ("_partner", by_name, "name_key", "profile_id"),
    ):
        side = lookup.select(F.col(key).alias(column), F.col(value).alias(f"_by{column}"))
        keyed = keyed.join(side, column, "left")
    return keyed.select(
        "lead_id", "ord", "code", F.coalesce("_by_email", "_by_contact", "_by_partner").alias("profile_id")
    )


def referral_outcomes(targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """Outcome per lead; every code is compared with the one stored at the start."""
    start = profiles.select(F.col("id").alias("profile_id"), F.col("referral_code").alias("old_code"))
    joined = targets.join(start, "profile_id", "left")
    outcome = (
        F.when(F.col("profile_id").isNull(), "no_match")
        .when(F.col("old_code").eqNullSafe(F.col("code")), "already_set")
        .otherwise("updated")
    )
    return joined.withColumn("outcome", outcome)


def referral_final_code(outcomes: DataFrame) -> DataFrame:
    """Code each updated profile ends with: that of the last lead that changed it."""
    changed = outcomes.filter("outcome = 'updated'")
    return changed.groupBy("profile_id").agg(F.max_by("code", "ord").alias("referral_code"))


def referral_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
