"""Names, e-mails, CRM text and dashboard labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospan.functions.numbers import first_truthy


def normalize_name(name: Column) -> Column:
    """Lower case, punctuation to spaces, spaces collapsed. Letters of any script stay."""
    words = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(words, r"\s+", " "))


def token_set(normal: Column) -> Column:
    """Distinct words of a normalised name."""
    return F.array_distinct(F.filter(F.split(normal, " "), lambda word: word != ""))


def token_overlap(left: Column, right: Column) -> Column:
    """Shared words over the smaller word count; 0 when either side has none."""
    sizes = [F.coalesce(F.array_size(words), F.lit(0)) for words in (left, right)]
    shared = F.array_size(F.array_intersect(left, right))
    return F.when((sizes[0] > 0) & (sizes[1] > 0), shared / F.least(*sizes)).otherwise(F.lit(0.0))


def squash_name(name: Column) -> Column:
    """Lower case with spaces collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def clean_crm_text(value: Column) -> Column:
    """Null for empty text and for the exact word the CRM uses as no value."""
    return F.nullif(F.nullif(value, F.lit("False")), F.lit(""))


def clean_email(value: Column) -> Column:
    """Trimmed lower-case e-mail, null when missing or the word false."""
    email = F.lower(F.trim(value))
    return F.nullif(F.nullif(email, F.lit("")), F.lit("false"))


def display_name(contact: Column, partner: Column, station: Column, default: str) -> Column:
    return F.coalesce(clean_crm_text(contact), clean_crm_text(partner), station, F.lit(default))


def location_text(city: Column, region: Column, country: Column) -> Column:
    return F.concat_ws(", ", *[F.nullif(part, F.lit("")) for part in (city, region, country)])


def format_income(value: Column, unit: Column) -> Column:
    """``1.5, K PHP`` becomes ``PHP 1.5K``.

    A leading K or M is always read as the magnitude, so ``MYR`` prints as
    ``YR`` millions. Up to three decimals are printed.
    """
    name = F.trim(first_truthy(unit, F.lit("PHP")))
    magnitude = F.upper(F.regexp_extract(name, r"(?i)^(K|M)?\s*(.+)$", 1))
    currency = F.regexp_extract(name, r"(?i)^(K|M)?\s*(.+)$", 2)
    number = F.call_function("format_number", F.coalesce(value, F.lit(0.0)), F.lit("#,##0.###"))
    return F.concat(currency, F.lit(" "), number, magnitude)
