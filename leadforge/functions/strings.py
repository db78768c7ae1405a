"""Contact and text columns: phones, e-mails, names, CSV cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MOBILE = r"(?:\+?91[ -]?)?0?([6-9][0-9]{9})"
#: A number of the city, after its code.
CITY_CODE = "422"
LANDLINE = rf"(?<![0-9])(?:\+?91[ -]?)?0?{CITY_CODE}[ -]?([0-9]{{6,7}})\b"


def phone_key(value: Column) -> Column:
    """Digits for comparison: punctuation goes, and a leading 91 of twelve or 0 of eleven digits."""
    digits = F.regexp_replace(value, r"[\s\-().+]", "")
    return F.when(digits.rlike("^91[0-9]{10}$") | digits.rlike("^0[0-9]{10}$"), F.right(digits, F.lit(10))).otherwise(digits)


def email_key(value: Column) -> Column:
    return F.lower(F.trim(value))


def phone_shown(digits: Column) -> Column:
    """Ten-digit mobiles in two groups of five, other numbers as they are."""
    return F.when(digits.rlike("^[6-9][0-9]{9}$"), F.concat(F.lit("+91 "), F.substring(digits, 1, 5), F.lit(" "), F.substring(digits, 6, 5))).otherwise(digits)


def csv_cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def html_escaped(value: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), " +", "-"), "[^a-z0-9-]", "")


def tidy_name(value: Column) -> Column:
    """Agency name: no closing punctuation, single spaces, capital at each word's start, the rest as it is."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(value, r"[\s.,;:!|-]+$", ""), r"\s+", " "))
    return F.array_join(F.transform(F.split(clean, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def config_hash(config: Column, weights: Column) -> Column:
    return F.substring(F.sha2(F.concat(config, weights), 256), 1, 16)
