"""Scalar conversions and small text expressions, all as JVM-side columns.

Every function takes and returns columns; what cannot be read becomes null unless stated otherwise.
White space means Unicode white space, as the sources strip it. ``clean`` says that a column is trimmed and not empty already, which
keeps the pattern out of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_SPACE = r"(?U)^\s+|\s+$"

# Fixed words of yes/no fields.
TRUE_WORDS = ("t", "true", "y", "yes", "1")
FALSE_WORDS = ("f", "false", "n", "no", "0")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def clean_field(c: Column) -> Column:
    """Trimmed field, empty as null."""
    return F.nullif(strip(c), F.lit(""))


def day_of_digits(c: Column) -> Column:
    """Date of eight digits yyyymmdd; null if there is no such day."""
    return F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2)).try_cast("date")


def partial_date(c: Column, clean: bool = False) -> tuple[Column, Column, Column]:
    """(raw, precision, exact) of a date that may hold 8, 6 or 4 digits.

    precision is day, month, year or invalid, null for a blank; only a day gives an exact date. Years run from 1900 to 2100.
    """
    raw = c if clean else clean_field(c)
    year_ok = F.substring(raw, 1, 4).try_cast("int").between(1900, 2100)
    month_ok = F.substring(raw, 5, 2).try_cast("int").between(1, 12)
    digits = raw.rlike("^[0-9]+$")
    n = F.length(raw)
    exact = F.when(digits & (n == 8) & year_ok, day_of_digits(raw))
    prec = (
        F.when(raw.isNull(), None)
        .when(exact.isNotNull(), "day")
        .when(digits & (n == 6) & year_ok & month_ok, "month")
        .when(digits & (n == 4) & year_ok, "year")
        .otherwise("invalid")
    )
    return raw, prec, exact


def iso_date(c: Column, clean: bool = False) -> Column:
    """Date from the first ten characters."""
    head = F.substring(c if clean else strip(c), 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), head.try_cast("date"))


def iso_timestamp(c: Column, clean: bool = False) -> Column:
    """Timestamp; text without zone is UTC (the session's zone is pinned to it)."""
    return (c if clean else strip(c)).try_cast("timestamp")


def integer(c: Column, clean: bool = False) -> Column:
    """Whole number; a decimal is cut towards zero; infinities and words are null."""
    text = c if clean else strip(c)
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def number(c: Column, clean: bool = False) -> Column:
    return (c if clean else strip(c)).try_cast("double")


def boolean(c: Column, clean: bool = False) -> Column:
    word = F.lower(c if clean else strip(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def compact_day(c: Column) -> Column:
    """Timestamp of a yyyymmdd day."""
    text = strip(c)
    return F.when(text.rlike("^[0-9]{8}$"), day_of_digits(text).cast("timestamp"))


def day_or_month(c: Column) -> Column:
    """Timestamp of a yyyy-mm-dd day, or of the first day of a yyyy-mm month."""
    text = strip(c)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(day, F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd"))))


def first_text(c: Column) -> Column:
    """First element of an array of strings, else the empty string."""
    return F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))


def join_texts(*arrays: Column) -> Column:
    """All non-blank strings of some arrays, stripped and joined by blanks."""
    parts = [F.coalesce(F.transform(a, strip), F.array().cast("array<string>")) for a in arrays]
    return F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def age_of(at: Column, now: Column) -> Column:
    """How long ago, in words: never, just now, minutes, hours or days."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(at)
    amount = lambda unit, letter: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{letter} ago"))
    return (
        F.when(at.isNull(), "never")
        .when(seconds < 0, "just now")
        .when(seconds < 3600, amount(60, "m"))
        .when(seconds < 86400, amount(3600, "h"))
        .otherwise(amount(86400, "d"))
    )


def excerpt(c: Column, heading: str, before: int = 0, length: int = 700) -> Column:
    """Up to ``length`` characters from where the heading stands (else from the start), white space collapsed."""
    text = F.regexp_replace(c, r"(?U)\s+", " ")
    at = F.locate(heading.lower(), F.lower(text))
    return strip(F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(length)))


def redact_secret(c: Column, names: str = "api_key|apikey|key|token") -> Column:
    """URL with the values of secret parameters masked."""
    return F.regexp_replace(c, rf"(?i)([?&](?:{names})=)[^&#\s]*", "$1***")


def key_digest(c: Column) -> Column:
    return F.sha2(F.trim(c), 256)


def set_flags(flags: dict[str, Column]) -> Column:
    """Names of the flags whose column is the text 1, in the given order."""
    return F.array_compact(F.array(*[F.when(c == "1", name) for name, c in flags.items()]))


def safe_ratio(part: Column, whole: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(default))


def half_up(c: Column) -> Column:
    """Whole number by rounding halves away from zero."""
    return F.round(c).cast("int")
