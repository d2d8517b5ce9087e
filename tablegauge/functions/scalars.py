"""Scalar expressions over single values: text forms, dates, masks and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text shown instead of a sensitive value.
MASK = "***"

# Date layouts tried in order. ISO comes first; day-first and month-first
# slashed dates are ambiguous, so only the order a caller passes decides between them.
DATE_LAYOUTS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy/MM/dd",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
)
# ISO 8601 date and time: seconds, a fraction of one to nine digits and a zone may be there or not.
ISO_TIME = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(\.\d{1,9})?(Z|[+-]\d{2}(?::?\d{2})?)?$"

# The words of an age text.
AGE_UNKNOWN = "Desconocido"
AGE_TODAY = "Hoy"
AGE_DAY, AGE_DAYS = "dia", "dias"
AGE_MONTH, AGE_MONTHS = "mes", "meses"
AGE_YEAR, AGE_YEARS = "año", "años"
DAYS_PER_MONTH, DAYS_PER_YEAR = 30, 365

# Analysis severities as stored on a persisted issue.
STORED_SEVERITY = {"critical": "critical", "high": "major", "medium": "minor", "low": "info"}
STORED_SEVERITY_DEFAULT = "minor"

# Lowest score of each label, best first.
SCORE_LABELS = ((0.98, "Excellent"), (0.95, "Good"), (0.90, "Acceptable"))
SCORE_LABEL_DEFAULT = "Poor"

# Words in a description that name the issue type, first hit wins.
TYPE_WORDS = (
    ("completeness", ("completeness",)),
    ("uniqueness", ("uniqueness", "duplicate")),
    ("consistency", ("consistency", "pattern")),
    ("outliers", ("outlier",)),
)
TYPE_DEFAULT = "general"


def mask_if(value: Column, column_name: str, sensitive: list[str] | None) -> Column:
    return F.lit(MASK) if column_name in (sensitive or []) else value


def mask_where(value: Column, condition: Column) -> Column:
    return F.when(condition, F.lit(MASK)).otherwise(value)


def integral_text(number: Column) -> Column:
    """Number as text without a trailing `.0`, so 658892118.0 reads 658892118."""
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(1e18))
    return F.when(whole, number.cast("decimal(20,0)").cast("string")).otherwise(float_text(number))


def float_text(number: Column) -> Column:
    """Shortest decimal text of a double: plain digits from 1e-4 up to 1e16, else an exponent."""
    size = F.abs(number)
    plain = number.try_cast("decimal(38,21)").cast("string")
    trimmed = F.regexp_replace(plain, r"0+$", "")
    digits = F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    scientific = F.split(number.cast("string"), "E")
    mantissa = F.regexp_replace(F.get(scientific, F.lit(0)), r"\.0$", "")
    power = F.get(scientific, F.lit(1)).cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    power_text = F.lpad(F.abs(power).cast("string"), 2, "0")
    power_text = F.when(F.abs(power) > 99, F.abs(power).cast("string")).otherwise(power_text)
    return (
        F.when(number == 0, F.lit("0.0"))
        .when((size >= F.lit(1e-4)) & (size < F.lit(1e16)), digits)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, power_text))
    )


def to_number(value: Column) -> Column:
    return value.try_cast("double")


def _layout_shape(layout: str) -> str:
    """Regex of the texts a layout can read: its letters are digits, the rest stands for itself."""
    bare = layout.replace("'", "")
    letters = "T" if "'T'" in layout else ""
    return "^" + "".join(r"\d" if c in "yMdHmsS" and c != letters else re.escape(c) for c in bare) + "$"


def to_timestamp(value: Column, layouts: tuple[str, ...] = DATE_LAYOUTS) -> Column:
    """Text to timestamp over explicit layouts; anything else becomes null.

    A cheap shape test runs first, so the parser only sees texts that can be dates.
    """
    text = F.trim(value)
    tried = [
        F.when(text.rlike(_layout_shape(layout)), F.try_to_timestamp(text, F.lit(layout)))
        for layout in layouts
    ]
    if layouts == DATE_LAYOUTS:
        tried.append(F.when(text.rlike(ISO_TIME), _iso_timestamp(text)))
    return F.coalesce(*tried)


def _iso_timestamp(text: Column) -> Column:
    """An ISO date and time; one without a zone is in the session's, digits below microseconds go."""
    part = lambda i: F.regexp_extract(text, ISO_TIME, i)
    seconds = F.when(part(3) == "", F.lit(":00")).otherwise(part(3))
    zone = F.regexp_replace(part(5), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    whole = F.concat(part(1), F.lit("T"), part(2), seconds, F.substring(part(4), 1, 7), zone)
    return F.when((part(3) != "") | (part(4) == ""), whole.try_cast("timestamp"))


def age_days(timestamp: Column, as_of: Column) -> Column:
    """Whole days from `timestamp` to `as_of`, rounded down."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(timestamp.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("bigint")


def _plural(count: Column, one: str, many: str) -> Column:
    return F.concat(
        count.cast("string"), F.lit(" "), F.when(count > 1, F.lit(many)).otherwise(F.lit(one))
    )


def age_text(days: Column) -> Column:
    """Human age: days, months of 30 days with the days left, years of 365 with the months left."""
    months = F.floor(days / DAYS_PER_MONTH).cast("bigint")
    days_left = days % DAYS_PER_MONTH
    years = F.floor(days / DAYS_PER_YEAR).cast("bigint")
    months_left = F.floor((days % DAYS_PER_YEAR) / DAYS_PER_MONTH).cast("bigint")

    def joined(head: Column, tail_count: Column, tail: Column) -> Column:
        return F.when(tail_count > 0, F.concat(head, F.lit(" y "), tail)).otherwise(head)

    return (
        F.when(days.isNull(), F.lit(AGE_UNKNOWN))
        .when(days == 0, F.lit(AGE_TODAY))
        .when(days == 1, F.lit(f"1 {AGE_DAY}"))
        .when(days < DAYS_PER_MONTH, F.concat(days.cast("string"), F.lit(f" {AGE_DAYS}")))
        .when(
            days < DAYS_PER_YEAR,
            joined(
                _plural(months, AGE_MONTH, AGE_MONTHS),
                days_left,
                _plural(days_left, AGE_DAY, AGE_DAYS),
            ),
        )
        .otherwise(
            joined(
                _plural(years, AGE_YEAR, AGE_YEARS),
                months_left,
                _plural(months_left, AGE_MONTH, AGE_MONTHS),
            )
        )
    )


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def percent_text(share: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f%%", F.round(share * 100, decimals))


def score_label(score: Column) -> Column:
    label = F.lit(SCORE_LABEL_DEFAULT)
    for lowest, name in reversed(SCORE_LABELS):
        label = F.when(score >= lowest, F.lit(name)).otherwise(label)
    return F.when(score.isNotNull(), label)


def duration_text(started: Column, completed: Column) -> Column:
    """Seconds, minutes and seconds, or hours and minutes between two instants; N/A if open."""
    seconds = F.floor(
        (F.unix_micros(completed.cast("timestamp")) - F.unix_micros(started.cast("timestamp")))
        / F.lit(1_000_000.0)
    ).cast("bigint")
    minutes = F.floor(seconds / 60).cast("bigint")
    hours = F.floor(seconds / 3600).cast("bigint")
    return (
        F.when(seconds.isNull(), F.lit("N/A"))
        .when(seconds < 60, F.format_string("%d seconds", seconds))
        .when(seconds < 3600, F.format_string("%d minutes %d seconds", minutes, seconds % 60))
        .otherwise(
            F.format_string(
                "%d hours %d minutes", hours, F.floor((seconds % 3600) / 60).cast("bigint")
            )
        )
    )


def stored_severity(severity: Column) -> Column:
    mapped = F.lit(STORED_SEVERITY_DEFAULT)
    for name, stored in STORED_SEVERITY.items():
        mapped = F.when(severity == name, F.lit(stored)).otherwise(mapped)
    return mapped


def issue_type_from_text(description: Column) -> Column:
    """Issue type named by the words of a description, `general` when none is found."""
    lowered = F.lower(description)
    guess = F.lit(TYPE_DEFAULT)
    for name, words in reversed(TYPE_WORDS):
        hit = lowered.contains(words[0])
        for word in words[1:]:
            hit = hit | lowered.contains(word)
        guess = F.when(hit, F.lit(name)).otherwise(guess)
    return guess
