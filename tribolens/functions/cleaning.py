"""Scalar cleaning expressions. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tribolens.functions import fixed_values as fv

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_HOUR = 3_600_000_000


def lookup(mapping: dict) -> Column:
    """Literal map column from a small dictionary."""
    return F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])


def strip(text: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks.

    A text that begins and ends with a visible ASCII character, as most do, is not searched for them.
    """
    text = text.cast("string")
    last, low, high = F.right(text, F.lit(1)), F.lit("!"), F.lit("\x7f")
    plain = (text >= low) & (text < high) & (last >= low) & (last < high)
    return F.when(plain, text).otherwise(F.trim(text, F.lit(fv.WHITE_SPACE)))


def known(text: Column) -> Column:
    """Trimmed text in which blank and spelled-out missing markers become NULL."""
    return F.when(~text.isin(fv.BLANK_TEXTS), text)


def identifier(value: Column) -> Column:
    """Text, trimmed, with missing markers as NULL."""
    return known(strip(value))


def component_code(value: Column) -> Column:
    """Upper-case code with `_` for other characters, common aliases folded."""
    upper = F.upper(identifier(value))
    # Codes without other characters are the common case and need no replacement.
    code = F.when(~upper.rlike("[^A-Z0-9]"), upper).otherwise(
        F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", "_"), F.lit("_")))
    return F.coalesce(F.try_element_at(lookup(fv.COMPONENT_ALIASES), code), code)


NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def number(value: Column) -> Column:
    """Double, with text that is no number and NaN folded into NULL.

    The cast alone would also take type suffixes and hexadecimal floats, as in the asset code `12D`.
    """
    parsed = value.try_cast("double")
    # The type of a column is known to the optimizer, which leaves one of the branches.
    plain = F.when(F.typeof(value) != "string", parsed).when(value.cast("string").rlike(NUMBER), parsed)
    return F.nanvl(plain, F.lit(None).cast("double"))


def finite_or(value: Column, default: float | None) -> Column:
    """Finite double, otherwise the default."""
    parsed = number(value)
    finite = F.when(F.abs(parsed) != F.lit(float("inf")), parsed)
    return finite if default is None else F.coalesce(finite, F.lit(default))


def text_or(value: Column, default: str = "") -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def flag(value: Column, default: bool = False) -> Column:
    """Spreadsheet boolean; any other non-blank text counts as true."""
    text = F.upper(strip(value))
    return (
        F.when(text.isNull(), F.lit(default))
        .when(text.isin(fv.TRUE_TEXTS), F.lit(True))
        .when(text.isin(fv.FALSE_TEXTS), F.lit(False))
        .otherwise(F.lit(True))
    )


def has_value(value: Column) -> Column:
    """True when the cell holds something other than a missing marker."""
    return F.coalesce(~strip(value).isin(fv.BLANK_TEXTS), F.lit(False))


def is_high_priority(value: Column) -> Column:
    return F.coalesce(F.upper(value.cast("string")).isin(fv.TRUE_TEXTS), F.lit(False))


def capitalised(value: Column, default: str) -> Column:
    """First letter upper, the rest lower (not per word)."""
    text = strip(value)
    return F.coalesce(F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2)))), F.lit(default))


def component_label(value: Column) -> Column:
    """Display name of a component code."""
    raw = F.upper(strip(F.coalesce(value, F.lit("Unknown"))))
    raw = F.when(raw == "", F.lit("UNKNOWN")).otherwise(raw)
    return F.coalesce(F.try_element_at(lookup(fv.COMPONENT_LABELS), raw), F.initcap(F.replace(raw, F.lit("_"), F.lit(" "))))


def matches(text: Column, pattern: str) -> Column:
    """Unanchored, case-insensitive search in which `.` stops only at a line feed."""
    return text.rlike("(?id)" + pattern)


def timestamp(value: Column, dtype: T.DataType) -> Column:
    """Zone-free timestamp from a date, a timestamp or trimmed text in one of the listed layouts, otherwise NULL."""
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return value.cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    text = value
    iso = F.replace(text, F.lit("/"), F.lit("-"))

    def first_of(*layouts: str) -> Column:
        return F.coalesce(*(F.try_to_timestamp(text, F.lit(x)) for x in layouts)).cast("timestamp_ntz")

    def with_times(day: str) -> list[str]:
        return [f"{day}{time}" for time in ("", " H:mm[:ss]", " H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]", " h:mm[:ss] a")]

    return (
        F.when(text.rlike(r"(?i)^\d{4}-\d{1,2}-\d{1,2}\s.*[ap]m$"), first_of("yyyy-M-d h:mm[:ss] a"))
        .when(text.rlike(r"(?i)^\d{4}/\d{1,2}/\d{1,2}\s.*[ap]m$"), first_of("yyyy/M/d h:mm[:ss] a"))
        .when(text.rlike(r"^\d{4}([-/])\d{1,2}\1\d{1,2}"), iso.try_cast("timestamp_ntz"))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), first_of(*with_times("M/d/yyyy")))
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}(\s|$)"), first_of(*with_times("M/d/yy")))
        .when(text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}"), first_of(*with_times("d-MMM-yyyy")))
        .when(text.rlike(r"^\d{8}$"), first_of("yyyyMMdd"))
    )


def trimmed_timestamp(value: Column, dtype: T.DataType) -> Column:
    return timestamp(strip(value) if isinstance(dtype, T.StringType) else value, dtype)


def is_time_only(text: Column) -> Column:
    """A bare clock time, which must never be read as a date."""
    return F.coalesce(text.rlike(fv.TIME_ONLY_PATTERN), F.lit(False))


def date_in_range(parsed: Column) -> Column:
    return F.year(parsed).between(fv.FIRST_YEAR, fv.LAST_YEAR)


def date_issue(text: Column, parsed: Column) -> Column:
    """Why a calendar date is not usable, or NULL; takes the trimmed text and what it parsed to."""
    return (
        F.when(text.isNull() | (text == ""), F.lit(fv.DATE_MISSING))
        .when(is_time_only(text), F.lit(fv.DATE_TIME_ONLY))
        .when(parsed.isNull(), F.lit(fv.DATE_UNPARSEABLE))
        .when(~date_in_range(parsed), F.lit(fv.DATE_OUT_OF_RANGE))
    )


def micros(moment: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, without passing through a session time zone."""
    in_day = (
        F.hour(moment).cast("long") * 3_600_000_000
        + F.minute(moment).cast("long") * 60_000_000
        + (F.extract(F.lit("SECOND"), moment) * 1_000_000).cast("long")
    )
    return F.unix_date(F.to_date(moment)).cast("long") * MICROS_PER_DAY + in_day


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days of elapsed time, rounded down."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(MICROS_PER_DAY)).cast("long")


def null_skipping_sum(*parts: Column) -> Column:
    """Sum of the parts that are present; NULL when none is."""
    total = F.coalesce(parts[0], F.lit(0.0))
    for part in parts[1:]:
        total = total + F.coalesce(part, F.lit(0.0))
    return F.when(F.coalesce(*parts).isNotNull(), total)
