"""Symbols, dates, rounding, maps and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labspark.functions.text import lower_strip, strip

# Symbols of a result cell, their stored names and types.
SYMBOLS = ("+", "-", "S", "I", "R")
SYMBOL_NAMES = {"+": "POS", "-": "NEG"}
SIGN_TYPE, SIR_TYPE = 1, 2
SUB_TYPES = (
    (1, 1, "POS"),
    (2, 1, "NEG"),
    (3, 2, "S"),
    (4, 2, "I"),
    (5, 2, "R"),
)
PANELS = {1: "GN", 2: "GP"}

# Month names; a text may have the first three letters instead.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)
_NAMES = "(?i:" + "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in MONTHS) + ")"
_SHORT = "(?i:" + "|".join(m[:3] for m in MONTHS) + ")"
_TIME_OF_DAY = r"(?:[Tt]|\s+)(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:[.,]\d{1,9})?)?(?:[Zz]|[+-]\d\d:?\d\d)?$"
_PLAIN_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
DISPLAY_FORMAT = "dd-MMM-yyyy HH:mm:ss"


def recode(col: Column, mapping: dict[str, str]) -> Column:
    """Replace mapped values, keep all others."""
    result = None
    for old, new in mapping.items():
        result = (F if result is None else result).when(col == old, F.lit(new))
    return col if result is None else result.otherwise(col)


def symbol_to_name(col: Column) -> Column:
    return recode(col, SYMBOL_NAMES)


def name_to_symbol(col: Column) -> Column:
    return recode(col, {name: symbol for symbol, name in SYMBOL_NAMES.items()})


def _day(*parts: Column) -> Column:
    return F.concat_ws("-", *parts).try_cast("date")


def _month_number(name: Column) -> Column:
    """1 to 12 from the first three letters of a month's name."""
    at = F.call_function("locate", F.lower(F.substring(name, 1, 3)), F.lit("".join(m[:3] for m in MONTHS)))
    return ((at + 2) / 3).cast("int").cast("string")


def _written_day(text: Column) -> Column:
    """Day of a text without time of day; one pattern decides how it is read. Month first, day first where the first number is no month."""
    numbers, named, month_first = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$", rf"^(\d{{1,2}})(?: ({_NAMES}) |-({_SHORT})-)(\d{{4}})$", rf"^({_NAMES}) (\d{{1,2}}),? (\d{{4}})$"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(text, pattern, group)

    a, b, year = part(numbers, 1), part(numbers, 3), part(numbers, 4)
    return (
        F.when(text.rlike(_PLAIN_DAY), text.try_cast("date"))
        .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.translate(text, "/", "-").try_cast("date"))
        .when(text.rlike(r"^\d{8}$"), _day(F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
        .when(text.rlike(numbers), F.coalesce(_day(year, a, b), _day(year, b, a)))
        .when(text.rlike(month_first), _day(part(month_first, 3), _month_number(part(month_first, 1)), part(month_first, 2)))
        .when(text.rlike(named), _day(part(named, 4), _month_number(F.concat(part(named, 2), part(named, 3))), part(named, 1)))
    )


def parse_date(col: Column) -> Column:
    """Day of a date text in one of the accepted forms, with or without a time of day, else null.

    Accepted are year-month-day with hyphens, slashes or nothing between, month/day/year and
    day/month/year with slashes or hyphens, and days with a month's name before or after.
    """
    text = strip(col)
    return F.when(text.rlike(_PLAIN_DAY), text.try_cast("date")).otherwise(
        F.get(F.transform(F.array(F.regexp_replace(text, _TIME_OF_DAY, "")), _written_day), F.lit(0))
    )


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def display_time(col: Column) -> Column:
    return F.coalesce(F.date_format(col, DISPLAY_FORMAT), F.lit("-"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two times, days included."""
    return F.floor(F.unix_timestamp(end)).cast("long") - F.floor(F.unix_timestamp(start)).cast("long")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, 0 where bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def percent(score: Column) -> Column:
    return F.round(score * 100, 2)


def round_vector(col: Column) -> Column:
    """Each component to the nearest integer, halves to the even one."""
    return F.transform(col, lambda x: F.bround(x).cast("int"))


def interpolate(start: Column, end: Column, gap: Column) -> Column:
    """start + gap * (end - start), component by component."""
    return F.zip_with(start, end, lambda a, b: a + gap * (b - a))


def normalise_results(results: Column, prefix: str = "S/I/R_") -> Column:
    """Drug -> symbol map of a scoring request: keys lower and stripped, symbols upper."""
    # A key that is given twice in different spelling keeps the last value.
    entries = F.transform(
        F.map_entries(results),
        lambda e: F.struct(
            F.concat(F.lit(prefix), lower_strip(e["key"])).alias("key"),
            name_to_symbol(F.upper(e["value"])).alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(
        keys,
        lambda k: F.element_at(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]), -1),
    )
    return F.map_from_arrays(keys, last)
