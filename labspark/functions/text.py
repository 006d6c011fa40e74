"""Text rules as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The specimen-site rules must use exactly these words, in this order.
UNKNOWN_SITES = ("", "unk")
SITE_PHRASES = {"open wound": "opened wound", "bited wound": "bite wound"}
SITE_CUTS = ("(", "/", "@", " at ", " or ")
SITE_SIDES = ("right ", "rt.", "r.", "rt ", "left ", "lt.", "l.", "lt ")

# Texts a CSV reader takes as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


# The characters taken as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends (trim() alone only removes blanks)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def lower_strip(col: Column) -> Column:
    return strip(F.lower(col))


def first_token(col: Column) -> Column:
    """First word; null for a text without any word."""
    return F.nullif(F.regexp_extract(col, f"[^{WHITE_SPACE}]+", 0), F.lit(""))


def is_blank(col: Column) -> Column:
    """Null, empty or white space only."""
    return col.isNull() | (strip(col) == "")


def blank_to_null(col: Column) -> Column:
    return F.when(~is_blank(col), col)


def missing_to_null(col: Column) -> Column:
    return F.when(~col.isin(*MISSING_TOKENS), col)


def clean_specimen(col: Column) -> Column:
    """Reduce a free-text specimen site to its base name."""
    text = lower_strip(col)
    site = text
    for cut in SITE_CUTS:
        site = strip(F.substring_index(site, cut, 1))
    for side in SITE_SIDES:
        site = strip(F.replace(site, F.lit(side), F.lit("")))
    named = F.when(text.isin(*UNKNOWN_SITES), F.lit("unknown"))
    for phrase, name in SITE_PHRASES.items():
        named = named.when(text.contains(phrase), F.lit(name))
    return named.otherwise(site)


def file_safe(col: Column) -> Column:
    """Drug name as used in file names."""
    return F.translate(col, "/", "_")


def display_name(col: Column) -> Column:
    return F.translate(col, "_", "/")


def parse_list(col: Column) -> Column:
    """A stored list text such as ['a', 'b'] as array<string>; null when malformed."""
    return F.from_json(col, "array<string>", {"allowSingleQuotes": "true"})


def assignments(columns: list[str]) -> Column:
    """Render columns as "name = value, name = value"; a null value prints as null."""
    return F.concat_ws(
        ", ",
        *[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in columns],
    )
