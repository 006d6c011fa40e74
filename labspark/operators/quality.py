"""Checks of an upload batch. Issues are rows: stage, code, column, line range."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.functions.text import clean_specimen, first_token, is_blank, lower_strip, strip
from labspark.functions.values import parse_date
from labspark.operators.numbering import line_ranges
from labspark.operators.reshape import ANSWER_PREFIX, RESULT_PREFIX, columns_with_prefix, quoted
from labspark.session import checkpointed
from labspark.sources.stored import IdentityIndex

# Columns and limits of an upload file.
MIN_ROWS = 300
REQUIRED = (
    "hn", "date_of_submission", "report_issued_date", "species", "bacteria_genus", "submitted_sample", "vitek_id",
)
DATES = ("date_of_submission", "report_issued_date")
IDENTITY = (
    "hn", "date_of_submission", "species", "submitted_sample", "bacteria_genus", "report_issued_date",
)
PREFIXES = (RESULT_PREFIX, ANSWER_PREFIX)

ISSUES = "stage_no int, stage string, code string, column string, lo long, hi long, lines string"
MALFORMED = "malformed_record"  # raw text of a record with too few or too many cells
_DERIVED = ("line_no", MALFORMED)


def _from_rows(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ISSUES)


def amount_issues(df: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    few = df.agg(F.count("*").alias("n")).filter(F.col("n") < min_rows)
    return few.select(
        F.lit(1).alias("stage_no"), F.lit("amount").alias("stage"), F.lit("too_few_rows").alias("code"),
        F.lit(None).cast("string").alias("column"), F.lit(None).cast("long").alias("lo"),
        F.lit(None).cast("long").alias("hi"), F.lit(None).cast("string").alias("lines"),
    )


def column_issues(df: DataFrame) -> DataFrame:
    """Missing columns, missing prefixes and unexpected columns; looks at the header only."""
    present = [c for c in df.columns if c not in _DERIVED]
    rows = [(2, "column", "missing_column", c, None, None, None) for c in REQUIRED if c not in present]
    rows += [
        (2, "column", "missing_prefix", p, None, None, None)
        for p in PREFIXES
        if not any(c.startswith(p) for c in present)
    ]
    rows += [
        (2, "column", "unexpected_column", c, None, None, None)
        for c in present
        if c not in REQUIRED and not c.startswith(PREFIXES)
    ]
    return _from_rows(df.sparkSession, rows)


def failing_lines(df: DataFrame, checks: list[tuple[str, str, Column]], line: str = "line_no") -> DataFrame:
    """One row per line and failed check; all checks run in a single scan."""
    found = F.array_compact(
        F.array(
            *[
                F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(column).cast("string").alias("column")))
                for code, column, bad in checks
            ]
        )
    )
    return df.select(F.col(line), F.explode(found).alias("f")).select(line, "f.code", "f.column")


def blank_checks(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str, Column]]:
    columns = columns or [*REQUIRED, *columns_with_prefix(df, ANSWER_PREFIX)]
    return [("blank", c, is_blank(F.col(quoted(c)).cast("string"))) for c in columns]


def date_checks(columns: tuple[str, ...] = DATES) -> list[tuple[str, str, Column]]:
    return [
        ("bad_date", c, ~is_blank(F.col(quoted(c))) & parse_date(F.col(quoted(c))).isNull()) for c in columns
    ]


def flag_checks(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, str, Column]]:
    columns = columns or columns_with_prefix(df, ANSWER_PREFIX)
    return [
        (
            "bad_flag", c,
            ~F.coalesce(F.lower(F.col(quoted(c)).cast("string")).isin("true", "false"), F.lit(False)),
        )
        for c in columns
    ]


def panel_checks(panel: str, column: str = "vitek_id") -> list[tuple[str, str, Column]]:
    value = F.col(quoted(column))
    return [("wrong_panel", column, ~is_blank(value) & (F.upper(strip(value)) != panel))]


def with_ranges(lines: DataFrame, stage_no: int, stage: str, line: str = "line_no") -> DataFrame:
    return line_ranges(lines, ["code", "column"], line).select(
        F.lit(stage_no).alias("stage_no"), F.lit(stage).alias("stage"), "code", "column", "lo", "hi",
        F.col("text").alias("lines"),
    )


def value_faults(df: DataFrame, panel: str) -> DataFrame:
    """Lines with a blank cell, bad date, bad flag or wrong panel, and records that do not fit the header."""
    checks = blank_checks(df) + date_checks() + flag_checks(df) + panel_checks(panel)
    if MALFORMED in df.columns:
        checks = [("malformed_line", None, F.col(MALFORMED).isNotNull()), *checks]
    return failing_lines(df, checks)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row; counted before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def semi_on(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `df` whose key values occur in `other`; nulls equal nulls."""
    right = other.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return df.join(right, same, "left_semi")


def duplicates_in_batch(df: DataFrame, keys: list[str]) -> DataFrame:
    """All members of duplicate groups."""
    return semi_on(df, duplicate_keys(df, keys), keys)


def identity(df: DataFrame, raw: bool = True) -> dict[str, Column]:
    """Comparable identity columns: days for dates, cleaned sample, lower-case text."""
    columns = {}
    for c in IDENTITY:
        value = F.col(quoted(c))
        if c in DATES:
            columns[f"_id_{c}"] = parse_date(value).cast("string") if raw else value.cast("date").cast("string")
        elif c == "submitted_sample":
            columns[f"_id_{c}"] = clean_specimen(value) if raw else lower_strip(value)
        elif c == "bacteria_genus":
            columns[f"_id_{c}"] = first_token(lower_strip(value))
        else:
            columns[f"_id_{c}"] = lower_strip(value.cast("string"))
    return columns


def duplicates_of_stored(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in the stored table; its keys are made distinct first."""
    return semi_on(df, stored.select(*keys).distinct(), keys)


def duplicate_faults(df: DataFrame, stored: DataFrame | IdentityIndex | None) -> DataFrame:
    """Lines that repeat another line of the batch or a stored report (both brought to one form).

    With an index of stored identities only its parts that the lines fall into are read.
    """
    tag = lambda rows, code: rows.select(
        "line_no", F.lit(code).alias("code"), F.lit(None).cast("string").alias("column")
    )
    lines = tag(duplicates_in_batch(df, list(IDENTITY)), "duplicate_in_batch")
    if isinstance(stored, IdentityIndex):
        lines = lines.unionByName(tag(stored.repeated(df.withColumns(identity(df))), "duplicate_of_stored"))
    elif stored is not None:
        keys = list(identity(df))
        old = stored.select(*[c.alias(n) for n, c in identity(stored, raw=False).items()])
        lines = lines.unionByName(
            tag(duplicates_of_stored(df.withColumns(identity(df)), old, keys), "duplicate_of_stored")
        )
    return lines


def quality_report(
    df: DataFrame, panel: str, stored: DataFrame | IdentityIndex | None = None, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Issues of the first stage that has any: amount, column, value, duplicate.

    Later stages do not run once one has failed; no rows means the batch may be loaded.
    """
    for issues in (amount_issues(df, min_rows), column_issues(df)):
        if not issues.isEmpty():
            return issues
    faults = checkpointed(value_faults(df, panel))  # one scan for the decision and the ranges
    if not faults.isEmpty():
        return with_ranges(faults, 3, "value")
    return with_ranges(duplicate_faults(df, stored), 4, "duplicate")


def new_values(values: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values the known table lacks."""
    incoming = values.select(column).filter(F.col(column).isNotNull()).distinct()
    return incoming.join(known.select(column).distinct(), column, "left_anti")


def new_columns(df: DataFrame, known: list[str]) -> DataFrame:
    """New result columns with at least one value, new answer columns with at least one true."""
    fresh = [c for c in columns_with_prefix(df, *PREFIXES) if c not in known]
    if not fresh:
        return df.sparkSession.createDataFrame([], "kind string, value string")

    def used(c: str) -> Column:
        text = F.col(quoted(c)).cast("string")
        return F.max(~is_blank(text) if c.startswith(RESULT_PREFIX) else F.lower(text) == "true")

    seen = df.agg(F.array(*[F.struct(used(c).alias("used"), F.lit(c).alias("value")) for c in fresh]).alias("c"))
    return seen.select(F.inline("c")).filter("used").select(
        F.when(F.col("value").startswith(RESULT_PREFIX), "result_column").otherwise("answer_column").alias("kind"),
        "value",
    )


def new_value_report(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Warnings (kind, value): genus, sample and drug columns not seen before."""
    forms = {
        "bacteria_genus": lambda c: c,  # compared as written
        "submitted_sample": clean_specimen,
    }
    parts = [
        new_values(df.select(form(F.col(c)).alias("value")), stored.select(F.col(c).alias("value")), "value").select(
            F.lit(c).alias("kind"), "value"
        )
        for c, form in forms.items()
    ]
    return reduce(DataFrame.unionByName, parts).unionByName(new_columns(df, stored.columns))

