"""Column types of text tables, found in one aggregate over all cells.

A cell is null, boolean, integer, decimal, date, timestamp or text. A column takes the
least type that holds all its cells: null below all, integer below decimal, date below
timestamp, text above all. No digit and no leading zero is lost: a number written with
leading zeros is text, and a number too long for a double is an exact decimal or text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators.reshape import quoted

# Kinds of cells as bits, so that a column's kinds are one bit_or.
BOOLEAN, INTEGER, DECIMAL, DATE, TIMESTAMP, TEXT = (1 << i for i in range(6))

_BOOLEAN = r"^(?i:true|false)$"
_INTEGER = r"^[+-]?(?:0|[1-9]\d*)$"
_DECIMAL = r"^[+-]?(?:0|[1-9]\d*)\.\d+$"
_FLOAT = r"^[+-]?(?:0|[1-9]\d*)(?:\.\d+)?[eE][+-]?\d{1,3}$"
_DATE = r"^\d{4}-\d\d-\d\d$"
_TIMESTAMP = r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:\.\d{1,6})?$"
#: Digits that a double holds exactly, and that a decimal may have.
_DOUBLE_DIGITS, _DECIMAL_DIGITS = 15, 38
_LONG_DIGITS = 18


@dataclass(frozen=True)
class Cells:
    """What a column's cells are: kinds as bits, most digits before and after the point, whether exponents occur."""

    kinds: int
    whole: int
    fraction: int
    exponent: bool

    def type(self) -> str:
        """The least type that holds all cells; a column without values is text."""
        if self.kinds == BOOLEAN:
            return "boolean"
        if self.kinds == INTEGER and self.whole <= _LONG_DIGITS:
            return "bigint"
        if self.kinds and not self.kinds & ~(INTEGER | DECIMAL):
            return self._number()
        if self.kinds == DATE:
            return "date"
        if self.kinds in (TIMESTAMP, DATE | TIMESTAMP):
            return "timestamp"
        return "string"

    def _number(self) -> str:
        digits = self.whole + self.fraction
        if self.exponent or (digits <= _DOUBLE_DIGITS and self.fraction):
            return "double" if digits <= _DOUBLE_DIGITS else "string"
        return f"decimal({digits},{self.fraction})" if digits <= _DECIMAL_DIGITS else "string"


def kind(cell: Column) -> Column:
    """The kind of a cell as a bit, 0 for null. A date must be a day of the calendar."""
    number = cell.rlike(_DECIMAL) | cell.rlike(_FLOAT)
    # No number and no date begins with another character than these; most texts are told by it.
    numeric = F.ascii(cell).between(ord("+"), ord("9"))
    return (
        F.when(cell.isNull(), 0)
        .when(~numeric, F.when(cell.rlike(_BOOLEAN), BOOLEAN).otherwise(TEXT))
        .when(cell.rlike(_INTEGER), INTEGER)
        .when(number, DECIMAL)
        .when(cell.rlike(_DATE) & cell.try_cast("date").isNotNull(), DATE)
        .when(cell.rlike(_TIMESTAMP) & cell.try_cast("timestamp").isNotNull(), TIMESTAMP)
        .otherwise(TEXT)
    )


def cells(df: DataFrame, columns: list[str]) -> dict[str, Cells]:
    """One aggregate over all cells of the text columns, as rows of place and cell: one small expression looks at each cell once.

    One row per column reaches the driver.
    """
    if not columns:
        return {}
    long = df.select(F.posexplode(F.array(*[F.col(quoted(c)) for c in columns])).alias("at", "cell")).filter("cell is not null")
    told = long.select("at", "cell", kind(F.col("cell")).alias("kind"))
    number = F.col("kind").isin(INTEGER, DECIMAL)
    exponent = F.col("cell").contains("e") | F.col("cell").contains("E")
    unsigned = F.when(F.substring("cell", 1, 1).isin("+", "-"), F.expr("substring(cell, 2)")).otherwise(F.col("cell"))
    mantissa = F.when(exponent, F.substring_index(F.substring_index(unsigned, "e", 1), "E", 1)).otherwise(unsigned)
    parts = told.select(
        "at", "kind", F.when(number, mantissa).alias("digits"), ((F.col("kind") == DECIMAL) & exponent).alias("exponent")
    )
    point = F.instr("digits", ".")
    found = parts.select("at", "kind", F.length("digits").alias("length"), point.alias("point"), "exponent").groupBy("at").agg(
        F.bit_or("kind").alias("kinds"),
        F.max(F.when(F.col("point") > 0, F.col("point") - 1).otherwise(F.col("length"))).alias("whole"),
        F.max(F.when(F.col("point") > 0, F.col("length") - F.col("point"))).alias("fraction"),
        F.max("exponent").alias("exponent"),
    )
    rows = {r["at"]: Cells(r["kinds"], r["whole"] or 0, r["fraction"] or 0, r["exponent"]) for r in found.collect()}
    return {c: rows.get(i, Cells(0, 0, 0, False)) for i, c in enumerate(columns)}


def inferred(df: DataFrame, keep_text: list[str] | None = None) -> DataFrame:
    """`df` with every text column in the least type that holds its cells.

    Columns named in `keep_text` and columns that are no texts stay as they are. A column
    without values stays text. The scan runs once for the types; the cast is part of the
    next plan. An empty table stays all text.
    """
    texts = [c for c, t in df.dtypes if t == "string" and c not in (keep_text or [])]
    types = {c: found.type() for c, found in cells(df, texts).items()}
    return df.select(*[F.col(quoted(c)).cast(types[c]).alias(c) if types.get(c, "string") != "string" else F.col(quoted(c)) for c in df.columns])
