"""Dimension lookups, get-or-create members and surrogate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labspark.operators.numbering import number_rows
from labspark.session import bounded, small


def lookup_or_other(
    facts: DataFrame, column: str, dimension: DataFrame, id_name: str, other: str = "other"
) -> DataFrame:
    """Add the id of a dimension member; names the dimension lacks get the id of `other`.

    `dimension` has the columns id and name.
    """
    fallback = dimension.filter(F.col("name") == other).agg(F.min("id")).first()[0]
    if fallback is None:
        raise ValueError(f"the dimension has no member {other!r}")
    names = bounded(dimension.select(F.col("name").alias(column), F.col("id").alias("_found")))
    return (
        facts.join(names, column, "left")
        .withColumn(id_name, F.coalesce(F.col("_found"), F.lit(fallback)))
        .drop("_found")
    )


def new_members(facts: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    """Distinct non-null values of a fact column that the dimension lacks, as `name`."""
    names = facts.select(F.col(column).alias("name")).filter("name is not null").distinct()
    return names.join(dimension.select("name").distinct(), "name", "left_anti")


def assign_keys(names: DataFrame, dimension: DataFrame, name: str = "name") -> DataFrame:
    """Number new members after the largest id in use, in name order."""
    last = dimension.agg(F.max("id")).first()[0] or 0
    few = small(names)
    if few is not None:
        number = F.row_number().over(Window.orderBy(name)) + F.lit(last)
        return few.withColumn("id", number.cast("long"))
    return number_rows(names, [F.col(name)], "id", start=last + 1)


def get_or_create(facts: DataFrame, column: str, dimension: DataFrame) -> DataFrame:
    """The dimension (id, name) with a member for every value of the fact column."""
    added = assign_keys(new_members(facts, column, dimension), dimension)
    return dimension.select(F.col("id").cast("long").alias("id"), "name").unionByName(added.select("id", "name"))


def with_ids(facts: DataFrame, column: str, dimension: DataFrame, id_name: str) -> DataFrame:
    """Replace a name column by the id of its member."""
    names = bounded(dimension.select(F.col("name").alias(column), F.col("id").alias(id_name)))
    return facts.join(names, column, "left")
