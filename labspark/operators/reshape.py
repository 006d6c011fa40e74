"""Wide and long forms of the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labspark.functions.values import SIGN_TYPE, SIR_TYPE, SUB_TYPES, SYMBOLS, name_to_symbol, symbol_to_name
from labspark.session import bounded

RESULT_PREFIX = "S/I/R_"
ANSWER_PREFIX = "ans_"


def columns_with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def quoted(name: str) -> str:
    """Column reference for names with dots or slashes."""
    return "`" + name.replace("`", "``") + "`"


def prefix_project(df: DataFrame, keys: list[str], *prefixes: str) -> DataFrame:
    return df.select(*keys, *[F.col(quoted(c)) for c in columns_with_prefix(df, *prefixes)])


def melt(df: DataFrame, keys: list[str], prefix: str, name: str, value: str) -> DataFrame:
    """One row per key and prefixed column, the prefix stripped from the name."""
    columns = columns_with_prefix(df, prefix)
    long = df.unpivot(keys, [F.col(quoted(c)) for c in columns], name, value)
    return long.withColumn(name, F.substring(F.col(name), len(prefix) + 1, 2**31 - 1))


def melt_symbols(df: DataFrame, keys: list[str], name: str = "name", value: str = "symbol") -> DataFrame:
    """Result cells that hold one of the five symbols."""
    return melt(df, keys, RESULT_PREFIX, name, value).filter(F.col(value).isin(*SYMBOLS))


def melt_flags(df: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Answers that are true; texts are parsed, not cast by emptiness."""
    long = melt(df, keys, ANSWER_PREFIX, name, "_flag")
    return long.filter(F.lower(F.col("_flag").cast("string")) == "true").drop("_flag")


def melt_facts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Results and true answers in one pass: keys, kind (the prefix), name and value; cells that say nothing are left out."""
    columns = columns_with_prefix(df, RESULT_PREFIX, ANSWER_PREFIX)
    cells = [F.col(quoted(c)).cast("string").alias(c) for c in columns]
    long = df.select(*keys, *cells).unpivot(keys, [F.col(quoted(c)) for c in columns], "_column", "value")
    result = F.col("_column").startswith(RESULT_PREFIX)
    says = F.when(result, F.col("value").isin(*SYMBOLS)).otherwise(F.lower("value") == "true")
    kind = F.when(result, RESULT_PREFIX).otherwise(ANSWER_PREFIX)
    name = F.expr(f"substring(_column, if(startswith(_column, '{RESULT_PREFIX}'), {len(RESULT_PREFIX) + 1}, {len(ANSWER_PREFIX) + 1}))")
    return long.filter(says).select(*keys, kind.alias("kind"), name.alias("name"), "value")


def pivot_flags(long: DataFrame, key: str, name: str, names: list[str]) -> DataFrame:
    """One boolean column per name: true where a row exists, else false."""
    wide = long.groupBy(key).pivot(name, names).agg(F.max(F.lit(True)))
    return wide.select(
        key, *[F.coalesce(F.col(quoted(n)), F.lit(False)).alias(ANSWER_PREFIX + n) for n in names]
    )


def pivot_symbols(long: DataFrame, key: str, name: str, symbol: str, names: list[str]) -> DataFrame:
    """One text column per name; several symbols of one key and name give the largest."""
    shown = long.withColumn(symbol, name_to_symbol(F.col(symbol)))
    wide = shown.groupBy(key).pivot(name, names).agg(F.max(symbol))
    return wide.select(key, *[F.col(quoted(n)).alias(RESULT_PREFIX + n) for n in names])


def pivot_facts(long: DataFrame, key: str, name: str, symbol: str, flag: str, names: list[str]) -> DataFrame:
    """Answer and result columns from one table of facts, in one aggregate.

    A name has the answer if any of its rows has the flag; several symbols give the largest.
    """
    shown = long.withColumn(symbol, name_to_symbol(F.col(symbol)))
    wide = shown.groupBy(key).pivot(name, names).agg(F.bool_or(flag).alias("flag"), F.max(symbol).alias("symbol"))
    return wide.select(
        key,
        *[F.coalesce(F.col(quoted(f"{n}_flag")), F.lit(False)).alias(ANSWER_PREFIX + n) for n in names],
        *[F.col(quoted(f"{n}_symbol")).alias(RESULT_PREFIX + n) for n in names],
    )


def wide_report(reports: DataFrame, *pivots: DataFrame, key: str = "report_id") -> DataFrame:
    """Reports with all answer and result columns; absent answers false, absent results ''."""
    wide = reports
    for pivot in pivots:
        wide = wide.join(pivot, key, "left")
    answers = {c: F.coalesce(F.col(quoted(c)), F.lit(False)) for c in columns_with_prefix(wide, ANSWER_PREFIX)}
    results = {c: F.coalesce(F.col(quoted(c)), F.lit("")) for c in columns_with_prefix(wide, RESULT_PREFIX)}
    return wide.withColumns({**answers, **results})


def infer_symbol_type(symbols: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    """Type of a new drug by majority of its symbols; a drug with a tie gets no row."""
    counts = symbols.groupBy(*keys).agg(
        F.count_if(F.col(symbol).isin("S", "I", "R")).alias("n_sir"),
        F.count_if(F.col(symbol).isin("+", "-")).alias("n_sign"),
    )
    return counts.filter("n_sir <> n_sign").withColumn(
        "sir_type_id", F.when(F.col("n_sir") > F.col("n_sign"), SIR_TYPE).otherwise(SIGN_TYPE)
    )


def sub_types(spark) -> DataFrame:
    return spark.createDataFrame(SUB_TYPES, "id int, sir_type_id int, symbol string")


def with_sub_type(
    rows: DataFrame, sub_type: DataFrame, symbol: str = "symbol", type_column: str = "sir_type_id"
) -> DataFrame:
    """Add sir_sub_id: the sub type with this symbol, null when it belongs to another type."""
    known = bounded(
        sub_type.select(
            F.col("id").alias("sir_sub_id"), F.col("sir_type_id").alias("_type"), F.col("symbol").alias("_symbol")
        )
    )
    match = (symbol_to_name(F.col(symbol)) == F.col("_symbol")) & (F.col(type_column) == F.col("_type"))
    return rows.join(known, match, "left").drop("_type", "_symbol")


def nest_children(
    parents: DataFrame, children: DataFrame, key: str, child_columns: list[str], name: str = "children"
) -> DataFrame:
    """Parents with a sorted list of their children; meant for dimension tables."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*child_columns))).alias(name))
    empty = F.array().cast(lists.schema[name].dataType)
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, empty))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a single value; one aggregate over all columns finds them."""
    filled = df.agg(*[F.max(F.col(quoted(c)).isNotNull()).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(quoted(c)) for c in df.columns if filled[c]])


def top_rows(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; every task keeps k rows per group before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)
