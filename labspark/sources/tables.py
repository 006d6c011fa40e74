"""Readers and writers for parquet, CSV and JDBC tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.functions.text import missing_to_null
from labspark.operators.numbering import number_rows
from labspark.operators.reshape import quoted
from labspark.sources.inference import inferred


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of an external database; pass partitionColumn, bounds and numPartitions to split the read."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def read_csv(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    line_no: str | None = None,
    malformed: str | None = None,
    multi_line: bool = False,
    typed: bool = False,
    keep_text: list[str] | None = None,
) -> DataFrame:
    """CSV with header as texts; the usual tokens for missing values become null.

    With `typed` every column has the least type that holds all its cells, found in one
    scan (`inference`); columns of `keep_text` stay texts.

    Quotes inside quoted cells are doubled. A record with more or fewer cells than the
    header stops the read, or, if `malformed` names a column, is kept with its raw text
    there (null for all good records). `multi_line` allows line breaks inside quotes, at
    the price that a file is read by one task; numbers are then those of records.

    Texts keep leading zeros, typed or not; dates in local forms are parsed by the steps that need them.
    Without a column list only the header line is read to name the columns. `line_no` adds
    the line of each row, 2 for the first one below the header; with several files the
    count runs on in path order.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    if columns is None:
        columns = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    if malformed is None:
        reader = reader.option("mode", "FAILFAST")
    else:
        schema = schema.add(malformed, T.StringType())
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", malformed)
    df = reader.schema(schema).option("enforceSchema", malformed is not None).csv(path)
    cells = [missing_to_null(F.col(quoted(c))).alias(c) for c in columns]
    cells += [F.col(quoted(malformed))] if malformed else []
    if typed:
        plain = df.select(*cells)
        types = dict(inferred(plain, [*(keep_text or []), *([malformed] if malformed else [])]).dtypes)
        cells = [c.cast(types[n]).alias(n) if types[n] != "string" else c for c, n in zip(cells, plain.columns)]
    if line_no is None:
        return df.select(*cells)
    place = ["_file", "_start", "_row"]
    placed = df.select(
        *cells,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return number_rows(placed, [F.col(c) for c in place], line_no, 2).drop(*place)


def append_rows(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def param_filter(df: DataFrame, **values: object) -> DataFrame:
    """Equality on the given columns."""
    for column, value in values.items():
        df = df.filter(F.col(quoted(column)) == F.lit(value))
    return df


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is in the list; an empty list gives no rows."""
    return df.filter(F.col(quoted(column)).isin(*values)) if values else df.limit(0)
