"""The star-schema tables in the roles of the report model.

orders are reports, their year the batch; customers give the species, nations the genus
and the priority the sample. Line items give results (return flag) and answers (open
lines) per part type, which stands for the drug.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.functions.values import recode
from labspark.operators.metrics import binary_metrics
from labspark.operators.reshape import RESULT_PREFIX, columns_with_prefix, pivot_facts, quoted
from labspark.session import bounded, dealt, distinct_values
from labspark.sources.tables import table

# Result symbols of the return flags.
FLAG_SYMBOLS = {"A": "+", "N": "S", "R": "R"}


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Reports without their dimensions."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("report_id"),
        F.col("o_custkey").alias("hn"),
        F.col("o_orderdate").alias("issued"),
        F.col("o_orderpriority").alias("sample"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("panel"),
        F.year("o_orderdate").alias("batch_id"),
    )


def reports(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("hn"), F.col("c_mktsegment").alias("species"), "c_nationkey"
    )
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("genus")
    )
    return cases(spark, folder).join(customers.join(nations, "c_nationkey").drop("c_nationkey"), "hn")


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batch ids with their row counts; one row per year."""
    return cases(spark, folder).groupBy("batch_id").agg(F.count("*").alias("amount_row"))


def span(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Year of the first batch, and the last version: one per year from the first to the last batch."""
    ends = cases(spark, folder).agg(F.min("batch_id").alias("a"), F.max("batch_id").alias("b")).first()
    return (ends.a, ends.b - ends.a + 1) if ends.a is not None else (1, 0)


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot version and batch: version v holds the batches of its first v years."""
    years = cases(spark, folder).select("batch_id").distinct()
    first, last = span(spark, folder)
    versions = F.sequence(F.col("batch_id") - (first - 1), F.lit(last))
    return years.select(F.explode(versions).alias("version"), "batch_id")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the drug name."""
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), "l_partkey", "l_returnflag", "l_linestatus", "l_quantity"
    )
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("label"))
    return items.join(parts, "l_partkey").drop("l_partkey")


def lines_by_report(spark: SparkSession, folder: str, *columns: Column | str) -> DataFrame:
    """Columns of the line items, dealt by report so that a task of the steps per report stays small in a table of any size."""
    rows = table(spark, folder, "lineitem").count()
    return dealt(lines(spark, folder).select("report_id", *columns), ["report_id"], rows)


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """One result per report and drug: the largest flag. Flags are letters; their codes need no sort before the shuffle."""
    largest = lines(spark, folder).groupBy("report_id", "label").agg(F.max(F.ascii("l_returnflag")).alias("code"))
    return largest.select("report_id", "label", F.char("code").alias("symbol"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    return lines(spark, folder).filter("l_linestatus = 'O'").select("report_id", "label").distinct()


def labels(spark: SparkSession, folder: str) -> list[str]:
    return distinct_values(table(spark, folder, "part"), "p_type", 1000)


def model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics per drug and version (year): flag R is the prediction, an open line the truth."""
    first, _ = span(spark, folder)
    versions = cases(spark, folder).select("report_id", (F.col("batch_id") - (first - 1)).alias("version"))
    rows = lines(spark, folder).join(versions, "report_id")
    counts = binary_metrics(
        rows,
        F.col("l_linestatus") == "O",
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0),
        ["label", "version"],
    )
    return bounded(counts)


def wide_facts(spark: SparkSession, folder: str, coding: dict[str, str]) -> DataFrame:
    """Answers and results per report from one pass over the line items.

    The largest flag of a report and drug counts, so flags are coded after the pivot.
    """
    facts = lines(spark, folder).withColumn("open", F.col("l_linestatus") == "O")
    wide = pivot_facts(facts, "report_id", "label", "l_returnflag", "open", labels(spark, folder))
    coded = {c: recode(F.col(quoted(c)), coding) for c in columns_with_prefix(wide, RESULT_PREFIX)}
    return wide.withColumns(coded)


def upload(spark: SparkSession, folder: str) -> DataFrame:
    """A wide upload as it would come from a file: all texts, one line per report."""
    names = labels(spark, folder)
    base = reports(spark, folder).select(
        "report_id",
        (F.col("report_id") + 2).alias("line_no"),
        F.col("hn").cast("string").alias("hn"),
        F.date_format("issued", "yyyy-MM-dd").alias("date_of_submission"),
        F.date_format(F.date_add(F.col("issued").cast("date"), 2), "yyyy-MM-dd").alias("report_issued_date"),
        F.concat(F.lit(" "), F.initcap("species")).alias("species"),
        F.concat(F.col("genus"), F.lit(" spp.")).alias("bacteria_genus"),
        F.concat(F.lit("Rt. "), F.col("sample"), F.lit(" (swab)")).alias("submitted_sample"),
        F.when(F.col("panel") == 1, "gn").otherwise("GN").alias("vitek_id"),
    )
    wide = base.join(wide_facts(spark, folder, FLAG_SYMBOLS), "report_id", "left")
    return wide.select(
        *[c for c in base.columns if c != "report_id"],
        *[F.col(quoted(f"S/I/R_{n}")) for n in names],
        *[
            F.when(F.coalesce(F.col(quoted(f"ans_{n}")), F.lit(False)), "True").otherwise("False").alias(f"ans_{n}")
            for n in names
        ],
    )
