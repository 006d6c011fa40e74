"""Dashboard reports over reports, their child facts and the batches of a snapshot.

`reports` has report_id, panel, batch_id and the attributes counted; `links` has version
and batch_id. A version covers the batches linked to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.functions.values import month_key
from labspark.operators.reshape import top_rows
from labspark.session import bounded


def snapshot_reports(reports: DataFrame, links: DataFrame, version: int, panel: int | None = None) -> DataFrame:
    """Reports of the batches of a version, of one panel or of all.

    Only the link rows of the version are sent to the reports.
    """
    batches = bounded(links.filter(F.col("version") == version).select("batch_id").distinct())
    rows = reports if panel is None else reports.filter(F.col("panel") == panel)
    return rows.join(batches, "batch_id", "left_semi")


def cases_by_month(reports: DataFrame, issued: str = "issued") -> DataFrame:
    return reports.groupBy("panel", month_key(F.col(issued)).alias("month")).agg(F.count("*").alias("n_cases"))


def cases_by(reports: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Cases per value and panel; with k the k most frequent values of each panel."""
    counts = reports.groupBy("panel", F.col(column).alias("name")).agg(F.count("*").alias("n_cases"))
    if k is None:
        return counts
    return top_rows(counts, ["panel"], [F.desc("n_cases"), F.asc("name")], k)


def top_labels(reports: DataFrame, answers: DataFrame, k: int = 11) -> DataFrame:
    """The k most frequently recommended drugs of each panel.

    `answers` may repeat a report's drug. The reports meet them first, so only rows of
    the snapshot are made distinct, on the partitioning of that join.
    """
    given = answers.join(reports.select("report_id", "panel"), "report_id")
    return cases_by(given.select("report_id", "panel", "label").distinct(), "label", k)


def symbol_distribution(reports: DataFrame, flags: DataFrame, shown: list[str]) -> DataFrame:
    """Per panel and drug one count per symbol, from one-letter flags (report_id, label, flag).

    The largest flag of a report and drug is its symbol. Reports meet the flags first, so
    only rows of the snapshot are grouped, on the partitioning of that join; letters are
    compared by their codes, which need no sort.
    """
    rows = flags.join(reports.select("report_id", "panel"), "report_id")
    largest = rows.groupBy("report_id", "panel", "label").agg(F.max(F.ascii("flag")).alias("code"))
    return largest.withColumn("symbol", F.char("code")).groupBy("panel", "label").agg(
        *[F.count_if(F.col("symbol") == s).alias(f"n_{s.lower()}") for s in shown]
    )


def batch_listing(reports: DataFrame, links: DataFrame, version: int) -> DataFrame:
    """Batches of a version, newest first, with their row counts."""
    return (
        snapshot_reports(reports, links, version)
        .groupBy("batch_id")
        .agg(F.count("*").alias("amount_row"))
        .orderBy(F.desc("batch_id"))
    )
