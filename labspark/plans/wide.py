"""The wide report as a stored table, one partition per panel and batch.

A change of a batch rewrites the partitions of that batch; setting a batch inactive
rewrites nothing, because readers name the batches that they want.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.functions.values import recode
from labspark.operators.reshape import RESULT_PREFIX, columns_with_prefix, pivot_facts, quoted, wide_report
from labspark.session import bounded
from labspark.sources.stored import named, rewrite

BY = ["panel", "file_id"]


def refresh(path: str, reports: DataFrame, facts: DataFrame, names: list[str], changed: DataFrame | None = None, coding: dict[str, str] | None = None) -> int:
    """Build the wide report of the changed batches (panel, file_id), or of all, and replace their partitions.

    `reports` has report_id, panel, file_id and the case columns, `facts` report_id, label,
    symbol and answer. Only facts of the changed batches are pivoted. Returns the number of
    partitions written. A batch that lost all its reports keeps its partition until it is set inactive.
    """
    if changed is not None:
        reports = reports.join(bounded(changed.select(*BY).distinct()), BY, "left_semi")
        facts = facts.join(reports.select("report_id"), "report_id", "left_semi")
    pivot = pivot_facts(facts, "report_id", "label", "symbol", "answer", names)
    coded = {c: recode(F.col(quoted(c)), CODING if coding is None else coding) for c in columns_with_prefix(pivot, RESULT_PREFIX)}
    return rewrite(wide_report(reports, pivot.withColumns(coded)), path, BY)


# Symbols shown for the stored flags.
CODING = {"A": "+", "N": "n/a"}


def active(spark: SparkSession, path: str, panel: int, batches: DataFrame) -> DataFrame:
    """The wide rows of a panel in the given batches (column file_id); only their partitions are opened."""
    return named(spark.read.parquet(path).filter(F.col("panel") == panel), "file_id", batches)
