"""Dashboards from counts that are stored per batch at load time.

Every report belongs to one batch, so counts per batch add up to those of any snapshot:
a dashboard reads the counts of its batches and no report or fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.functions.values import month_key
from labspark.operators.reshape import top_rows
from labspark.sources.stored import named, rewrite

KINDS = ("month", "species", "genus", "sample")


def report_counts(reports: DataFrame) -> DataFrame:
    """(batch_id, panel, kind, name, n): cases per month, species, genus and sample, by grouping sets in one aggregate."""
    rows = reports.select("batch_id", "panel", month_key(F.col("issued")).alias("month"), "species", "genus", "sample")
    sets = [[F.col("batch_id"), F.col("panel"), F.col(k)] for k in KINDS]
    counts = rows.groupingSets(sets, "batch_id", "panel", *KINDS).agg(
        F.count("*").alias("n"), *[F.grouping(k).alias(f"_{k}") for k in KINDS]
    )
    kind = F.coalesce(*[F.when(F.col(f"_{k}") == 0, F.lit(k)) for k in KINDS])
    return counts.select("batch_id", "panel", kind.alias("kind"), F.coalesce(*KINDS).alias("name"), "n")


def fact_counts(reports: DataFrame, facts: DataFrame, symbols: list[str]) -> DataFrame:
    """(batch_id, panel, kind, name, n) of `facts` (report_id, label, flag, open): reports per drug with an open line, and per drug and largest flag."""
    rows = facts.join(reports.select("report_id", "batch_id", "panel"), "report_id")
    per_drug = rows.groupBy("report_id", "batch_id", "panel", "label").agg(F.bool_or("open").alias("open"), F.max(F.ascii("flag")).alias("code"))
    counts = per_drug.groupBy("batch_id", "panel", F.col("label").alias("name")).agg(
        F.count_if("open").alias("answer"), *[F.count_if(F.col("code") == ord(s)).alias(f"symbol {s}") for s in symbols], F.count("*").alias("drug")
    )
    kinds = ["answer", "drug", *[f"symbol {s}" for s in symbols]]
    return counts.unpivot(["batch_id", "panel", "name"], kinds, "kind", "n").select("batch_id", "panel", "kind", "name", "n")


def store(counts: DataFrame, path: str) -> int:
    """Keep the counts by batch; batches that are there already are replaced. Returns how many were written."""
    return rewrite(counts, path, ["batch_id"])


def snapshot_counts(stored: DataFrame, batches: DataFrame) -> DataFrame:
    """(panel, kind, name, n) of a snapshot: the counts of its batches (column batch_id), added up."""
    return named(stored, "batch_id", batches).groupBy("panel", "kind", "name").agg(F.sum("n").alias("n")).filter("n > 0")


def dashboards(counts: DataFrame, symbols: list[str], k: int = 10, k_labels: int = 11) -> dict[str, DataFrame]:
    """The six dashboards of a snapshot: per month, per species, top genera, top samples, top recommended drugs, symbols per drug."""

    def of(kind: str) -> DataFrame:
        return counts.filter(F.col("kind") == kind).select("panel", "name", F.col("n").alias("n_cases"))

    def top(kind: str, rows: int) -> DataFrame:
        return top_rows(of(kind), ["panel"], [F.desc("n_cases"), F.asc("name")], rows)

    names = counts.filter((F.col("kind") == "drug") | F.col("kind").startswith("symbol "))
    pivot = names.groupBy("panel", F.col("name").alias("label")).agg(
        *[F.coalesce(F.max(F.when(F.col("kind") == f"symbol {s}", F.col("n"))), F.lit(0)).alias(f"n_{s.lower()}") for s in symbols]
    )
    return {
        "cases_by_month": of("month").withColumnRenamed("name", "month"),
        "by_species": of("species"),
        "top_genera": top("genus", k),
        "top_samples": top("sample", k),
        "top_labels": top("answer", k_labels),
        "symbol_pivot": pivot,
    }
