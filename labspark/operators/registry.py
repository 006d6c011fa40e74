"""Model snapshots, champions and their metrics.

Tables: model (model_id, antimicrobial_id, accuracy, precision, recall, f1, performance, …),
model_group (model_group_id, version, vitek_id, metrics), model_group_model (links),
model_group_file (links), binning (model_group_id, schema array<string>). Version 0 of a
panel points at its champions, higher versions are fixed snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators.metrics import MEASURES
from labspark.session import bounded

ALL_MODELS = "All Model (Test By Case)"  # fixed value: name of the summary row


def latest_versions(groups: DataFrame, panel: str = "vitek_id") -> DataFrame:
    return groups.groupBy(panel).agg(F.max("version").alias("version"))


def rows_of_latest_version(groups: DataFrame, panel: str = "vitek_id") -> DataFrame:
    return groups.join(bounded(latest_versions(groups, panel)), [panel, "version"], "left_semi")


def vocabulary_union(binning: DataFrame, groups: DataFrame, panel: str = "vitek_id") -> DataFrame:
    """Distinct values allowed by the latest snapshot of any panel."""
    latest = rows_of_latest_version(groups, panel).select("model_group_id")
    return binning.join(latest, "model_group_id", "left_semi").select(F.explode("schema").alias("name")).distinct()


def compare_f1(challenger: Column, champion: Column) -> Column:
    return F.when(challenger > champion, "better").when(challenger < champion, "worse").otherwise("same")


def champion_challenger(challengers: DataFrame, champions: DataFrame, label: str) -> DataFrame:
    """Both sides have label, model_id and the metrics on the same test rows."""
    old = champions.select(label, *[F.col(c).alias(f"champion_{c}") for c in ("model_id", *MEASURES)])
    return challengers.join(old, label).withColumn(
        "performance", compare_f1(F.col("f1"), F.col("champion_f1"))
    )


def promote(decisions: DataFrame, label: str) -> DataFrame:
    """Pointer and metrics after a run: a challenger that is better or the same takes over."""
    wins = F.col("performance").isin("better", "same")
    return decisions.select(
        label,
        *[F.when(wins, F.col(c)).otherwise(F.col(f"champion_{c}")).alias(c) for c in ("model_id", *MEASURES)],
    )


def current_rows(promoted: DataFrame, last_version: int) -> DataFrame:
    """Rows for the table of current models: the version after the last one."""
    return promoted.withColumn("version", F.lit(last_version + 1))


def snapshot_models(model: DataFrame, links: DataFrame, groups: DataFrame, panel: int, version: int) -> DataFrame:
    """Models of one version with the snapshot each model comes from."""
    group = groups.filter((F.col("vitek_id") == panel) & (F.col("version") == version))
    origin = links.join(
        groups.filter("version > 0").select(
            "model_group_id", F.col("version").alias("origin_version"), F.col("model_group_id").alias("origin_group_id")
        ),
        "model_group_id",
    ).select("model_id", "origin_version", "origin_group_id")
    return (
        group.select("model_group_id")
        .join(links, "model_group_id")
        .join(model, "model_id")
        .join(origin, "model_id")
    )


def performance_by_label(model: DataFrame, links: DataFrame, groups: DataFrame, label: Column) -> DataFrame:
    """Metrics of one drug over all snapshots."""
    return (
        model.filter(label)
        .join(links, "model_id")
        .join(groups.filter("version > 0").select("model_group_id", "version"), "model_group_id")
        .select("version", *MEASURES)
    )


def performance_by_version(
    model: DataFrame, links: DataFrame, groups: DataFrame, labels: DataFrame, panel: int, version: int
) -> DataFrame:
    """Metrics of one version per drug, plus the row for all models together."""
    per_model = (
        snapshot_models(model, links, groups, panel, version)
        .join(labels, "antimicrobial_id")
        .select(
            "name", F.col("origin_version").alias("version"), *MEASURES, "performance",
            F.col("origin_group_id").alias("model_group_id"),
        )
    )
    whole = groups.filter((F.col("vitek_id") == panel) & (F.col("version") == version)).select(
        F.lit(ALL_MODELS).alias("name"), "version", *MEASURES, F.lit("-").alias("performance"), "model_group_id"
    )
    return per_model.unionByName(whole)


def performance_of_current(
    current: DataFrame, model: DataFrame, links: DataFrame, groups: DataFrame, labels: DataFrame, panel: int
) -> DataFrame:
    """What version 0 shows: champions with the metrics of their newest test, plus the row for all models together.

    `current` (model_id, metrics, version) gets one row per champion and run; the rows of
    the panel's largest version count. The version shown is the one a model comes from.
    """
    of_panel = current.join(model.select("model_id", "antimicrobial_id"), "model_id").join(labels, "antimicrobial_id")
    newest = of_panel.agg(F.max("version").alias("version"))
    origin = links.join(
        groups.filter((F.col("version") > 0) & (F.col("vitek_id") == panel)).select(
            "model_group_id", F.col("version").alias("origin_version")
        ),
        "model_group_id",
    ).select("model_id", "origin_version", "model_group_id")
    shown = of_panel.join(F.broadcast(newest), "version", "left_semi").join(origin, "model_id")
    rows = shown.select("name", F.col("origin_version").alias("version"), *MEASURES, F.lit("-").alias("performance"), "model_group_id")
    whole = groups.filter((F.col("vitek_id") == panel) & (F.col("version") == 0)).select(
        F.lit(ALL_MODELS).alias("name"), "version", *MEASURES, F.lit("-").alias("performance"), "model_group_id"
    )
    return rows.unionByName(whole)


def resolve_champions(
    model: DataFrame, links: DataFrame, groups: DataFrame, binning: DataFrame, panel: int
) -> DataFrame:
    """Champions of a panel with the vocabulary of the snapshot they were trained in."""
    pointed = links.join(
        groups.filter((F.col("version") == 0) & (F.col("vitek_id") == panel)).select("model_group_id"),
        "model_group_id", "left_semi",
    ).select("model_id")
    origin = links.join(groups.filter("version > 0").select("model_group_id", "version"), "model_group_id")
    return (
        model.join(pointed, "model_id", "left_semi")
        .join(origin, "model_id")
        .join(binning.withColumnRenamed("schema", "sample_vocabulary"), "model_group_id")
    )


def remove_snapshot(model: DataFrame, links: DataFrame, groups: DataFrame, group_id: int) -> dict[str, DataFrame]:
    """The three tables without one snapshot; its models go too, unless another group points at them."""
    gone = links.filter(F.col("model_group_id") == group_id).select("model_id").distinct()
    held = links.filter(F.col("model_group_id") != group_id).select("model_id").distinct()
    return {
        "model": model.join(gone.join(held, "model_id", "left_anti"), "model_id", "left_anti"),
        "model_group": groups.filter(F.col("model_group_id") != group_id),
        "model_group_model": links.filter(F.col("model_group_id") != group_id),
    }


def register_snapshot(
    group_id: int, version: int, panel: int, models: DataFrame, batches: DataFrame, vocabulary: DataFrame
) -> dict[str, DataFrame]:
    """Rows to append for a new snapshot.

    `vocabulary` is a table (name). It is stored as one list per snapshot, as binning needs it.
    """
    spark = models.sparkSession
    return {
        "model": models,
        "model_group": spark.createDataFrame(
            [(group_id, version, panel)], "model_group_id long, version int, vitek_id int"
        ),
        "model_group_model": models.select(F.lit(group_id).cast("long").alias("model_group_id"), "model_id"),
        "model_group_file": batches.select(F.lit(group_id).cast("long").alias("model_group_id"), "file_id"),
        "binning": vocabulary.agg(F.array_sort(F.collect_set("name")).alias("schema")).select(
            F.lit(group_id).cast("long").alias("model_group_id"), "schema"
        ),
    }
