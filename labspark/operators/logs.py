"""Change logs, run logs and their pages.

Files are only appended to: an update is a new row, the current state of a key its newest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.session import bounded

PAGE_ROWS = 10


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key. The maximum is taken before the shuffle, so hot keys do no harm."""
    newest = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def change(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    """Rows to append: the matching rows with new values."""
    return df.filter(condition).withColumns(changes)


def apply_changes(df: DataFrame, changed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State after appending change rows."""
    return latest_rows(df.unionByName(changed), keys, order)


def soft_delete(batches: DataFrame, batch: Column, key: str, order: str) -> DataFrame:
    """Batches after one was set inactive; `order` counts the changes of a batch."""
    off = change(batches, batch, {"active": F.lit(False), order: F.col(order) + 1})
    return apply_changes(batches, off, [key], [order])


def purge_unreferenced(parents: DataFrame, references: DataFrame, key: str, reference_key: str) -> DataFrame:
    """Parents that nothing refers to."""
    used = references.select(F.col(reference_key).alias(key)).distinct()
    return parents.join(used, key, "left_anti")


def page(df: DataFrame, order: list[Column], number: int, rows: int = PAGE_ROWS) -> DataFrame:
    """Page `number` (from 1) in a total order; each task keeps only the rows up to the page end."""
    if number < 1:
        raise ValueError("page numbers start at 1")
    return df.orderBy(*order).offset((number - 1) * rows).limit(rows)


def log_order(finish: str, start: str, key: str) -> list[Column]:
    """Unfinished runs first, then the newest; waiting runs without a start come last."""
    return [F.desc_nulls_first(finish), F.asc_nulls_last(start), F.asc(key)]


def with_results(logs: DataFrame, results: DataFrame, key: str, type_column: str, detail: str) -> DataFrame:
    """One row per log and detail; a log without details has the type 'success'.

    Details stay rows: a log may hold any number of them, and the inner join lets adaptive
    execution split the details of a hot log. Logs without details are added apart.
    """
    found = results.join(logs, key)
    silent = logs.join(results.select(key).distinct(), key, "left_anti").withColumn(type_column, F.lit("success"))
    return found.unionByName(silent, allowMissingColumns=True).withColumn("has_detail", F.col(detail).isNotNull())


def queue_head(log: DataFrame, queue: str, key: str, status: str, waiting: tuple[str, ...]) -> DataFrame:
    """First waiting entry per queue."""
    return log.filter(F.col(status).isin(*waiting)).groupBy(queue).agg(F.min(key).alias("head"))


def gate_counts(log: DataFrame, status: str, gates: dict[str, str]) -> DataFrame:
    """One row: for each gate how many entries hold it and whether it is open."""
    return log.agg(
        *[F.count_if(F.col(status) == value).alias(f"n_{gate}") for gate, value in gates.items()],
        *[(F.count_if(F.col(status) == value) == 0).alias(f"{gate}_open") for gate, value in gates.items()],
    )


def same_members(left: DataFrame, right: DataFrame, column: str) -> bool:
    """Whether two id lists hold the same members."""
    sides = left.select(column, F.lit(1).alias("s")).unionByName(right.select(column, F.lit(2).alias("s")))
    odd = sides.groupBy(column).agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a = b")
    return odd.isEmpty()


def upload_page(logs: DataFrame, results: DataFrame, key: str, type_column: str, detail: str, order: list[Column], number: int) -> DataFrame:
    """One page of logs, each with its results; only the logs of the page meet the results."""
    return with_results(bounded(page(logs, order, number)), results, key, type_column, detail)


def training_page(logs: DataFrame, panels: DataFrame, groups: DataFrame, order: list[Column], number: int) -> DataFrame:
    """One page of training runs with panel name and, where a run made a snapshot, its version."""
    rows = logs.join(panels.select(F.col("id").alias("vitek_id"), F.col("name").alias("vitek_name")), "vitek_id")
    return page(rows, order, number).join(groups.select("model_group_id", "version"), "model_group_id", "left")


def active_page(files: DataFrame, panels: DataFrame, number: int, deletable_after: int = 2021) -> DataFrame:
    """One page of active, filled batches, newest first, with panel name, `can_delete` and the number of all such batches."""
    named = files.join(panels.select(F.col("id").alias("vitek_id"), F.col("name").alias("vitek_name")), "vitek_id")
    shown = named.filter("active and amount_row is not null")
    rows = page(shown, [F.desc("upload_at"), F.asc("id")], number)
    return rows.withColumn("total_row", F.lit(shown.count()).cast("long")).withColumn("can_delete", F.year("upload_at") > deletable_after)


def delete_outcomes(files: DataFrame, runs: DataFrame, references: DataFrame, key: str, status: str, busy: tuple[str, ...]) -> DataFrame:
    """What a request to delete each batch leads to: fail, deleted or inactive.

    While a training is waiting or running every request fails. A batch that no snapshot
    uses is deleted, any other only set inactive.
    """
    blocked = not runs.filter(F.col(status).isin(*busy)).isEmpty()
    used = references.select(F.col(key).alias("_used")).distinct()
    outcome = F.when(F.lit(blocked), "fail").when(F.col("_used").isNull(), "deleted").otherwise("inactive")
    return files.join(used, F.col(key) == F.col("_used"), "left").withColumn("outcome", outcome).drop("_used")
