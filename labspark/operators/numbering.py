"""Row numbers and running totals over a whole table without one big window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.session import bounded, checkpointed

_ROW_BITS = 33  # monotonically_increasing_id() keeps the partition above these bits


def _ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition and sort, then fix the result so that positions stay as they are."""
    return checkpointed(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", _ROW_BITS))


def number_rows(df: DataFrame, order: list[Column], name: str, start: Column | int = 1) -> DataFrame:
    """Number the rows start, start+1, … in the given total order.

    Every task numbers its own range; only one count per partition is shared.
    """
    rows = _ordered(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bounded(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    first = start if isinstance(start, Column) else F.lit(start)
    inside = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        rows.join(offsets, "_part")
        .withColumn(name, (F.col("_before") + inside + first).cast("long"))
        .drop("_part", "_at", "_before")
    )


def running_totals(
    df: DataFrame, group: list[str], order: list[Column], totals: dict[str, Column]
) -> DataFrame:
    """Add running sums per group, the current row included.

    The table is range-partitioned by group and order, so a hot group spreads over
    many tasks; the sums of the earlier partitions are added as an offset.
    """
    keys = [F.col(g) for g in group]
    inputs = df.select("*", *[c.alias(f"_in_{n}") for n, c in totals.items()])
    rows = _ordered(inputs, keys + order)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*group, "_part").agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in totals])
    offsets = bounded(
        parts.select(
            *group,
            "_part",
            *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals],
        )
    )
    within = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, [*group, "_part"]).select(
        *df.columns,
        *[(F.col(f"_off_{n}") + F.sum(f"_in_{n}").over(within)).alias(n) for n in totals],
    )


def line_ranges(lines: DataFrame, group: list[str], line: str, bucket_size: int = 65_536) -> DataFrame:
    """Consecutive line numbers per group as ranges: group columns, lo, hi, text.

    Copies of a line are dropped before the shuffle. Runs are found inside fixed buckets
    of line numbers; only runs that touch a bucket border, at most two per bucket, meet
    again to be joined.
    """
    rows = (
        lines.select(*group, F.col(line).cast("long").alias("_n"))
        .distinct()
        .withColumn("_b", F.expr(f"_n div {bucket_size}"))
    )
    position = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_n"))
    runs = (
        rows.withColumn("_run", F.col("_n") - position)
        .groupBy(*group, "_b", "_run")
        .agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    )
    border = (F.col("lo") % bucket_size == 0) | (F.col("hi") % bucket_size == bucket_size - 1)
    by_line = Window.partitionBy(*group).orderBy("lo")
    joined = (
        runs.filter(border)
        .withColumn("_new", (F.coalesce(F.lag("hi").over(by_line), F.lit(-9)) + 1 != F.col("lo")).cast("int"))
        .withColumn("_chain", F.sum("_new").over(by_line))
        .groupBy(*group, "_chain")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    ranges = runs.filter(~border).select(*group, "lo", "hi").unionByName(joined.select(*group, "lo", "hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(
        F.concat_ws(" - ", F.col("lo").cast("string"), F.col("hi").cast("string"))
    )
    return ranges.withColumn("text", text)
