"""Session settings, checkpoints and the size check used before any broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 50_000
MAX_BROADCAST_BYTES = 8 * 1024 * 1024
#: Rows that one task of a shuffle takes where a table is dealt by its row count.
TASK_ROWS = 500_000
#: Characters of a plan's text that the driver keeps for each of its last executions.
MAX_PLAN_TEXT = 20_000


def configure(spark: SparkSession) -> SparkSession:
    """Set the SQL options the library relies on; all can be changed at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Split hot join partitions even where that costs one more shuffle.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # The driver keeps the plans of a thousand executions as text; those of long plans would fill its memory.
    spark.conf.set("spark.sql.maxPlanStringLength", str(MAX_PLAN_TEXT))
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("labspark")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder: elsewhere a
    machine-local path would be lost with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="labspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` as a table below the shared folder and go on from there.

    Cuts the lineage, so a lost executor costs no earlier stage, and gives the next plan
    column pruning and a known size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """`df` as a local table if it has at most `max_rows` rows and 8 MB, else None.

    At most max_rows + 1 rows reach the driver.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows or head.get_total_buffer_size() > MAX_BROADCAST_BYTES:
        return None
    return df.sparkSession.createDataFrame(head, schema=df.schema)


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast `df` if it is small in rows and bytes, else return it as it is.

    A larger table keeps its plan and joins by shuffle, where adaptive execution splits
    hot partitions.
    """
    local = small(df, max_rows)
    return df if local is None else F.broadcast(local)


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """`df`, of about `rows` rows, by hash of the keys in tasks of about TASK_ROWS rows.

    A fixed number of shuffle partitions would let the memory of a task grow with the
    table; where that number is enough, `df` stays as it is.
    """
    parts = -(-rows // TASK_ROWS)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(parts, *keys)


def distinct_values(df: DataFrame, column: str, max_values: int = 10_000) -> list:
    """Sorted distinct non-null values of a dimension column, for pivots and label sets."""
    rows = (
        df.select(F.col(column).alias("v")).filter("v is not null").distinct().limit(max_values + 1).collect()
    )
    if len(rows) > max_values:
        raise ValueError(f"{column} has more than {max_values} distinct values")
    return sorted(row.v for row in rows)
