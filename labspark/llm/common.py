"""What the operators of this subpackage share: the word rule, table access and connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.session import checkpointed, configure

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = WORD.encode()

#: Rows per Arrow batch. Texts may be very long, so batches are kept far below Spark's default of 10,000.
BATCH_ROWS = 500


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's options and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str]) -> DataFrame:
    """The named columns of a table; no other column is read."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def content(doc_id: str, text: str) -> Column:
    """64 bits that stand for a row's id and text. Rows that agree in both are the same row."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.length(text))


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph as rows (node, root), root being the smallest node.

    Only nodes that occur in a link are returned. Each round takes over the smallest
    label of the neighbours, hands it on to the node's present root, and then jumps from
    each label to that label's label, so the rounds grow with the logarithm of the
    longest path. Everything stays in tables; only a count of changes reaches the driver.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    edges = checkpointed(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = checkpointed(
        edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select(
            "node", F.least("node", "m").alias("root")
        )
    )
    for _ in range(max_rounds):
        seen = edges.join(labels, F.col("y") == F.col("node")).select("x", F.col("root").alias("offer"))
        offers = seen.groupBy("x").agg(F.min("offer").alias("offer"))
        held = labels.join(offers, F.col("node") == F.col("x")).select("node", "root", F.least("root", "offer").alias("m"))
        wanted = held.select("node", "m").unionByName(held.select(F.col("root").alias("node"), "m"))
        lowest = wanted.groupBy("node").agg(F.min("m").alias("m"))
        above = lowest.select(F.col("node").alias("up"), F.col("m").alias("up_m"))
        old = labels.select(F.col("node").alias("was"), F.col("root").alias("old"))
        step = checkpointed(
            lowest.join(above, F.col("m") == F.col("up")).join(old, F.col("node") == F.col("was")).select(
                "node", F.least("m", "up_m").alias("root"), "old"
            )
        )
        labels = step.select("node", "root")
        if step.filter("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
