"""Tables kept by partition: a change rewrites only the partitions it touches, a read opens only those it asks for.

Keyed tables have no column to partition by; they are parted by a hash of the key, with
one file per part, so that rows of a key are found without a look at the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from labspark.operators.logs import PAGE_ROWS, latest_rows
from labspark.operators.numbering import number_rows
from labspark.session import bounded, checkpointed

PART = "_part"
#: Partition values that a read may name; with more the whole table is read.
MAX_NAMED = 4_096


def part_of(keys: list[str], parts: int) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def rewrite(rows: DataFrame, path: str, by: list[str]) -> int:
    """Replace the partitions that `rows` has rows of; returns how many. Others stay as they are.

    The rows are fixed first, as they may come from the partitions that are replaced.
    """
    rows = checkpointed(rows)
    touched = rows.select(*by).distinct().count()
    if touched:
        dealt = rows.repartition(*by)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return touched


def named(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of `df` whose partition column is among the values; a short list is named, so that other partitions are not opened."""
    found = [r[0] for r in values.select(column).distinct().limit(MAX_NAMED + 1).collect()]
    if len(found) > MAX_NAMED:
        return df.join(values.select(column).distinct(), column, "left_semi")
    return df.filter(F.col(column).isin(*found)) if found else df.limit(0)


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class StateTable:
    """The current row of every key, parted by a hash of the key."""

    path: str
    keys: list[str]
    order: list[str]
    schema: T.StructType
    parts: int = 64

    def rows(self, spark: SparkSession) -> DataFrame:
        return read(spark, self.path, self._stored()).drop(PART)

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])

    def apply(self, changes: DataFrame) -> int:
        """Take over the newest row of each changed key; only the parts of changed keys are read and written. Returns how many."""
        changes = checkpointed(changes.select(*self.schema.names).withColumn(PART, part_of(self.keys, self.parts)))
        held = named(read(changes.sparkSession, self.path, self._stored()), PART, changes)
        newest = latest_rows(held.unionByName(changes), [PART, *self.keys], self.order)
        return rewrite(newest.select(*self.schema.names, PART), self.path, [PART])

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """The current rows of some keys."""
        asked = keys.select(*self.keys).distinct().withColumn(PART, part_of(self.keys, self.parts))
        held = named(read(keys.sparkSession, self.path, self._stored()), PART, asked)
        return held.join(asked.drop(PART), self.keys, "left_semi").drop(PART)


@dataclass(frozen=True)
class IdentityIndex:
    """Which identities are stored: hash and key values, parted by hash and batch.

    The hash leads to the part; the key values decide, nulls being equal.
    """

    path: str
    keys: list[str]
    schema: T.StructType  # of the keys
    parts: int = 256

    def _stored(self) -> T.StructType:
        fixed = [T.StructField("hash", T.LongType())]
        return T.StructType([*fixed, *self.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField("file_id", T.LongType())])

    def _hashed(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.xxhash64(*self.keys).alias("hash"), *self.keys).withColumn(PART, part_of(self.keys, self.parts))

    def add(self, rows: DataFrame, file_id: int) -> None:
        """Store the identities of a batch; those of the same batch that are there already are replaced.

        A part that the batch had rows in, and has none in now, keeps a row without hash, which equals no identity.
        """
        found = checkpointed(self._hashed(rows.select(*self.keys).distinct()).withColumn("file_id", F.lit(file_id).cast("long")))
        old = read(rows.sparkSession, self.path, self._stored()).filter(F.col("file_id") == file_id).select(PART, "file_id").distinct()
        left = old.join(found.select(PART).distinct(), PART, "left_anti")
        rewrite(found.unionByName(left, allowMissingColumns=True), self.path, [PART, "file_id"])

    def among(self, rows: DataFrame, batches: DataFrame | None = None) -> DataFrame:
        """Identities held of those parts that the rows' identities fall into, of the given batches (column file_id) or of all."""
        held = named(read(rows.sparkSession, self.path, self._stored()), PART, self._hashed(rows))
        return held if batches is None else named(held, "file_id", batches)

    def repeated(self, rows: DataFrame, batches: DataFrame | None = None) -> DataFrame:
        """The rows whose identity is stored."""
        held = self.among(rows, batches).select("hash", *[F.col(k).alias(f"_r_{k}") for k in self.keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in self.keys])
        hashed = rows.withColumn("_hash", F.xxhash64(*self.keys))
        return hashed.join(bounded(held), (F.col("_hash") == F.col("hash")) & same, "left_semi").drop("_hash")


@dataclass(frozen=True)
class Pages:
    """A table in a fixed order, parted by place, so that any page opens one part or two."""

    path: str
    block: int = 1_000_000

    def build(self, df: DataFrame, order: list[F.Column]) -> int:
        """Store the rows with their place in the order; returns how many there are."""
        placed = number_rows(df, order, "_place", 0).withColumn(PART, F.expr(f"_place div {self.block}"))
        placed.write.mode("overwrite").partitionBy(PART).parquet(self.path)
        return df.sparkSession.read.parquet(self.path).agg(F.count("*")).first()[0]

    def page(self, spark: SparkSession, number: int, rows: int = PAGE_ROWS) -> DataFrame:
        """Page `number` (from 1) in the order of the table."""
        if number < 1:
            raise ValueError("page numbers start at 1")
        first = (number - 1) * rows
        last = first + rows - 1
        held = spark.read.parquet(self.path).filter(F.col(PART).between(first // self.block, last // self.block))
        return held.filter(F.col("_place").between(first, last)).orderBy("_place").drop("_place", PART)
