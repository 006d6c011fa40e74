"""A training corpus from raw documents: quality, repeated lines, near duplicates, source mix, packed sequences.

Each stage is a function of (spark, docs, sf_dir) over all that the stage before kept. All
but the last return the columns of documents. Null texts count as empty where a stage looks
at them; repeated rows are handled as each operator states; an empty table runs through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm import lines, mixing, packing, quality, simhash
from labspark.llm.common import prepared, table
from labspark.session import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects. It learns from labels that are not held out."""
    prepared(spark)
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"]).filter(~quality.held_out())
    scored = quality.with_scores(docs, quality.fit(docs, labels), score="_llm_score")
    return scored.filter(F.col("_llm_score") >= quality.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts and count the characters anew; every document stays."""
    prepared(spark)
    out = lines.without_repeats(docs)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    prepared(spark)
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it; what it does not take goes."""
    prepared(spark)
    mixed = mixing.mix(docs).filter("_llm_copies > 0")
    return mixed.withColumn("_llm_copy", F.explode(F.array_repeat(F.lit(1), F.col("_llm_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 2,048."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The classifier, the components and the packing cannot be said in SQL; tests/llm/test_pipeline.py holds plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written to the shared folder and read again."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
