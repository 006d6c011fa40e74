"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm import alignment, credentials, licenses, lines, merkle, mixing, neighbours, packing, phrases, quality, simhash, sketches, sql, substrings
from labspark.llm.common import table
from labspark.llm.registered import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


@query("op1_scaled_sketches")
def op1_scaled_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return sketches.edited_likeness(docs).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        sketches.as_text(F.col("sketch")).alias("fingerprint"),
        sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.col("to_edited.likeness").alias("near_edited"),
        F.col("to_next.likeness").alias("near_next"),
        F.col("to_edited.a_in_b").alias("contained_in_edited"),
        F.col("to_next.a_in_b").alias("contained_in_next"),
    )


@query("op2_line_dedup")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return lines.without_repeats(docs).select(
        "doc_id",
        F.col("_llm_lines").alias("n_lines"),
        F.col("_llm_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op3_simhash_near_dups")
def op3_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    groups = simhash.near_groups(docs, radius=4, words=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_secret_formats")
def op4_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = credentials.scan(docs, credentials.learn(docs))
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(shown, ",").alias("spans"), "n_format"
    )


@query("op5_substring_dedup", sql.SUBSTRING_DEDUP)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    cut = substrings.without_repeats(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_mix_sources")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.mix(docs).select(
        "doc_id",
        F.col("_llm_size").alias("size"),
        F.col("_llm_source_size").alias("source_size"),
        F.col("_llm_target").alias("target"),
        (F.col("_llm_copies") * F.col("_llm_size")).cast("long").alias("taken"),
    )


@query("op7_pack_sequences")
def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", ["doc_id", "text"]))


@query("op8_license_digests", sql.LICENSE_DIGESTS)
def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return licenses.scan(docs, licenses.known_digests(spark)).select(
        "doc_id", "digest", "license_id", "n_notices", F.array_join("notices", ",").alias("notices")
    )


@query("op9_quality_votes")
def op9_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"]).filter(~quality.held_out())
    scored = quality.with_scores(docs, quality.fit(docs, labels))
    return scored.select(
        "doc_id",
        quality.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op10_multiprobe_neighbours")
def op10_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query("op13_merkle_manifest")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents", columns)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(altered, merkle.leaf(columns, {"text": lowered})).otherwise(merkle.leaf(columns))
    proven = merkle.manifest(docs, columns, "lang", presented=tampered)
    shown = proven.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.joined_digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"),
        merkle.folded(F.col("presented"), F.col("proof")).alias("folded_root"),
        F.size("proof").alias("n_levels"),
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_positional_index", sql.POSITIONAL_INDEX)
def op12_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    items = table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return phrases.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return alignment.align(docs, digest=True).withColumnRenamed("groups", "groups_sha256")
