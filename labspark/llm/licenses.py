"""License scans by canonical digests, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labspark.llm.common import content
from labspark.llm.license_texts import KNOWN
from labspark.session import bounded, checkpointed

#: Spellings that count as the same word; the second replaces the first.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("https", "http"),
    ("initialise", "initialize"),
    ("licence", "license"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
#: A line that only states copyright.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n(©]*(copyright\s*(\(c\)|©|[0-9]{4}|[<\[]|by\b)|(\(c\)|©)\s*[0-9]{4}|all rights reserved)[^\n]*$"
)


def canonical(text: Column) -> Column:
    """The text's lines in canonical form, still one per line.

    Lower case; copyright lines emptied; every run of other characters than letters and
    digits one space. `spelled` replaces equivalent spellings.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    marked = out.contains("copyright") | out.contains("©") | out.contains("(c)") | out.contains("all rights reserved")
    out = F.when(marked, F.regexp_replace(out, COPYRIGHT_LINE, "")).otherwise(out)
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def spelled(text: Column) -> Column:
    """Equivalent spellings replaced; texts that hold none are only searched."""
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def whole(lines: Column) -> Column:
    """A canonical text as one line; spellings that lines had split are found here."""
    return spelled(F.btrim(F.regexp_replace(lines, r"[ \n]+", " ")))


def digest(line: Column) -> Column:
    """The digest by which canonical texts are looked up; none for an empty text."""
    return F.when(line != "", F.sha2(line, 256))


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(license_id, known_digest) of known texts (license_id, text), by default of the built-in ones; one row per digest."""
    if texts is None:
        texts = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    made = texts.select("license_id", digest(whole(spelled(canonical(F.col("text"))))).alias("known_digest"))
    return made.filter("known_digest is not null").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Look up every document, and every line of it, as an entire text.

    Rows (doc_id, content, digest, license_id, n_notices, notices): the digest of the
    whole text (null if nothing is left of it), the licence it is (or null), and the
    licences whose entire text is one line of it, with the number of such lines. One row
    for each row of `docs`; null texts are empty; repeated rows are repeated; an empty
    table gives no rows. Known digests are broadcast only after a check of their size.
    """
    lines = docs.select(
        F.col(doc_id).alias("doc_id"), content(doc_id, text).alias("content"), spelled(canonical(F.col(text))).alias("c")
    ).select("doc_id", "content", digest(whole(F.col("c"))).alias("digest"), F.transform(F.split("c", "\n"), lambda x: digest(F.btrim(x))).alias("each"))
    lines = checkpointed(lines)  # texts are brought to canonical form once, for whole texts and for lines
    table = bounded(known)
    found = (
        lines.select("doc_id", "content", F.posexplode("each").alias("pos", "line_digest"))
        .filter("line_digest is not null")
        .join(table, F.col("line_digest") == F.col("known_digest"))
        .groupBy("doc_id", "content", "license_id", "pos")
        .agg(F.lit(1).alias("n"))
        .groupBy("doc_id", "content", "license_id")
        .agg(F.sum("n").alias("n"))
        .groupBy("doc_id", "content")
        .agg(F.sum("n").cast("long").alias("n_notices"), F.array_sort(F.collect_list("license_id")).alias("notices"))
        .withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    )
    wholes = lines.select("doc_id", "content", "digest").join(table, F.col("digest") == F.col("known_digest"), "left").drop("known_digest")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content"))
    return wholes.join(found, same, "left").select(
        "doc_id",
        "content",
        "digest",
        "license_id",
        F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )
