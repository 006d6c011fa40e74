"""Threshold-scaled sketches of documents, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators.numbering import number_rows

SHINGLE_WORDS = 5
#: Share of all hashes that a sketch retains.
FRACTION = 1 / 8
#: A sketch with fewer retained hashes is filled up to so many with the next smallest ones, so short texts compare exactly.
LEAST = 64
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also where `use` repeats it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def below(fraction: float = FRACTION) -> int:
    """Hashes under this signed value are the given fraction of all."""
    return int((1 << 64) * fraction) - (1 << 63)


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for null and blank texts."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def sketch(text: Column, fraction: float = FRACTION, least: int = LEAST, n: int = SHINGLE_WORDS) -> Column:
    """Sorted hashes of the text's word shingles that lie below the fraction, `least` at least if there are so many.

    A shingle is n words; a shorter text is one shingle; a text without words has an
    empty sketch. The sketch of two texts together is the union of their sketches, cut
    by the same rule (`merge`).
    """

    def shingles(codes: Column) -> Column:
        size = F.size(codes)
        return (
            F.when(size == 0, F.array().cast("array<long>"))
            .when(size < n, F.array(F.xxhash64(codes)))
            .otherwise(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice(codes, i, n))))
        )

    coded = let(words(text), lambda w: F.transform(w, lambda x: F.xxhash64(x)))
    return let(let(coded, shingles), lambda hashes: cut(hashes, fraction, least))


def cut(hashes: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The rule of a sketch on any array of hashes."""
    kept = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < below(fraction))))
    filled = F.slice(F.array_sort(F.array_distinct(hashes)), 1, least)
    return let(kept, lambda k: F.when(F.size(k) >= least, k).otherwise(filled))


def merge(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """The sketch of the union of two texts' shingles."""
    return let(F.array_union(a, b), lambda both: cut(both, fraction, least))


def _complete_to(sketch: Column, fraction: float, least: int) -> Column:
    """Up to this value a sketch holds every hash of its text."""
    top = F.lit((1 << 63) - 1)
    return F.when(F.size(sketch) < least, top).otherwise(F.greatest(F.lit(below(fraction) - 1), F.element_at(sketch, -1)))


def compare(a: Column, b: Column, fraction: float = FRACTION, least: int = LEAST) -> Column:
    """A struct (likeness, a_in_b, b_in_a), each 0 to 1, over the hashes for which both sketches are complete.

    Two empty sketches are alike; an empty one and another share nothing.
    """

    def counted(end: Column) -> Column:
        left, right = F.filter(a, lambda h: h <= end), F.filter(b, lambda h: h <= end)
        return F.struct(F.size(left).alias("a"), F.size(right).alias("b"), F.size(F.array_intersect(left, right)).alias("both"))

    def shares(n: Column) -> Column:
        def share(part: Column) -> Column:
            return F.coalesce(F.try_divide(n["both"], part), F.when((n["a"] == 0) & (n["b"] == 0), 1.0).otherwise(0.0))

        return F.struct(
            share(n["a"] + n["b"] - n["both"]).alias("likeness"), share(n["a"]).alias("a_in_b"), share(n["b"]).alias("b_in_a")
        )

    return let(let(F.least(_complete_to(a, fraction, least), _complete_to(b, fraction, least)), counted), shares)


def as_text(sketch: Column) -> Column:
    """16 hexadecimal digits per hash; equal texts give equal strings, no words the empty string."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_sketch(docs: DataFrame, text: str = "text", name: str = "sketch") -> DataFrame:
    return docs.withColumn(name, sketch(F.col(text)))


def successors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each distinct id the next one in descending order and how many of its characters the edit may need.

    Rows (receiver, donor, need); the smallest id, or null, is followed by the largest.
    Only ids and lengths are moved.
    """
    half = F.floor(F.char_length(F.coalesce(F.col(text), F.lit(""))) / 2).cast("int")
    ids = docs.groupBy(F.col(doc_id).alias("id")).agg(F.max(half).alias("need"))
    numbered = number_rows(ids, [F.col("id").desc_nulls_last()], "_n", 0)
    total = numbered.agg(F.count("*")).first()[0]
    at = ((F.col("_n") + 1) % F.lit(max(total, 1))).alias("_at")
    left = numbered.select(F.col("id").alias("receiver"), "need", at)
    right = numbered.select(F.col("id").alias("donor"), "_n")
    return left.join(right, F.col("_at") == F.col("_n")).select("receiver", "donor", "need")


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketch every text, its edited text and the next document, and compare.

    The edit replaces the last half of a text by the beginning of the next document in
    descending doc_id. Every row of `docs` gives one row. Null texts count as empty. Rows
    that share a doc_id all have the next smaller id as successor; if that id has several
    rows, the one with the smallest beginning counts; null ids come last. One exchange of
    the texts by id serves both as donors and as receivers.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # As a struct, the id is equal to itself where it is null too, and one exchange serves grouping and joining.
    rows = with_sketch(rows).select(F.struct("doc_id").alias("key"), "text", "sketch")
    nexts = successors(rows.select("key.doc_id", "text"), "doc_id", "text")
    nexts = nexts.select(F.struct("receiver").alias("receiver"), F.struct("donor").alias("donor"), "need")
    given = (
        rows.join(nexts, F.col("key") == F.col("donor"))
        .select("receiver", F.struct(F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("sketch").alias("next")).alias("g"))
        .groupBy("receiver")
        .agg(F.min("g").alias("g"))
    )
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("g.head", F.lit(1), half))
    both = (
        rows.join(given, F.col("key") == F.col("receiver"))
        .select("key.doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("g.next").alias("next"), edited.alias("edited"))
        .select("*", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
        .select(
            "*",
            compare(F.col("sketch"), F.col("edited_sketch")).alias("to_edited"),
            compare(F.col("sketch"), F.col("next")).alias("to_next"),
        )
    )
    return both.drop("edited")
