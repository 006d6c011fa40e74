"""SimHash near-duplicates by ball hashing that meets in the middle."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import WORD_BYTES, components, content
from labspark.session import TASK_ROWS, checkpointed

#: A bucket with more fingerprints than this is searched by longer keys.
MAX_BUCKET = 64
#: There buckets may be so many times larger, as what is left is searched by whole balls: 2,081 rows a fingerprint.
CLOSER = 8
#: Keys as (first bit, width), counted cyclically: halves, and any two thirds. Each bit is in one half, and in two of the pairs.
HALVES = ((0, 32), (32, 32))
THIRDS = ((0, 43), (21, 43), (43, 42))
SHINGLES_AT_ONCE = 200_000
_LOWER = bytes(range(256)).lower()
_WORDS = re.compile(WORD_BYTES)


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one UTF-8 text as a signed integer: a bit is set if over half the shingles set it."""
    found = _WORDS.findall((text or b"").translate(_LOWER))
    if not found:
        return 0
    line, n = b" ".join(found), len(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n < words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: n - words + 1], ends[words - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        cut = slice(at, at + SHINGLES_AT_ONCE)
        hashes = [digest(line[a:b], seed) for a, b in zip(starts[cut].tolist(), ends[cut].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """Rows (doc_id, content, fp): one for each row of `docs`. A null text counts as empty; its fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            fps = pa.array([fingerprint(t, words) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], ["doc_id", "content", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), content(doc_id, text).alias("content"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, content long, fp long")


def _flips(width: int, most: int) -> list[int]:
    """All masks with at most `most` of `width` bits set, as signed 64-bit integers."""
    masks, last = [0], [(0, 0)]
    for _ in range(most):
        last = [(m | 1 << i, i + 1) for m, at in last for i in range(at, width)]
        masks += [m for m, _ in last]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _ball(value: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: value.bitwiseXOR(m)))


def _meet(prints: DataFrame, parts: tuple, reach: int, radius: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) at most `radius` bits apart, of those with keys at most twice `reach` apart; fingerprints of crowded buckets.

    A bucket is a variant with the keys that reach it. Each key does so by a flip of its
    own, so the flips' places, one bit each, tell a bucket's keys: no list grows with it
    and nothing is looked up. A pair with a key or bucket of over `most` fingerprints
    may be missing; both are then in the second table, which is written.
    """
    flips = _flips(max(width for _, width in parts), reach)
    words = range(0, len(flips), 64)
    fp = F.col("fp")
    cut = [
        F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, 64 - at)).bitwiseAND(F.lit((1 << width) - 1)) for at, width in parts
    ]
    keyed = prints.select("fp", F.posexplode(F.array(*cut)).alias("block", "key"))
    keys = checkpointed(keyed.groupBy("block", "key").agg(F.count("*").alias("n")))
    variants = F.transform(F.array(*map(F.lit, flips)), lambda m: F.col("key").bitwiseXOR(m))
    tasks = 1 + keys.count() * len(flips) // TASK_ROWS  # small files of keys would be read by few tasks
    emitted = keys.repartition(tasks, "block", "key").select("block", "n", F.posexplode(variants).alias("flip", "variant"))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("flip"))  # by the flip's lowest six bits
    told = [F.bit_or(F.when(F.col("flip").between(w, w + 63), place).otherwise(0)).alias(f"flips{w}") for w in words]
    buckets = emitted.groupBy("block", "variant").agg(F.sum("n").alias("n"), *told)
    buckets = checkpointed(buckets.filter(sum(F.bit_count(f"flips{w}") for w in words) > 1))

    def used(w: int) -> Column:
        return F.filter(F.array(*map(F.lit, flips[w : w + 64])), lambda _, i: F.bit_get(F.col(f"flips{w}"), i) == 1)

    def later(x: Column, i: Column) -> Column:
        after = F.slice("keys", i + 2, F.size("keys") - i - 1)
        return F.transform(F.filter(after, lambda y: x < y), lambda y: F.struct(x.alias("x"), y.alias("y")))

    found = F.transform(F.concat(*map(used, words)), lambda m: F.col("variant").bitwiseXOR(m))
    buckets = buckets.select("block", "n", found.alias("keys"))
    # Two keys meet in two buckets, in one by the two flips in either order.
    apart = buckets.filter(F.col("n") <= most).select("block", F.inline(F.flatten(F.transform("keys", later))))
    same = keys.filter(F.col("n").between(2, most)).select("block", F.col("key").alias("x"), F.col("key").alias("y"))
    left = keyed.select("block", F.col("key").alias("x"), F.col("fp").alias("a"))
    right = keyed.select("block", F.col("key").alias("y"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    once = (F.col("x") < F.col("y")) | (F.col("a") < F.col("b"))
    pairs = apart.unionByName(same).join(left, ["block", "x"]).join(right, ["block", "y"]).filter(near & once)
    crowded = buckets.filter(F.col("n") > most).select("block", F.explode("keys").alias("key"))
    crowded = crowded.unionByName(keys.filter(F.col("n") > most).select("block", "key"))
    rest = keyed.join(crowded, ["block", "key"], "left_semi").select("fp").distinct()
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), checkpointed(rest)


def links(prints: DataFrame, radius: int = 4, blocks: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Pairs (a, b) that join all fingerprints of `prints.fp` at most `radius` bits apart into their components.

    `prints` has distinct fingerprints. With one block every fingerprint emits the whole
    ball of half the radius, 2,081 variants at radius 4. With two blocks of 32 bits one
    block differs by at most half the radius, so each block's ball of a quarter of the
    radius is enough: 66 variants, emitted once for equal blocks. Fingerprints that meet
    in a variant are verified. Those of buckets over `max_bucket` are searched again by
    keys of two thirds of the bits, one of which differs by at most two thirds of the
    radius: 132 variants. Only those of buckets over CLOSER times `max_bucket` there are
    hashed by whole balls, where all that meet are within the radius of each other and
    link to the smallest. No pair is lost; links inside such a group are implied by its star.
    """
    if blocks not in (1, 2):
        raise ValueError("blocks is 1 or 2")
    if radius % 2:
        # An odd radius needs a larger ball on one side, after which those that meet may be too far apart.
        raise ValueError("whole balls need an even radius")
    found, rest = [], prints.select("fp")
    if blocks == 2:
        for parts, apart, most in ((HALVES, radius // 2, max_bucket), (THIRDS, 2 * radius // 3, CLOSER * max_bucket)):
            pairs, rest = _meet(rest, parts, -(-apart // 2), radius, most)
            found.append(pairs)
            if rest.isEmpty():
                break
    if not found or not rest.isEmpty():
        met = rest.select("fp", _ball(F.col("fp"), _flips(64, radius // 2)).alias("variant"))
        low = met.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a <> top")
        found.append(met.join(low.drop("top"), "variant").filter("fp <> a").select("a", F.col("fp").alias("b")))
    return reduce(DataFrame.unionByName, found).distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """Rows (doc_id, content, fp, component_id): the group of each row, named by its smallest doc_id.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows
    are returned as often as they occur; a group without any id has a null component_id;
    an empty table gives no rows. Equal fingerprints are folded before any search.
    """
    rows = checkpointed(fingerprints(docs, doc_id, text, words))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(links(prints, radius), "a", "b")
    rooted = prints.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "content", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """The rows of `docs` with one row of each near-duplicate group: the smallest doc_id, then the smallest text hash.

    All columns of `docs` are kept. A null doc_id comes last in its group.
    """
    groups = near_groups(docs, doc_id, text, radius)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "content")).alias("best")
    kept = groups.groupBy("root").agg(best).select(
        F.col("best.doc_id").alias("_llm_id"), F.col("best.content").alias("_llm_kept")
    )
    keyed = docs.withColumn("_llm_content", content(doc_id, text))
    same = (F.col("_llm_content") == F.col("_llm_kept")) & F.col(doc_id).eqNullSafe(F.col("_llm_id"))
    found = keyed.join(kept, same, "left_semi")
    return found.dropDuplicates([doc_id, "_llm_content"]).select(*docs.columns)
