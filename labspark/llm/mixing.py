"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from labspark.llm.common import WORD, content
from labspark.operators.numbering import number_rows
from labspark.session import bounded, checkpointed

#: Fixed weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Slices of the ranking per source; only the slice in which a source's target falls is ranked row by row.
SLICES = 16_384


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Add `target` to one row per source (source, source_size).

    Sources in code point order, null last, take the weights in turn and share `share`
    times all sizes. A target stops at `most` times its source's size; the excess is
    shared again by weight among the rest until none is above.
    """
    numbered = number_rows(sizes, [F.col("source").isNull(), F.col("source")], "_rank", 0)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = checkpointed(numbered.withColumn("_weight", turn).drop("_rank"))
    cap = F.col("source_size") * F.lit(float(most))
    level = 0.0
    while True:
        full = F.col("_weight") * level > cap
        sums = rows.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, cap)).alias("full"),
            F.sum(F.when(~full, F.col("_weight"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not sums["open"]:
            break
        risen = (share * (sums["all"] or 0) - (sums["full"] or 0.0)) / sums["open"]
        if risen <= level:
            break
        level = risen
    return rows.withColumn("target", F.least(F.col("_weight") * level, cap)).drop("_weight")


def sized(docs: DataFrame, doc_id: str, text: str, source: str, weight: str | None, seed: int) -> DataFrame:
    """The columns of `docs` under a prefix, and what the plan needs of each row."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_key")), 12) + 0.5) / float(1 << 52)
    wanted = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(0.0))
    return docs.select(
        *[F.col(c).alias(f"_in_{c}") for c in docs.columns],
        word_count(text).alias("_size"),
        content(doc_id, text).alias("_key"),
        F.col(source).alias("_source"),
        wanted.alias("_wanted"),
    ).withColumn("_odds", u / (1 - u))


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the plan's ratio and add whole copies, inclusion odds and the rank value of Pareto sampling."""
    expected = F.least(F.try_divide(F.col("_ratio") * F.col("_wanted"), F.col("_mean")), F.lit(float(MOST_COPIES)))
    rest = F.col("_expected") - F.col("_whole")
    odds = F.when(rest > 0, rest / (1 - rest))
    share = F.col("_ratio") - F.floor("_ratio")
    usual = F.when(share > 0, share / (1 - share)).otherwise(1.0)
    return (
        rows.join(plan, rows["_source"].eqNullSafe(plan["source"]))
        .withColumn("_expected", F.coalesce(expected, F.lit(0.0)))
        .withColumn("_whole", F.floor("_expected"))
        .withColumn("_rank", F.col("_odds") / odds)
        # The rank value, scaled into 0..1 in the same order: even slices where weights are even.
        .withColumn("_slice", F.floor(F.col("_rank") * usual / (1 + F.col("_rank") * usual) * SLICES).cast("int"))
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: str | None = None,
    seed: int = 7,
) -> DataFrame:
    """`docs` with _llm_size, _llm_source_size, _llm_target and _llm_copies: how often each document enters the mix.

    Every document is due ratio = target / source size copies (times its weight over the
    source's mean weight, if a weight column is given), at most two. Whole copies are
    certain. For the rest documents are ranked by random odds over inclusion odds and
    taken from the front until their words reach what the source still lacks; the last
    one is taken if that brings the sum nearer. The random number comes from id and text,
    so reruns agree and repeated rows share their fate. Null sources form one source,
    null texts have size 0, an empty table gives no rows. No source is sorted as a whole:
    sums over slices of the ranking find the slice in which its target falls. A column of the
    input that is called like an added one is replaced. Texts of any length are only counted.
    """
    docs = docs.drop("_llm_size", "_llm_source_size", "_llm_target", "_llm_copies")
    names = ["_size", "_key", "_source", "_wanted", "_odds"]
    rows = checkpointed(sized(docs, doc_id, text, source, weight, seed).select(*names))
    sums = rows.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_size").cast("long").alias("source_size"),
        F.try_divide(F.sum(F.col("_size") * F.col("_wanted")), F.sum("_size")).alias("_mean"),
    )
    plan = checkpointed(
        targets(sums).withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    )
    drawn = _with_copies(rows, bounded(plan))
    by_source = Window.partitionBy("source")
    # Slice -1 holds the certain copies of the source, so a running sum over slices is what has been taken so far.
    slices = (
        drawn.select("source", F.lit(-1).alias("_slice"), (F.col("_whole") * F.col("_size")).alias("w"))
        .unionByName(drawn.filter("_rank is not null").select("source", "_slice", F.col("_size").alias("w")))
        .groupBy("source", "_slice")
        .agg(F.sum("w").alias("w"))
        .withColumn("upto", F.sum("w").over(by_source.orderBy("_slice")))
        .withColumn("before", F.col("upto") - F.col("w"))
    )
    crossing = (
        slices.join(plan.select(F.col("source").alias("s"), F.col("target").alias("t")), F.col("source").eqNullSafe(F.col("s")))
        .filter("_slice >= 0 and upto > t and before <= t")
        .select(F.col("source").alias("s"), F.col("_slice").alias("at"), "before", "t")
    )
    crossing = checkpointed(crossing)
    order = Window.partitionBy("s").orderBy("_rank", "_key")
    last = (
        drawn.join(bounded(crossing), drawn["source"].eqNullSafe(F.col("s")) & (F.col("_slice") == F.col("at")))
        .filter("_rank is not null")
        .withColumn("sum", F.col("before") + F.sum("_size").over(order))
        .filter((F.col("sum") - F.col("t")) <= (F.col("t") - (F.col("sum") - F.col("_size"))))
        .groupBy("s")
        .agg(F.max(F.struct("_rank", "_key")).alias("_last"))
    )
    # Without a crossing slice every ranked document fits; without a last row none of the crossing slice does.
    cuts = crossing.select(F.col("s").alias("c"), "at").join(last, F.col("c").eqNullSafe(F.col("s")), "left").select("c", "at", "_last")
    full = checkpointed(plan.join(cuts, F.col("source").eqNullSafe(F.col("c")), "left").drop("c"))
    plain = sized(docs, doc_id, text, source, weight, seed)
    taken = F.when(F.col("_rank").isNull(), False).when(F.col("at").isNull(), True).when(
        F.col("_slice") == F.col("at"), F.coalesce(F.struct("_rank", "_key") <= F.col("_last"), F.lit(False))
    ).otherwise(F.col("_slice") < F.col("at"))
    out = _with_copies(plain, bounded(full)).withColumn("_copies", (F.col("_whole") + taken.cast("int")).cast("int"))
    return out.select(
        *[F.col(f"_in_{c}").alias(c) for c in docs.columns],
        F.col("_size").alias("_llm_size"),
        F.col("source_size").alias("_llm_source_size"),
        F.col("target").alias("_llm_target"),
        F.col("_copies").alias("_llm_copies"),
    )
