"""Merkle manifest of a table: a hash tree per group of rows, one root over the groups, a proof per row.

Rows of a group are numbered in order and cut into aligned blocks of FANOUT ** LEVELS
leaves, one row of a table each. A block hashes its own levels. The levels above are a
butterfly: in every round each block takes over the roots that the other members of its
aligned run hold, and hashes the common ancestor for itself, so that after the last round
every block knows its whole upper proof and no pass leads down again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators.numbering import number_rows
from labspark.session import bounded, checkpointed

FANOUT = 8
#: Levels that a block hashes by itself: 8 ** 3 = 512 leaves, some 100 KB.
LEVELS = 3
#: A level of a proof: the place in the run, and the digests of the run's other members, from left to right.
_PROOF = "array<struct<at:int,others:array<string>>>"


def joined_digest(parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts, put together."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def leaf(columns: Sequence[str], changed: Mapping[str, Column] | None = None) -> Column:
    """H of a row's values: `-` for null, else the number of UTF-8 bytes, a colon and the value.

    `changed` replaces columns, for the leaf of a row that was altered.
    """
    values = [(changed or {}).get(c, F.col(c)).cast("string") for c in columns]
    shown = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*shown).cast("binary"), 256)


def _above(nodes: Column, fanout: int) -> Column:
    """The level above an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: joined_digest(F.slice(nodes, i * fanout + 1, fanout)))


def _height(count: Column, fanout: int) -> Column:
    """Levels of hashing above `count` nodes until one is left."""
    powers = [fanout**k for k in range(64) if fanout**k < 1 << 62]
    return reduce(lambda a, b: a + b, [(count > p).cast("int") for p in powers])


def _others(run: Column, at: Column) -> Column:
    """A level of a proof, from all members of the run and the place of one's own."""
    others = F.concat(F.slice(run, F.lit(1), at), F.slice(run, at + 2, F.greatest(F.size(run) - at - 1, F.lit(0))))
    return F.struct(at.cast("int").alias("at"), others.alias("others"))


def _butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, blocks, root) to (tree, block, subroot, proof): rounds of swapped roots.

    In round r a block and its partners differ in digit r of the block number. A sibling
    subtree that is cut short at the end of a tree has fewer blocks than partners; they
    share the askers evenly, as all of them hold its root.
    """
    state = checkpointed(blocks.withColumn("proof", F.expr(f"cast(array() as {_PROOF})")))
    most = state.agg(F.max("blocks").alias("n")).first()["n"] or 0
    span = 1
    while span < most:
        asks = state.filter(F.col("blocks") > span).select(
            "tree", "block", "blocks", "root", "proof", (F.expr(f"block div {span}") % fanout).cast("int").alias("at"),
            F.expr(f"(block div {span * fanout}) * {fanout}").alias("base"), (F.col("block") % span).alias("low"),
        )
        last = F.expr(f"(blocks - 1) div {span}")
        wanted = asks.withColumn("member", F.explode(F.sequence("base", F.least(F.col("base") + fanout - 1, last))))
        size = F.least(F.lit(span), F.col("blocks") - F.col("member") * span)
        wanted = wanted.select("tree", "block", "blocks", "proof", "at", "member", (F.col("member") * span + F.col("low") % size).alias("source"))
        held = state.select(F.col("tree").alias("t"), F.col("block").alias("source"), F.col("root").alias("given"))
        met = wanted.withColumnRenamed("tree", "t").join(held, ["t", "source"])
        runs = met.groupBy(F.col("t").alias("tree"), "block").agg(
            F.first("blocks").alias("blocks"), F.first("proof").alias("proof"), F.first("at").alias("at"),
            F.transform(F.sort_array(F.collect_list(F.struct("member", "given"))), lambda s: s["given"]).alias("run"),
        )
        grown = runs.select(
            "tree", "block", "blocks", joined_digest(F.col("run")).alias("root"),
            F.concat("proof", F.array(_others(F.col("run"), F.col("at")))).cast(_PROOF).alias("proof"),
        )
        state = checkpointed(grown.unionByName(state.filter(F.col("blocks") <= span)))
        span *= fanout
    return state.select("tree", "block", F.col("root").alias("subroot"), "proof")


def _grown(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, pos, n, leaf, payload) to (tree, leaf, payload, subroot, proof); pos counts from 0 in each tree of n leaves."""
    width = fanout**levels
    packed = checkpointed(
        leaves.withColumn("block", F.expr(f"pos div {width}"))
        .groupBy("tree", "block")
        .agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "leaf", "payload"))).alias("rows"))
    )
    height = F.least(F.lit(levels), _height(F.col("n"), fanout))
    nodes = packed.withColumn("_0", F.transform("rows", lambda r: r["leaf"]))
    for k in range(levels):
        nodes = nodes.withColumn(f"_{k + 1}", F.when(height > k, _above(F.col(f"_{k}"), fanout)).otherwise(F.col(f"_{k}")))
    inner = F.array(*[F.when(height > k, F.col(f"_{k}")) for k in range(levels)])
    nodes = checkpointed(nodes.select("tree", "block", "n", "rows", inner.alias("inner"), F.get(f"_{levels}", F.lit(0)).alias("root")))
    tops = nodes.select("tree", "block", F.expr(f"(n + {width - 1}) div {width}").alias("blocks"), "root")
    upper = _butterfly(tops, fanout).withColumnRenamed("proof", "upper")
    rows = nodes.join(upper, ["tree", "block"]).select("tree", "inner", "upper", "subroot", F.posexplode("rows").alias("i", "r"))
    own = []
    for k in range(levels):
        at = F.expr(f"i div {fanout**k}").cast("int")
        run = F.slice(F.get("inner", F.lit(k)), at - at % fanout + 1, fanout)
        own.append(F.when(F.get("inner", F.lit(k)).isNotNull(), _others(run, at % fanout)))
    proof = F.concat(F.filter(F.array(*own), lambda p: p.isNotNull()).cast(_PROOF), "upper")
    return rows.select("tree", "r.leaf", "r.payload", "subroot", proof.alias("proof"))


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    return number_rows(checkpointed(rows), [*order, F.monotonically_increasing_id()], "at", 0)


def manifest(docs: DataFrame, columns: Sequence[str], group: str, doc_id: str = "doc_id", presented: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row per row of `docs`: (doc_id, group, leaf, presented, subroot, root, proof).

    The leaf is the digest of `columns`. Leaves of one value of `group` (null is a value)
    ascend by doc_id, null first, then by leaf, and form a tree: every `fanout` consecutive
    nodes give a node, the last run fewer. Subroots, ordered by group (null first, bytewise),
    form the tree that leads to root. `proof` lists the levels from the leaf to root, each
    with the place in its run and the digests of the others. `presented` is the leaf to be
    checked against the proof, the row's own where nothing is given. Repeated rows are leaves
    of their own; only digests leave the scan, so long texts cost no memory; other columns
    are not looked at, whatever their names; an empty table gives no rows.
    """
    own = leaf(columns)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(group).alias("group"), own.alias("leaf"), (own if presented is None else presented).alias("presented"))
    numbered = _numbered(rows, [F.col("group").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    numbered = checkpointed(numbered)
    trees = checkpointed(numbered.groupBy("group").agg(F.min("at").alias("tree"), F.count("*").alias("n")))
    known = bounded(trees.withColumnRenamed("group", "g"))
    leaves = numbered.join(known, F.col("group").eqNullSafe(F.col("g"))).select(
        "tree", (F.col("at") - F.col("tree")).alias("pos"), "n", "leaf", F.struct("doc_id", "presented").alias("payload")
    )
    grown = checkpointed(_grown(leaves, fanout, levels))
    # Trees begin where their first leaf stands, so their order is that of the groups.
    tops = number_rows(grown.groupBy("tree").agg(F.min("subroot").alias("leaf")), [F.col("tree")], "pos", 0)
    tops = checkpointed(tops)
    top = tops.select(F.lit(0).cast("long").alias("tree"), "pos", F.lit(tops.count()).cast("long").alias("n"), "leaf", F.col("tree").alias("payload"))
    roots = _grown(top, fanout, levels).select(F.col("payload").alias("tree"), F.col("subroot").alias("root"), F.col("proof").alias("above"))
    named = roots.join(trees.select("tree", "group"), "tree")
    return grown.join(bounded(named), "tree").select(
        "payload.doc_id", "group", "leaf", "payload.presented", "subroot", "root", F.concat("proof", "above").alias("proof")
    )


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def up(node: Column, level: Column) -> Column:
        others, at = level["others"], level["at"]
        left = F.slice(others, F.lit(1), at)
        right = F.slice(others, at + 1, F.greatest(F.size(others) - at, F.lit(0)))
        return joined_digest(F.concat(left, F.array(node), right))

    return F.aggregate(proof, start, up)


def siblings(proof: Column) -> Column:
    """All digests of a proof in order."""
    return F.flatten(F.transform(proof, lambda p: p["others"]))
