"""Approximate nearest neighbours by multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.session import bounded, checkpointed

TABLES = 2
#: Vectors per bucket that the number of hash functions aims at.
BUCKET = 1_024
#: Hash values that the buckets of one shelf may differ in. Shelves are what is shuffled.
FREE = 3
#: Vectors and queries that meet in one group at most; queries that are scored at once.
BLOCK = 16_384
SCORED = 256
#: Recall on the sample queries for which probes are added.
TARGET_RECALL = 0.97
SAMPLE_QUERIES = 200
#: Vectors of the sample that gives the width of the cells.
SAMPLE_VECTORS = 2_000
#: Probes a table at most. An index that misses TARGET_RECALL within them is not used: fewer functions make larger buckets.
MAX_PROBES = 1_024


@dataclass(frozen=True)
class Index:
    """Hash functions floor((a.x + b) / width) of all tables, the norm that inner products are lifted to, and the probes."""

    a: np.ndarray  # tables, functions, dimensions + 1
    b: np.ndarray  # tables, functions
    width: float
    norm: float
    probes: int

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """One more component, after which the nearest vector is the one of largest inner product."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return np.column_stack([vectors, rest])

    def places(self, lifted: np.ndarray) -> np.ndarray:
        """(rows, tables, functions): places on the hash lines, in units of the width."""
        return (np.einsum("tmd,nd->ntm", self.a, lifted) + self.b) / self.width

    def shelves(self, cells: np.ndarray) -> np.ndarray:
        """Ids of what buckets are kept together: those that agree in all but the last FREE hash values."""
        return bucket_ids(cells[..., : max(0, cells.shape[-1] - FREE)])


def bucket_ids(cells: np.ndarray) -> np.ndarray:
    """One 64-bit id per vector of hash values."""
    out = np.full((*cells.shape[:-1], 1), 0x9E3779B97F4A7C15, np.uint64)[..., 0]
    for i in range(cells.shape[-1]):
        out = (out ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def probe_sequence(place: np.ndarray, probes: int) -> np.ndarray:
    """Hash values of the `probes` buckets likeliest to hold neighbours of a query at `place`, its own first.

    Moving one value down or up costs the squared distance to that border. Sets of moves
    are visited by their summed cost with a heap: each set grows by the next move or
    exchanges its last move for the next. Sets that move a value both ways are passed over.
    """
    base = np.floor(place)
    inside = place - base
    moves = sorted([(x * x, i, -1) for i, x in enumerate(inside)] + [((1 - x) ** 2, i, 1) for i, x in enumerate(inside)])
    out = [base]
    heap = [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(moves):
            step = moves[last + 1][0]
            heapq.heappush(heap, (cost + step, (*chosen, last + 1)))
            heapq.heappush(heap, (cost + step - moves[last][0], (*chosen[:-1], last + 1)))
        if len({moves[c][1] for c in chosen}) == len(chosen):
            cell = base.copy()
            for c in chosen:
                cell[moves[c][1]] += moves[c][2]
            out.append(cell)
    return np.array(out)


def usable(vec: str) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def _matrix(vectors: pa.Array | pd.Series, size: int) -> np.ndarray:
    """Rows of doubles; a shorter vector ends in zeros."""
    if isinstance(vectors, pd.Series):
        lists = [np.asarray(v, float) for v in vectors]
    else:
        vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
        flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
        if len(offsets) and (offsets == size).all():
            return flat.astype(float).reshape(-1, size)
        lists = [np.asarray(v, float) for v in vectors.to_pylist()]
    out = np.zeros((len(lists), size))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def exact(
    queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None = None
) -> list[tuple]:
    """(query, id, score) of the k best for each query in one block; scores are recomputed pair by pair.

    `allowed` (queries, rows) leaves out what a query did not probe.
    """
    out = []
    rough = queries @ base.T
    if allowed is not None:
        rough[~allowed] = -np.inf
    for q in range(len(queries)):
        near = _top(rough[q], ids, k + 8)
        near = near[rough[q][near] > -np.inf]
        scores = (base[near] * queries[q]).sum(axis=1)
        best = _top(scores, ids[near], k)
        out += [(int(query_ids[q]), int(ids[near[i]]), float(scores[i])) for i in best]
    return out


_FOUND = "query long, vec long, score double"


def _same(v: Column) -> Column:
    """Equal for equal vectors."""
    return F.sha2(F.array_join(F.transform(v, lambda x: x.cast("string")), ","), 256)


def fold(vectors: DataFrame, vec_id: str, vec: str, copies: int) -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors (vec = their smallest id, v), and (vec, vec_id) for up to `copies` smallest ids of each.

    No list of the k nearest can hold more of a vector's copies than that.
    """
    rows = vectors.filter(usable(vec)).filter(F.col(vec_id).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero
    keyed = rows.select("vec_id", _same(F.col("v")).alias("same"), "v")
    order = Window.partitionBy("same").orderBy("vec_id")
    ranked = keyed.select("same", "vec_id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= copies)
    ranked = checkpointed(ranked)
    first = ranked.filter("n = 1").select(F.col("same").alias("s"), F.col("vec_id").alias("vec"))
    members = ranked.join(first, F.col("same") == F.col("s")).select("vec", "vec_id")
    distinct = keyed.join(first, (F.col("same") == F.col("s")) & (F.col("vec_id") == F.col("vec"))).select("vec", "v").dropDuplicates(["vec"])
    return checkpointed(distinct), checkpointed(members)


def fit(base: DataFrame, queries: DataFrame, size: int, k: int, seed: int = 11) -> Index | None:
    """Choose functions, width and probes for `base` (vec, v).

    The number of functions grows with the logarithm of the rows, so that buckets stay
    small. Hash lines come from a fixed seed. SAMPLE_VECTORS vectors of lowest hash
    give the width; up to SAMPLE_QUERIES queries are compared with all rows in blocks, and
    the probes are what brings their neighbours to TARGET_RECALL. Where MAX_PROBES do not,
    functions are given up one by one; None if no number of them reaches it.
    """
    stats = base.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).first()
    n, norm = stats["n"], float(np.sqrt(stats["top"] or 1.0))
    functions = max(2, round(float(np.log(max(n / BUCKET, 1)) / np.log(3))))
    pick = np.random.default_rng(seed)
    a = pick.standard_normal((TABLES, functions, size + 1))
    shifts = pick.random((TABLES, functions))
    sample = base.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE_VECTORS).toArrow()
    spread = _matrix(sample.column("v"), size)

    def of(m: int) -> Index:
        index = Index(a[:, :m], np.zeros((TABLES, m)), 1.0, norm, 1)
        lines = index.places(index.lifted(spread, False))
        # Cells of two standard deviations: about three hold nearly all of a line.
        width = 2.0 * float(np.sqrt(lines.var(axis=0).mean())) or 1.0
        return replace(index, width=width, b=shifts[:, :m] * width)

    asked = queries.orderBy(F.xxhash64("vec", F.lit(1)), "vec").limit(SAMPLE_QUERIES).toArrow()
    if not asked.num_rows:
        return of(functions)
    ids, vectors = asked.column("vec").to_numpy(), _matrix(asked.column("v"), size)
    best = _scan_all(base, vectors, ids, size, k).toPandas()
    truth = base.join(bounded(best_frame(base, best)), "vec").toPandas()
    near = _matrix(truth.v, size)
    for m in range(functions, 0, -1):
        index = of(m)
        wanted = _wanted(index, ids, vectors, best, truth.vec.to_numpy(), near)
        if wanted is not None:
            return replace(index, probes=wanted)
    return None


def _wanted(index: Index, ids: np.ndarray, vectors: np.ndarray, best: pd.DataFrame, names: np.ndarray, near: np.ndarray) -> int | None:
    """Probes that bring the neighbours `best` of the sample queries to TARGET_RECALL; None if MAX_PROBES do not."""
    cells = dict(zip(names.tolist(), bucket_ids(np.floor(index.places(index.lifted(near, False))))))
    probes = [
        [{bucket: i for i, bucket in enumerate(bucket_ids(probe_sequence(p, MAX_PROBES)).tolist())} for p in row]
        for row in index.places(index.lifted(vectors, True))
    ]
    own = {q: i for i, q in enumerate(ids.tolist())}
    ranks = sorted(
        min(table.get(int(bucket), MAX_PROBES) for table, bucket in zip(probes[own[q]], cells[v]))
        for q, v in zip(best["query"], best.vec)
    )
    rank = ranks[min(len(ranks) - 1, int(np.ceil(len(ranks) * TARGET_RECALL)) - 1)] if ranks else 0
    return rank + 1 if rank < MAX_PROBES else None


def best_frame(base: DataFrame, best: pd.DataFrame) -> DataFrame:
    """Distinct ids of the neighbours found, at most SAMPLE_QUERIES * k."""
    return base.sparkSession.createDataFrame([(int(v),) for v in sorted(set(best.vec))], "vec long")


def _scan_all(base: DataFrame, vectors: np.ndarray, ids: np.ndarray, size: int, k: int) -> DataFrame:
    """The k nearest of all rows for a bounded set of queries: top k per batch, then overall. Own rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = exact(vectors, ids, _matrix(batch.column(1), size), batch.column(0).to_numpy(), k + 1)
            yield _found_batch([r for r in rows if r[0] != r[1]])

    return _merge(base.select("vec", "v").mapInArrow(run, _FOUND), k)


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query", "vec", "score"])


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec")
    once = found.groupBy("query", "vec").agg(F.max("score").alias("score"))
    return once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def _stored(base: DataFrame, index: Index, size: int) -> DataFrame:
    """(table, shelf, bucket, vec, v) of every row and table."""
    sent = base.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            cells = np.floor(model.places(model.lifted(_matrix(batch.column(1), size), False)))
            for t in range(cells.shape[1]):
                columns = [np.full(len(cells), t, np.int32), model.shelves(cells[:, t]), bucket_ids(cells[:, t])]
                names = ["table", "shelf", "bucket", "vec", "v"]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0), batch.column(1)], names)

    return base.select("vec", "v").mapInArrow(run, "table int, shelf long, bucket long, vec long, v array<double>")


def _probing(queries: DataFrame, index: Index, size: int) -> DataFrame:
    """(table, shelf, buckets, vec, v): per query and shelf the buckets probed there."""
    sent = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            places = model.places(model.lifted(_matrix(batch.column(1), size), True))
            for t in range(places.shape[1]):
                at, shelves, buckets = [], [], []
                for row, place in enumerate(places[:, t]):
                    cells = probe_sequence(place, model.probes)
                    kept, ids = model.shelves(cells), bucket_ids(cells)
                    for shelf in np.unique(kept):
                        at.append(row)
                        shelves.append(shelf)
                        buckets.append(ids[kept == shelf])
                rows = pa.array(at, pa.int64())
                columns = [pa.array(np.full(len(at), t, np.int32)), pa.array(shelves, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))]
                names = ["table", "shelf", "buckets", "vec", "v"]
                yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(rows), batch.column(1).take(rows)], names)

    return queries.select("vec", "v").mapInArrow(run, "table int, shelf long, buckets array<long>, vec long, v array<double>")


def _meet(stored: pa.Table, probing: pa.Table, size: int, k: int) -> pa.Table:
    """The k best for each query among the rows of the buckets that it probes on this shelf."""
    rows: list[tuple] = []
    if stored.num_rows and probing.num_rows:
        ids, matrix = stored.column("vec").to_numpy(), _matrix(stored.column("v"), size)
        names, bucket = np.unique(stored.column("bucket").to_numpy(), return_inverse=True)
        for start in range(0, probing.num_rows, SCORED):
            block = probing.slice(start, SCORED)
            probed = np.array([np.isin(names, b) for b in block.column("buckets").to_pylist()])
            rows += exact(_matrix(block.column("v"), size), block.column("vec").to_numpy(), matrix, ids, k, probed[:, bucket])
    return pa.Table.from_batches([_found_batch(rows)])


def _probed(base: DataFrame, heads: DataFrame, index: Index, size: int, k: int) -> DataFrame:
    """(query, vec, score): the k best of each query among the buckets that it probes."""
    stored, probing = _stored(base, index, size), _probing(heads, index, size)
    shelf = ["table", "shelf"]
    parts = F.ceil(F.count("*") / BLOCK).cast("int")
    sizes = bounded(stored.groupBy(*shelf).agg(parts.alias("parts")).join(probing.groupBy(*shelf).agg(parts.alias("turns")), shelf))
    part, turn = (F.pmod(F.xxhash64("vec"), n).cast("int") for n in ("parts", "turns"))
    left = stored.join(sizes, shelf).withColumn("part", part).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    right = probing.join(sizes, shelf).withColumn("turn", turn).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    group = [*shelf, "part", "turn"]
    met = (
        left.select(*group, "bucket", "vec", "v").groupBy(*group)
        .cogroup(right.select(*group, "buckets", "vec", "v").groupBy(*group))
        .applyInArrow(lambda a, b: _meet(a, b, size, k), _FOUND)
    )
    return checkpointed(_merge(met, k))


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", k: int = 20) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each query, by inner product in doubles.

    Queries are rows of `vectors`; a row is no candidate of itself. Vectors that are null,
    empty, zero or not finite, and rows without id, take no part; a row repeated with its
    id counts once. Copies of a vector are searched once. Buckets lie on shelves, which are
    split into blocks of at most BLOCK vectors and BLOCK queries, so none is too large. A query for which fewer
    than k were found is compared with all rows, in blocks; so are all queries if no index
    reaches TARGET_RECALL on the sample. No usable vectors: no rows.
    """
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base, members = fold(vectors, vec_id, vec, k + 1)
    size = base.agg(F.max(F.size("v"))).first()[0]
    if size is None:
        return empty
    asked = queries.filter(usable(vec)).select(F.col(vec_id).cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("q"))
    asked = asked.filter("query_id is not null").dropDuplicates(["query_id"])
    named = _same(F.col("v"))
    plain = asked.withColumn("v", F.transform("q", lambda x: x + F.lit(0.0))).withColumn("same", named)
    known = base.withColumn("s", named).select("vec", "s")
    asked = checkpointed(plain.join(known, F.col("same") == F.col("s")).select("query_id", "vec"))
    heads = checkpointed(base.join(asked.select("vec").distinct(), "vec", "left_semi"))
    index = fit(base, heads, size, k)
    if index is None:
        return _expand(_blocks(base, heads, size, k + 1), asked, members, k)
    answered = _expand(_probed(base, heads, index, size, k + 1), asked, members, k)
    few = answered.groupBy("query_id").agg(F.count("*").alias("n"))
    total = members.count()
    short = asked.join(few, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < min(k, max(total - 1, 0)))
    missing = checkpointed(short.select("query_id", "vec"))
    left = missing.select("vec").distinct()
    if left.isEmpty():
        return answered
    every = _blocks(base, base.join(left, "vec", "left_semi"), size, k + 1)
    again = _expand(every, missing, members, k)
    return answered.join(missing, "query_id", "left_anti").unionByName(again)


def _blocks(base: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    """A stated query set against all rows: each block of rows meets each block of queries."""
    n = max(1, -(-queries.count() // BLOCK))
    blocks = queries.withColumn("block", F.pmod(F.xxhash64("vec"), F.lit(n)).cast("int")).groupBy("block").agg(
        F.collect_list("vec").alias("qs"), F.collect_list("v").alias("qv")
    )
    rows = base.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    parts = max(1, -(-base.count() // BLOCK))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("vec"), F.lit(parts)).cast("int"))
    spread = blocks.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        rows = _matrix(left.v, size)
        for q in right.itertuples() if len(left) else ():
            asked, names = _matrix(pd.Series(list(q.qv)), size), np.asarray(q.qs)
            for at in range(0, len(names), SCORED):
                found += exact(asked[at : at + SCORED], names[at : at + SCORED], rows, left.vec.to_numpy(), k)
        frame = pd.DataFrame(found, columns=["query", "vec", "score"])
        return frame.astype({"query": "int64", "vec": "int64", "score": "float64"})

    met = rows.withColumnRenamed("b", "block").groupBy("block", "p").cogroup(spread.groupBy("block", "p")).applyInPandas(meet, _FOUND)
    return checkpointed(_merge(met, k))


def _expand(found: DataFrame, asked: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Distinct vectors back to rows: each query of a vector gets all copies but itself, and keeps the k nearest."""
    copies = members.withColumnRenamed("vec", "m")
    hits = asked.withColumnRenamed("vec", "own").join(found, F.col("own") == F.col("query"))
    rows = hits.select("query_id", F.col("vec").alias("near"), "score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = rows.join(copies, F.col("near") == F.col("m")).filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
