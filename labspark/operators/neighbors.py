"""Exact k nearest neighbours as a blocked join.

Vectors are grouped around a few pivots. The distances of the k nearest members of every
pivot bound the answer of a query from above, so by the triangle inequality many cells
need not be visited (the pivot-based kNN join of Lu et al., 2012). Queries and base are each
dealt into a few groups of limited size, every query group meets every base group once, and
the task visits the cells of its base group nearest first, with the bounds found so far. So
a row is sent as often as the other side has groups, however many cells it has to visit.
Rows with equal vectors are folded first: the k lowest ids of a vector
are all that any query can need, and one query answers for all of its copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labspark.operators.reshape import top_rows
from labspark.session import checkpointed

ONE_CELL_ROWS = 8192  # below this a single cell is cheapest
ROWS_PER_SQUARE_PIVOT = 36  # pivots grow with the square root of the rows: one for 36 rows, two for 144, …
GROUP_ROWS = 8192  # rows of a group, up to GROUPS groups; beyond, groups grow up to GROUP_BYTES
GROUPS = 8
GROUP_BYTES = 32 * 1024 * 1024  # of vectors in one group
BLOCK_ROWS = 2048  # base rows compared at once
QUERY_BLOCK_ROWS = 512
_EXACT_AT_ONCE = 8192  # pairs
_SLACK = 1e-9  # relative room for rounding in the bounds; candidates are compared exactly

_NEAR = "array<struct<d2: double, id: long>>"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list<double> column as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _pick_pivots(base: DataFrame, count: int) -> np.ndarray:
    """A few base vectors, chosen by hash so that every run picks the same ones.

    Any point can be a pivot; a single cell is measured from the origin.
    """
    if count == 1:
        return np.zeros((1, 1))
    rows = base.select("vec").orderBy(F.xxhash64("id"), "id").limit(count).toArrow()
    return _matrix(rows.column("vec"))


def _assign_cells(base: DataFrame, pivots: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            near = _distances(_matrix(batch.column("vec")), pivots)
            cell = near.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(near[np.arange(len(cell)), cell])],
                names=["scope", "id", "vec", "cell", "reach"],
            )

    return base.select("scope", "id", "vec").mapInArrow(
        assign, "scope string, id long, vec array<double>, cell int, reach double"
    )


def _cell_summaries(cells: DataFrame, k: int) -> dict[str, dict[int, tuple]]:
    """Per scope and cell its radii and the k smallest distances.

    One row per scope and cell, so its size depends on the pivots, not on the data.
    """
    sizes = cells.groupBy("scope", "cell").agg(F.min("reach").alias("low"), F.max("reach").alias("high"))
    inner = (
        top_rows(cells.select("scope", "cell", "reach", "id"), ["scope", "cell"], [F.col("reach"), F.col("id")], k)
        .groupBy("scope", "cell")
        .agg(F.sort_array(F.collect_list("reach")).alias("inner"))
    )
    summary: dict[str, dict[int, tuple]] = {}
    for row in sizes.join(inner, ["scope", "cell"]).collect():
        summary.setdefault(row.scope, {})[row.cell] = (row.low, row.high, list(row.inner))
    return summary


def _group_count(rows: int, width: int) -> int:
    """Groups of a scope's rows: a fixed number, and more only where a group would pass its size."""
    return max(1, min(GROUPS, -(-rows // GROUP_ROWS)), -(-rows * 8 * width // GROUP_BYTES))


def _per_scope(numbers: dict[str, int]) -> Column:
    """A number by the scope of the row, null for other scopes."""
    entries = [F.lit(x) for entry in numbers.items() for x in entry]
    return F.create_map(*entries)[F.col("scope")] if entries else F.lit(None).cast("int")


def _dealt(rows: DataFrame, own: str, own_groups: dict[str, int], other: str, other_groups: dict[str, int]) -> DataFrame:
    """Every row in its group by hash, once for every group of the other side."""
    place = F.pmod(F.xxhash64("id"), _per_scope(own_groups).cast("long")).cast("int")
    return rows.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), _per_scope(other_groups) - 1)))


class _Best:
    """The k nearest found so far of a block of queries."""

    def __init__(self, rows: int, k: int) -> None:
        self.k = k
        self.d2 = np.full((rows, k), np.inf)
        self.ids = np.full((rows, k), np.iinfo(np.int64).max)
        self.found = np.zeros(rows, np.int64)

    def add(self, who: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Add pairs; returns the queries concerned."""
        users, at = np.unique(who, return_inverse=True)
        held, place = np.nonzero(np.arange(self.k) < self.found[users, None])
        at = np.concatenate([at, held])
        d2 = np.concatenate([d2, self.d2[users[held], place]])
        ids = np.concatenate([ids, self.ids[users[held], place]])
        order = np.lexsort((ids, d2, at))
        at, d2, ids = at[order], d2[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        at, rank = at[keep], rank[keep]
        self.d2[users[at], rank] = d2[keep]
        self.ids[users[at], rank] = ids[keep]
        self.found[users] = np.bincount(at, minlength=len(users))
        return users


def _upper_bounds(near: np.ndarray, parts: dict[int, tuple], k: int) -> np.ndarray:
    """Distance within which a query has k base rows, from the summaries of all cells."""
    upper = np.concatenate([near[:, [cell]] + np.asarray(inner, dtype=float) for cell, (_, _, inner) in parts.items()], axis=1)
    return np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] >= k else np.full(len(near), np.inf)


def _compare_cell(q: np.ndarray, visit: np.ndarray, b: np.ndarray, ids: np.ndarray, bound: np.ndarray, best: _Best) -> None:
    """Compare the queries at `visit` with the rows of a cell; tightens their bounds."""
    k = best.k
    some = q[visit]
    norms, own = (b * b).sum(axis=1), (some * some).sum(axis=1)
    rough = norms - 2.0 * (some @ b.T) + own[:, None]
    room = _SLACK * (1.0 + norms.max() + own)
    limit = bound[visit] ** 2
    limit = limit + np.where(np.isfinite(limit), _SLACK * limit, 0.0) + room
    hit = rough <= limit[:, None]
    crowded = np.flatnonzero(hit.sum(axis=1) > 2 * k)
    if len(crowded):
        kth = np.partition(rough[crowded], k - 1, axis=1)[:, k - 1]
        hit[crowded] &= rough[crowded] <= (kth + _SLACK * np.abs(kth) + room[crowded])[:, None]
    row, at = np.nonzero(hit)
    for start in range(0, len(row), _EXACT_AT_ONCE):
        r, c = row[start : start + _EXACT_AT_ONCE], at[start : start + _EXACT_AT_ONCE]
        users = best.add(visit[r], ((b[c] - some[r]) ** 2).sum(axis=1), ids[c])
        full = users[best.found[users] == k]
        bound[full] = np.minimum(bound[full], np.sqrt(best.d2[full, k - 1]))


def _compare(pivots: np.ndarray, summary: dict[str, dict[int, tuple]], k: int, block_rows: int, query_rows: int):
    """Best k rows of a base group for each query of a query group; exact distances decide."""

    def compare(key: tuple, queries: pa.Table, base: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if queries.num_rows and base.num_rows:
            parts = summary[key[0].as_py()]
            cells = base.column("cell").to_numpy()
            order = np.argsort(cells, kind="stable")
            cells, ids, b = cells[order], base.column("id").to_numpy()[order], _matrix(base.column("vec"))[order]
            here, starts = np.unique(cells, return_index=True)
            ends = np.append(starts[1:], len(cells))
            q, qids = _matrix(queries.column("vec")), queries.column("id").to_numpy()
            # Queries of one cell lie side by side, so that a block needs few cells.
            slices = range(0, len(q), query_rows)
            home = np.concatenate([_distances(q[i : i + query_rows], pivots).argmin(axis=1) for i in slices])
            order = np.argsort(home, kind="stable")
            q, qids = q[order], qids[order]
            for i in slices:
                block = q[i : i + query_rows]
                near = _distances(block, pivots)
                bound, best = _upper_bounds(near, parts, k), _Best(len(block), k)
                for c in np.argsort(near[:, here].mean(axis=0), kind="stable"):
                    low, high, _ = parts[here[c]]
                    d = near[:, here[c]]
                    for start in range(starts[c], ends[c], block_rows):
                        room = _SLACK * (1.0 + d + (high if np.isfinite(high) else 0.0))
                        visit = np.flatnonzero((d - high <= bound + room) & (low - d <= bound + room))
                        if len(visit):
                            end = min(start + block_rows, ends[c])
                            _compare_cell(block, visit, b[start:end], ids[start:end], bound, best)
                row, place = np.nonzero(np.arange(k) < best.found[:, None])
                found.append((qids[i : i + query_rows][row], best.d2[row, place], best.ids[row, place]))
        qid, d2, near_id = (np.concatenate(x) for x in zip(*found))
        return pa.table({"qid": qid, "d2": d2, "id": near_id})

    return compare


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    id_column: str,
    vector: str,
    query_scope: Column | None = None,
    base_scope: Column | None = None,
) -> DataFrame:
    """The k nearest other base rows of every query row.

    Returns id, neighbor_id, d2 (squared distance) and rank, ordered by distance, then id.
    A row is never its own neighbour. With scopes only base rows of the same scope count.
    """
    scope = lambda c: (F.lit("") if c is None else c.cast("string")).alias("scope")
    vec = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("vec")
    rows = queries.select(scope(query_scope), F.col(id_column).cast("long").alias("id"), vec)
    points = base.select(scope(base_scope), F.col(id_column).cast("long").alias("id"), vec)

    reach = k + 1  # one more, because a row may meet itself
    folded = checkpointed(top_rows(points, ["scope", "vec"], [F.col("id")], reach).drop("rank"))
    asked = checkpointed(rows.groupBy("scope", "vec").agg(F.min("id").alias("id")))
    counts = {r.scope: r["count"] for r in folded.groupBy("scope").count().collect()}
    asking = {r.scope: r["count"] for r in asked.groupBy("scope").count().collect()}
    n_rows = sum(counts.values())
    pivots = _pick_pivots(folded, isqrt(n_rows // ROWS_PER_SQUARE_PIVOT) if n_rows >= ONE_CELL_ROWS else 1)
    first = folded.select(F.size("vec").alias("d")).first()
    width = max(1, first.d if first else 1)
    if len(pivots) == 1:  # nothing to leave out: every query meets all rows of its scope
        cells = folded.withColumn("cell", F.lit(0))
        summary = {s: {0: (0.0, np.inf, [])} for s in counts}
    else:
        cells = _assign_cells(folded, pivots)
        summary = _cell_summaries(checkpointed(cells.select("scope", "id", "cell", "reach")), reach)
    q_groups, b_groups = ({s: _group_count(n, width) for s, n in x.items() if s is not None and s in counts} for x in (asking, counts))
    block_rows = max(1, min(BLOCK_ROWS, GROUP_BYTES // (8 * width)))
    compared = (
        _dealt(asked, "q_group", q_groups, "b_group", b_groups).groupBy("scope", "q_group", "b_group")
        .cogroup(_dealt(cells, "b_group", b_groups, "q_group", q_groups).groupBy("scope", "q_group", "b_group"))
        .applyInArrow(_compare(pivots, summary, reach, block_rows, QUERY_BLOCK_ROWS), "qid long, d2 double, id long")
    )
    best = (
        top_rows(compared, ["qid"], [F.col("d2"), F.col("id")], reach)
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("d2", "id"))).alias("near"))
    )
    # Vectors are wide: they meet their answers by shuffle, never through the driver.
    answered = asked.join(best.hint("merge"), asked["id"] == best["qid"]).select("scope", "vec", "near")
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k)
    return (
        rows.join(answered.hint("merge"), ["scope", "vec"])
        .select("id", F.posexplode(others).alias("_pos", "n"))
        .select(
            F.col("id").alias(id_column),
            F.col("n.id").alias("neighbor_id"),
            F.col("n.d2").alias("d2"),
            (F.col("_pos") + 1).cast("int").alias("rank"),
        )
    )
