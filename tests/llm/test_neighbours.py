import numpy as np
import pandas as pd
import pytest

from labspark.llm import neighbours
from labspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(rows, queries, k=20):
    """rows: (vec_id, vector). Exact lists, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    matrix = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i in queries:
            scores = (matrix * np.asarray(v, float)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def lists(df):
    out = {}
    for r in df.sort_values(["query_id", "rank"]).itertuples():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_query_recall(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = list(zip(table.vec_id.tolist(), table.embedding))
    want = brute(rows, {i for i, _ in rows if i % 20 == 0})
    got = lists(QUERIES["op10_multiprobe_neighbours"](spark, SF).toPandas())
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = 0
    scores = {(q, i): s for q, near in brute(rows, set(want), len(rows)).items() for i, s in near}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(scores[q, i] - s) < 1e-12 for i, s in near)
        hits += len({i for i, _ in near} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("block", [7, 2048])
def test_unlike_norms_and_hot_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    pick = np.random.default_rng(2)
    centre = pick.standard_normal(12)
    rows = [(i, (centre + 0.01 * pick.standard_normal(12)) * pick.uniform(0.5, 3)) for i in range(120)]
    rows += [(200 + i, pick.standard_normal(12) * pick.uniform(0.1, 4)) for i in range(200)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = lists(neighbours.search(frame, frame.filter("vec_id % 10 = 0"), k=5).toPandas())
    want = brute(rows, set(got), 5)
    assert len(got) == 32
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got) >= 0.9 * 5 * len(got)


def test_probe_sequence_is_in_order():
    place = np.array([0.1, 3.5, -2.2])
    cells = neighbours.probe_sequence(place, 27)
    assert len(np.unique(cells, axis=0)) == 27
    base = np.floor(place)
    cost = [sum((p - b) ** 2 if c < b else (b + 1 - p) ** 2 if c > b else 0 for p, b, c in zip(place, base, cell)) for cell in cells]
    assert cost == sorted(cost)


def test_nulls_ties_few_rows_and_clashing_columns(spark):
    inf, nan = float("inf"), float("nan")
    good = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.5, 0.5]), (101, [-1.0, 0.0])]
    bad = [(300, None), (301, [0.0, 0.0]), (302, [nan, 1.0]), (303, [inf, 1.0]), (304, [None, 1.0]), (None, [1.0, 1.0]), (305, [])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad + good[:3]], "vec_id long, embedding array<float>, vec int, rank int")
    got = lists(neighbours.search(frame, frame.filter("vec_id % 20 = 0"), k=20).toPandas())
    assert got == brute(good, {0, 20, 100})
    few = frame.filter("vec_id in (0, 100, 101)")
    assert lists(neighbours.search(few, few, k=20).toPandas()) == brute([good[0], *good[-2:]], {0, 100, 101})
    assert neighbours.search(frame.limit(0), frame.limit(0)).count() == 0
    assert neighbours.search(frame.filter("vec_id = 301"), frame).count() == 0


@pytest.mark.parametrize("probes", [1, 16])
def test_recall_holds_where_the_probes_do_not_suffice(spark, monkeypatch, probes):
    """Vectors without structure in many more buckets than may be probed."""
    monkeypatch.setattr(neighbours, "MAX_PROBES", probes)
    monkeypatch.setattr(neighbours, "BUCKET", 4)
    pick = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(pick.standard_normal((2_000, 16)))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = lists(neighbours.search(frame, frame.filter("vec_id % 20 = 0"), k=10).toPandas())
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 10)
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got) >= 0.95 * 10 * len(want)
