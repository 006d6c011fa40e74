import numpy as np
import pytest
from pyspark.sql import functions as F

from labspark.operators import neighbors, resample
from labspark.operators.neighbors import nearest

VECTORS = "id long, label int, vec array<double>"


def brute(ids, x, k, allowed=None):
    """Reference answer by full comparison, ties by id."""
    out = {}
    for i in range(len(ids)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        ok = np.ones(len(ids), bool) if allowed is None else allowed[i].copy()
        ok[i] = False
        at = np.flatnonzero(ok)
        order = at[np.lexsort((ids[at], d[at]))][:k]
        out[int(ids[i])] = [int(n) for n in ids[order]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append(r.neighbor_id)
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(neighbors, "ONE_CELL_ROWS", 20)
    monkeypatch.setattr(neighbors, "ROWS_PER_SQUARE_PIVOT", 2)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 8)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK_ROWS", 4)


def frame(spark, x, labels=None):
    labels = [0] * len(x) if labels is None else labels
    return spark.createDataFrame(
        [(int(i), int(l), [float(v) for v in row]) for i, (l, row) in enumerate(zip(labels, x))], VECTORS
    ).repartition(4)


def test_one_hot_vectors_with_a_hot_value(spark, small_blocks):
    """A third of all rows is the same vector, distances are full of ties."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, size=(150, 6)).astype(float)
    x[:50] = x[0]
    assert found(nearest(frame(spark, x), frame(spark, x), 5, "id", "vec")) == brute(np.arange(150), x, 5)


def test_clusters_and_scopes(spark, small_blocks):
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 3, size=160)
    x = rng.normal(size=(160, 3)) + 20 * labels[:, None]
    df = frame(spark, x, labels)
    same = labels[:, None] == labels[None, :]
    got = nearest(df, df, 4, "id", "vec", F.col("label"), F.col("label"))
    assert found(got) == brute(np.arange(160), x, 4, same)
    assert found(nearest(df, df, 4, "id", "vec")) == brute(np.arange(160), x, 4)


def test_fewer_rows_than_k(spark):
    x = np.array([[0.0], [1.0], [5.0]])
    assert found(nearest(frame(spark, x), frame(spark, x), 5, "id", "vec")) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}
    one = frame(spark, x[:1])
    assert found(nearest(one, one, 5, "id", "vec")) == {}


def test_many_groups_meet_in_pairs(spark, small_blocks, monkeypatch):
    """Rows are sent by group, not by cell, and vectors meet by shuffle: none goes through the driver as a broadcast."""
    monkeypatch.setattr(neighbors, "GROUP_ROWS", 12)
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 2, size=120)
    x = np.round(rng.normal(size=(120, 5)), 1) + labels[:, None]
    df = frame(spark, x, labels)
    rare = df.filter("label = 1")
    got = nearest(rare, df, 4, "id", "vec")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "CoGroups" in plan
    assert found(got) == {i: n for i, n in brute(np.arange(120), x, 4).items() if labels[i]}


def test_groups_grow_only_where_one_would_be_too_large():
    assert [neighbors._group_count(n, 64) for n in (0, 100, 20_000, 65_536, 500_000)] == [1, 1, 3, 8, 8]
    assert neighbors._group_count(2_000_000, 64) == -(-2_000_000 * 512 // neighbors.GROUP_BYTES)


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(5)
    labels = np.array([1] * 25 + [0] * 90)
    x = rng.normal(size=(115, 4)) + 1.2 * labels[:, None]
    return frame(spark, x, labels), x, labels


@pytest.mark.parametrize("sampler", ["smote", "borderline_smote", "rsmote"])
def test_samplers_fill_the_gap_inside_the_class(two_classes, sampler):
    df, x, labels = two_classes
    out = getattr(resample, sampler)(df, seed=7).collect()
    assert len(out) == (65 if sampler != "rsmote" else resample.rsmote_plan(
        resample.rsmote_groups(resample.rsmote_density(df))).agg(F.sum("turns")).first()[0])
    for r in out:
        assert r.label == 1 and labels[r.id] == 1 and labels[r.neighbor_id] == 1 and 0 <= r.gap < 1
        assert np.allclose(r.vec, x[r.id] + r.gap * (x[r.neighbor_id] - x[r.id]))
    assert len({(r.id, r.turn) for r in out}) == len(out)


def test_repeatable(two_classes):
    df, _, _ = two_classes
    first = resample.smote(df, seed=1)
    assert first.exceptAll(resample.smote(df.repartition(7), seed=1)).isEmpty()
    assert not first.exceptAll(resample.smote(df, seed=2)).isEmpty()


def test_adasyn_follows_the_foreign_neighbours(two_classes):
    df, _, _ = two_classes
    plan = resample.adasyn_plan(df).collect()
    total = sum(r.n_other for r in plan)
    assert all(r.turns == round(r.n_other * 65 / total) for r in plan)
    assert resample.adasyn(df).count() == sum(r.turns for r in plan)


def test_svm_smote_directions(two_classes):
    df, x, _ = two_classes
    support = {r.id: r.danger for r in resample.svm_support(df).collect()}
    out = resample.svm_smote(df).collect()
    assert len(out) == 65 and {r.id for r in out} <= set(support)
    for r in out:
        assert (r.gap >= 0) if support[r.id] else (-0.5 < r.gap <= 0)


def test_rsmote_stages(two_classes):
    df, x, labels = two_classes
    dense = resample.rsmote_density(df)
    kept = {r.id: r for r in dense.collect()}
    near = brute(np.arange(115), x, 5)
    for i in range(25):
        major = sum(labels[n] == 0 for n in near[i])
        assert (i in kept) == (major < 5)
        if i in kept:
            assert kept[i].n_major == major
    others = np.array(sorted(kept))
    for i, r in kept.items():
        d_major = np.sort(np.sqrt(((x[labels == 0] - x[i]) ** 2).sum(axis=1)))[:6].sum()
        d_own = np.sort(np.sqrt(((x[others] - x[i]) ** 2).sum(axis=1)))[:6].sum()
        assert r.density == pytest.approx(min(100, d_major / d_own), abs=1e-6)
    groups = {r.id: r for r in resample.rsmote_groups(dense).collect()}
    ordered = sorted(groups.values(), key=lambda r: -r.density)
    marks = [r.grp for r in ordered]
    assert marks == sorted(marks)
    values = np.array([r.density for r in ordered])
    sse = [values[:c].var() * c + values[c:].var() * (len(values) - c) for c in range(1, len(values))]
    best = int(np.argmin(sse)) + 1
    assert marks.count(1) == (best if 2 <= best <= len(values) - 2 else 0)
    plan = resample.rsmote_plan(resample.rsmote_groups(dense)).collect()
    for grp in {r.grp for r in plan}:
        part = [r for r in plan if r.grp == grp]
        assert sum(r.turns for r in part) == part[0].quota


def test_rsmote_equal_densities_stay_one_group(spark):
    x = np.array([[0.0, 0.0]] * 8 + [[3.0, float(i)] for i in range(20)])
    dense = resample.rsmote_density(frame(spark, x, [1] * 8 + [0] * 20))
    rows = resample.rsmote_groups(dense).collect()
    assert {r.density for r in rows} == {100.0} and {r.grp for r in rows} == {0}


def test_resample_rounds(two_classes):
    df, _, _ = two_classes
    out = resample.resample(df, "SMOTE")
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0: 90, 1: 90}
    with pytest.raises(ValueError):
        resample.resample(df, "none")


def test_several_smaller_classes(spark):
    rng = np.random.default_rng(6)
    labels = np.array([0] * 40 + [1] * 12 + [2] * 9)
    df = frame(spark, rng.normal(size=(61, 3)) + labels[:, None], labels)
    counts = {r.label: r["count"] for r in resample.smote(df).groupBy("label").count().collect()}
    assert counts == {1: 28, 2: 31}


def test_turns_are_not_broadcast(two_classes):
    df, _, _ = two_classes
    plan = resample.smote(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [neighbor_id" in plan
