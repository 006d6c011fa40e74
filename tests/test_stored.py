"""Tables kept by partition: what is rewritten, what is opened, and that results are those of a full build."""

import pytest
from pyspark.sql import functions as F

from labspark.operators import resample as rs
from labspark.plans import summaries, wide
from labspark.session import scratch_path
from labspark.sources.stored import IdentityIndex, Pages, StateTable, named


def files(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_state_rewrites_only_the_parts_of_changed_keys(spark):
    rows = spark.range(1_000).select("id", F.lit(1).alias("turn"), F.lit("new").alias("status"))
    state = StateTable(scratch_path(spark, "state"), ["id"], ["turn"], rows.schema, parts=32)
    assert state.rows(spark).count() == 0
    assert state.apply(rows) == 32
    before = files(spark.read.parquet(state.path))
    change = spark.createDataFrame([(7, 2, "done"), (7, 3, "gone"), (5_000, 1, "new")], "id long, turn int, status string")
    assert state.apply(change) <= 2
    after = files(spark.read.parquet(state.path))
    assert len(before - after) <= 2 and len(before & after) >= 30
    assert state.rows(spark).count() == 1_001
    assert [(r.turn, r.status) for r in state.of_keys(spark.createDataFrame([(7,)], "id long")).collect()] == [(3, "gone")]
    assert state.apply(change.limit(0)) == 0


def test_index_opens_files_in_proportion_to_the_upload(spark):
    stored = spark.range(5_000).select(F.col("id").cast("string").alias("hn"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("day"))
    index = IdentityIndex(scratch_path(spark, "identities"), ["hn", "day"], stored.schema, parts=64)
    upload = spark.createDataFrame([("1", 1, "a"), ("3", None, "b"), ("1", 2, "c"), ("x", None, "d")], "hn string, day long, line string")
    assert index.repeated(upload).count() == 0
    index.add(stored, 1)
    index.add(stored.limit(0), 2)
    assert {r.line for r in index.repeated(upload).collect()} == {"a", "b"}
    assert len(files(index.among(upload))) <= 4 and len(files(spark.read.parquet(index.path))) == 64
    index.add(stored.filter("hn <> '1'"), 1)  # the batch again, corrected: its parts are replaced
    batches = spark.createDataFrame([(1,)], "file_id long")
    assert {r.line for r in index.repeated(upload, batches).collect()} == {"b"}
    assert index.repeated(upload, spark.createDataFrame([(9,)], "file_id long")).count() == 0
    index.add(stored.filter("hn = '9'"), 1)  # most parts lose all their rows of the batch
    assert index.repeated(upload).count() == 0
    assert index.repeated(upload.withColumns({"hn": F.lit("9"), "day": F.lit(None).cast("long")})).count() == 4


def test_long_value_lists_join(spark, monkeypatch):
    df = spark.range(100).withColumn("p", F.col("id") % 10)
    values = spark.createDataFrame([(1,), (2,), (2,)], "p long")
    assert named(df, "p", values).count() == 20
    monkeypatch.setattr("labspark.sources.stored.MAX_NAMED", 1)
    assert named(df, "p", values).count() == 20
    assert named(df, "p", values.limit(0)).count() == 0


def test_pages(spark):
    pages = Pages(scratch_path(spark, "pages"), block=37)
    assert pages.build(spark.range(500).withColumn("x", F.col("id") % 13), [F.desc("x"), F.col("id")]) == 500
    want = sorted(((i % 13, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    for number in (1, 4, 37, 50):
        assert [(r.x, r.id) for r in pages.page(spark, number).collect()] == want[number * 10 - 10 : number * 10]
    assert pages.page(spark, 51).count() == 0
    with pytest.raises(ValueError):
        pages.page(spark, 0)


def test_wide_refresh_equals_a_full_build(spark):
    reports = spark.createDataFrame([(i, 1 + i % 2, 2000 + i % 3, f"s{i}") for i in range(12)], "report_id long, panel int, file_id int, sample string")
    facts = spark.createDataFrame([(i, x, "A" if i % 2 else "R", i % 3 == 0) for i in range(10) for x in "ab"], "report_id long, label string, symbol string, answer boolean")
    path, full = scratch_path(spark, "wide"), scratch_path(spark, "wide")
    assert wide.refresh(path, reports, facts, ["a", "b"]) == 6
    changed = facts.filter("NOT (report_id IN (0, 6) AND label = 'a')")  # reports of batch 2000, panel 1
    batch = spark.createDataFrame([(1, 2000)], "panel int, file_id int")
    assert wide.refresh(path, reports, changed, ["a", "b"], batch) == 1
    wide.refresh(full, reports, changed, ["a", "b"])
    rows = [sorted(map(str, spark.read.parquet(p).collect())) for p in (path, full)]
    assert rows[0] == rows[1] and len(rows[0]) == 12
    some = wide.active(spark, path, 1, spark.createDataFrame([(2000,), (2001,)], "file_id int"))
    assert some.count() == 4 and "PartitionFilters: [isnotnull(panel" in some._jdf.queryExecution().toString()


def test_summaries_of_one_batch_are_replaced(spark):
    path = scratch_path(spark, "counts")
    rows = lambda n: spark.createDataFrame([(b, 1, "month", "2020-01", n) for b in (1, 2)], "batch_id int, panel int, kind string, name string, n long")
    assert summaries.store(rows(5), path) == 2
    assert summaries.store(rows(7).filter("batch_id = 2"), path) == 1
    total = lambda *b: [r.n for r in summaries.snapshot_counts(spark.read.parquet(path), spark.createDataFrame([(x,) for x in b], "batch_id int")).collect()]
    assert total(1, 2) == [12] and total(2) == [7] and total(3) == []


def test_radial_margin_parts_rings(spark):
    """A ring around a disk: no line parts them, the kernel does."""
    import math

    rows = []
    for i in range(120):
        inner = i % 4 == 0
        turn, reach = i * 0.61, (0.6 if inner else 3.0) + 0.1 * math.sin(i)
        rows.append((i, int(inner), [reach * math.cos(turn), reach * math.sin(turn)]))
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    inside = [r.margin for r in rs.kernel_margins(df, 1).collect()]
    outside = [r.margin for r in rs.kernel_margins(df.withColumn("label", 1 - F.col("label")), 1).collect()]
    assert min(inside) > 0 and min(outside) > 0


@pytest.mark.parametrize("space", ["dense", "sets"])
def test_kernel_similarities_by_batch(spark, space, monkeypatch):
    """Similarities come from arrays of rows, not from a loop over values in each row."""
    import numpy as np

    monkeypatch.setattr(rs, "KERNEL_ROWS", 3)
    if space == "dense":
        rows = [[float(i % 3), float(i), 0.5 * i] for i in range(10)]
        away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        kind, item = rs.DENSE, "double"
    else:
        rows = [[t for t in range(6) if (i >> t % 4) & 1] for i in range(10)]
        away = lambda a, b: len(set(a) ^ set(b))
        kind, item = rs.SETS, "bigint"
    held, weights = [rows[1], rows[4], rows[0]], np.array([[1.0, 0.5], [-2.0, 0.0], [0.25, 3.0]])
    df = spark.createDataFrame(list(enumerate(rows)), f"id long, vec array<{item}>").repartition(2)
    out = rs.kernel_features(df, held, weights, 0.1, kind)
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        want = np.exp([-0.1 * away(rows[r.id], m) for m in held]) @ weights
        assert np.allclose(r.kernel, want)
    margins = {r.id: r.m for r in df.select("id", rs.kernel_margin(held, [1.0, -2.0, 0.25], 0.1, 0.5, kind).alias("m")).collect()}
    assert np.allclose([margins[i] for i in range(10)], [np.exp([-0.1 * away(v, m) for m in held]) @ weights[:, 0] + 0.5 for v in rows])
