import random

from pyspark.sql import functions as F

from labspark.operators import dims, features, logs, metrics, numbering, quality, reshape, split
from labspark.session import bounded, distinct_values


def collect(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---- numbering ----


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(16)
    got = numbering.number_rows(df, [F.col("k")], "n", 2).orderBy("k").collect()
    assert [r.n for r in got] == list(range(2, 5002))


def test_running_totals_with_hot_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("g")).repartition(16)
    got = numbering.running_totals(df, ["g"], [F.desc("id")], {"c": F.lit(1), "s": F.col("id")}).collect()
    hot = sorted((r for r in got if r.g == "hot"), key=lambda r: -r.id)
    assert [r.c for r in hot] == list(range(1, 2501))
    assert hot[-1].s == sum(range(2500))
    assert len(got) == 3000


def test_line_ranges_join_over_bucket_borders(spark, rows):
    values = [2, 3, 4, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 19, 20, 25]
    df = rows("g string, n long", *[("a", v) for v in values], ("a", 2), ("b", 9), ("b", 10))
    got = {(r.g, r.text) for r in numbering.line_ranges(df, ["g"], "n", bucket_size=5).collect()}
    assert got == {("a", "2 - 4"), ("a", "7 - 17"), ("a", "19 - 20"), ("a", "25"), ("b", "9 - 10")}


def test_line_ranges_random(spark):
    rng = random.Random(1)
    lines = sorted(rng.sample(range(400), 230))
    df = spark.createDataFrame([("a", n) for n in lines], "g string, n long")
    got = sorted((r.lo, r.hi) for r in numbering.line_ranges(df, ["g"], "n", bucket_size=7).collect())
    want, start = [], lines[0]
    for a, b in zip(lines, [*lines[1:], None]):
        if b != a + 1:
            want.append((start, a))
            start = b
    assert got == want


# ---- splits ----


def test_quota_split(spark):
    df = spark.range(1003).select(
        F.col("id"), F.when(F.col("id") < 600, "a").when(F.col("id") < 1002, "b").otherwise("single").alias("s")
    )
    got = split.quota_split(df, "id", "s", 0.1, min_stratum=2)
    counts = {(r.s, r.type): r.n for r in got.groupBy("s", "type").agg(F.count("*").alias("n")).collect()}
    # 1002 rows take part, ceil(100.2) = 101 go to test; the single row goes to train
    assert counts[("single", "train")] == 1
    assert counts[("a", "test")] + counts[("b", "test")] == 101
    assert abs(counts[("a", "test")] - 60) <= 1
    again = split.quota_split(df.repartition(5), "id", "s", 0.1, min_stratum=2)
    assert got.exceptAll(again).isEmpty() and got.count() == 1003


def test_quota_split_keeps_rows_without_stratum(spark, rows):
    df = rows("id long, s string", *[(i, "a") for i in range(10)], (10, None))
    got = {r.id: r.type for r in split.quota_split(df, "id", "s", 0.5).collect()}
    assert len(got) == 11 and got[10] == "train" and list(got.values()).count("test") == 5


def test_quota_ranks_within_one_slice(spark, monkeypatch):
    """Keys that share a slice are still cut at the exact row."""
    monkeypatch.setattr(split, "order_key", lambda seed, c: F.lpad(F.col(c).cast("string"), 12, "0"))
    df = spark.range(50).select("id", F.lit("a").alias("s"))
    got = split.quota_split(df, "id", "s", 0.3).filter("type = 'train'")
    assert sorted(r.id for r in got.collect()) == list(range(35))


def test_split_by_label(spark, rows):
    reports = spark.range(100).withColumnRenamed("id", "report_id")
    answers = rows("report_id long, label string", *[(i, "x") for i in range(40)], *[(i, "y") for i in range(3)], (1, "x"))
    got = split.split_by_label(reports, answers, ["x", "y"])
    counts = {(r.label, r.has_answer, r.sub_type): r.n for r in got.groupBy("label", "has_answer", "sub_type").agg(F.count("*").alias("n")).collect()}
    assert counts[("x", True, "test")] == 8 and counts[("x", False, "test")] == 12
    assert sum(n for (l, _, t), n in counts.items() if l == "y" and t == "test") == 20


# ---- dimensions ----


def test_dimensions(spark, rows):
    dim = rows("id long, name string", (3, "cat"), (5, "other"), (9, "dog"))
    facts = rows("v string", ("cat",), ("cow",), ("ant",), (None,), ("cow",))
    assert collect(dims.get_or_create(facts, "v", dim), "id")[-2:] == [(10, "ant"), (11, "cow")]
    known = {r.v: r.sid for r in dims.lookup_or_other(facts, "v", dim, "sid").collect()}
    assert known == {"cat": 3, "cow": 5, "ant": 5, None: 5}
    empty = rows("id long, name string")
    assert collect(dims.get_or_create(facts, "v", empty), "id") == [(1, "ant"), (2, "cat"), (3, "cow")]


def test_bounded_keeps_large_tables(spark):
    big = spark.range(100)
    assert bounded(big, 10) is big
    assert bounded(big, 100).count() == 100


# ---- reshape ----


def test_wide_and_long(spark, rows):
    wide = rows(
        "id long, `S/I/R_a.b/c` string, `S/I/R_x` string, ans_p string, ans_q string",
        (1, "+", "s", "True", "False"), (2, "R", None, "FALSE", "true"),
    )
    assert collect(reshape.melt_symbols(wide, ["id"]), "id") == [(1, "a.b/c", "+"), (2, "a.b/c", "R")]
    assert collect(reshape.melt_flags(wide, ["id"]), "id") == [(1, "p"), (2, "q")]
    back = reshape.pivot_symbols(reshape.melt_symbols(wide, ["id"]), "id", "name", "symbol", ["a.b/c", "x"])
    assert back.columns == ["id", "S/I/R_a.b/c", "S/I/R_x"]
    reports = rows("report_id long", (1,), (3,))
    flags = reshape.pivot_flags(rows("report_id long, name string", (1, "p")), "report_id", "name", ["p", "q"])
    symbols = reshape.pivot_symbols(
        rows("report_id long, name string, symbol string", (1, "a", "POS")), "report_id", "name", "symbol", ["a"]
    )
    full = reshape.wide_report(reports, flags, symbols)
    assert collect(full, "report_id") == [(1, True, False, "+"), (3, False, False, "")]


def test_type_inference_and_sub_types(spark, rows):
    long = rows(
        "name string, symbol string",
        ("a", "S"), ("a", "R"), ("a", "+"), ("b", "+"), ("b", "-"), ("b", "I"), ("tie", "+"), ("tie", "S"),
    )
    types = {r.name: r.sir_type_id for r in reshape.infer_symbol_type(long, ["name"]).collect()}
    assert types == {"a": 2, "b": 1}
    typed = rows("symbol string, sir_type_id int", ("+", 1), ("+", 2), ("R", 2), ("-", 1))
    subs = collect(reshape.with_sub_type(typed, reshape.sub_types(spark)), "symbol", "sir_type_id")
    assert subs == [("+", 1, 1), ("+", 2, None), ("-", 1, 2), ("R", 2, 5)]


def test_nesting_and_empty_columns(spark, rows):
    parents = rows("k int", (1,), (2,))
    children = rows("k int, c string", (1, "b"), (1, "a"))
    got = {r.k: [x.c for x in r.children] for r in reshape.nest_children(parents, children, "k", ["c"]).collect()}
    assert got == {1: ["a", "b"], 2: []}
    df = rows("a int, `b.c` string, d string", (1, None, None), (None, "x", None))
    assert reshape.drop_empty_columns(df).columns == ["a", "b.c"]


# ---- features ----


def test_bin_rare(spark, rows):
    df = rows("id int, v string", *[(i, "common") for i in range(3)], (3, "rare"), (4, "rare"), (5, None))
    got = {r.id: r.v for r in features.bin_rare(df, "v", 3).collect()}
    assert got == {0: "common", 1: "common", 2: "common", 3: "other", 4: "other", 5: None}


def test_encoder_ignores_nulls_and_new_values(spark, rows):
    from pyspark.ml.functions import vector_to_array

    train = rows("id int, a string, `S/I/R_x.y` string", (1, "p", "S"), (2, "q", None), (3, "p", "R"))
    model = features.fit_encoder(train, ["a", "S/I/R_x.y"])
    test = rows("id int, a string, `S/I/R_x.y` string", (1, "p", "S"), (2, "new", "R"), (3, None, None))
    out = features.encode(test, model, ["a", "S/I/R_x.y"]).select("id", vector_to_array("features").alias("v"))
    vectors = {r.id: r.v for r in out.collect()}
    assert vectors == {1: [1.0, 0.0, 0.0, 1.0], 2: [0.0, 0.0, 1.0, 0.0], 3: [0.0, 0.0, 0.0, 0.0]}
    assert [c for c in features.encode(test, model, ["a", "S/I/R_x.y"]).columns] == ["id", "a", "S/I/R_x.y", "features"]


def test_tokens_and_alignment(spark, rows):
    df = rows("id int, a string, b string", (1, "x", None), (2, "y", "z"))
    long = features.tokens(df, "id", ["a", "b"])
    assert collect(long, "id", "feature") == [(1, "a_x"), (2, "a_y"), (2, "b_z")]
    assert collect(features.align(long, "id", ["b_z", "a_q", "a_x"]), "id") == [(1, 0, 0, 1), (2, 1, 0, 0)]


# ---- metrics ----


def test_case_rules(spark, rows):
    pairs = rows(
        "c int, truth boolean, predicted boolean",
        (1, False, False), (2, False, True), (3, True, False), (4, True, True), (4, False, True), (4, True, False),
    )
    got = {r.c: (r.accuracy, r.precision, r.recall, r.f1) for r in metrics.case_scores(pairs, "c", 4).collect()}
    assert got[1] == (1.0, 1.0, 1.0, 1.0)
    assert got[2] == (0.75, 0.0, 0.0, 0.0)
    assert got[3] == (0.75, 0.0, 0.0, 0.0)
    assert got[4] == (0.5, 0.5, 0.5, 0.5)


def test_binary_metrics_without_positives(spark, rows):
    df = rows("t boolean, s double", (True, 0.4), (False, 0.1))
    r = metrics.binary_metrics(df, F.col("t"), F.col("s")).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.5, 0.0, 0.0, 0.0)
    at_half = metrics.binary_metrics(rows("t boolean, s double", (True, 0.5)), F.col("t"), F.col("s")).first()
    assert at_half.tp == 1


def test_ranking(spark, rows):
    scores = rows("c int, label string, score double", (1, "b", 0.9), (1, "a", 0.9), (1, "z", 0.49), (1, "m", 0.98919))
    assert collect(metrics.rank_scores(scores, "c", "label"), "rank") == [
        (1, 1, "m", 98.92), (1, 2, "a", 90.0), (1, 3, "b", 90.0),
    ]


# ---- logs ----


def test_log_pages(spark, rows):
    df = rows("id int, finish int, start int", *[(i, None if i < 3 else i, None if i == 1 else i) for i in range(25)])
    order = logs.log_order("finish", "start", "id")
    assert [r.id for r in logs.page(df, order, 1).collect()] == [0, 2, 1, 24, 23, 22, 21, 20, 19, 18]
    assert [r.id for r in logs.page(df, order, 3).collect()] == [7, 6, 5, 4, 3]
    assert logs.page(df, order, 4).count() == 0


def test_changes(spark, rows):
    batches = rows("id int, active boolean, n int", (1, True, 0), (2, True, 0))
    got = logs.soft_delete(batches, F.col("id") == 2, "id", "n")
    assert collect(got, "id") == [(1, True, 0), (2, False, 1)]
    assert logs.same_members(rows("k int", (1,), (2,), (2,)), rows("k int", (2,), (1,)), "k")
    assert not logs.same_members(rows("k int", (1,)), rows("k int", (2,), (1,)), "k")


def test_distinct_values_limit(spark):
    import pytest

    with pytest.raises(ValueError):
        distinct_values(spark.range(20), "id", 10)


# ---- upload checks ----


def upload(spark, n=300, changes=None, extra=None, drop=None):
    """A faultless upload of n lines; changes: {(line_no, column): value}."""
    columns = ["line_no", *quality.REQUIRED, "S/I/R_amikacin", "ans_cefazolin", *(extra or [])]
    data = []
    for line in range(2, n + 2):
        row = {
            "line_no": line, "hn": f"{line:05d}", "date_of_submission": "2021-01-01", "report_issued_date": "2021-01-03",
            "species": "dog", "bacteria_genus": "Escherichia coli", "submitted_sample": "ear", "vitek_id": "gn",
            "S/I/R_amikacin": "S", "ans_cefazolin": "True", **{c: "x" for c in extra or []},
        }
        row.update({c: v for (at, c), v in (changes or {}).items() if at == line})
        data.append(tuple(row[c] for c in columns if c != drop))
    columns = [c for c in columns if c != drop]
    schema = ", ".join(f"`{c}` {'long' if c == 'line_no' else 'string'}" for c in columns)
    return spark.createDataFrame(data, schema)


def issues(df, stored=None):
    return {(r.stage, r.code, r.column, r.lines) for r in quality.quality_report(df, "GN", stored).collect()}


def test_faultless_upload(spark):
    assert issues(upload(spark)) == set()


def test_stages_stop_at_the_first_fault(spark):
    assert issues(upload(spark, 299, extra=["odd"])) == {("amount", "too_few_rows", None, None)}
    assert issues(upload(spark, extra=["odd"], changes={(2, "hn"): ""})) == {("column", "unexpected_column", "odd", None)}
    assert issues(upload(spark, drop="hn")) == {("column", "missing_column", "hn", None)}
    assert issues(upload(spark, drop="ans_cefazolin")) == {("column", "missing_prefix", "ans_", None)}


def test_value_faults(spark):
    changes = {(n, "bacteria_genus"): " " for n in (2, 3, 4, 7)}
    changes |= {(9, "date_of_submission"): "soon", (10, "ans_cefazolin"): "maybe", (11, "vitek_id"): "GP"}
    changes |= {(12, "hn"): None}
    assert issues(upload(spark, changes=changes)) == {
        ("value", "blank", "bacteria_genus", "2 - 4"), ("value", "blank", "bacteria_genus", "7"),
        ("value", "bad_date", "date_of_submission", "9"), ("value", "bad_flag", "ans_cefazolin", "10"),
        ("value", "wrong_panel", "vitek_id", "11"), ("value", "blank", "hn", "12"),
    }


def test_duplicates(spark, rows):
    import datetime as dt

    stored = rows(
        "hn string, date_of_submission date, report_issued_date date, species string, bacteria_genus string, submitted_sample string",
        ("00005", dt.date(2021, 1, 1), dt.date(2021, 1, 3), "dog", "escherichia", "ear"),
    )
    changed = {(3, "hn"): "00002", (5, "submitted_sample"): "Left ear (deep)"}
    assert issues(upload(spark, changes=changed), stored) == {
        ("duplicate", "duplicate_in_batch", None, "2 - 3"), ("duplicate", "duplicate_of_stored", None, "5"),
    }


def test_new_value_warnings(spark, rows):
    stored = rows("bacteria_genus string, submitted_sample string, `S/I/R_amikacin` string", ("Escherichia coli", "skin", "S"))
    df = upload(spark, 5, extra=["S/I/R_new", "ans_new"], changes={(n, "S/I/R_new"): None for n in range(2, 6)})
    got = {(r.kind, r.value) for r in quality.new_value_report(df, stored).collect()}
    assert got == {
        ("submitted_sample", "ear"), ("result_column", "S/I/R_new"), ("answer_column", "ans_cefazolin"),
    }


def test_null_keys_count_as_equal(spark, rows):
    df = rows("a string, b int", ("x", None), ("x", None), ("y", 1))
    assert quality.duplicates_in_batch(df, ["a", "b"]).count() == 2
