import random
import threading

import pytest
from pyspark.sql import functions as F

from labspark.operators import reshape
from labspark.plans import load, train
from labspark.session import scratch_path
from labspark.sources.tables import in_list, read_csv
from labspark.streaming.uploads import process_uploads, upload_stream
from tests.test_operators import upload


def dimensions(spark):
    names = "id long, name string"
    return load.Dimensions(
        species=spark.createDataFrame([(1, "cat"), (2, "dog"), (3, "other")], names),
        bacteria_genus=spark.createDataFrame([(4, "escherichia")], names),
        submitted_sample=spark.createDataFrame([], names),
        antimicrobial_sir=spark.createDataFrame([(1, "amikacin", 2)], "id long, name string, sir_type_id int"),
        antimicrobial_answer=spark.createDataFrame([], names),
        sir_sub_type=reshape.sub_types(spark),
    )


def test_csv_keeps_lines_zeros_and_missing(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("007", "NA"), ("8", "x"), (None, "null")], "hn string, v string").coalesce(1).write.option(
        "header", True
    ).csv(path)
    got = [tuple(r) for r in read_csv(spark, path, line_no="line_no").orderBy("line_no").collect()]
    assert got == [("007", None, 2), ("8", "x", 3), (None, None, 4)]


def test_upload_stream_takes_files_one_by_one(spark):
    path = scratch_path(spark, "arriving")
    for name, n in (("a", 3), ("b", 2)):
        part = spark.range(n).select(F.concat(F.lit(name), "id").alias("hn"), F.lit("NA").alias("v"))
        part.coalesce(1).write.mode("append").option("header", True).csv(path)
    seen = {}

    def handle(upload, file_id):
        seen[file_id] = [tuple(r) for r in upload.orderBy("line_no").collect()]

    checkpoint = scratch_path(spark, "stream")
    process_uploads(upload_stream(spark, path), handle, checkpoint, once=True).awaitTermination(120)
    assert list(seen.values()) == [[("a0", None, None, 2), ("a1", None, None, 3), ("a2", None, None, 4)], [("b0", None, None, 2), ("b1", None, None, 3)]]
    process_uploads(upload_stream(spark, path), handle, checkpoint, once=True).awaitTermination(120)
    assert len(seen) == 2


def test_process_upload(spark):
    folder = scratch_path(spark, "store")
    bad = upload(spark, changes={(4, "hn"): ""})
    status, issues, batch = load.process_upload(bad, dimensions(spark), 1, 1, folder)
    assert status == "fail" and issues.first().lines == "4" and batch is None
    stored = upload(spark, 1).withColumn("date_of_submission", F.lit("2001-01-01").cast("date")).withColumn(
        "report_issued_date", F.lit("2001-01-02").cast("date")
    )
    status, warnings, batch = load.process_upload(
        upload(spark, changes={(5, "submitted_sample"): "Tail"}), dimensions(spark), 1, 1, folder, stored
    )
    assert status == "success" and [tuple(r) for r in warnings.collect()] == [("submitted_sample", "tail")]
    assert spark.read.parquet(f"{folder}/report").count() == 300
    log = [(r.file_id, r.status, r.amount_row) for r in spark.read.parquet(f"{folder}/upload_log").collect()]
    assert log == [(1, "success", 300)] and spark.read.parquet(f"{folder}/file").first().active


def test_csv_edges(spark, tmp_path):
    """Doubled quotes, ragged records and line breaks inside quotes; nothing is lost in silence."""
    good, ragged, broken = (str(tmp_path / n) for n in ("good.csv", "ragged.csv", "broken.csv"))
    (tmp_path / "good.csv").write_text('a,b\n1,"say ""hi"", ok"\n')
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3\n4,5,6\n")
    (tmp_path / "broken.csv").write_text('a,b\n1,"two\nlines"\n')
    assert [tuple(r) for r in read_csv(spark, good).collect()] == [("1", 'say "hi", ok')]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, ragged).collect()
    kept = read_csv(spark, ragged, line_no="line_no", malformed="malformed_record").orderBy("line_no").collect()
    assert [(r.line_no, r.malformed_record) for r in kept] == [(2, None), (3, "3"), (4, "4,5,6")]
    assert [tuple(r) for r in read_csv(spark, broken, multi_line=True).collect()] == [("1", "two\nlines")]


def test_malformed_records_are_issues(spark):
    df = upload(spark).withColumn("malformed_record", F.when(F.col("line_no") == 7, "raw"))
    issues = load.quality_report(df, "GN").collect()
    assert [(r.stage, r.code, r.lines) for r in issues] == [("value", "malformed_line", "7")]


def test_years_outside_the_usual_range(spark, tmp_path):
    from datetime import datetime

    from labspark.plans import roles

    rows = [(i, 1, "F", 1.0, datetime(y, 5, 1), "x", None, None) for i, y in enumerate((1994, 1996, 2002))]
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string, o_clerk string, o_comment string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "orders.parquet"))
    assert roles.span(spark, str(tmp_path)) == (1994, 9)
    got = sorted(tuple(r) for r in roles.links(spark, str(tmp_path)).collect())
    assert got == sorted([(v, 1994) for v in range(1, 10)] + [(v, 1996) for v in range(3, 10)] + [(9, 2002)])


def test_configurations(spark):
    row = ("a", "XGBClassifier", 10, 0.5, 3, 0.9, 0.8, 0.1, 1, "ADASYN", 2)
    columns = "label string, algorithm string, n_estimators int, gamma double, max_depth int, subsample double, colsample_bytree double, learning_rate double, random_state int, smote string, smote_random_state int"
    config = train.configurations(spark.createDataFrame([row], columns))["a"]
    assert (config.n_estimators, config.gamma, config.smote, config.smote_random_state) == (10, 0.5, "ADASYN", 2)
    with pytest.raises(ValueError, match="unknown"):
        train.configurations(spark.createDataFrame([row[:1] + ("os.system",) + row[2:]], columns))


def test_empty_list_gives_no_rows(spark):
    assert in_list(spark.range(3), "id", []).count() == 0


def test_ingest(spark):
    df = upload(
        spark, 300, extra=["S/I/R_new.drug", "ans_b/c"],
        changes={
            **{(n, "S/I/R_new.drug"): "+" for n in range(2, 290)}, **{(n, "ans_b/c"): "true" for n in (5, 6)},
            (3, "species"): " Fox", (4, "species"): "CAT ", (4, "bacteria_genus"): "Proteus mirabilis",
            (7, "S/I/R_new.drug"): "S", (8, "S/I/R_amikacin"): "-",
        },
    )
    batch = load.ingest(df, dimensions(spark), panel=1, file_id=9, last_report_id=50)
    report = {r.report_id: r for r in batch.report.collect()}
    assert sorted(report) == list(range(51, 351))
    assert report[51].hn == "00002" and report[52].species_id == 3 and report[53].species_id == 1
    assert report[51].bacteria_genus_id == 4 and report[53].bacteria_genus_id == 5
    # the only cat and the only other go to train, the others are split 268 / 30
    assert sum(r.type == "test" for r in report.values()) == 30
    assert {r.file_id for r in report.values()} == {9}
    drugs = {r.name: (r.id, r.sir_type_id) for r in batch.dimensions.antimicrobial_sir.collect()}
    assert drugs == {"amikacin": (1, 2), "new.drug": (2, 1)}
    subs = {(r.report_id, r.antimicrobial_id): r.sir_sub_id for r in batch.report_sir.collect()}
    assert subs[(51, 2)] == 1 and subs[(56, 2)] is None and subs[(57, 1)] is None and subs[(51, 1)] == 3
    answers = {r.name: r.id for r in batch.dimensions.antimicrobial_answer.collect()}
    assert answers == {"b/c": 1, "cefazolin": 2}
    assert batch.report_answer.filter("antimicrobial_id = 1").count() == 2
    trains = batch.report_train.groupBy("antimicrobial_id", "sub_type").count().collect()
    assert {(r.antimicrobial_id, r.sub_type): r["count"] for r in trains} == {
        (1, "train"): 216, (1, "test"): 54, (2, "train"): 216, (2, "test"): 54,
    }
    folder = scratch_path(spark, "facts")
    load.append_batch(batch, folder)
    load.append_batch(batch, folder)  # the same file_id again changes nothing
    assert spark.read.parquet(f"{folder}/report").count() == 300
    assert spark.read.parquet(f"{folder}/report_answer").count() == batch.report_answer.count()
    assert [r.name for r in spark.read.parquet(f"{folder}/dim_antimicrobial_sir").collect()] == ["new.drug"]


@pytest.fixture(scope="module")
def panel(spark):
    """Reports whose answers follow from one result column."""
    rng = random.Random(2)
    data = []
    for i in range(400):
        a = rng.choice(["S", "R"])
        data.append((
            i, rng.choice(["dog", "cat"]), "escherichia", rng.choice(["ear", "skin", "rare" + str(i % 97)]), a,
            rng.choice(["+", "-", ""]), "", a == "S" and rng.random() < 0.4, a == "R", 1, "train" if i % 10 else "test",
        ))
    wide = spark.createDataFrame(
        data,
        "report_id long, species string, bacteria_genus string, submitted_sample string, `S/I/R_a.1` string, "
        "`S/I/R_b` string, `S/I/R_none` string, `ans_x/y` boolean, ans_z boolean, file_id int, type string",
    )
    assigned = wide.select(
        "report_id", F.explode(F.array(F.lit("x/y"), F.lit("z"))).alias("label"),
        F.when(F.col("report_id") % 5 == 0, "test").otherwise("train").alias("sub_type"),
    )
    return wide, assigned


def test_training_and_scoring(spark, panel):
    wide, assigned = panel
    folder = scratch_path(spark, "models")
    configs = {"z": train.Config(n_estimators=3, max_depth=2), "x/y": train.Config(n_estimators=3, max_depth=2, smote="ADASYN")}
    models, pointers = train.train_panel(wide, assigned, ["x/y", "z"], configs, folder)
    assert {r.label for r in pointers.collect()} == {"x/y", "z"}
    assert models[1].metrics["f1"] == 1.0 and "S/I/R_none" not in models[1].columns
    names = {r.submitted_sample for r in models[0].sample_vocabulary.collect()}
    assert "other" in names and "ear" in names

    loaded = [train.load_model(spark, m.label, m.path, m.columns, m.sample_vocabulary) for m in models]
    requests = spark.createDataFrame(
        [
            (1, " Dog", "Escherichia", "gn", "Left Ear", {"A.1": "r", "B": "pos"}),
            (2, "dog", "escherichia", "GN", "never seen", {"a.1": "s"}),
            (3, "dog", "escherichia", "XX", "ear", {"a.1": "r"}),
        ],
        "case_id long, species string, bacteria_genus string, vitek_id string, submitted_sample string, sir map<string,string>",
    )
    cases = train.normalise_requests(requests, ["S/I/R_a.1", "S/I/R_b"])
    first = cases.filter("case_id = 1").first()
    assert {r.case_id: r.status for r in cases.collect()} == {1: "success", 2: "success", 3: "fail"}
    assert (first["S/I/R_a.1"], first["S/I/R_b"], first.submitted_sample) == ("R", "+", "ear")
    got = {(r.case_id, r.label): r.score_pct for r in train.recommend(cases, loaded).collect()}
    assert got[(1, "z")] > 50 and (2, "z") not in got and not any(c == 3 for c, _ in got)

    test = train.feature_table(wide).filter("type = 'test'")
    by_case = train.evaluate_by_case(models, test).first()
    assert by_case.n_cases == 40 and 0 <= by_case.f1 <= 1

    typed = wide.withColumn("vitek_id", F.lit(1))
    batches = wide.select("file_id").distinct()
    new, tables = train.training_run(
        typed, assigned, ["z"], configs, scratch_path(spark, "models"), 1, 4, batches, models, last_current=4
    )
    groups = {r.version: r for r in tables["model_group"].collect()}
    assert set(groups) == {0, 5} and groups[5].n_cases == 40 and groups[5].f1 == 1.0
    assert {(r.model_group_id, r.model_id) for r in tables["model_group_model"].collect()} == {(5, new[0].path), (0, new[0].path)}
    assert [(r.label, r.version) for r in tables["model_current"].collect()] == [("z", 5)]
    assert tables["model_group_file"].count() == 1 and "ear" in tables["binning"].first().schema
    assert tables["model"].first().performance == "same"

    again, promoted = train.train_panel(wide, assigned, ["z"], configs, scratch_path(spark, "models"), champions=models)
    assert promoted.first().model_id == again[0].path  # the same F1 promotes


def test_labels_side_by_side_keep_their_own_properties(spark):
    """Jobs of labels that ran at once changed each other's pool and execution id, which ended some runs with an error."""
    here, sc = threading.Barrier(3, timeout=60), spark.sparkContext

    def work(label):
        sc.setLocalProperty("labspark.label", label)
        here.wait()
        found = sc.getLocalProperty("labspark.label"), sc.getLocalProperty("spark.scheduler.pool")
        here.wait()
        return found

    assert train.side_by_side(work, ["a", "b", "c"], spark) == [(x, f"fit {x}") for x in "abc"]


def test_retrain_gate(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "file_id int")
    assert not train.needs_training(ids(1, 2), ids(2, 1))
    assert train.needs_training(ids(1, 2, 3), ids(2, 1))


def test_an_upload_is_cleaned_once(spark, monkeypatch, capsys):
    """The split passes over its rows several times; cleaning texts is no part of what it passes over."""
    seen, real = [], load.split_by_case
    monkeypatch.setattr(load, "split_by_case", lambda reports, **k: seen.append(reports) or real(reports, **k))
    rows = [(i, f"h{i}", "2020-01-02", "2020-01-03", " Dog", "Escherichia spp.", "Rt. ear (swab)", "GN", "+", "True") for i in range(2, 32)]
    names = "line_no long, hn string, date_of_submission string, report_issued_date string, species string, bacteria_genus string, submitted_sample string, vitek_id string, `S/I/R_amikacin` string, ans_x string"
    batch = load.ingest(spark.createDataFrame(rows, names), dimensions(spark), 1, 7)
    capsys.readouterr()
    seen[0].explain(True)
    plan = capsys.readouterr().out
    assert "report_id" in plan and "btrim" not in plan.lower() and "regexp" not in plan.lower() and "StringTrim" not in plan
    assert batch.report.count() == 30 and batch.report_train.count() > 0
