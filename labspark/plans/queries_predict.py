"""Registered scoring of requests, a training run, and support rows of a curved boundary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.operators import resample as rs
from labspark.operators.reshape import wide_report
from labspark.operators.split import quota_split, split_by_label
from labspark.plans import roles, train
from labspark.plans.queries_resample import _TWO_CLASSES, rare_and_rest
from labspark.plans.queries_reshape import _cleaned, quota_sql
from labspark.plans.registered import CASES, LINES, REPORTS, SYMBOLS, query
from labspark.functions.text import clean_specimen
from labspark.operators.forest import NODES
from labspark.session import bounded, scratch_path
from labspark.sources.tables import table

_KNOWN = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")  # priorities whose samples the models know


def fixed_models(spark, folder) -> list[train.Trained]:
    """Two trees per drug, whose leaves follow from the drug's shares of open lines and of flag R."""
    lines = roles.lines(spark, folder)
    shares = lines.groupBy("label").agg(
        F.round(F.count_if(F.col("l_linestatus") == "O") / F.count("*"), 6).alias("p"), F.round(F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 6).alias("q")
    )
    # One row per drug reaches the driver, as with the models of a run.
    vocabulary = table(spark, folder, "orders").filter(F.col("o_orderpriority").isin(*_KNOWN)).select(_sample().alias("submitted_sample")).distinct()
    models = []
    for r in shares.orderBy("label").collect():
        asks = [
            (r.label, 0, 1.0, 0, 0.0, f"S/I/R_{r.label}", "R", 1, 2), (r.label, 0, 1.0, 1, 0.0, "submitted_sample", "other", 3, 4), (r.label, 0, 1.0, 2, -0.4, None, None, None, None),
            (r.label, 0, 1.0, 3, r.p, None, None, None, None), (r.label, 0, 1.0, 4, r.p - 0.45, None, None, None, None),
            (r.label, 1, 0.5, 0, 0.0, "species", "building", 1, 2), (r.label, 1, 0.5, 1, -0.1, None, None, None, None), (r.label, 1, 0.5, 2, r.q, None, None, None, None),
        ]
        columns = ["species", "submitted_sample", f"S/I/R_{r.label}"]
        models.append(train.Trained(r.label, None, columns, vocabulary, nodes=spark.createDataFrame(asks, NODES)))
    return models


def _sample():
    return clean_specimen(F.concat(F.lit("Rt. "), F.col("o_orderpriority"), F.lit(" (swab)")))


def requests(spark, folder) -> DataFrame:
    """Reports as they would be asked for: mixed case, results as a map, one unknown panel."""
    symbol = F.when(F.col("symbol") == "A", "pos").when(F.col("symbol") == "N", "Neg").otherwise("r")
    maps = roles.symbols(spark, folder).groupBy("report_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit(" "), F.initcap("label")).alias("key"), symbol.alias("value")))).alias("sir")
    )  # as many entries as there are drugs
    vitek = F.when(F.col("o_orderstatus") == "P", "XX").otherwise(" gn")
    panels = table(spark, folder, "orders").select(F.col("o_orderkey").alias("report_id"), vitek.alias("vitek_id"))
    return roles.reports(spark, folder).join(panels, "report_id").join(maps, "report_id", "left").select(
        F.col("report_id").alias("case_id"), F.concat(F.lit(" "), F.initcap("species")).alias("species"), F.concat("genus", F.lit(" spp.")).alias("bacteria_genus"),
        "vitek_id", F.concat(F.lit("Rt. "), F.col("sample"), F.lit(" (swab)")).alias("submitted_sample"), "sir",
    )


_LEAVES = f"""{REPORTS}, {LINES}, {SYMBOLS}, shares AS (SELECT label, round(count(*) FILTER (WHERE l_linestatus = 'O') / count(*)::double, 6) AS p,
    round(count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::double, 6) AS q FROM items GROUP BY label),
  asked AS (SELECT report_id AS case_id, o_orderstatus <> 'P' AS good, lower(species) AS species, {_cleaned("'Rt. ' || sample || ' (swab)'")} AS site, sample FROM reports JOIN orders ON o_orderkey = report_id)"""


@query(
    "predict_requests",
    f"""WITH {_LEAVES}, margins AS (SELECT case_id, s.label,
      CASE WHEN symbol = 'R' THEN -0.4 WHEN sample NOT IN {_KNOWN} THEN p - 0.45 ELSE p END + 0.5 * CASE WHEN species = 'building' THEN q ELSE -0.1 END AS margin
      FROM asked JOIN shares s ON good LEFT JOIN symbols x ON x.report_id = case_id AND x.label = s.label),
    scores AS (SELECT case_id, label, 1 / (1 + exp(-2 * margin)) AS score FROM margins)
    SELECT case_id, label, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, label) AS INTEGER) AS rank, round(score * 100, 2) AS score_pct
    FROM scores WHERE score >= 0.5""",
)
def predict_requests(spark, folder):
    """From request to ranking: normalised, samples binned for each model, all trees walked, ranked in percent."""
    models = fixed_models(spark, folder)
    cases = train.normalise_requests(requests(spark, folder), [m.columns[-1] for m in models])
    return train.recommend(cases, models)


@query(
    "request_cases",
    f"""WITH {_LEAVES} SELECT case_id, species, site AS submitted_sample, CASE WHEN good THEN 'GN' ELSE 'XX' END AS vitek_id,
      CASE WHEN good THEN 'success' ELSE 'fail' END AS status, CASE x.symbol WHEN 'A' THEN '+' WHEN 'N' THEN '-' ELSE x.symbol END AS "S/I/R_PROMO"
    FROM asked LEFT JOIN symbols x ON x.report_id = case_id AND x.label = 'PROMO'""",
)
def request_cases(spark, folder):
    """Requests as feature rows: text rules, panel, status and the result columns that the models read."""
    rows = train.normalise_requests(requests(spark, folder), ["S/I/R_PROMO"])
    return rows.select("case_id", "species", "submitted_sample", "vitek_id", "status", F.col("`S/I/R_PROMO`"))


_PANEL_ONE = "panel_one AS (SELECT * FROM cases WHERE panel = 1)"


@query(
    "training_run",
    f"""WITH {CASES}, {_PANEL_ONE}, {quota_sql("panel_one", "", "sample", "report_id", 0.1, 2, "split")}, drugs AS (SELECT count(DISTINCT p_type) AS n FROM part)
    SELECT 'model' AS name, n FROM drugs UNION ALL SELECT 'model_current', n FROM drugs UNION ALL SELECT 'model_group_model', 2 * n FROM drugs
    UNION ALL SELECT 'model_group', 2 UNION ALL SELECT 'model_group_file', count(DISTINCT batch_id) FROM panel_one
    UNION ALL SELECT 'cases tested of version 3', count(*) FROM split WHERE type = 'test' UNION ALL SELECT 'cases tested of version 0', count(*) FROM split WHERE type = 'test'
    UNION ALL SELECT 'binning', count(*) FROM (SELECT sample FROM panel_one GROUP BY sample HAVING count(*) >= 10)""",
)
def training_run(spark, folder):
    """A whole run over the reports of panel 1 with settings from a table: how many rows each table gets, and how many cases were tested.

    All drugs are fitted side by side; settings follow from the drugs' names.
    """
    cases = roles.cases(spark, folder).filter("panel = 1")
    types = quota_split(cases.select("report_id", "sample"), "report_id", "sample", 0.1, min_stratum=2).select("report_id", "type")
    base = roles.reports(spark, folder).filter("panel = 1").join(types, "report_id").select(
        "report_id", "type", "species", F.col("genus").alias("bacteria_genus"), F.col("sample").alias("submitted_sample"), F.col("batch_id").alias("file_id"), F.col("panel").alias("vitek_id")
    )
    wide = wide_report(base, roles.wide_facts(spark, folder, roles.FLAG_SYMBOLS))
    labels = roles.labels(spark, folder)
    assigned = split_by_label(cases.join(types.filter("type = 'train'"), "report_id", "left_semi"), roles.answers(spark, folder), labels).select("report_id", "label", "sub_type")
    settings = table(spark, folder, "part").select(F.col("p_type").alias("label")).distinct().select(
        "label", F.lit("XGBClassifier").alias("algorithm"), F.lit(2).alias("n_estimators"), F.lit(2).alias("max_depth"), F.lit(0.1).alias("learning_rate"), F.lit(1.0).alias("subsample"),
        F.lit(1.0).alias("colsample_bytree"), F.lit(0.0).alias("gamma"), F.lit(0).alias("random_state"), F.when(F.col("label") == "PROMO", "ADASYN").otherwise("SMOTE").alias("smote"), F.lit(0).alias("smote_random_state"),
    )
    batches = base.select("file_id").distinct()
    _, tables = train.training_run(wide, assigned, labels, train.configurations(settings), scratch_path(spark, "models"), 1, 2, batches)
    names = ["model", "model_current", "model_group_model", "model_group", "model_group_file"]
    counts = [tables[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names]
    counts.append(tables["binning"].select(F.lit("binning").alias("name"), F.size("schema").cast("long").alias("n")))
    tested = tables["model_group"].select(F.concat(F.lit("cases tested of version "), F.col("version").cast("string")).alias("name"), F.col("n_cases").alias("n"))
    return bounded(reduce(DataFrame.unionByName, [*counts, tested]))


_WIDTH = 0.05
_MARKS = f"""marks AS (SELECT vec AS mark, CASE WHEN label = 1 THEN 1.0 ELSE -0.5 END AS weight FROM v ORDER BY id LIMIT 16),
  margins AS (SELECT v.id, sum(weight * exp(-{_WIDTH} * list_sum(list_transform(list_zip(vec, mark), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS margin
    FROM v, marks WHERE label = 1 GROUP BY v.id)"""


@query(
    "kernel_support",
    f"WITH {_TWO_CLASSES}, {_MARKS} SELECT id, round(margin, 6) AS margin FROM margins WHERE margin <= 1",
)
def kernel_support(spark, folder):
    """Rows of the rare class inside the margin of a fixed radial projection: sixteen landmarks with weights by class."""
    rows = rare_and_rest(spark, folder)
    picked = rows.orderBy("id").limit(16).collect()  # the landmarks, a fixed number
    weights = [1.0 if r.label == 1 else -0.5 for r in picked]
    margin = rs.kernel_margin([r.vec for r in picked], weights, _WIDTH, 0.0)
    return rows.filter("label = 1").select("id", F.round(margin, 6).alias("margin")).filter("margin <= 1")
