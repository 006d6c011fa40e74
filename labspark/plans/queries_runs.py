"""Registered check stages, pages, configuration listings and delete decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.functions.values import display_time, parse_date
from labspark.operators import logs, quality
from labspark.operators.reshape import ANSWER_PREFIX, quoted
from labspark.operators.split import quota_split
from labspark.plans import roles, train
from labspark.plans.queries_quality import faulty_upload
from labspark.plans.queries_reshape import _cleaned, quota_sql
from labspark.plans.queries_reports import _RUNS, _runs
from labspark.plans.queries_stored import stored_identities
from labspark.plans.registered import ANSWERS, CASES, LINES, REPORTS, SYMBOLS, query
from labspark.sources.tables import table

_NO_LINES = "CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi, CAST(NULL AS VARCHAR) AS lines"


@query(
    "amount_stage",
    f"""SELECT CAST(1 AS INTEGER) AS stage_no, 'amount' AS stage, 'too_few_rows' AS code, CAST(NULL AS VARCHAR) AS "column", {_NO_LINES}
    FROM (SELECT count(*) AS n FROM orders) WHERE n < 100000000""",
)
def amount_stage(spark, folder):
    """An upload below a minimum no test table reaches; the faults of later stages are not looked for."""
    return quality.quality_report(faulty_upload(spark, folder), "GN", min_rows=100_000_000)


@query(
    "column_stage",
    f"""SELECT CAST(2 AS INTEGER) AS stage_no, 'column' AS stage, code, "column", {_NO_LINES} FROM (
      SELECT 'missing_column' AS code, 'species' AS "column" UNION ALL SELECT 'missing_prefix', 'ans_'
      UNION ALL SELECT 'unexpected_column', 'answer_' || p_type FROM (SELECT DISTINCT p_type FROM part))
    WHERE (SELECT count(*) FROM orders) >= 1""",
)
def column_stage(spark, folder):
    """A wide upload with columns of the data's drugs, without species and with answers under another prefix."""
    df = roles.upload(spark, folder).drop("species")
    renamed = {c: f"answer_{c[len(ANSWER_PREFIX) :]}" for c in df.columns if c.startswith(ANSWER_PREFIX)}
    return quality.quality_report(df.withColumnsRenamed(renamed), "GN", min_rows=1)


_UPLOADED = f"""{REPORTS}, uploaded AS (SELECT report_id + 2 AS line_no, hn, issued, species, genus, sample, batch_id,
    count(*) OVER (PARTITION BY hn, issued, species, genus, sample) AS n FROM reports)"""


@query(
    "duplicate_stage",
    f"""WITH {_UPLOADED}, old AS (SELECT DISTINCT hn, issued, species, genus, sample FROM uploaded
      WHERE batch_id = (SELECT min(batch_id) FROM cases)),
    faults AS (SELECT 'duplicate_in_batch' AS code, line_no AS n FROM uploaded WHERE n > 1
      UNION ALL SELECT 'duplicate_of_stored', line_no FROM uploaded JOIN old USING (hn, issued, species, genus, sample)),
    runs AS (SELECT *, n - row_number() OVER (PARTITION BY code ORDER BY n) AS g FROM faults)
    SELECT CAST(4 AS INTEGER) AS stage_no, 'duplicate' AS stage, code, CAST(NULL AS VARCHAR) AS "column", min(n) AS lo, max(n) AS hi,
      CASE WHEN min(n) = max(n) THEN min(n)::varchar ELSE min(n) || ' - ' || max(n) END AS lines FROM runs GROUP BY code, g""",
)
def duplicate_stage(spark, folder):
    """An upload without other faults, against the index of the identities of the first year's reports."""
    upload = roles.upload(spark, folder)
    first, _ = roles.span(spark, folder)
    stored = upload.withColumns({c: parse_date(F.col(c)) for c in quality.DATES}).filter(F.year("date_of_submission") == first)
    stored = stored.withColumn("submitted_sample", quality.clean_specimen(F.col("submitted_sample")))
    return quality.quality_report(upload, "GN", stored_identities(spark, stored), min_rows=1)


@query(
    "new_value_report",
    f"""WITH {REPORTS}, {LINES}, {SYMBOLS}, {ANSWERS}, old AS (SELECT * FROM reports WHERE genus > 'NATION_2' AND sample <> '1-URGENT')
    SELECT DISTINCT 'bacteria_genus' AS kind, genus || ' spp.' AS value FROM reports WHERE genus NOT IN (SELECT genus FROM old)
    UNION ALL SELECT DISTINCT 'submitted_sample', {_cleaned("'Rt. ' || sample || ' (swab)'")} FROM reports
      WHERE sample NOT IN (SELECT sample FROM old)
    UNION ALL SELECT DISTINCT 'result_column', 'S/I/R_' || label FROM symbols JOIN reports USING (report_id) WHERE label <> 'PROMO'
    UNION ALL SELECT DISTINCT 'answer_column', 'ans_' || label FROM answers JOIN reports USING (report_id) WHERE label <> 'PROMO'""",
)
def new_value_report(spark, folder):
    """Genera, samples and drug columns of an upload that the stored reports lack."""
    upload = roles.upload(spark, folder)
    old = upload.filter("bacteria_genus > 'NATION_2 spp.' AND NOT submitted_sample LIKE '%1-URGENT%'")
    stored = old.select(
        "bacteria_genus", quality.clean_specimen(F.col("submitted_sample")).alias("submitted_sample"), quoted_column("S/I/R_PROMO"), quoted_column("ans_PROMO")
    )
    return quality.new_value_report(upload, stored)


def quoted_column(name: str):
    return F.col(quoted(name))


@query(
    "test_frame",
    f"""WITH {CASES}, {quota_sql("cases", "", "sample", "report_id", 0.1, 2, "split")}
    SELECT report_id, sample, batch_id AS file_id FROM split WHERE type = 'test' AND panel = 1 AND batch_id <> 1997""",
)
def test_frame(spark, folder):
    rows = roles.cases(spark, folder)
    typed = quota_split(rows.select("report_id", "sample"), "report_id", "sample", 0.1, min_stratum=2)
    wide = rows.drop("sample").join(typed, "report_id").withColumnsRenamed({"batch_id": "file_id", "panel": "vitek_id"})
    active = roles.batches(spark, folder).select(F.col("batch_id").alias("file_id")).filter("file_id <> 1997")
    return train.test_frame(wide, 1, active).select("report_id", "sample", "file_id")


# ---- pages ----

_ORDER = "ORDER BY finish_date DESC NULLS FIRST, start_date ASC NULLS LAST, event_id LIMIT 10 OFFSET 20"
_SHOWN = ", ".join(f"coalesce(strftime({c}, '%d-%b-%Y %H:%M:%S'), '-') AS {c}" for c in ("start_date", "finish_date"))


def _times(rows):
    return rows.withColumns({c: display_time(F.col(c)) for c in ("start_date", "finish_date")})


@query(
    "upload_log_page",
    f"""WITH {_RUNS}, shown AS (SELECT * FROM runs {_ORDER})
    SELECT event_id, status, {_SHOWN}, coalesce(role, 'success') AS type, turn, text AS detail, text IS NOT NULL AS has_detail
    FROM shown LEFT JOIN conversations ON conv_id = event_id""",
)
def upload_log_page(spark, folder):
    """Third page of the runs with the results (conversation turns) of exactly its ten runs."""
    results = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("event_id"), F.col("role").alias("type"), "turn", F.col("text").alias("detail")
    )
    order = logs.log_order("finish_date", "start_date", "event_id")
    found = logs.upload_page(_runs(spark, folder).drop("user_id"), results, "event_id", "type", "detail", order, 3)
    return _times(found).select("event_id", "status", "start_date", "finish_date", "type", "turn", "detail", "has_detail")


@query(
    "training_log_page",
    f"""WITH {_RUNS}, named AS (SELECT runs.*, r_name AS vitek_name FROM runs JOIN region ON r_regionkey = user_id % 3),
    shown AS (SELECT * FROM named {_ORDER})
    SELECT event_id, status, {_SHOWN}, vitek_name, CAST(n_regionkey AS INTEGER) AS version FROM shown LEFT JOIN nation ON n_nationkey = user_id""",
)
def training_log_page(spark, folder):
    """Regions stand for panels, nations for snapshots; most runs made none."""
    runs = _runs(spark, folder).withColumns({"vitek_id": (F.col("user_id") % 3).cast("int"), "model_group_id": F.col("user_id")})
    panels = table(spark, folder, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    groups = table(spark, folder, "nation").select(F.col("n_nationkey").alias("model_group_id"), F.col("n_regionkey").cast("int").alias("version"))
    order = logs.log_order("finish_date", "start_date", "event_id")
    return _times(logs.training_page(runs, panels, groups, order, 3)).select(
        "event_id", "status", "start_date", "finish_date", "vitek_name", "version"
    )


@query(
    "active_batch_page",
    """WITH files AS (SELECT o_orderkey AS id, o_orderdate AS upload_at, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS panel,
      CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END AS amount_row FROM orders WHERE o_orderstatus <> 'P'),
    shown AS (SELECT *, (SELECT count(*) FROM files WHERE amount_row IS NOT NULL) AS total_row FROM files
      WHERE amount_row IS NOT NULL ORDER BY upload_at DESC, id LIMIT 10 OFFSET 10)
    SELECT id, r_name AS vitek_name, strftime(upload_at, '%d-%b-%Y %H:%M:%S') AS upload_at, amount_row, total_row, year(upload_at) > 2000 AS can_delete
    FROM shown JOIN region ON r_regionkey = panel""",
)
def active_batch_page(spark, folder):
    files = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("upload_at"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("vitek_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")).alias("amount_row"),
        (F.col("o_orderstatus") != "P").alias("active"),
    )
    panels = table(spark, folder, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return logs.active_page(files, panels, 2, 2000).withColumn("upload_at", display_time(F.col("upload_at"))).select(
        "id", "vitek_name", "upload_at", "amount_row", "total_row", "can_delete"
    )


# ---- configuration ----


@query(
    "configuration_listing",
    """WITH configs AS (SELECT s_nationkey AS antimicrobial_id, count(*) AS n, max(s_suppkey) AS m FROM supplier GROUP BY s_nationkey)
    SELECT n_name AS name, 'n_estimators = ' || n || ', gamma = 0.5, max_depth = ' || (n % 9 + 1) || ', subsample = 1.0, colsample_bytree = 0.5, '
      || 'learning_rate = 0.1, random_state = ' || m AS params, CASE WHEN n % 2 = 0 THEN 'SMOTE' ELSE 'ADASYN' END AS algo
    FROM configs JOIN nation ON n_nationkey = antimicrobial_id WHERE n_regionkey = 1""",
)
def configuration_listing(spark, folder):
    """Nations stand for drugs, regions for panels; settings follow from the suppliers of a nation."""
    n = F.col("n")
    configs = (
        table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("antimicrobial_id"))
        .agg(F.count("*").alias("n"), F.max("s_suppkey").alias("random_state"))
        .select(
            "antimicrobial_id", n.alias("n_estimators"), F.lit(0.5).alias("gamma"), (n % 9 + 1).alias("max_depth"), F.lit(1.0).alias("subsample"),
            F.lit(0.5).alias("colsample_bytree"), F.lit(0.1).alias("learning_rate"), "random_state", F.when(n % 2 == 0, "SMOTE").otherwise("ADASYN").alias("smote"),
        )
    )
    drugs = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("vitek_id")
    )
    return train.configuration_listing(configs, drugs, 1)


@query(
    "delete_outcomes",
    """SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM events WHERE event_type IN ('pending', 'training')) THEN 'fail'
      WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'deleted' ELSE 'inactive' END AS outcome FROM orders""",
)
def delete_outcomes(spark, folder):
    files = table(spark, folder, "orders").select("o_orderkey")
    used = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return logs.delete_outcomes(files, table(spark, folder, "events"), used, "o_orderkey", "event_type", ("pending", "training"))
