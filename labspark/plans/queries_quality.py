"""Registered checks of upload batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.operators import quality
from labspark.operators.numbering import line_ranges
from labspark.plans.registered import query
from labspark.session import scratch_path
from labspark.sources.stored import IdentityIndex
from labspark.sources.tables import table

_FAULTY = """upload AS (
  SELECT o_orderkey + 2 AS line_no,
    CASE WHEN o_totalprice > 400000 THEN '' ELSE o_custkey::varchar END AS hn,
    strftime(o_orderdate, '%Y-%m-%d') AS date_of_submission,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'soon' WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%m/%d/%Y')
      WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30.5' WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate, '%Y/%m/%d')
      WHEN o_orderpriority = '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%Y%m%d') WHEN o_orderstatus = 'P' THEN '13/13/' || strftime(o_orderdate, '%Y')
      ELSE strftime(o_orderdate, '%b %d, %Y') END AS report_issued_date,
    o_orderstatus AS species,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_totalprice > 250000 THEN '   ' ELSE 'genus' END AS bacteria_genus,
    o_orderpriority AS submitted_sample,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'gp' ELSE ' gn ' END AS vitek_id,
    CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN 'maybe' WHEN o_orderstatus = 'P' THEN 'TRUE' ELSE 'False' END AS ans_x
  FROM orders)"""

_BLANK = " UNION ALL ".join(
    f"SELECT 'blank' AS code, '{c}' AS \"column\", line_no AS n FROM upload WHERE trim(coalesce({c}, '')) = ''"
    for c in (*quality.REQUIRED, "ans_x")
)
_DATES = """SELECT 'bad_date' AS code, 'report_issued_date' AS "column", line_no AS n FROM upload
  WHERE report_issued_date = 'soon' OR report_issued_date LIKE '13/13/%'"""
_FLAGS = """SELECT 'bad_flag' AS code, 'ans_x' AS "column", line_no AS n FROM upload
  WHERE lower(ans_x) NOT IN ('true', 'false')"""
_PANEL = """SELECT 'wrong_panel' AS code, 'vitek_id' AS "column", line_no AS n FROM upload
  WHERE upper(trim(vitek_id)) <> 'GN'"""


def _ranges_sql(lines: str) -> str:
    return f"""WITH {_FAULTY}, lines AS ({lines}),
    runs AS (SELECT *, n - row_number() OVER (PARTITION BY code, "column" ORDER BY n) AS g FROM lines)
    SELECT CAST(3 AS INTEGER) AS stage_no, 'value' AS stage, code, "column", min(n) AS lo, max(n) AS hi,
      CASE WHEN min(n) = max(n) THEN min(n)::varchar ELSE min(n) || ' - ' || max(n) END AS lines
    FROM runs GROUP BY code, "column", g"""


def faulty_upload(spark, folder):
    """Orders as an upload with faults that depend on the data of the row."""
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    forms = {"1-URGENT": "MM/dd/yyyy", "2-HIGH": "yyyy-MM-dd'T10:20:30.5'", "3-MEDIUM": "yyyy/MM/dd", "4-NOT SPECIFIED": "yyyyMMdd"}
    written = F.when((priority == "5-LOW") & (status == "P"), F.date_format("o_orderdate", "'13/13/'yyyy"))
    for name, form in forms.items():
        written = written.when(priority == name, F.date_format("o_orderdate", form))
    written = written.otherwise(F.date_format("o_orderdate", "MMM dd, yyyy"))
    return table(spark, folder, "orders").select(
        (F.col("o_orderkey") + 2).alias("line_no"),
        F.when(price > 400000, "").otherwise(F.col("o_custkey").cast("string")).alias("hn"),
        day.alias("date_of_submission"),
        F.when((status == "P") & (priority == "1-URGENT"), "soon").otherwise(written).alias("report_issued_date"),
        status.alias("species"),
        F.when((priority == "4-NOT SPECIFIED") & (price > 250000), "   ").otherwise("genus").alias("bacteria_genus"),
        priority.alias("submitted_sample"),
        F.when((status == "F") & (priority == "2-HIGH"), "gp").otherwise(" gn ").alias("vitek_id"),
        F.lit("S").alias("S/I/R_x"),
        F.when((priority == "3-MEDIUM") & (status == "O"), "maybe")
        .when(status == "P", "TRUE")
        .otherwise("False")
        .alias("ans_x"),
    )


def _checked(df, checks):
    return quality.with_ranges(quality.failing_lines(df, checks), 3, "value")


@query("blank_cells", _ranges_sql(_BLANK))
def blank_cells(spark, folder):
    df = faulty_upload(spark, folder)
    return _checked(df, quality.blank_checks(df))


@query("bad_dates", _ranges_sql(_DATES))
def bad_dates(spark, folder):
    return _checked(faulty_upload(spark, folder), quality.date_checks())


@query("bad_flags", _ranges_sql(_FLAGS))
def bad_flags(spark, folder):
    df = faulty_upload(spark, folder)
    return _checked(df, quality.flag_checks(df))


@query("wrong_panel", _ranges_sql(_PANEL))
def wrong_panel(spark, folder):
    return _checked(faulty_upload(spark, folder), quality.panel_checks("GN"))


@query("quality_report", _ranges_sql(" UNION ALL ".join((_BLANK, _DATES, _FLAGS, _PANEL))))
def quality_report(spark, folder):
    return quality.quality_report(faulty_upload(spark, folder), "GN")


@query(
    "line_ranges",
    """WITH runs AS (
      SELECT o_orderstatus, o_orderkey AS n,
             o_orderkey - row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS g FROM orders)
    SELECT o_orderstatus, min(n) AS lo, max(n) AS hi,
      CASE WHEN min(n) = max(n) THEN min(n)::varchar ELSE min(n) || ' - ' || max(n) END AS text
    FROM runs GROUP BY o_orderstatus, g""",
)
def status_ranges(spark, folder):
    return line_ranges(table(spark, folder, "orders"), ["o_orderstatus"], "o_orderkey")


@query(
    "dups_in_batch",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
      SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1""",
)
def dups_in_batch(spark, folder):
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return quality.duplicates_in_batch(items, ["l_orderkey", "l_linenumber"])


@query(
    "dups_vs_stored",
    """WITH keyed AS (SELECT o_orderkey, o_custkey, lower(o_orderpriority) AS sample, o_orderstatus,
                             year(o_orderdate) AS batch_id FROM orders)
    SELECT o_orderkey, o_custkey, sample, o_orderstatus FROM keyed WHERE batch_id = (SELECT max(batch_id) FROM keyed)
      AND (o_custkey, sample, o_orderstatus) IN (SELECT (o_custkey, sample, o_orderstatus) FROM keyed WHERE batch_id < (SELECT max(batch_id) FROM keyed))""",
)
def dups_vs_stored(spark, folder):
    """Reports of the newest batch that repeat a report of an earlier batch, by the index of stored identities."""
    keyed = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.lower("o_orderpriority").alias("sample"), "o_orderstatus",
        F.year("o_orderdate").alias("batch_id"),
    )
    keys = ["o_custkey", "sample", "o_orderstatus"]
    newest = keyed.agg(F.max("batch_id").alias("b")).first()["b"]
    index = IdentityIndex(scratch_path(spark, "identities"), keys, keyed.select(*keys).schema, parts=32)
    index.add(keyed.filter(F.col("batch_id") < newest), 0)
    return index.repeated(keyed.filter(F.col("batch_id") == newest).drop("batch_id"))
