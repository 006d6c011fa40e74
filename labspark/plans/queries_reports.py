"""Registered reports, listings and log pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from labspark.functions.values import display_time
from labspark.operators import logs
from labspark.operators.reshape import nest_children
from labspark.plans import reports as rep
from labspark.plans import roles
from labspark.plans.registered import ANSWERS, CASES, LINES, LINKS, REPORTS, SYMBOLS, query
from labspark.session import bounded
from labspark.sources.tables import table

_IN_SNAPSHOT = "batch_id IN (SELECT batch_id FROM links WHERE version = (SELECT max(version) FROM links))"


def _snapshot(spark, folder, rows=None):
    rows = roles.cases(spark, folder) if rows is None else rows
    return rep.snapshot_reports(rows, roles.links(spark, folder), roles.span(spark, folder)[1])


@query(
    "snapshot_cases_by_month",
    f"""WITH {CASES}, {LINKS}
    SELECT panel, strftime(issued, '%Y-%m') AS month, count(*) AS n_cases
    FROM cases WHERE {_IN_SNAPSHOT} GROUP BY ALL""",
)
def snapshot_cases_by_month(spark, folder):
    return rep.cases_by_month(_snapshot(spark, folder)).orderBy("panel", "month")


@query(
    "snapshot_by_segment",
    f"""WITH {REPORTS}, {LINKS}
    SELECT panel, species AS name, count(*) AS n_cases FROM reports WHERE {_IN_SNAPSHOT} GROUP BY ALL""",
)
def snapshot_by_segment(spark, folder):
    return rep.cases_by(_snapshot(spark, folder, roles.reports(spark, folder)), "species").orderBy(
        "panel", F.desc("n_cases"), "name"
    )


def _top_sql(column: str, k: int) -> str:
    return f"""WITH {REPORTS}, {LINKS}, counts AS (
      SELECT panel, {column} AS name, count(*) AS n_cases FROM reports WHERE {_IN_SNAPSHOT} GROUP BY ALL)
    SELECT panel, name, n_cases, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY panel ORDER BY n_cases DESC, name) AS INTEGER) AS rank FROM counts)
    WHERE rank <= {k}"""


@query("snapshot_top_nations", _top_sql("genus", 10))
def snapshot_top_nations(spark, folder):
    return rep.cases_by(_snapshot(spark, folder, roles.reports(spark, folder)), "genus", 10)


@query("snapshot_top_priorities", _top_sql("sample", 10))
def snapshot_top_priorities(spark, folder):
    return rep.cases_by(_snapshot(spark, folder, roles.reports(spark, folder)), "sample", 10)


@query(
    "snapshot_top_labels",
    f"""WITH {CASES}, {LINKS}, {LINES}, {ANSWERS}, counts AS (
      SELECT panel, label AS name, count(*) AS n_cases
      FROM answers JOIN cases USING (report_id) WHERE {_IN_SNAPSHOT} GROUP BY ALL)
    SELECT panel, name, n_cases, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY panel ORDER BY n_cases DESC, name) AS INTEGER) AS rank FROM counts)
    WHERE rank <= 11""",
)
def snapshot_top_labels(spark, folder):
    given = roles.lines_by_report(spark, folder, "label", "l_linestatus").filter("l_linestatus = 'O'").select("report_id", "label")
    return rep.top_labels(_snapshot(spark, folder), given)


@query(
    "snapshot_symbol_pivot",
    f"""WITH {CASES}, {LINKS}, {LINES}, {SYMBOLS}
    SELECT panel, label, count(*) FILTER (WHERE symbol = 'A') AS n_a, count(*) FILTER (WHERE symbol = 'N') AS n_n,
           count(*) FILTER (WHERE symbol = 'R') AS n_r
    FROM symbols JOIN cases USING (report_id) WHERE {_IN_SNAPSHOT} GROUP BY ALL""",
)
def snapshot_symbol_pivot(spark, folder):
    flags = roles.lines_by_report(spark, folder, "label", F.col("l_returnflag").alias("flag"))
    return rep.symbol_distribution(_snapshot(spark, folder), flags, ["A", "N", "R"])


@query(
    "batch_listing",
    f"""WITH {CASES}, {LINKS}
    SELECT batch_id, count(*) AS amount_row FROM cases WHERE {_IN_SNAPSHOT} GROUP BY ALL""",
)
def batch_listing(spark, folder):
    return rep.batch_listing(roles.cases(spark, folder), roles.links(spark, folder), roles.span(spark, folder)[1])


@query(
    "active_batches",
    f"""WITH {CASES}
    SELECT batch_id, count(*) AS amount_row, batch_id > 1999 AS can_delete
    FROM cases WHERE batch_id <> 1997 GROUP BY ALL""",
)
def active_batches(spark, folder):
    found = roles.batches(spark, folder).withColumn("active", F.col("batch_id") != 1997)
    return (
        found.filter(F.col("active") & F.col("amount_row").isNotNull())
        .select("batch_id", "amount_row", (F.col("batch_id") > 1999).alias("can_delete"))
        .orderBy(F.desc("batch_id"))
    )


@query(
    "star_join",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS issued, c_mktsegment, n_name, r_name
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'F'""",
)
def star_join(spark, folder):
    orders = table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    customer, nation, region = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued"), "c_mktsegment", "n_name", "r_name")
    )


@query(
    "nest_children",
    """SELECT r_regionkey, r_name, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS nations
    FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def nest_regions(spark, folder):
    nested = nest_children(
        table(spark, folder, "region"),
        table(spark, folder, "nation").withColumnRenamed("n_regionkey", "r_regionkey"),
        "r_regionkey",
        ["n_nationkey", "n_name"],
        "nations",
    )
    return nested.withColumn("nations", F.array_join(F.transform("nations", lambda n: n["n_name"]), ","))


# ---- logs ----

_RUNS = """runs AS (
  SELECT event_id, event_type AS status, user_id,
         CASE WHEN event_type = 'signup' THEN NULL ELSE ts + INTERVAL 1 MINUTE END AS finish_date,
         CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS start_date
  FROM events)"""


def _runs(spark, folder):
    """Events as runs: signups are unfinished, errors never started."""
    e = table(spark, folder, "events")
    return e.select(
        "event_id",
        F.col("event_type").alias("status"),
        "user_id",
        F.when(F.col("event_type") != "signup", F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("finish_date"),
        F.when(F.col("event_type") != "error", F.col("ts")).alias("start_date"),
    )


@query(
    "log_page",
    f"""WITH {_RUNS}
    SELECT event_id, status, coalesce(strftime(start_date, '%d-%b-%Y %H:%M:%S'), '-') AS start_date,
           coalesce(strftime(finish_date, '%d-%b-%Y %H:%M:%S'), '-') AS finish_date
    FROM (SELECT * FROM runs ORDER BY finish_date DESC NULLS FIRST, start_date ASC NULLS LAST, event_id
          LIMIT 10 OFFSET 20)""",
)
def log_page(spark, folder):
    rows = logs.page(_runs(spark, folder), logs.log_order("finish_date", "start_date", "event_id"), 3)
    return rows.select(
        "event_id", "status",
        display_time(F.col("start_date")).alias("start_date"),
        display_time(F.col("finish_date")).alias("finish_date"),
    )


@query(
    "log_results",
    """WITH details AS (SELECT conv_id, turn, role AS type, text AS detail FROM conversations)
    SELECT q.doc_id AS log_id, coalesce(d.type, 'success') AS type, d.turn, d.detail, d.detail IS NOT NULL AS has_detail
    FROM documents q LEFT JOIN details d ON d.conv_id = q.doc_id""",
)
def log_results(spark, folder):
    """Documents stand for logs, conversation turns for their results; every log is kept."""
    runs = table(spark, folder, "documents").select(F.col("doc_id").alias("log_id"))
    results = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("log_id"), "turn", F.col("role").alias("type"), F.col("text").alias("detail")
    )
    return logs.with_results(runs, results, "log_id", "type", "detail")


@query(
    "queue_head",
    """SELECT user_id, min(event_id) AS head FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id""",
)
def queue_head(spark, folder):
    return logs.queue_head(table(spark, folder, "events"), "user_id", "event_id", "event_type", ("error", "signup"))


@query(
    "latest_state",
    """SELECT user_id, event_id, ts, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    WHERE rn = 1""",
)
def latest_state(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    return logs.latest_rows(events, ["user_id"], ["ts", "event_id"])


@query(
    "soft_delete",
    f"""WITH {CASES}
    SELECT batch_id, count(*) AS amount_row, batch_id <> 1998 AS active,
           CAST(CASE WHEN batch_id = 1998 THEN 1 ELSE 0 END AS INTEGER) AS change_no
    FROM cases GROUP BY ALL""",
)
def soft_delete(spark, folder):
    state = roles.batches(spark, folder).select(
        "batch_id", "amount_row", F.lit(True).alias("active"), F.lit(0).alias("change_no")
    )
    return logs.soft_delete(bounded(state), F.col("batch_id") == 1998, "batch_id", "change_no")


@query(
    "purge_unreferenced",
    """SELECT o_orderkey, o_custkey FROM orders o
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)""",
)
def purge_unreferenced(spark, folder):
    """The parents a purge may remove: orders without line items."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return logs.purge_unreferenced(orders, table(spark, folder, "lineitem"), "o_orderkey", "l_orderkey")


@query(
    "gate_counts",
    """SELECT count(*) FILTER (WHERE event_type = 'error') AS n_training,
           count(*) FILTER (WHERE event_type = 'pending') AS n_uploading,
           count(*) FILTER (WHERE event_type = 'error') = 0 AS training_open,
           count(*) FILTER (WHERE event_type = 'pending') = 0 AS uploading_open FROM events""",
)
def gate_counts(spark, folder):
    return logs.gate_counts(table(spark, folder, "events"), "event_type", {"training": "error", "uploading": "pending"})


@query(
    "needs_retrain",
    f"""WITH {CASES}, {LINKS}, active AS (SELECT DISTINCT batch_id FROM cases WHERE batch_id <> 1997)
    SELECT version, bool_or(a.batch_id IS NULL OR l.batch_id IS NULL) AS needs_retrain FROM (
      SELECT v.version, b.batch_id FROM (SELECT DISTINCT version FROM links) v, (SELECT DISTINCT batch_id FROM cases) b) p
    LEFT JOIN links l USING (version, batch_id) LEFT JOIN active a USING (batch_id)
    WHERE a.batch_id IS NOT NULL OR l.batch_id IS NOT NULL GROUP BY version""",
)
def needs_retrain(spark, folder):
    """Per snapshot version: do its batches differ from the active ones?"""
    versions = F.explode(F.sequence(F.lit(1), F.lit(roles.span(spark, folder)[1])))
    held = roles.links(spark, folder).select("version", "batch_id", F.lit(1).alias("s"))
    active = (
        roles.batches(spark, folder).filter("batch_id <> 1997").select(versions.alias("version"), "batch_id", F.lit(2).alias("s"))
    )
    both = held.unionByName(active).groupBy("version", "batch_id").agg(F.count("*").alias("n"))
    return both.groupBy("version").agg(F.bool_or(F.col("n") == 1).alias("needs_retrain"))


