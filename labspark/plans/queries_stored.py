"""Registered queries over tables that are kept by partition: state, identities, wide reports, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.operators import quality
from labspark.operators.logs import PAGE_ROWS
from labspark.plans import roles, summaries, wide
from labspark.plans.queries_reports import _IN_SNAPSHOT, _top_sql
from labspark.plans.queries_reshape import _WIDE
from labspark.plans.registered import ANSWERS, LINES, LINKS, REPORTS, SYMBOLS, query
from labspark.session import scratch_path
from labspark.sources.stored import IdentityIndex, Pages, StateTable
from labspark.sources.tables import table


@query(
    "state_after_changes",
    """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    late AS (SELECT * FROM events WHERE user_id = (SELECT user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1)
      AND ts >= (SELECT max(ts) - INTERVAL 1 DAY FROM events))
    SELECT user_id, event_id, event_type, CAST(1 AS INTEGER) AS parts_rewritten FROM ranked WHERE rn = 1""",
)
def state_after_changes(spark, folder):
    """Newest event per user, kept as a table: all but the last day of one user, then that user's rest as a change."""
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    newest = events.orderBy(F.desc("ts"), F.desc("event_id")).select("user_id", "ts").first()
    late = (F.col("user_id") == newest.user_id) & (F.col("ts") >= F.lit(newest.ts) - F.expr("INTERVAL 1 DAY"))
    state = StateTable(scratch_path(spark, "state"), ["user_id"], ["ts", "event_id"], events.schema)
    state.apply(events.filter(~late))
    rewritten = state.apply(events.filter(late))
    return state.rows(spark).select("user_id", "event_id", "event_type", F.lit(rewritten).alias("parts_rewritten"))


_KEYED = """keyed AS (SELECT o_orderkey, o_custkey, lower(o_orderpriority) AS sample, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS batch_id FROM orders)"""


@query(
    "dups_by_index",
    f"""WITH {_KEYED}, newest AS (SELECT max(batch_id) AS b FROM keyed)
    SELECT o_orderkey, o_custkey, sample, o_orderstatus FROM keyed, newest WHERE batch_id = b
      AND (o_custkey, sample, o_orderstatus) IN (SELECT (o_custkey, sample, o_orderstatus) FROM keyed, newest WHERE batch_id < b AND batch_id > b - 3)""",
)
def dups_by_index(spark, folder):
    """Reports of the newest batch that repeat one of the two batches before it, by the index of stored identities."""
    keyed = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.lower("o_orderpriority").alias("sample"), "o_orderstatus", F.year("o_orderdate").alias("batch_id")
    )
    last = keyed.agg(F.max("batch_id").alias("b")).first()["b"]
    keys = ["o_custkey", "sample", "o_orderstatus"]
    index = IdentityIndex(scratch_path(spark, "identities"), keys, keyed.select(*keys).schema)
    for batch in range(last - 3, last):
        index.add(keyed.filter(F.col("batch_id") == batch), batch)
    active = spark.createDataFrame([(last - 2,), (last - 1,)], "file_id long")
    return index.repeated(keyed.filter(F.col("batch_id") == last), active).select("o_orderkey", *keys)


@query(
    "wide_refreshed",
    f"""WITH {_WIDE.replace("FROM lineitem JOIN", "FROM (SELECT * FROM lineitem WHERE l_quantity < 45 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = (SELECT min(year(o_orderdate)) + 1 FROM orders))) lineitem JOIN")}
    SELECT wide.* EXCLUDE (batch_id, panel), batch_id AS file_id, CAST(1 AS INTEGER) AS parts_rewritten FROM wide WHERE panel = 1 AND batch_id <> (SELECT min(year(o_orderdate)) + 2 FROM orders)""",
)
def wide_refreshed(spark, folder):
    """The wide report of panel 1 and the active batches, after the facts of one batch changed: only its partition is rewritten."""
    path = scratch_path(spark, "wide")
    reports = roles.reports(spark, folder).withColumnRenamed("batch_id", "file_id")
    names = roles.labels(spark, folder)
    facts = roles.lines(spark, folder)
    # What is corrected: line items of 45 and more in the reports of one batch are withdrawn.
    first, _ = roles.span(spark, folder)
    of_batch = reports.filter(F.col("file_id") == first + 1).select("report_id")
    corrected = facts.join(of_batch, "report_id", "left_anti").unionByName(facts.join(of_batch, "report_id", "left_semi").filter("l_quantity < 45"))
    wide.refresh(path, reports, _coded_facts(facts), names)
    changed = spark.createDataFrame([(1, first + 1)], "panel int, file_id int")
    rewritten = wide.refresh(path, reports, _coded_facts(corrected), names, changed)
    active = roles.batches(spark, folder).select(F.col("batch_id").alias("file_id")).filter(F.col("file_id") != first + 2)
    return wide.active(spark, path, 1, active).drop("panel").withColumn("parts_rewritten", F.lit(rewritten))


def _coded_facts(facts: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    return facts.select("report_id", "label", flag.alias("symbol"), (F.col("l_linestatus") == "O").alias("answer"))


_COUNTED = f"""{REPORTS}, {LINKS}, {LINES}, {SYMBOLS}, {ANSWERS}"""


def _union_of_dashboards() -> str:
    top = lambda name, column, k: f"""SELECT '{name}' AS dashboard, panel, name, n_cases AS n, rank FROM ({_top_sql(column, k).replace(f"WITH {REPORTS}, {LINKS}, counts", "WITH counts")})"""
    labels = """SELECT 'top_labels', panel, label, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY panel ORDER BY n DESC, label) AS INTEGER) AS rank
      FROM (SELECT panel, label, count(*) AS n FROM answers JOIN cases USING (report_id) WHERE """ + _IN_SNAPSHOT + " GROUP BY ALL)) WHERE rank <= 11"
    pivot = "SELECT 'symbol_pivot', panel, label || ' ' || s, n, CAST(0 AS INTEGER) FROM (SELECT panel, label, s, count(*) FILTER (WHERE symbol = s) AS n FROM symbols JOIN cases USING (report_id), (SELECT unnest(['A', 'N', 'R']) AS s) WHERE " + _IN_SNAPSHOT + " GROUP BY ALL)"
    parts = [
        f"SELECT 'cases_by_month' AS dashboard, panel, strftime(issued, '%Y-%m') AS name, count(*) AS n, CAST(0 AS INTEGER) AS rank FROM cases WHERE {_IN_SNAPSHOT} GROUP BY ALL",
        f"SELECT 'by_species', panel, species, count(*), CAST(0 AS INTEGER) FROM reports WHERE {_IN_SNAPSHOT} GROUP BY ALL",
        top("top_genera", "genus", 10), top("top_samples", "sample", 10), labels, pivot,
    ]
    return f"WITH {_COUNTED} " + " UNION ALL ".join(f"({p})" for p in parts)


@query("dashboards_from_summaries", _union_of_dashboards())
def dashboards_from_summaries(spark, folder):
    """All six dashboards of the newest snapshot from stored counts per batch: facts are read when a batch is loaded, never for a dashboard."""
    path = scratch_path(spark, "counts")
    reports = roles.reports(spark, folder)
    facts = roles.lines_by_report(spark, folder, "label", F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "O").alias("open"))
    symbols = ["A", "N", "R"]
    summaries.store(summaries.report_counts(reports).unionByName(summaries.fact_counts(reports, facts, symbols)), path)
    links = roles.links(spark, folder)
    batches = links.filter(F.col("version") == roles.span(spark, folder)[1]).select("batch_id")
    found = summaries.dashboards(summaries.snapshot_counts(spark.read.parquet(path), batches), symbols)
    none = F.lit(0)
    shown = {
        "cases_by_month": ("month", "n_cases", none), "by_species": ("name", "n_cases", none), "top_genera": ("name", "n_cases", F.col("rank")),
        "top_samples": ("name", "n_cases", F.col("rank")), "top_labels": ("name", "n_cases", F.col("rank")),
    }
    parts = [found[d].select(F.lit(d).alias("dashboard"), "panel", F.col(name).alias("name"), F.col(n).alias("n"), rank.alias("rank")) for d, (name, n, rank) in shown.items()]
    cells = F.array(*[F.struct(F.concat("label", F.lit(f" {s}")).alias("name"), F.col(f"n_{s.lower()}").alias("n")) for s in symbols])
    pivot = found["symbol_pivot"].select(F.lit("symbol_pivot").alias("dashboard"), "panel", F.inline(cells)).withColumn("rank", none)
    return reduce(DataFrame.unionByName, [*parts, pivot])


def stored_identities(spark, stored: DataFrame) -> IdentityIndex:
    """An index of the identities of stored reports, as one batch."""
    held = stored.select(*[c.alias(n) for n, c in quality.identity(stored, raw=False).items()])
    index = IdentityIndex(scratch_path(spark, "identities"), held.columns, held.schema)
    index.add(held, 0)
    return index




@query(
    "deep_page",
    """WITH ends AS (SELECT count(*) // 10 AS pages FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT l_orderkey, l_linenumber, l_extendedprice,
      row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem), ends
    WHERE place > (pages - 1) * 10 AND place <= pages * 10""",
)
def deep_page(spark, folder):
    """The last full page of all line items in order of price, through the offset index."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    order = [F.desc("l_extendedprice"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]]
    pages = Pages(scratch_path(spark, "pages"), block=5_000)
    held = pages.build(items, order)
    return pages.page(spark, held // PAGE_ROWS).select("l_orderkey", "l_linenumber", "l_extendedprice")
