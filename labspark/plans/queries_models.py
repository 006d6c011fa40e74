"""Registered metrics, rankings, snapshots and champions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labspark.operators import metrics, registry
from labspark.operators.metrics import MEASURES
from labspark.plans import roles
from labspark.plans.queries_tables import snapshot_vocabularies
from labspark.plans.registered import CASES, LINES, LINKS, METRICS, query
from labspark.session import bounded
from labspark.sources.tables import table

_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in MEASURES)


def _rounded():
    return [F.round(m, 6).alias(m) for m in MEASURES]


@query(
    "binary_metrics",
    f"""WITH scored AS (SELECT lang, quality = 1 AS truth, n_chars / (n_chars + 1000.0::double) >= 0.5 AS predicted
      FROM labels JOIN documents USING (doc_id)),
    counts AS (SELECT lang, count(*) FILTER (WHERE truth AND predicted) AS tp, count(*) FILTER (WHERE NOT truth AND predicted) AS fp,
      count(*) FILTER (WHERE truth AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT truth AND NOT predicted) AS tn
      FROM scored GROUP BY lang)
    SELECT lang, tp, fp, fn, tn, round((tp + tn)::double / (tp + fp + fn + tn), 6) AS accuracy,
      round(CASE WHEN tp + fp = 0 THEN 0.0::double ELSE tp::double / (tp + fp) END, 6) AS precision,
      round(CASE WHEN tp + fn = 0 THEN 0.0::double ELSE tp::double / (tp + fn) END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0::double ELSE (2 * tp)::double / (2 * tp + fp + fn) END, 6) AS f1 FROM counts""",
)
def binary_metrics(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, folder, "labels").join(documents, "doc_id")
    score = F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))
    found = metrics.binary_metrics(rows, F.col("quality") == 1, score, ["lang"])
    return found.select("lang", "tp", "fp", "fn", "tn", *_rounded())


_PAIRS = f"""{LINES}, pairs AS (
  SELECT report_id, label, bool_or(l_linestatus = 'O') AS truth, bool_or(l_returnflag = 'R') AS predicted FROM items GROUP BY ALL),
  counts AS (SELECT o_orderkey AS report_id, count(*) FILTER (WHERE truth AND predicted) AS tp,
    count(*) FILTER (WHERE NOT truth AND predicted) AS fp, count(*) FILTER (WHERE truth AND NOT predicted) AS fn
    FROM orders LEFT JOIN pairs ON report_id = o_orderkey GROUP BY o_orderkey),
  scores AS (SELECT report_id, (6 - fp - fn) / 6.0::double AS accuracy,
    CASE WHEN tp + fn = 0 THEN (fp = 0)::int::double WHEN tp + fp = 0 THEN 0 ELSE tp::double / (tp + fp) END AS precision,
    CASE WHEN tp + fn = 0 THEN (fp = 0)::int::double ELSE tp::double / (tp + fn) END AS recall,
    CASE WHEN tp + fn = 0 THEN (fp = 0)::int::double ELSE (2 * tp)::double / (2 * tp + fp + fn) END AS f1 FROM counts)"""


@query(
    "multilabel_by_case",
    f"WITH {_PAIRS} SELECT count(*) AS n_cases, {', '.join(f'round(avg({m}), 6) AS {m}' for m in MEASURES)} FROM scores",
)
def multilabel_by_case(spark, folder):
    pairs = (
        roles.lines(spark, folder)
        .groupBy("report_id", "label")
        .agg(
            F.bool_or(F.col("l_linestatus") == "O").alias("truth"),
            F.bool_or(F.col("l_returnflag") == "R").alias("predicted"),
        )
    )
    cases = roles.cases(spark, folder).select("report_id")
    found = metrics.metrics_by_case(pairs, "report_id", len(roles.labels(spark, folder)), cases)
    return found.select("n_cases", *_rounded())


@query(
    "rank_recommendations",
    f"""WITH {LINES}, scores AS (SELECT report_id, label, avg(l_quantity) / 50 AS score FROM items GROUP BY ALL)
    SELECT report_id, label, CAST(row_number() OVER (PARTITION BY report_id ORDER BY score DESC, label) AS INTEGER) AS rank,
      round(score * 100, 2) AS score_pct FROM scores WHERE score >= 0.5""",
)
def rank_recommendations(spark, folder):
    scores = (
        roles.lines(spark, folder).groupBy("report_id", "label").agg((F.avg("l_quantity") / 50).alias("score"))
    )
    return metrics.rank_scores(scores, "report_id", "label")


# ---- registry tables from the metrics per drug and version ----

_HISTORY = f"""{LINES}, {METRICS}, history AS (
  SELECT *, label || '-' || version AS model_id, max(f1) OVER (PARTITION BY label ORDER BY version
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM metrics),
  judged AS (SELECT *, CASE WHEN best IS NULL OR f1 > best THEN 'better' WHEN f1 < best THEN 'worse' ELSE 'same' END AS performance
    FROM history)"""


def _models(spark, folder, tests=None):
    """Models of all versions with the outcome against the champion of their time; `tests` are the metrics, if they are at hand."""
    earlier = Window.partitionBy("label").orderBy("version").rowsBetween(Window.unboundedPreceding, -1)
    tests = roles.model_metrics(spark, folder) if tests is None else tests
    history = tests.withColumn("_best", F.max("f1").over(earlier))
    return history.select(
        F.concat_ws("-", "label", F.col("version").cast("string")).alias("model_id"),
        F.col("label").alias("antimicrobial_id"),
        "version", "tp", "fp", "fn", "tn",
        *MEASURES,
        F.when(F.col("_best").isNull(), "better").otherwise(registry.compare_f1(F.col("f1"), F.col("_best"))).alias("performance"),
    )


def _champions(models, upto: int):
    """Model each drug points at after version `upto`."""
    won = models.filter((F.col("version") <= upto) & F.col("performance").isin("better", "same"))
    return won.groupBy("antimicrobial_id").agg(F.max_by("model_id", "version").alias("model_id"))


def _registry(spark, folder, tests=None):
    """model, links and groups of one panel; group 0 holds the champions."""
    models = bounded(_models(spark, folder, tests))
    links = models.select(F.col("version").alias("model_group_id"), "model_id").unionByName(
        _champions(models, roles.span(spark, folder)[1]).select(F.lit(0).alias("model_group_id"), "model_id")
    )
    per_group = links.join(models.drop("model_group_id"), "model_id").groupBy("model_group_id").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    )
    groups = metrics.with_measures(per_group).select(
        "model_group_id", F.col("model_group_id").alias("version"), F.lit(1).alias("vitek_id"), *MEASURES
    )
    return models.drop("version", "tp", "fp", "fn", "tn"), bounded(links), bounded(groups)


@query(
    "perf_by_label",
    f"WITH {LINES}, {METRICS} SELECT version, {_ROUNDED} FROM metrics WHERE label = 'PROMO' AND version > 0",
)
def perf_by_label(spark, folder):
    models, links, groups = _registry(spark, folder)
    return registry.performance_by_label(models, links, groups, F.col("antimicrobial_id") == "PROMO").select(
        "version", *_rounded()
    )


_LAST = "(SELECT max(version) FROM judged)"


def _version_sql(rows: str, version: str) -> str:
    total = "sum(tp + tn)::double / sum(tp + fp + fn + tn)"
    return f"""SELECT label AS name, version, {_ROUNDED}, performance, version AS model_group_id FROM judged WHERE {rows}
    UNION ALL SELECT 'All Model (Test By Case)', CAST({version} AS INTEGER), round({total}, 6), round(sum(tp)::double / sum(tp + fp), 6),
      round(sum(tp)::double / sum(tp + fn), 6), round(2 * sum(tp)::double / sum(2 * tp + fp + fn), 6), '-', CAST({version} AS INTEGER)
    FROM judged WHERE {rows}"""


@query("perf_by_version", f"WITH {_HISTORY} {_version_sql(f'version = {_LAST}', _LAST)}")
def perf_by_version(spark, folder):
    return _performance(spark, folder, roles.span(spark, folder)[1])


@query(
    "perf_current",
    f"""WITH {_HISTORY}, champion AS (
      SELECT label, max(version) AS version FROM judged WHERE performance <> 'worse' GROUP BY label),
    tested AS (SELECT label, champion.version, tp, fp, fn, tn, accuracy, precision, recall, f1 FROM champion
      JOIN (SELECT label, tp, fp, fn, tn, accuracy, precision, recall, f1 FROM metrics WHERE version = {_LAST}) USING (label))
    SELECT label AS name, version, {_ROUNDED}, '-' AS performance, version AS model_group_id FROM tested
    UNION ALL SELECT 'All Model (Test By Case)', CAST(0 AS INTEGER), round(sum(tp + tn)::double / sum(tp + fp + fn + tn), 6),
      round(sum(tp)::double / sum(tp + fp), 6), round(sum(tp)::double / sum(tp + fn), 6),
      round(2 * sum(tp)::double / sum(2 * tp + fp + fn), 6), '-', CAST(0 AS INTEGER)
    FROM (SELECT j.* FROM judged j JOIN champion USING (label, version))""",
)
def perf_current(spark, folder):
    """Champions with the metrics of their last test, each with the version it comes from.

    The rows of the newest batch are that test: every champion is re-tested on them.
    """
    tests = roles.model_metrics(spark, folder)  # one pass over the facts, for the models and their last test
    models, links, groups = _registry(spark, folder, tests)
    _, last = roles.span(spark, folder)
    retest = tests.filter(F.col("version") == last)
    pointed = _champions(models.withColumn("version", F.substring_index("model_id", "-", -1).cast("int")), last)
    current = pointed.join(retest.withColumnRenamed("label", "antimicrobial_id"), "antimicrobial_id").select(
        "model_id", *MEASURES, F.lit(last + 1).alias("version")
    )
    older = pointed.select("model_id", *[F.lit(0.0).alias(m) for m in MEASURES], F.lit(last).alias("version"))
    names = models.select("antimicrobial_id", F.col("antimicrobial_id").alias("name")).distinct()
    found = registry.performance_of_current(older.unionByName(current), models, links, groups, names, 1)
    return found.select("name", "version", *_rounded(), "performance", "model_group_id")


def _performance(spark, folder, version: int):
    models, links, groups = _registry(spark, folder)
    names = models.select("antimicrobial_id", F.col("antimicrobial_id").alias("name")).distinct()
    found = registry.performance_by_version(models, links, groups, names, 1, version)
    return found.select("name", "version", *_rounded(), "performance", "model_group_id")


@query(
    "champion_challenger",
    f"""WITH {_HISTORY}, champion AS (
      SELECT label, max(version) AS version FROM judged WHERE version < (SELECT max(version) FROM judged) AND performance <> 'worse' GROUP BY label)
    SELECT n.label, n.model_id, o.model_id AS champion_model_id, round(n.f1, 6) AS f1, round(o.f1, 6) AS champion_f1,
      CASE WHEN n.f1 > o.f1 THEN 'better' WHEN n.f1 < o.f1 THEN 'worse' ELSE 'same' END AS performance
    FROM judged n JOIN champion USING (label) JOIN judged o ON o.label = champion.label AND o.version = champion.version
    WHERE n.version = (SELECT max(version) FROM judged)""",
)
def champion_challenger(spark, folder):
    return _decided(spark, folder).select(
        "label", "model_id", "champion_model_id", F.round("f1", 6).alias("f1"),
        F.round("champion_f1", 6).alias("champion_f1"), "performance",
    )


def _decided(spark, folder):
    _, last = roles.span(spark, folder)
    judged = bounded(_models(spark, folder))
    models = judged.drop("performance").withColumnRenamed("antimicrobial_id", "label")
    old = models.join(bounded(_champions(judged, last - 1).select("model_id")), "model_id", "left_semi")
    return registry.champion_challenger(models.filter(F.col("version") == last), old, "label")


@query(
    "promote_current",
    f"""WITH {_HISTORY}, champion AS (
      SELECT label, max(version) AS version FROM judged WHERE performance <> 'worse' GROUP BY label)
    SELECT label, model_id, {_ROUNDED}, CAST((SELECT max(version) FROM metrics) + 1 AS INTEGER) AS version FROM champion JOIN judged USING (label, version)""",
)
def promote_current(spark, folder):
    rows = registry.current_rows(registry.promote(_decided(spark, folder), "label"), roles.span(spark, folder)[1])
    return rows.select("label", "model_id", *_rounded(), "version")


_VOCABULARY = f"""{CASES}, {LINKS}, parts AS (
  SELECT links.version, p_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN cases ON report_id = l_orderkey
  JOIN links USING (batch_id)),
  name_counts AS (SELECT version, p_name, count(*) AS n FROM parts GROUP BY ALL),
  vocabulary AS (SELECT version, count(DISTINCT CASE WHEN n < 135 THEN 'other' ELSE p_name END) AS n_values
    FROM name_counts GROUP BY version)"""


@query(
    "resolve_champions",
    f"""WITH {_HISTORY}, {_VOCABULARY}, champion AS (
      SELECT label, max(version) AS version FROM judged WHERE performance <> 'worse' GROUP BY label)
    SELECT label, model_id, version, n_values FROM champion JOIN judged USING (label, version) JOIN vocabulary USING (version)""",
)
def resolve_champions(spark, folder):
    models, links, groups = _registry(spark, folder)
    binning = snapshot_vocabularies(spark, folder, 135).select(
        F.col("version").alias("model_group_id"), F.col("vocabulary").alias("schema")
    )
    found = registry.resolve_champions(models, links, groups, bounded(binning), 1)
    return found.select(
        F.col("antimicrobial_id").alias("label"), "model_id", "version",
        F.size("sample_vocabulary").cast("long").alias("n_values"),
    )


_NEWEST = f"(SELECT * FROM judged WHERE version = {_LAST})"


@query(
    "register_snapshot",
    f"""WITH {_HISTORY}, {_VOCABULARY.replace("count(DISTINCT CASE WHEN n < 135 THEN 'other' ELSE p_name END) AS n_values", "string_agg(DISTINCT CASE WHEN n < 135 THEN 'other' ELSE p_name END, '|' ORDER BY CASE WHEN n < 135 THEN 'other' ELSE p_name END) AS names")},
    fresh AS (SELECT CAST({_LAST} + 1 AS BIGINT) AS group_id)
    SELECT 'model' AS name, group_id, model_id AS item, round(f1, 6) AS value FROM {_NEWEST}, fresh
    UNION ALL SELECT 'model_group', group_id, CAST(1 AS VARCHAR), group_id::double FROM fresh
    UNION ALL SELECT 'model_group_model', group_id, model_id, NULL FROM {_NEWEST}, fresh
    UNION ALL SELECT 'model_group_file', group_id, batch_id::varchar, NULL FROM (SELECT DISTINCT batch_id FROM cases), fresh
    UNION ALL SELECT 'binning', group_id, names, NULL FROM vocabulary, fresh WHERE version = {_LAST}""",
)
def register_snapshot(spark, folder):
    """All rows that a new snapshot of the newest models appends, in one long form."""
    _, last = roles.span(spark, folder)
    models = bounded(_models(spark, folder).filter(F.col("version") == last))
    batches = roles.batches(spark, folder).select(F.col("batch_id").alias("file_id"))
    names = snapshot_vocabularies(spark, folder, 135).filter(F.col("version") == last)
    vocabulary = names.select(F.explode("vocabulary").alias("name"))
    tables = registry.register_snapshot(last + 1, last + 1, 1, models, batches, vocabulary)
    none = F.lit(None).cast("double")

    def rows(name, item, value=none, group=F.col("model_group_id")):
        return tables[name].select(
            F.lit(name).alias("name"), group.cast("long").alias("group_id"), item.cast("string").alias("item"), value.alias("value")
        )

    parts = (
        rows("model", F.col("model_id"), F.round("f1", 6), F.lit(last + 1)),
        rows("model_group", F.col("vitek_id"), F.col("version").cast("double")),
        rows("model_group_model", F.col("model_id")),
        rows("model_group_file", F.col("file_id")),
        rows("binning", F.array_join("schema", "|")),
    )
    return reduce(DataFrame.unionByName, parts)


@query(
    "remove_snapshot",
    f"""WITH {_HISTORY}, champion AS (
      SELECT label, max(version) AS version FROM judged WHERE performance <> 'worse' GROUP BY label),
    links AS (SELECT version AS model_group_id, model_id FROM judged
      UNION ALL SELECT CAST(0 AS INTEGER), model_id FROM judged JOIN champion USING (label, version))
    SELECT 'model' AS name, model_id AS item, label AS of_item FROM judged
      WHERE version <> 3 OR (label, version) IN (SELECT (label, version) FROM champion)
    UNION ALL SELECT 'model_group', model_group_id::varchar, CAST(1 AS VARCHAR) FROM (SELECT DISTINCT model_group_id FROM links) WHERE model_group_id <> 3
    UNION ALL SELECT 'model_group_model', model_id, model_group_id::varchar FROM links WHERE model_group_id <> 3""",
)
def remove_snapshot(spark, folder):
    """The rows of all three tables after snapshot 3 is removed; its champions stay."""
    models, links, groups = _registry(spark, folder)
    left = registry.remove_snapshot(models, links, groups, 3)

    def rows(name, item, of_item):
        return left[name].select(F.lit(name).alias("name"), F.col(item).cast("string").alias("item"), F.col(of_item).cast("string").alias("of_item"))

    parts = (
        rows("model", "model_id", "antimicrobial_id"),
        rows("model_group", "model_group_id", "vitek_id"),
        rows("model_group_model", "model_id", "model_group_id"),
    )
    return reduce(DataFrame.unionByName, parts)
