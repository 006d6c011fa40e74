"""What a task takes at most does not grow with the table."""

from __spark_entry__ import queries
from labspark import session
from labspark.plans import roles, summaries
from labspark.plans import reports as rep

FOLDER = "/root/testdata/sf0.001"


def largest(df):
    """Rows of the largest partition."""
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_few_rows_stay_and_many_are_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    df = spark.range(2_000).selectExpr("id div 2 as k")
    assert session.dealt(df, ["k"], 800) is df
    met = session.dealt(df, ["k"], 2_000)
    assert met.rdd.getNumPartitions() == 20 and largest(met) < 200
    assert met.groupBy("k").count().filter("count <> 2").isEmpty()


def test_symbols_per_drug_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    whole = sorted(queries()["snapshot_symbol_pivot"](spark, FOLDER).collect())
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    seen = []
    monkeypatch.setattr(rep, "symbol_distribution", lambda r, flags, s, done=rep.symbol_distribution: seen.append(flags) or done(r, flags, s))
    assert sorted(queries()["snapshot_symbol_pivot"](spark, FOLDER).collect()) == whole
    assert largest(seen[0]) < 300 and seen[0].count() == roles.lines(spark, FOLDER).count()


def test_counts_of_a_batch_meet_in_tasks_of_bounded_size(spark, monkeypatch):
    whole = sorted(queries()["dashboards_from_summaries"](spark, FOLDER).collect())
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    seen = []
    monkeypatch.setattr(summaries, "fact_counts", lambda r, facts, s, done=summaries.fact_counts: seen.append(facts) or done(r, facts, s))
    assert sorted(queries()["dashboards_from_summaries"](spark, FOLDER).collect()) == whole
    assert largest(seen[0]) < 300
