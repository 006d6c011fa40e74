from labspark.operators import quality


def test_rows_are_counted_in_every_task(spark):
    """No limit sends all rows through one task before they are counted."""
    issues = quality.amount_issues(spark.range(10), min_rows=100)
    assert "Limit" not in issues._jdf.queryExecution().logical().toString()
    assert [r.code for r in issues.collect()] == ["too_few_rows"]
    assert quality.amount_issues(spark.range(10), min_rows=10).count() == 0
