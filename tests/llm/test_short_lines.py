from labspark.llm import lines
from tests.llm.test_lines import brute_dedup, shown


def test_short_lines_go_only_as_exact_copies(spark):
    docs = [(1, "All rights reserved.\n\nHome\none two three four five"), (2, "all  rights reserved.\n\nMenu\none two three four"),
            (3, "版权所有。保留一切权利。\nAll rights kept."), (4, "版权所有。保留一切权利。\n\nhome\none two three four"), (5, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = shown(lines.without_repeats(frame))
    assert got == brute_dedup(docs)
    assert [r[3] for r in got] == [docs[0][1], "\nMenu\none two three four", docs[2][1], "", None]


def test_places_are_sent_by_their_count(spark, monkeypatch):
    """Whether the places of lines are broadcast is known before any of them is fetched."""
    wanted = spark.range(100).selectExpr("id AS d", "id AS c", "array(named_struct('pos', 0, 'h', id)) AS wanted")
    monkeypatch.setattr(type(wanted), "toArrow", None)
    assert "broadcast" in lines._sent(wanted)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(lines, "MAX_BROADCAST_BYTES", 100 * 40 - 1)
    assert "broadcast" not in lines._sent(wanted)._jdf.queryExecution().logical().toString()


def test_columns_like_the_added_ones_are_replaced(spark):
    docs = spark.createDataFrame([(1, "same words in this line\nx", "p"), (2, "same words in this line", "q")], "doc_id long, text string, _llm_lines string")
    assert shown(lines.without_repeats(docs)) == [(1, 2, 0, "same words in this line\nx"), (2, 1, 1, "")]
