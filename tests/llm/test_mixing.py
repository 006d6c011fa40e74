import pytest

from labspark.llm import mixing
from labspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def brute_targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        for s in above or open_:
            out[s] = 2.0 * sizes[s] if above else left * weight[s] / total
        left -= sum(out[s] for s in above)
        open_ -= above or open_
    return out


def test_query(spark):
    docs = brute.documents(SF)
    docs["size"] = [len(brute.WORDS.findall(t or "")) for t in docs.text]
    got = QUERIES["op6_mix_sources"](spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    assert got.doc_id.tolist() == docs.doc_id.tolist() and got["size"].tolist() == docs["size"].tolist()
    assert (got.taken <= 2 * got["size"]).all()
    got["source"] = docs.source
    want = brute_targets(docs.groupby("source")["size"].sum().to_dict())
    for source, rows in got.groupby("source"):
        assert rows.target.iloc[0] == pytest.approx(want[source])
        assert (rows.source_size == rows["size"].sum()).all()
        assert abs(rows.taken.sum() - want[source]) <= rows["size"].max() / 2 + 1e-6
    again = QUERIES["op6_mix_sources"](spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    assert again.taken.tolist() == got.taken.tolist()


def test_whole_copies_are_certain(spark):
    got = QUERIES["op6_mix_sources"](spark, SF).toPandas()
    ratio = got.target / got.source_size
    assert (got.taken >= (ratio // 1) * got["size"] - 1e-6).all()


def test_weights_change_the_odds(spark):
    rows = [(i, "w " * 10, "a", 9.0 if i % 2 else 1.0) for i in range(400)] + [(1000 + i, "w " * 10, "b", 1.0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, likes double")
    got = mixing.mix(docs, weight="likes").toPandas()
    b = got[got.source == "a"]
    assert b[b.likes == 9].eval("_llm_copies").mean() > b[b.likes == 1].eval("_llm_copies").mean() + 0.5
    assert (got._llm_copies <= 2).all()


def test_nulls_ties_empties_and_clashing_columns(spark):
    rows = [(None, None, None, 1), (1, "", "a", 2), (2, "x y", "a", 3), (2, "x y", "a", 3), (3, "z", None, 4), (4, None, "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int")
    got = mixing.mix(docs).toPandas()
    assert len(got) == 6 and got._size.sum() == 18 and got._llm_size.sum() == 5
    twins = got[got.doc_id == 2]
    assert twins._llm_copies.nunique() == 1
    assert got[got.source == "b"]._llm_target.tolist() == [0.0]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_columns_like_the_added_ones_are_replaced(spark):
    docs = spark.createDataFrame([(1, "one two", "a", 9), (2, "word " * 200_000, "a", 9)], "doc_id long, text string, source string, _llm_size int")
    got = {r.doc_id: r._llm_size for r in mixing.mix(docs).collect()}
    assert got == {1: 2, 2: 200_000}
