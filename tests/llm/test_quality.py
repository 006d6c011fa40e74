import zlib

import numpy as np
import pandas as pd

from labspark.llm import quality
from labspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = QUERIES["op9_quality_votes"](spark, SF).toPandas()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    both = both[both.held_out]
    good, bad = both[both.quality == 1], both[both.quality == 0]
    assert good.predicted.mean() > 0.97
    assert (1 - bad.predicted).mean() > 0.6
    auc = np.mean([(g > bad.score).mean() + (g == bad.score).mean() / 2 for g in good.score])
    assert auc > 0.85


def test_blocked_vote_equals_plain_vote():
    pick = np.random.default_rng(1)
    raw = pick.poisson(0.3, (60, quality.TERMS)).astype(float)
    known = np.arange(quality.TERMS)
    model = quality.Votes(known, np.ones(quality.TERMS), np.linalg.svd(raw)[2][:8].T, np.zeros((0, 0)), (pick.random(60) < 0.7) * 1.0, 5)
    model = quality.Votes(known, model.weights, model.projection, model.latent(raw), model.labels, 5)
    probe = pick.poisson(0.3, (7, quality.TERMS)).astype(float)
    for row, score in zip(model.latent(probe), model.scores(probe)):
        near = sorted(((float(row @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[:5]
        weights = [max(s, 0) ** 8 for s, _ in near]
        assert abs(score - sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights)) < 1e-9


def test_nulls_empties_no_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "Some text here.", 3), (2, "", 2)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    got = quality.with_scores(docs, quality.fit(docs, labels)).toPandas()
    assert len(got) == 4 and got.score.between(0, 1).all() and got.y.sum() == 8
    none = quality.with_scores(docs, quality.fit(docs, labels.limit(0))).toPandas()
    assert none.score.tolist() == [0.5] * 4
    assert quality.with_scores(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_words_tell_texts_of_one_style_apart(spark):
    """Same letters, lengths and marks; only the words differ."""
    pick = np.random.default_rng(5)
    good, bad = (["".join(pick.choice(list("abcdefgh"), 5)) for _ in range(60)] for _ in range(2))
    rows = [(i, " ".join(pick.choice(good if i % 2 else bad, 40)) + ".", i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:300]], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.with_scores(docs, quality.fit(docs, labels)).collect()}
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in rows[300:]]) > 0.95


def test_equal_neighbours_count_in_order():
    """Of equal cosines on the edge the first labelled rows vote, however many documents are scored at once."""
    counts = np.zeros((6, quality.TERMS))
    counts[:, 5] = 1
    labels = np.array([1.0, 1.0, 0, 0, 0, 0])
    model = quality.Votes(np.arange(quality.TERMS), np.ones(quality.TERMS), np.eye(quality.TERMS)[:, :8], np.zeros((0, 0)), labels, 3)
    model = quality.Votes(model.known, model.weights, model.projection, model.latent(counts), labels, 3)
    assert np.allclose(model.scores(counts[:1]), 2 / 3) and np.allclose(model.scores(counts), 2 / 3)


def test_very_long_text_and_a_column_like_the_score(spark):
    docs = spark.createDataFrame([(1, "some words here. " * 100_000, "x", 7), (2, "other", "y", 8)], "doc_id long, text string, `a.b` string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = quality.with_scores(docs, quality.fit(docs, labels))
    assert got.columns == ["doc_id", "text", "a.b", "score"] and dict(got.dtypes)["score"] == "double"
    assert sorted(r.doc_id for r in got.select("doc_id", "score").collect()) == [1, 2]
