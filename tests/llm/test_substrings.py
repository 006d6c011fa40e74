import random

import pytest
from pyspark.sql import functions as F

from labspark.llm import substrings
from labspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def shown(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    docs = brute.documents(folder)
    want = brute.substring_dedup(list(zip(docs.doc_id.tolist(), docs.text)))
    assert sorted(map(tuple, QUERIES["op5_substring_dedup"](spark, folder).collect())) == want
    assert sum(w[2] for w in want) > 0


@pytest.mark.parametrize("most", [1, 512])
def test_shared_passages(spark, most):
    """Passages of a small vocabulary, cut and joined at random; with groups of one all windows go by whole prefixes."""
    pick = random.Random(most)
    source = [pick.choice("abcdefgh") for _ in range(400)]
    docs = []
    for key in range(40):
        words = []
        for _ in range(pick.randint(0, 4)):
            at = pick.randrange(380)
            words += source[at : at + pick.randint(1, 60)] + [pick.choice("xyz") for _ in range(pick.randint(0, 3))]
        docs.append((key, " ".join(words)))
    docs += [(40, "a " * 70), (41, "a b " * 30), (42, " ".join(source))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert shown(substrings.without_repeats(frame, max_group=most)) == brute.substring_dedup(docs)


def test_nulls_ties_empties_and_clashing_columns(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [(None, long, 1), (1, None, 2), (2, "", 3), (3, long, 4), (3, long, 4), (4, f"x {long}\ty", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, twin int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.without_repeats(docs).collect()), key=str)
    assert got == sorted([(None, 30, 30), (1, 0, 0), (2, 0, 0), (3, 30, 0), (3, 30, 0), (4, 32, 30)], key=str)
    assert substrings.without_repeats(docs.limit(0)).count() == 0
    huge = [(1, " ".join(f"q{i % 5003}" for i in range(200_000)))]
    frame = spark.createDataFrame(huge, "doc_id long, text string")
    assert shown(substrings.without_repeats(frame)) == brute.substring_dedup(huge)
