"""Exact and near matches of item windows against plain loops, and the corner cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labspark.llm import phrases
from tests.llm.brute import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def windows(items, size):
    out = {}
    for key, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - size + 1) if ws else 0):
            out.setdefault(tuple(ws[i : i + size]), set()).add("" if key is None else str(key))
    return out


def brute(docs, items, size):
    known, out = windows(items, size), []
    sizes = {len(w) for w in known}
    for key, text in docs:
        ws, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                names = known.get(tuple(ws[i : i + n]))
                if names:
                    hit.update(range(i, i + n))
                    ids |= names
        out.append((key, len(ws), len(hit), sorted(ids)))
    return sorted(out, key=str)


def near(docs, items, size, slack):
    known, out = windows(items, size), set()
    for key, text in docs:
        ws = words(text)
        for window in known:
            span = len(window) + slack
            for i in range(max(1, len(ws) - span + 1)):
                if not Counter(window) - Counter(ws[i : i + span]):
                    out.add((key, window, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def contamination(spark, docs, items, size):
    got = phrases.contamination(*frames(spark, docs, items), size=size)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("letters", ["ab", "aaaaaaaaabcdefgh"])
def test_few_terms_and_one_frequent_term(spark, letters):
    draw = random.Random(len(letters))
    docs = [(i, " ".join(draw.choices(letters, k=draw.randrange(60)))) for i in range(40)]
    items = [(i, "-".join(draw.choices(letters.upper(), k=draw.randrange(9)))) for i in range(12)]
    assert contamination(spark, docs, items, 4) == brute(docs, items, 4)


def test_nulls_repeats_long_texts_and_other_scripts(spark):
    passage = "The Ärger of 3 men, and a DOG's life—one two three four"
    long_text = "filler word " * 60_000 + passage + " filler" * 9
    docs = [(None, passage), (None, None), (1, ""), (2, " ,;"), (3, f"x {passage.upper()} y"), (3, f"x {passage.upper()} y"), (3, passage),
            (4, passage.replace("ä", "Ä")), (5, long_text), (6, passage.replace("3", "4")), (7, "solo"), (8, "日本語 dog")]
    items = [(1, passage), (10, passage), (2, "Solo!"), (None, "日本語"), (3, None), (4, "..."), (5, "filler word " * 8), (1, passage)]
    assert contamination(spark, docs, items, 10) == brute(docs, items, 10)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = [(1, "one two three")], [(1, "two three")]
    assert contamination(spark, [], items, 2) == []
    assert contamination(spark, docs, [], 2) == [(1, 3, 0, [])]
    left, right = frames(spark, docs, items)
    for name in ["content", "n_words", "postings", "phrase", "items", "n_hit", "size", "term", "d", "c"]:
        left, right = left.withColumn(name, F.lit("x")), right.withColumn(name, F.lit("x"))
    assert [tuple(r) for r in phrases.contamination(left, right, size=2).collect()] == [(1, 3, 2, ["1"])]


def test_every_place_is_returned(spark):
    docs, items = frames(spark, [(1, "a b a b a b c"), (2, "b a")], [(9, "a b")])
    _, matches, known = phrases.search(docs, items, size=2)
    assert [(r.doc_id, r.size, sorted(r.begins)) for r in matches.collect()] == [(1, 2, [0, 2, 4])]
    assert [(r.phrase, r.item_id) for r in known.collect()] == [(phrases._phrase([b"a", b"b"]), 9)]


def test_near_matches(spark):
    draw = random.Random(4)
    docs = [(i, " ".join(draw.choices("abcdefgh", k=draw.randrange(14)))) for i in range(30)]
    items = [(i, " ".join(draw.choices("abcdefgh", k=draw.choice([1, 2, 5])))) for i in range(8)]
    _, matches, _ = phrases.search(*frames(spark, docs, items), size=3, slack=2)
    names = {phrases._phrase([w.encode() for w in window]): window for window in windows(items, 3)}
    got = {(r.doc_id, names[r.phrase], b) for r in matches.collect() for b in r.begins}
    assert got == near(docs, items, 3, 2)


def test_places_join_by_shuffle_beyond_the_bound(spark, monkeypatch):
    docs, items = [(i, f"one two three {i}") for i in range(20)], [(1, "two three")]
    assert "broadcast" in phrases._sent(spark.createDataFrame([([("p", 1, [1], None)],)], "asked array<struct<phrase:string,size:int,begins:array<int>,terms:array<bigint>>>"))._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(phrases, "MAX_BROADCAST_BYTES", 0)
    assert contamination(spark, docs, items, 2) == brute(docs, items, 2)


def test_only_texts_with_places_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MAX_BROADCAST_BYTES", 0)  # places beyond the bound
    held, seen = "one two three four five six seven eight nine ten", []
    docs = spark.createDataFrame([(i, f"w{i} " * 50 + (held if i % 50 == 0 else "")) for i in range(200)], "doc_id long, text string")
    items = spark.createDataFrame([("a", held)], "item_id string, text string")
    whole = phrases._candidates
    monkeypatch.setattr(phrases, "_candidates", lambda rows, asked: seen.append(whole(rows, asked)) or seen[0])
    found = phrases.contamination(docs, items).filter("n_hit > 0").collect()
    assert sorted(r.doc_id for r in found) == [0, 50, 100, 150] and {r.n_hit for r in found} == {10}
    assert 4 <= seen[0].count() < 20
