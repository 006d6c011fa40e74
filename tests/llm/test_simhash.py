import random

import pytest

from labspark.llm import simhash
from labspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def shown(df):
    from pyspark.sql import functions as F

    rows = df.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_brute_force(spark):
    docs = brute.documents(SF)
    want = brute.simhash_groups(list(zip(docs.doc_id.tolist(), docs.text)))
    assert sorted(map(tuple, QUERIES["op3_simhash_near_dups"](spark, SF).collect())) == want


@pytest.mark.parametrize("limit", [1, 64])
def test_balls_and_pairs_find_the_same_groups(spark, monkeypatch, limit):
    """Fingerprints around a few centres, so that buckets are hot; with limit 1 every bucket goes by whole balls."""
    pick = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = pick.getrandbits(64)
        for _ in range(25):
            value = centre
            for bit in pick.sample(range(64), pick.randint(0, 5)):
                value ^= 1 << bit
            prints.add(value)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = brute.roots(len(prints), near)
    for blocks in (1, 2):
        links = simhash.links(frame, 4, blocks, limit).collect()
        at = {p: i for i, p in enumerate(signed)}
        pairs = [(at[r.a], at[r.b]) for r in links]
        assert all((prints[a] ^ prints[b]).bit_count() <= 4 for a, b in pairs)
        assert brute.roots(len(prints), pairs) == want


def test_nulls_ties_empties_and_clashing_columns(spark):
    rows = [(None, None, 1), (3, "", 2), (2, "one two three four five", 3), (2, "one two three four five", 3),
            (1, "ONE two\tthree  four five", 4), (9, "quite another text of some words", 5), (None, "lone words here now", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    want = sorted(brute.simhash_groups([(a, b) for a, b, _ in rows]), key=str)
    assert shown(simhash.near_groups(docs)) == want
    kept = sorted((tuple(r) for r in simhash.one_of_each(docs).collect()), key=str)
    assert [r[0] for r in kept] == [1, 3, 9, None]
    assert simhash.near_groups(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).columns == docs.columns


def test_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == brute.simhash(text)


def test_buckets_of_two_link_without_a_second_look(spark, monkeypatch):
    pick = random.Random(5)
    ones = [pick.getrandbits(62) for _ in range(300)]
    frame = spark.createDataFrame([(p,) for p in ones + [p ^ 0b101 for p in ones[:40]]], "fp long")
    written, keep = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: written.append(keep(df)) or written[-1])
    assert {(r.a, r.b) for r in simhash.links(frame).collect()} == {tuple(sorted((p, p ^ 0b101))) for p in ones[:40]}
    assert written[-1].isEmpty()  # members met through the variants


def test_crowded_halves_are_searched_by_longer_keys(spark, monkeypatch):
    """100 fingerprints with one lower half, 20 of them beside another one: no whole balls, no row for each variant."""
    pick = random.Random(9)
    high = [pick.getrandbits(31) << 32 for _ in range(100)]
    prints = [h | 77 for h in high] + [(h ^ 0b1011 << 33) | 76 for h in high[:20]]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    written, keep = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(simhash, "_ball", lambda *_: pytest.fail("whole balls"))
    found = {(r.a, r.b) for r in simhash.links(frame).collect()}
    assert found == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4}
    assert len(found) == 20
    assert max(df.count() for df in written) <= 3 * len(prints)


def test_thirds_hold_each_bit_twice():
    held = [(at + i) % 64 for at, width in simhash.THIRDS for i in range(width)]
    assert sorted(held) == sorted([*range(64), *range(64)])
