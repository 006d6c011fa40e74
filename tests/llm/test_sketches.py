import hashlib
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from labspark.llm import sketches
from labspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    codes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    out = set()
    for i in range(max(1, len(codes) - n + 1) if codes else 0):
        h = 42
        for c in codes[i : i + n]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", c), h)
        out.add(signed(h))
    return out


def sketch(text):
    every = sorted(shingles(text))
    low = [h for h in every if h < (1 << 61) - (1 << 63)]
    return low if len(low) >= 64 else every[:64]


def likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    end = min(float("inf") if len(s) < 64 else max(s[-1], (1 << 61) - (1 << 63) - 1) for s in (a, b))
    a, b = {h for h in a if h <= end}, {h for h in b if h <= end}
    return len(a & b) / len(a | b)


def as_text(hashes):
    return "".join(f"{h % (1 << 64):016x}" for h in hashes)


def wanted(docs):
    """docs: (doc_id, text), every id once."""
    docs = [(k, t or "") for k, t in sorted(docs, reverse=True)]
    out = []
    for (key, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other = sketch(text), sketch(edited)
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((key, len(text), digest, as_text(own), as_text(other), likeness(own, other), likeness(own, sketch(following))))
    return sorted(out)


def test_query_equals_brute_force(spark):
    docs = brute.documents(SF)
    got = sorted(tuple(r)[:7] for r in QUERIES["op1_scaled_sketches"](spark, SF).collect())
    want = wanted(list(zip(docs.doc_id.tolist(), docs.text)))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:])


def test_likeness_is_near_the_truth(spark):
    docs = brute.documents(SF)
    got = QUERIES["op1_scaled_sketches"](spark, SF).toPandas().set_index("doc_id")
    texts = docs.text.tolist()
    errors = []
    for key, text, following in zip(docs.doc_id[1:], texts[1:], texts):
        half = len(text) // 2
        a, b = shingles(text), shingles(text[: len(text) - half] + following[:half])
        errors.append(abs(got.near_edited[key] - len(a & b) / len(a | b)))
    assert np.mean(errors) < 0.03 and max(errors) < 0.25


def test_merge_is_the_sketch_of_both(spark):
    docs = brute.documents(SF).text.tolist()
    rows = [(docs[i], docs[i + 1]) for i in range(0, 40, 2)] + [("", "a b c d e f"), ("", ""), ("x", "y")]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = frame.select(sketches.merge(sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))).alias("m")).collect()
    for (a, b), r in zip(rows, got):
        every = sorted(shingles(a) | shingles(b))
        low = [h for h in every if h < (1 << 61) - (1 << 63)]
        assert r.m == (low if len(low) >= 64 else every[:64])


def test_containment_of_unequal_documents(spark):
    words = [f"u{i}" for i in range(20_000)]
    rows = [(" ".join(words[4_000:6_000]), " ".join(words))]
    frame = spark.createDataFrame(rows, "a string, b string")
    got = frame.select(sketches.compare(sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))).alias("c")).first().c
    assert got.a_in_b == 1.0 and abs(got.b_in_a - 0.1) < 0.03 and abs(got.likeness - 0.1) < 0.03


def test_nulls_ties_empties_and_clashing_columns(spark):
    rows = [(None, "null id text", 1), (1, None, 2), (2, "", 3), (3, "two words", 4), (3, "two words", 4), (4, "αβγ " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch int")
    got = sketches.edited_likeness(docs).orderBy(F.col("doc_id").desc_nulls_last()).collect()
    assert [r.doc_id for r in got] == [4, 3, 3, 2, 1, None] and [r.n_chars for r in got] == [200_000, 9, 9, 0, 0, 12]
    assert got[1] == got[2] and got[1].edited_sha256 == hashlib.sha256(b"two w").hexdigest()
    assert got[3].to_edited.likeness == got[3].to_next.likeness == 1.0
    assert got[5].edited_sha256 == hashlib.sha256("null iαβγ αβ".encode()).hexdigest()
    assert sketches.edited_likeness(docs.limit(0)).count() == 0
