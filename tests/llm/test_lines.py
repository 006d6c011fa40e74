import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from labspark.llm import lines
from labspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[ \t\r]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_dedup(docs, threshold=1):
    """docs: (doc_id, text); every id once. Returns (doc_id, lines, removed, kept text).

    Lines that are not blank count whatever their length; edits link those of five words and more.
    """
    seen = {}
    for key, text in docs:
        for pos, line in enumerate((text or "").lower().split("\n")):
            line = SPLIT.sub(" ", line.strip(" \t\r"))
            if line:
                seen.setdefault(line, []).append((key, pos))
    names = list(seen)
    words = [n.split(" ") for n in names]
    long = [i for i, w in enumerate(words) if len(w) >= 5]
    near = [(i, j) for n, i in enumerate(long) for j in long[:n] if abs(len(words[i]) - len(words[j])) <= threshold
            and len(set(words[i]) ^ set(words[j])) <= 2 * threshold and distance(words[i], words[j]) <= threshold]
    root, first, gone = brute.roots(len(names), near), {}, set()
    for i, n in enumerate(names):
        first[root[i]] = min([first.get(root[i], seen[n][0]), *seen[n]])
    for i, n in enumerate(names):
        gone |= {at for at in seen[n] if at != first[root[i]]}
    out = []
    for key, text in docs:
        if text is None:
            out.append((key, 0, 0, None))
            continue
        all_lines = text.split("\n")
        kept = [x for pos, x in enumerate(all_lines) if (key, pos) not in gone]
        out.append((key, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def shown(df):
    return sorted(tuple(r) for r in df.select("doc_id", "_llm_lines", "_llm_removed", "text").collect())


def test_query_equals_brute_force(spark):
    docs = brute.documents(SF)
    want = [(k, n, r, hashlib.sha256(t.encode()).hexdigest()) for k, n, r, t in brute_dedup(list(zip(docs.doc_id.tolist(), docs.text)))]
    assert sorted(map(tuple, QUERIES["op2_line_dedup"](spark, SF).collect())) == want


@pytest.mark.parametrize("threshold,bucket", [(1, 48), (1, 2), (2, 48), (3, 48)])
def test_edited_lines(spark, threshold, bucket):
    """Lines edited at random; with buckets of two nearly all are linked through variants."""
    pick, vocabulary = random.Random(threshold), [f"w{i}" for i in range(9)]
    texts = []
    for _ in range(8):
        line = [pick.choice(vocabulary) for _ in range(pick.randint(5, 12))]
        for _ in range(12):
            other = list(line)
            for _ in range(pick.randint(0, 3)):
                at, kind = pick.randrange(len(other)), pick.randrange(3)
                other[at : at + (kind > 0)] = [pick.choice(vocabulary)] if kind < 2 else []
            texts.append(" ".join(other))
    pick.shuffle(texts)
    docs = [(i, "\n".join(texts[i * 4 : i * 4 + 4])) for i in range(len(texts) // 4)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert shown(lines.without_repeats(frame, threshold=threshold, max_bucket=bucket)) == brute_dedup(docs, threshold)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    pick = random.Random(5)
    rows = []
    for _ in range(300):
        a = [pick.choice("abc") for _ in range(pick.randint(0, 9))]
        b = list(a) if pick.random() < 0.7 else [pick.choice("abc") for _ in range(pick.randint(0, 9))]
        for _ in range(pick.randint(0, 4)):
            at = pick.randint(0, len(b))
            b[at : at + pick.randint(0, 1)] = [pick.choice("abc")] * pick.randint(0, 1)
        rows.append((a, b))
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = frame.withColumn("near", lines.within(F.col("a"), F.col("b"), threshold)).collect()
    assert [r.near for r in got] == [distance(r.a, r.b) <= threshold for r in got]


def test_nulls_ties_empties_and_clashing_columns(spark):
    same = "one two three four five six"
    rows = [(None, f"{same}\nshort line", 1), (1, None, 2), (2, "", 3), (3, f"{same}\n\n{same.upper()} \nshort line", 4), (3, f"{same}\n\n{same.upper()} \nshort line", 4), (4, same.replace("two", "2"), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line int")
    got = sorted((tuple(r) for r in lines.without_repeats(docs).collect()), key=str)
    assert got == sorted([(None, "", 1, 2, 2), (1, None, 2, 0, 0), (2, "", 3, 1, 0), (3, f"{same}\n\nshort line", 4, 4, 1),
                          (3, f"{same}\n\nshort line", 4, 4, 1), (4, "", 5, 1, 1)], key=str)
    assert lines.without_repeats(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000), (2, "word " * 200_000)], "doc_id long, text string")
    assert [r._llm_removed for r in lines.without_repeats(long).orderBy("doc_id").collect()] == [0, 1]
