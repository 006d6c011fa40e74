"""The manifest against a plain tree, its proofs, and its corner cases."""

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from labspark.llm import merkle
from labspark.llm.queries import QUERIES

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple) -> str:
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def grow(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """Root, and per leaf the levels (place in the run, whole run)."""
    proofs = [[] for _ in nodes]
    held = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for i, below in enumerate(held):
            for j in below:
                proofs[j].append((i % fanout, runs[i // fanout]))
        held = [sum(held[i : i + fanout], []) for i in range(0, len(held), fanout)]
        nodes = [digest(*run) for run in runs]
    return nodes[0], proofs


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows: list[tuple], fanout: int = 8) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        members = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((members, *grow([leaf(r) for r in members], fanout)))
    root, above = grow([t[1] for t in trees], fanout)
    out = []
    for (members, subroot, proofs), upper in zip(trees, above):
        for row, proof in zip(members, proofs):
            proof = proof + upper
            others = [run[i] for at, run in proof for i in range(len(run)) if i != at]
            altered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            node = leaf((*row[:4], lowered(row[4]))) if altered else leaf(row)
            for at, run in proof:
                node = digest(*run[:at], node, *run[at + 1 :])
            out.append((row[0], leaf(row), subroot, root, digest(*others), node, node == root))
    return sorted(out, key=str)


def shown(spark, docs, fanout=8, levels=merkle.LEVELS):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    presented = F.when(altered, merkle.leaf(COLUMNS, {"text": lower})).otherwise(merkle.leaf(COLUMNS))
    got = merkle.manifest(docs, COLUMNS, "lang", presented=presented, fanout=fanout, levels=levels)
    back = merkle.folded(F.col("presented"), F.col("proof"))
    rows = got.select("doc_id", "leaf", "subroot", "root", merkle.joined_digest(merkle.siblings(F.col("proof"))), back, back == F.col("root")).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_plain_tree(spark):
    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select {', '.join(COLUMNS)} from '{folder}/documents.parquet'").fetchall()
    got = QUERIES["op13_merkle_manifest"](spark, folder)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == brute(rows)


def test_rounds_of_ragged_trees(spark):
    counts = [1, 2, 3, 7, 8, 9, 26, 27, 28, 64, 65, 82, 100, 244]
    rows = [(1000 * g + i * 7 % 1000, "s", f"l{g}", i, f"Text {i}") for g, n in enumerate(counts) for i in range(n)]
    assert shown(spark, spark.createDataFrame(rows, SCHEMA), fanout=3, levels=1) == brute(rows, 3)


def test_many_groups(spark):
    rows = [(i, "s", f"lang{i // 2}", 1, "T") for i in range(60)]
    assert shown(spark, spark.createDataFrame(rows, SCHEMA), fanout=2, levels=2) == brute(rows, 2)


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long_text = "Ab\né" * 400_000
    rows = [(None, None, None, None, None), (3, "s", None, 0, ""), (3, "s", None, 0, ""), (3, "t", "en", 4, "A"), (3, "s", "en", 4, "B"),
            (None, "s", "en", 1, "X"), (7, "s", "", 1, long_text), (8, "é", "ü", 2, "Z" * 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ["leaf", "root", "proof", "pos", "tree", "group", "at", "n", "block", "payload", "presented"]:
        docs = docs.withColumn(name, F.lit(1))
    assert shown(spark, docs) == brute(rows)


def test_empty_table(spark):
    assert shown(spark, spark.createDataFrame([], SCHEMA)) == []


def test_proofs_fail_for_any_other_leaf(spark):
    rows = [(i, "s", "a", i, f"Text {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wrong = merkle.manifest(docs, COLUMNS, "lang", presented=merkle.leaf(COLUMNS, {"n_chars": F.col("n_chars") + 1}))
    assert wrong.filter(merkle.folded(F.col("presented"), F.col("proof")) == F.col("root")).count() == 0
    assert wrong.filter(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 20
