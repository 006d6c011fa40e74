import zlib

import numpy as np
import pandas as pd
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from labspark.llm import packing
from labspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def reference_ids(texts):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [1] for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(docs, got):
    """Every id in one piece, right checksums, gapless sequences, next to no padding."""
    for key, ids in zip(docs.doc_id, reference_ids(docs.text)):
        mine = got[got.doc_id == key].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
        assert mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4"))
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        assert rows.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


def test_query(spark):
    check(brute.documents(SF), QUERIES["op7_pack_sequences"](spark, SF).toPandas())


def test_many_groups_keep_sequences_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 100_000)
    got = packing.pack(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 2048


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2047), min_size=1, max_size=60))
def test_balance_places_every_token_once(lengths):
    lengths = np.sort(np.array(lengths))[::-1]
    placed = packing.balance(lengths)
    load = {}
    for piece in range(len(lengths)):
        parts = sorted(p[1:] for p in placed if p[0] == piece)
        assert sum(p[1] for p in parts) == lengths[piece]
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1].tolist()]
        for _, size, at in parts:
            load[at] = load.get(at, 0) + size
    assert max(load.values()) <= 2048 and len(load) <= -(-lengths.sum() // 2048)


def test_costs_are_balanced():
    """One long piece and many short ones: long pieces do not meet while others stay cheap."""
    placed = packing.balance(np.array([1000] * 4 + [50] * 80))
    assert len({p[3] for p in placed[:4]}) == 4


def test_nulls_ties_empties_and_clashing_columns(spark):
    rows = [(None, None, 1), (1, "", 2), (2, "same words", 3), (2, "same words", 3), (3, "a" * 40_000 + " " * 9_000 + "é" * 5_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs).toPandas()
    assert got[got.doc_id.isna()].length.tolist() == [1] and len(got[got.doc_id == 2]) == 2
    long = brute.pd.DataFrame({"doc_id": [3], "text": [rows[4][1]]})
    ids = reference_ids(long.text)[0]
    assert got[got.doc_id == 3].length.sum() == len(ids)
    huge = spark.createDataFrame([(None, "a"), (2**62 + 1, "b")], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(huge).collect()} == {None, 2**62 + 1}
    assert packing.pack(docs.limit(0)).count() == 0


def test_strings_of_added_tokens_are_their_ids(spark):
    docs = pd.DataFrame({"doc_id": [1, 2], "text": ["a <|endoftext|> b", "plain"]})
    got = packing.pack(spark.createDataFrame(docs)).toPandas()
    check(docs, got)
    ids = np.array([64, 220, 50256, 275, 1], "<u4")
    assert got[got.doc_id == 1].ids_crc32.tolist() == [zlib.crc32(ids)]
