import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labspark.llm import quality
from tests.llm import brute
from tests.llm.test_lines import brute_dedup
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import reference_ids

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage returned, the documents first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return [d.sort_values(["doc_id", "start"] if "start" in d else "doc_id", ignore_index=True) for d in out]


def test_quality_stage(spark, steps):
    """A plain vote over all learnt labels, one document after the other."""
    docs, kept = steps[0], steps[1]
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    labels = labels[[zlib.crc32(str(d).encode()) % 5 != 0 for d in labels.doc_id]]
    model = quality.fit(spark.createDataFrame(docs), spark.createDataFrame(labels))
    want = []
    for row in docs.itertuples():
        vector = model.latent(quality.terms((row.text or "").encode())[None])[0]
        near = sorted(((float(vector @ v), y) for v, y in zip(model.vectors, model.labels)), key=lambda x: -x[0])[: model.neighbours]
        weights = [max(s, 0) ** 8 for s, _ in near]
        score = sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights) if sum(weights) > 1e-9 else model.labels.mean()
        if score >= 0.3:
            want.append(row.doc_id)
    assert kept.doc_id.tolist() == want and list(kept.columns) == COLUMNS


def test_line_stage(steps):
    want = brute_dedup(list(zip(steps[1].doc_id.tolist(), steps[1].text)))
    assert list(zip(steps[2].doc_id, steps[2].text)) == [(k, t) for k, _, _, t in want]
    assert (steps[2].n_chars == steps[2].text.str.len()).all() and list(steps[2].columns) == COLUMNS


def test_near_duplicate_stage(steps):
    groups = brute.simhash_groups(list(zip(steps[2].doc_id.tolist(), steps[2].text)))
    assert steps[3].doc_id.tolist() == sorted({g for _, _, g in groups}) and list(steps[3].columns) == COLUMNS


def test_mix_stage(steps):
    before, after = steps[3].copy(), steps[4].copy()
    for d in (before, after):
        d["size"] = [len(brute.WORDS.findall(t)) for t in d.text]
    assert after.doc_id.value_counts().max() <= 2 and set(after.doc_id) <= set(before.doc_id)
    for source, target in brute_targets(before.groupby("source")["size"].sum().to_dict()).items():
        taken = after[after.source == source]["size"].sum()
        assert abs(taken - target) <= before[before.source == source]["size"].max() / 2 + 1e-6


def test_pack_stage(steps):
    docs, got = steps[4].drop_duplicates("doc_id"), steps[5]
    copies = steps[4].doc_id.value_counts()
    for key, ids in zip(docs.doc_id, reference_ids(docs.text)):
        mine = got[got.doc_id == key]
        assert mine.length.sum() == copies[key] * len(ids)
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4"))
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 2048


def test_run_gives_the_stages_rows(spark, steps):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got.groupby("doc_id").length.sum().equals(steps[5].groupby("doc_id").length.sum())


def test_stages_take_nulls_repeats_extra_columns_and_empty_tables(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", "en", None, 0), (7, "", "en", None, 0)], base.schema)
    docs = base.union(odd).withColumn("fp", F.lit(1)).withColumn("start", F.lit("x"))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, SF), stage(spark, empty, SF)
        assert docs.count() > 0 and empty.count() == 0
