from hashlib import sha256

from labspark.llm import licenses
from labspark.llm.license_texts import KNOWN, _MIT
from labspark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_query_finds_notice_lines(spark):
    docs = brute.documents(SF)
    notices = {"licensed under cc by nc 4 0": "CC-BY-NC-4.0", "licensed under the apache license version 2 0": "Apache-2.0",
               "released under the mit license": "MIT", "this work is licensed under the gnu general public license version 3": "GPL-3.0"}
    got = QUERIES["op8_license_digests"](spark, SF).toPandas().sort_values("doc_id", ignore_index=True)
    assert got.doc_id.tolist() == docs.doc_id.tolist()
    for row, text in zip(got.itertuples(), docs.text):
        plain = [" ".join("".join(c if c.isalnum() else " " for c in line.lower()).split()) for line in text.split("\n")]
        found = [notices[p] for p in plain if p in notices]
        assert row.n_notices == len(found) and row.notices == ",".join(sorted(set(found)))
    assert got.n_notices.sum() > 0


def rewritten(text):
    """Other case, wrapping, punctuation and spelling, and somebody's copyright."""
    text = text.replace("license", "licence").replace("MERCHANTABILITY", "Merchantability").replace("sublicense", "sub-license")
    words = text.replace('"', "''").replace(",", " ,").split()
    lines = [" * " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
    return "\n".join(["/*", " * Copyright (c) 2019-2023, Jane Doe and others.  All rights reserved.", "© 2001 Someone", *lines, " */"])


def test_whole_texts_in_other_dress(spark):
    rows = [(i, rewritten(t)) for i, (_, t) in enumerate(KNOWN)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    for i, (name, _) in enumerate(KNOWN):
        assert got[i] == name, KNOWN[i]


def test_a_changed_word_is_no_match(spark):
    docs = spark.createDataFrame([(1, _MIT.replace("free of charge", "for a fee")), (2, _MIT)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_digests(spark)).collect()}
    assert got == {1: None, 2: "MIT"}


def test_own_licences_nulls_ties_and_clashing_columns(spark):
    own = spark.createDataFrame([("own", "My own licence!"), ("second", "my own license"), ("void", "  "), ("null", None)], "license_id string, text string")
    known = licenses.known_digests(spark, own)
    assert known.collect() == [(sha256(b"my own license").hexdigest(), "own")] or known.count() == 1
    rows = [(None, "MY OWN LICENSE", 1), (1, None, 2), (2, "", 3), (3, "x\nMy-own-license\nmy own licence.", 4), (3, "x\nMy-own-license\nmy own licence.", 4),
            (4, "Copyright (c) 2020 A\n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = sorted(((r.doc_id, r.license_id, r.n_notices, r.notices, r.digest is None) for r in licenses.scan(docs, known).collect()), key=str)
    want = [(None, "own", 1, ["own"], False), (1, None, 0, [], True), (2, None, 0, [], True), (3, None, 2, ["own"], False), (3, None, 2, ["own"], False),
            (4, None, 0, [], True)]
    assert got == sorted(want, key=str)
    assert licenses.scan(docs.limit(0), known).count() == 0


def test_long_texts_and_spdx_lines(spark):
    """Entire texts with their copyright lines, and identifiers of which only some were known."""
    whole = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    texts = [f"Copyright (C) 2007 Somebody\n\n{t}" for name in whole for n, t in KNOWN if n == name and len(t) > 5_000]
    lines = {"GPL-2.0-only": "GPL-2.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-or-later": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "Zlib": "Zlib",
             "CC-BY-4.0": "CC-BY-4.0", "AGPL-3.0-only": "AGPL-3.0"}
    rows = list(enumerate(texts + [f"x = 1\n# SPDX-License-Identifier: {line}" for line in lines]))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_digests(spark))
    got = {r.doc_id: r.license_id or r.notices[0] for r in found.collect()}
    assert [got[i] for i in range(len(rows))] == whole + list(lines.values())
