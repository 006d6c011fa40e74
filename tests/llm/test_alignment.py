"""Groups, links and counts against plain loops; fragments as a monoid; ranges of long texts; corner cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labspark.llm import alignment
from labspark.llm.queries import QUERIES
from tests.llm import brute

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
# The public byte-to-character table of byte-level BPE.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PLAIN)}


def spans(pieces):
    out, at = [], 0
    for i, data in pieces:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def tokenized(text):
    if not text:
        return [], []
    want = (" " + text).encode()
    a = [(i, bytes(BYTE[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    return (spans(a), spans(b)) if b"".join(d for _, d in a) == b"".join(d for _, d in b) == want else ([], [])


def groups_of(a, b):
    common = {e for *_, e in a} & {e for *_, e in b}
    sides = []
    for side in (a, b):
        runs = [[]]
        for i, _, e in side:
            runs[-1].append(str(i))
            if e in common:
                runs.append([])
        sides.append([",".join(run) for run in runs[:-1]])
    return ["|".join(pair) for pair in zip(*sides)]


def links_of(a, b):
    out, k = [], 0
    for i, s, e in a:
        while k and b[k - 1][2] > s:
            k -= 1
        while k < len(b) and b[k][1] < e:
            if b[k][2] > s:
                out.append((i, b[k][0]))
            k += 1
    return out


def plain(docs):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per document."""
    rows = [(key, *tokenized(text)) for key, text in docs]
    linked = [links_of(a, b) for _, a, b in rows]
    counts = Counter(p for links in linked for p in set(links))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (key, a, b), links in zip(rows, linked):
        groups = groups_of(a, b)
        best = sum(counts[p] == most[p[0]] for p in links)
        out.append((key, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), ";".join(groups)))
    return sorted(out, key=str)


def aligned(spark, docs, **options):
    got = alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), **options)
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    frame = brute.documents(folder)
    want = plain(list(zip(frame.doc_id.tolist(), frame.text)))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r) for r in QUERIES["op11_token_alignment"](spark, folder).select(*names).collect()), key=str)
    assert got == [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want]


def texts():
    draw = random.Random(11)
    some = ["the Überfluß", "naïve  café", "日本語のテキスト", "don't <s> <|endoftext|> </s>", "tab\tand\nline", " lead", "trail ", "a" * 300, "emoji 🙂🙂 end", "x　y   z", "<0x41>"]
    return [(i, " ".join(draw.choices(some, k=draw.randrange(1, 30)))) for i in range(12)]


def test_ranges_and_rare_pairs_change_nothing(spark):
    docs = texts()
    want = plain(docs)
    assert aligned(spark, docs) == want
    assert aligned(spark, docs, size=64, fanout=2, most_sent=20) == want
    assert aligned(spark, docs, size=400, fanout=3, most_sent=0) == want


def test_nulls_repeats_other_bytes_and_very_long_texts(spark):
    long_text = "word " * 60_000 + "Ünbroken" * 9_000 + " end"
    docs = [(None, "one two"), (1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (5, "a▁b"), (6, "▁" * 40_000), (7, "a\0b"), (8, long_text), (9, "\n")]
    got = aligned(spark, docs)
    assert got == plain(docs)
    assert [r[1] for r in got if r[0] in (1, 2, 5, 6)] == [0] * 4


def test_empty_table_and_clashing_columns(spark):
    assert aligned(spark, []) == []
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    for name in ["row", "part", "n_a", "groups", "pairs", "pair", "n", "best", "rest", "low"]:
        docs = docs.withColumn(name, F.lit("x"))
    assert [tuple(r) for r in alignment.align(docs).collect()] == plain([(1, "one two")])


ends = st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.lists(st.integers(0, 62), max_size=6), st.data())
def test_fragments_are_a_monoid(a_ends, b_ends, cuts, data):
    last = max(a_ends[-1], b_ends[-1])
    a_ends, b_ends = sorted({*a_ends, last}), sorted({*b_ends, last})
    tokens = alignment.Tokens(np.arange(len(a_ends)) % 5, np.array(a_ends), np.arange(len(b_ends)) % 7, np.array(b_ends))
    edges = [0, *sorted(cuts), 70]
    parts = [alignment.fragment(tokens.between(low, high)) for low, high in zip(edges, edges[1:])]
    while len(parts) > 1:  # in any order of neighbours
        at = data.draw(st.integers(0, len(parts) - 2))
        parts[at : at + 2] = [alignment.compose(parts[at], parts[at + 1])]
    whole, want = alignment.finished(parts[0]), alignment.closed(tokens)
    assert (whole.groups, whole.n_a, whole.n_b, whole.n_groups) == (want.groups, want.n_a, want.n_b, want.n_groups)
    assert whole.pairs.tolist() == want.pairs.tolist() and whole.times.tolist() == want.times.tolist()
    assert not len(whole.tail.a) and not len(whole.head.a)
    for both in (alignment.compose(alignment.EMPTY, parts[0]), alignment.compose(parts[0], alignment.EMPTY)):
        assert alignment._stored(both) == alignment._stored(parts[0])
