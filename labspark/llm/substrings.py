"""Repeated word sequences across documents, by suffix subtrees split by prefix.

Not every suffix is kept. A window of 20 words has a sampled suffix: the place in it whose
next five words hash lowest, the anchor. Equal windows choose the same anchor, so equal
windows meet under the anchor's five words, the prefix that splits all suffixes into
groups. Prefixes that occur once end there. Groups of suffixes that stay small form a
subtree each, whose nodes of depth 20 are the repeated windows. Groups that stay large
are split by longer prefixes, of 13, 17, 19 and at last all 20 words, each only where the
one before left a large group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.session import checkpointed

WINDOW = 20
PREFIX = 5
#: A prefix with more distinct surroundings than this is split by a longer one instead of a subtree in memory.
MAX_GROUP = 512
_OFFSETS = WINDOW - PREFIX + 1

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = _U(0xD6E8FEB86659FD93)


@cache
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), from a table of the next power of two."""
    return _powers(base, 1 << max(10, n.bit_length()))[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _MIX
    x = (x ^ (x >> _U(29))) * _MIX
    return x ^ (x >> _U(32))


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and one per PREFIX words in a row."""
    n = len(words)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, n)
    grams = np.zeros(n - PREFIX + 1, _U)
    for i in range(PREFIX):
        grams = grams * _U(_BASE) + codes[i : n - PREFIX + 1 + i]
    return codes, _mixed(grams)


def _anchor(words: list[bytes]) -> int:
    """Where the anchor of a text's first window lies."""
    return int(_grams(words[:WINDOW])[1].argmin())


def anchors(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """(key, surroundings, first window, number of windows) of each anchor of a text.

    The windows of an anchor are consecutive. `surroundings` hashes all words that they
    cover together with the anchor's place in them.
    """
    n = len(words)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    codes, grams = _grams(words)
    starts = np.arange(n - WINDOW + 1)
    owner = starts + sliding_window_view(grams, _OFFSETS).argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    count = np.diff(np.concatenate((first, [len(owner)])))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(codes * _power(_BASE, n), dtype=_U)))
    region = (sums[first + count - 1 + WINDOW] - sums[first]) * _power(_INVERSE, n)[first]
    at = owner[first]
    around = _mixed(region + _U(31) * (at - first).astype(_U) + _U(1 << 20) * count.astype(_U))
    return grams[at].view(np.int64), around.view(np.int64), first, count


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, twin, text); `twin` tells rows of one id apart."""
    twin = F.pmod(F.xxhash64(F.col(text)), F.lit((1 << 31) - 1)).cast("int")
    return docs.select(F.col(doc_id).alias("doc_id"), twin.alias("twin"), F.col(text).alias("text"))


def _split(column: pa.Array) -> list[list[bytes]]:
    """Words of each text. bytes.split() parts at exactly the six characters of the word rule."""
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


def _prefixes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [anchors(words)[0] for words in _split(batch.column(0))]
            keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])

    return docs.select("text").mapInArrow(run, "key long")


def _suffixes(docs: DataFrame, kind: str) -> DataFrame:
    """(key, around, doc_id, twin, span) of every anchor; span is 16 * first window + windows - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(words) for words in _split(batch.column(2))]
            if not found:
                continue
            key, around, first, count = (np.concatenate(x) for x in zip(*found))
            at = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            columns = [pa.array(key), pa.array(around), batch.column(0).take(at), batch.column(1).take(at), pa.array(first * 16 + count - 1)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "around", "doc_id", "twin", "span"])

    return docs.mapInArrow(run, f"key long, around long, doc_id {kind}, twin int, span long")


def _cut_out(texts: DataFrame, kind: str) -> DataFrame:
    """(doc_id, twin, text, found array<struct<key,span,big>>) to one row (key, big, doc_id, twin, span, words) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, big, spans, cuts = [], [], [], [], []
            for row, (words, found) in enumerate(zip(_split(batch.column(2)), batch.column(3).to_pylist())):
                for f in found:
                    first, count = f["span"] >> 4, (f["span"] & 15) + 1
                    at.append(row)
                    keys.append(f["key"])
                    big.append(f["big"])
                    spans.append(f["span"])
                    cuts.append(b" ".join(words[first : first + count - 1 + WINDOW]))
            rows = pa.array(at, pa.int64())
            columns = [pa.array(keys, pa.int64()), pa.array(big, pa.bool_()), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(spans, pa.int64()), pa.array(cuts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "big", "doc_id", "twin", "span", "words"])

    return texts.mapInArrow(run, f"key long, big boolean, doc_id {kind}, twin int, span long, words binary")


def _windows(words: bytes, count: int) -> Iterable[tuple[int, bytes]]:
    parts = words.split(b" ")
    return ((j, b" ".join(parts[j : j + WINDOW])) for j in range(count))


def subtree_marks(group: list[dict]) -> list[tuple[dict, int]]:
    """The rows of one prefix with the set of their windows that also start earlier, as bits.

    Suffixes from each window's start are sorted, so the leaves below a node of depth
    WINDOW lie side by side; all but the earliest leaf are marked.
    """
    suffixes = []
    for i, row in enumerate(group):
        place = (row["doc_id"] is None, row["doc_id"] or 0, row["twin"], row["span"] >> 4)
        suffixes += [(path, place[:3] + (place[3] + j,), i, j) for j, path in _windows(row["words"], (row["span"] & 15) + 1)]
    suffixes.sort()
    marks = [0] * len(group)
    node = earliest = None
    for path, place, i, j in suffixes:
        if path != node:
            node, earliest = path, place
        elif place != earliest:
            marks[i] |= 1 << j
    return [(row, mark) for row, mark in zip(group, marks) if mark]


def _subtrees(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, twin, span, mask) from rows that lie sorted by key, one group of suffixes in memory at a time."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds = None

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "twin", "span", "mask"])

        def seen(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal kinds
            for batch in source:
                kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int32()]
                yield batch

        for _, group in groupby(entries(seen(batches)), key=lambda r: r["key"]):
            out += [(r["doc_id"], r["twin"], r["span"], mask) for r, mask in subtree_marks(list(group))]
            if len(out) > 5_000:
                yield made()
        if out:
            yield made()

    sorted_rows = rows.repartition("key").sortWithinPartitions("key")
    return sorted_rows.mapInArrow(run, f"doc_id {kind}, twin int, span long, mask int")


def _refined(rows: DataFrame, kind: str, width: int) -> DataFrame:
    """(key, around, doc_id, twin, span, words): rows (doc_id, twin, span, words) under longer prefixes.

    The windows of a row are parted by where the anchor lies in them, in turns of `width`
    places. All windows of a part share WINDOW - width + 1 words around the anchor; they are
    the part's key. `around` stands for all the words that the part covers.
    """

    def parts(words: list[bytes], count: int) -> Iterator[tuple[bytes, bytes, int, int]]:
        at = _anchor(words)
        for turn in range((at - count + 1) // width, at // width + 1):
            low, high = turn * width, turn * width + width - 1
            first, last = max(0, at - high), min(count - 1, at - low)
            core = b" ".join(words[at - low : at - high + WINDOW])
            yield b"%d %d " % (width, turn) + core, b" ".join(words[first : last + WINDOW]), first, last - first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, around, spans, cuts = [], [], [], [], []
            for row, (span, joined) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                for core, region, first, more in parts(joined.split(b" "), (span & 15) + 1):
                    at.append(row)
                    keys.append(xxhash.xxh64_intdigest(core) - (1 << 63))
                    around.append(xxhash.xxh3_128_digest(region))
                    spans.append(((span >> 4) + first) * 16 + more)
                    cuts.append(region)
            rows_at = pa.array(at, pa.int64())
            columns = [pa.array(keys, pa.int64()), pa.array(around, pa.binary()), batch.column(0).take(rows_at), batch.column(1).take(rows_at), pa.array(spans, pa.int64()), pa.array(cuts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "around", "doc_id", "twin", "span", "words"])

    return rows.select("doc_id", "twin", "span", "words").mapInArrow(run, f"key long, around binary, doc_id {kind}, twin int, span long, words binary")


def _copies(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, twin, span, mask): all windows of the rows that equal an earlier row of their class."""
    repeated = classes.filter("n > 1").select("key", "around", "first")
    return (
        rows.join(repeated, ["key", "around"])
        .filter(_place(F.col("span")) != F.col("first"))
        .select("doc_id", "twin", "span", F.expr("shiftleft(2, cast(span & 15 as int)) - 1").cast("int").alias("mask"))
    )


def _split_further(rows: DataFrame, kind: str, max_group: int) -> list[DataFrame]:
    """Marks of the windows of large groups: prefixes grow from level to level where a group is still large.

    At each level rows that cover the same words are folded to the earliest. At the last
    one the prefix is the whole window, which leaves one row per group.
    """
    marks, width = [], _OFFSETS // 2
    while width and not rows.isEmpty():
        split = checkpointed(_refined(rows, kind, width))
        classes = checkpointed(
            split.groupBy("key", "around").agg(F.min(_place(F.col("span"))).alias("first"), F.count("*").alias("n"), F.first("words").alias("words"))
        )
        sizes = classes.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        told = checkpointed(
            classes.join(sizes.hint("merge"), "key").select("key", "first.doc_id", "first.twin", F.col("first.start").alias("span"), "words", (F.col("size") > max_group).alias("big"))
        )
        marks += [_copies(split, classes), _subtrees(told.filter("not big").drop("big"), kind)]
        rows, width = told.filter("big"), width // 2
    return marks


def _place(start: Column) -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "twin", start.alias("start"))


def repeats(rows: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, twin, span, mask): for `rows` (doc_id, twin, text) the windows that also start earlier.

    A row stands for consecutive windows; bit j of the mask tells of the window j words
    after the first. Equal surroundings are folded first, so a passage that many
    documents share enters a subtree once.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = _prefixes(rows).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    more = checkpointed(more)  # as a table, so that the join can split a hot prefix
    met = checkpointed(_suffixes(rows, kind).join(more, "key", "left_semi"))
    classes = checkpointed(met.groupBy("key", "around").agg(F.min(_place(F.col("span"))).alias("first"), F.count("*").alias("n")))
    sizes = classes.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    told = classes.join(sizes, "key").select(
        F.col("first.doc_id").alias("d"), F.col("first.twin").alias("t"),
        F.struct("key", F.col("first.start").alias("span"), (F.col("size") > max_group).alias("big")).alias("f"),
    )
    wanted = told.groupBy("d", "t").agg(F.collect_list("f").alias("found"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("twin").eqNullSafe(F.col("t"))
    texts = rows.join(wanted, same).select("doc_id", "twin", "text", "found")
    cuts = checkpointed(_cut_out(texts, kind))
    small = _subtrees(cuts.filter("not big").select("key", "doc_id", "twin", "span", "words"), kind)
    return reduce(DataFrame.unionByName, [_copies(met, classes), small, *_split_further(cuts.filter("big"), kind, max_group)])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): each text without the words of windows that also start earlier.

    Earlier means a smaller doc_id (null last), or the same document and an earlier
    start. Windows are judged on the texts as they are. Rows equal in id and text are one
    document and get the same result; rows of one id with different texts are ordered by
    a hash. Null texts have no words; an empty table gives no rows.
    """
    rows = _rows(docs, doc_id, text)
    marks = repeats(rows, max_group).withColumnsRenamed({"doc_id": "d", "twin": "t"})
    lists = marks.groupBy("d", "t").agg(F.collect_list(F.struct(F.shiftright("span", 4).alias("first"), "mask")).alias("marks"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("twin").eqNullSafe(F.col("t"))
    joined = rows.join(lists, same, "left").select("doc_id", "text", F.col("marks.first").alias("first"), F.col("marks.mask").alias("mask"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(_OFFSETS)
        for batch in batches:
            sizes, gone, kept = [], [], []
            for words, first, mask in zip(_split(batch.column(1)), batch.column(2), batch.column(3)):
                n = len(words)
                if first.is_valid:
                    firsts, masks = first.values.to_numpy(), mask.values.to_numpy()
                    hit, j = np.nonzero(masks[:, None] >> bits & 1)
                    begin = firsts[hit] + j
                    edges = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(begin + WINDOW, minlength=n + 1)[: n + 1]
                    covered = np.cumsum(edges)[:n] > 0
                    words = [words[i] for i in np.flatnonzero(~covered).tolist()]
                sizes.append(n)
                gone.append(n - len(words))
                kept.append(b" ".join(words).decode())
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
