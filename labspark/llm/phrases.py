"""Benchmark passages in training documents, by a positional inverted index.

Windows of benchmark items are looked up by their two rarest terms: the index holds the
postings (term, document, positions) of those terms alone, and a window can only begin
where the two position lists meet once each is moved by the term's place in the window.
What meets is compared word by word. Other terms, however frequent, are never stored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import content
from labspark.session import MAX_BROADCAST_BYTES, bounded, checkpointed

WINDOW = 10
#: Bits of the filter that tells which terms are asked for. It has a fixed size; what passes by chance is dropped by joins.
FILTER_BITS = 1 << 23
#: Term counts that a task holds before it hands them on.
HELD = 1 << 20

# A word: a run of bytes other than these, A-Z being lower-cased first.
_APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_APART + bytes(range(0x41, 0x5B)), b" " * len(_APART) + bytes(range(0x61, 0x7B)))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _terms(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _phrase(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def windows(items: DataFrame, item_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """(item_id, phrase, size, terms) of every window; `phrase` is a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, phrases, sizes, terms = [], [], [], []
            for row, value in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(value)
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    cut = words[i : i + size]
                    at.append(row)
                    phrases.append(_phrase(cut))
                    sizes.append(len(cut))
                    terms.append(_terms(cut))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(phrases, pa.binary()), pa.array(sizes, pa.int32()), pa.array(terms, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "phrase", "size", "terms"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"item_id {kind}, phrase binary, size int, terms array<long>")


def _asked(terms: DataFrame) -> np.ndarray:
    """The bit filter of a column `term`; its size does not depend on the terms."""
    bit = F.pmod("term", F.lit(FILTER_BITS))
    rows = terms.select(F.shiftright(bit, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(pmod(term, {FILTER_BITS}) & 63 as int))").alias("bit"))
    held = rows.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 6, np.int64)
    out[held.column("slot").to_numpy()] = held.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _passes(asked: np.ndarray, terms: np.ndarray) -> np.ndarray:
    return asked[terms & (FILTER_BITS - 1)]


def _frequencies(texts: DataFrame, asked: np.ndarray) -> DataFrame:
    """(term, n): how often the terms that pass the filter occur in a column `text`."""
    sent = texts.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, held = [], [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            term, at = np.unique(np.concatenate(kept), return_inverse=True)
            return term, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        def made(term: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], ["term", "n"])

        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for value in batch.column(0).cast(pa.binary()).to_pylist():
                terms = _terms(words_of(value))
                found.append(terms[_passes(sent.value, terms)])
            term, n = np.unique(np.concatenate(found), return_counts=True)
            kept.append(term)
            counts.append(n)
            held += len(term)
            if held > HELD:
                term, n = folded()
                kept, counts, held = [term], [n], len(term)
                if held > HELD // 2:
                    yield made(term, n)
                    kept, counts, held = [], [], 0
        if kept:
            yield made(*folded())

    return texts.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _indexed(rows: DataFrame, asked: np.ndarray) -> DataFrame:
    """(doc_id, content, n_words, postings): per document the positions of the terms that pass the filter."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, terms, ends, places, total = [], [0], [], [np.zeros(1, np.int64)], [], 0
            for value in batch.column(2).cast(pa.binary()).to_pylist():
                every = _terms(words_of(value))
                sizes.append(len(every))
                at = np.flatnonzero(_passes(sent.value, every))
                at = at[np.argsort(every[at], kind="stable")]
                found, first = np.unique(every[at], return_index=True)
                counts.append(counts[-1] + len(found))
                terms.append(found)
                ends.append(total + np.append(first, len(at))[1:] if len(found) else np.zeros(0, np.int64))
                places.append(at)
                total += len(at)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *places]), pa.int32()))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *terms]), pa.int64()), lists], ["term", "places"])
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "n_words", "postings"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, content long, n_words long, postings array<struct<term:long,places:array<int>>>")


def _probes(known: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, size, t1, p1, t2, p2, probe): the two rarest terms of each window and their places; windows with an absent term go."""
    each = known.select("phrase", "size", F.posexplode("terms").alias("p", "term"))
    ranked = each.join(counts, "term").groupBy("phrase", "size").agg(F.sort_array(F.collect_list(F.struct("n", "term", "p"))).alias("terms"))
    whole = ranked.filter(F.size("terms") == F.col("size"))
    first, second = F.get("terms", F.lit(0)), F.get("terms", F.lit(1))
    rows = whole.select("phrase", "size", first["term"].alias("t1"), first["p"].alias("p1"), second["term"].alias("t2"), second["p"].alias("p2"))
    return rows.withColumn("probe", F.xxhash64("t1", "t2", F.col("p2") - F.col("p1")))


def _met(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, content, probe, rare, other): documents that hold both terms of a probe, with both position lists.

    Both lists are counted from the rarer term's place. Rows repeated with their id meet here and count once.
    """
    pairs = probes.select("probe", "t1", "t2", (F.col("p2") - F.col("p1")).alias("gap")).distinct()
    one = pairs.select(F.col("t1").alias("term"), "probe", F.lit(0).alias("gap"), F.lit(True).alias("rarest"))
    two = pairs.select(F.coalesce("t2", "t1").alias("term"), "probe", F.coalesce("gap", F.lit(0)).alias("gap"), F.lit(False).alias("rarest"))
    asked = postings.join(bounded(one.unionByName(two)), "term")
    moved = F.transform("places", lambda p: p - F.col("gap"))
    return (
        asked.select("doc_id", "content", "probe", "rarest", moved.alias("places"))
        .groupBy("doc_id", "content", "probe")
        .agg(F.max(F.when(F.col("rarest"), F.col("places"))).alias("rare"), F.max(F.when(~F.col("rarest"), F.col("places"))).alias("other"))
        .filter("rare is not null and other is not null")
    )


def phrase_at(words: list[bytes], phrase: bytes, size: int, begins: list[int], wanted: list[bytes] | None) -> list[int]:
    """The places of `begins` where the words of the phrase stand side by side."""
    return [b for b in begins if 0 <= b <= len(words) - size and _phrase(words[b : b + size]) == phrase]


def near_at(slack: int) -> Callable:
    """Places where all words of a window stand, in any order, within its size and `slack` words more."""

    def check(words: list[bytes], phrase: bytes, size: int, begins: list[int], wanted: list[int] | None) -> list[int]:
        need, span = Counter(wanted), size + slack
        lowest = {b for at in begins for b in range(max(0, at - span + 1), max(0, min(at, len(words) - span)) + 1)}
        terms = _terms(words).tolist()
        return [b for b in sorted(lowest) if not need - Counter(terms[b : b + span])]

    return check


def _verified(found: DataFrame, check: Callable, schema: str) -> DataFrame:
    """(doc_id, content, text, asked) to (doc_id, content, found): the asked places that pass the check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, asked in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = words_of(value)
                rows = [(a["phrase"], a["size"], check(words, a["phrase"], a["size"], a["begins"], a["terms"])) for a in asked]
                out.append([{"phrase": p, "size": n, "begins": b} for p, n, b in rows if b])
            kind = pa.list_(pa.struct([("phrase", pa.binary()), ("size", pa.int32()), ("begins", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "content", "found"])

    return found.mapInArrow(run, schema)


def _candidates(rows: DataFrame, asked: np.ndarray) -> DataFrame:
    """The rows whose `content` passes the filter: texts of other documents are not shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passes(sent.value, batch.column("content").to_numpy())))

    return rows.mapInArrow(run, rows.schema)


def _sent(asked: DataFrame) -> DataFrame:
    """`asked` broadcast if its rows and lists are within MAX_BROADCAST_BYTES by count, before any row is fetched; else joined by shuffle."""
    size = F.aggregate("asked", F.lit(32).cast("long"), lambda n, a: n + 64 + 4 * F.size(a["begins"]) + 8 * F.coalesce(F.size(a["terms"]), F.lit(0)))
    held = asked.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(asked) if held <= MAX_BROADCAST_BYTES else asked.hint("merge")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, slack: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of `items` in `docs`: (documents, matches, windows).

    documents: (doc_id, content, n_words) of every row. matches: (doc_id, content, phrase,
    size, begins), one row per document and window that occurs in it, with every place.
    windows: distinct (phrase, item_id). Without `slack` a match is the exact phrase; with
    it, all words of the window in any order within size + slack words.

    A window is `size` consecutive words of an item; an item of fewer words, but not none,
    is one window. Null and empty texts have no words. Rows equal in id and text are one
    document, items of one id are one item. A text of any length is one row's work and is
    looked at three times; the index keeps only its postings of terms that are some
    window's rarest. Empty tables give empty results; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), content(doc_id, text).alias("content"), F.col(text).alias("text"))
    every = checkpointed(windows(items, item_id, item_text, size))
    known = every.groupBy("phrase").agg(F.first("size").alias("size"), F.first("terms").alias("terms"))
    counts = _frequencies(rows.select("text"), _asked(every.select(F.explode("terms").alias("term")).distinct()))
    probes = checkpointed(_probes(known, counts))
    terms = probes.select(F.explode(F.array("t1", "t2")).alias("term")).filter("term is not null")
    index = checkpointed(_indexed(rows, _asked(terms.distinct())))
    postings = index.select("doc_id", "content", F.explode("postings").alias("p")).select("doc_id", "content", "p.term", "p.places")
    met = _met(postings, probes)
    # Position lists meet where both terms stand as far apart as in the window; near matches only need both terms.
    starts = met.select("doc_id", "content", "probe", (F.array_intersect("rare", "other") if slack is None else F.col("rare")).alias("starts"))
    wanted = probes.select("probe", "phrase", "size", "p1")
    wanted = wanted.withColumn("terms", F.lit(None).cast("array<long>")) if slack is None else wanted.join(known.select("phrase", "terms"), "phrase")
    begins = F.transform("starts", lambda s: s - F.col("p1")) if slack is None else F.col("starts")
    asked = starts.filter(F.size("starts") > 0).join(bounded(wanted), "probe").groupBy("doc_id", "content").agg(
        F.collect_list(F.struct("phrase", "size", begins.alias("begins"), "terms")).alias("asked")
    )
    asked = checkpointed(asked).withColumnsRenamed({"doc_id": "d", "content": "c"})
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c"))
    held = _candidates(rows, _asked(asked.select(F.col("c").alias("term"))))
    met_texts = held.join(_sent(asked), same).select("doc_id", "content", "text", "asked")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, content long, found array<struct<phrase:binary,size:int,begins:array<int>>>"
    found = checkpointed(_verified(met_texts, phrase_at if slack is None else near_at(slack), schema).filter(F.size("found") > 0))
    # A repeated row was looked at once per copy.
    matches = found.dropDuplicates(["doc_id", "content"]).select("doc_id", "content", F.inline("found"))
    return index.select("doc_id", "content", "n_words"), matches, every.select("phrase", "item_id").distinct()


def _covered(spans: Column) -> Column:
    """How many words an array of (begin, end) covers, each word once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        new = F.greatest(s["end"].cast("long") - F.greatest(acc["upto"], s["begin"].cast("long")), F.lit(0).cast("long"))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["upto"], s["end"].cast("long")).alias("upto"))

    return F.aggregate(F.sort_array(spans), start, step)["n"]


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) per row of `docs`: words inside exact matches, and the ids of the items matched.

    `items` is sorted as text; an item without id shows as an empty text. All else is as `search` has it.
    """
    documents, matches, known = search(docs, items, doc_id, text, item_id, item_text, size)
    span = F.transform("begins", lambda b: F.struct(b.alias("begin"), (b + F.col("size")).alias("end")))
    hits = matches.groupBy("doc_id", "content").agg(F.flatten(F.collect_list(span)).alias("spans"))
    named = known.select("phrase", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    ids = matches.select("doc_id", "content", "phrase").join(bounded(named), "phrase").groupBy("doc_id", "content").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = hits.withColumnsRenamed({"doc_id": "d", "content": "c"}).join(
        ids.withColumnsRenamed({"doc_id": "d2", "content": "c2"}), F.col("d").eqNullSafe(F.col("d2")) & (F.col("c") == F.col("c2"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c"))
    return documents.join(both, same, "left").select(
        "doc_id", "n_words", F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
