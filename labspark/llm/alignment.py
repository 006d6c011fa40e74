"""Token groups of two tokenizers over the same bytes, and how often their tokens are linked corpus-wide.

A text is looked at as bytes with a space before them. Places where a token of both
tokenizers ends cut it into groups. A byte range yields a fragment: the open tokens up to
its first such place, the closed groups up to its last, and the open tokens after that.
Fragments of adjoining ranges compose associatively, so that a very long document is
tokenized in ranges by many tasks and put together by a tree reduction over tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.llm.common import BATCH_ROWS
from labspark.llm.packing import encoder
from labspark.session import checkpointed

#: Bytes of a range. Longer documents are dealt out in ranges.
RANGE = 32 << 10
#: Fragments that one step of the tree reduction puts together.
FANOUT = 8
#: The most frequent id pairs travel to all tasks, at most so many (13 bytes each); the others are joined by shuffle.
MAX_SENT = 1 << 19
#: Distinct pairs that a task counts before it hands them on.
HELD = 1 << 21

# An id pair as one integer: A's id above B's.
_LOW = 16
#: Both tokenizers start anew at a space between two characters that are no white space.
_SAFE = re.compile(r"(?<=\S)(?= \S)")

_NONE = np.zeros(0, np.int64)


@dataclass(frozen=True)
class Tokens:
    """Tokens of both kinds in order: ids, and the byte offset at which each ends."""

    a: np.ndarray = field(default_factory=lambda: _NONE)
    a_ends: np.ndarray = field(default_factory=lambda: _NONE)
    b: np.ndarray = field(default_factory=lambda: _NONE)
    b_ends: np.ndarray = field(default_factory=lambda: _NONE)

    def __add__(self, other: Tokens) -> Tokens:
        mine, theirs = self.parts(), other.parts()
        return Tokens(*[np.concatenate(x) for x in zip(mine, theirs)])

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def between(self, low: int, high: int) -> Tokens:
        """Those that end above low, up to high."""
        i, j = np.searchsorted(self.a_ends, [low, high], "right")
        k, m = np.searchsorted(self.b_ends, [low, high], "right")
        return Tokens(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])

    def packed(self) -> bytes:
        return np.concatenate([[len(self.a), len(self.b)], *self.parts()]).astype("<i8").tobytes()

    @staticmethod
    def unpacked(data: bytes) -> Tokens:
        values = np.frombuffer(data, "<i8")
        n, m = int(values[0]), int(values[1])
        return Tokens(*np.split(values[2:], [n, 2 * n, 2 * n + m]))


@dataclass(frozen=True)
class Fragment:
    """A byte range: open tokens before its first common end, closed groups, open tokens after its last.

    A range without a common end has all its tokens in `head` and `cut` is false. `ok` tells
    that the tokens' bytes are those of the text. Pairs are distinct; `times` counts them.
    """

    ok: bool
    cut: bool
    head: Tokens
    tail: Tokens
    groups: bytes = b""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    pairs: np.ndarray = field(default_factory=lambda: _NONE)
    times: np.ndarray = field(default_factory=lambda: _NONE)


EMPTY = Fragment(True, False, Tokens(), Tokens())


@cache
def _shown() -> list[str]:
    """Ids as decimals with the sign that follows: comma, bar, comma, semicolon for last or not last of A or B."""
    return [f"{i}{sign}" for i in range(1 << _LOW) for sign in ",|,;"]


def closed(tokens: Tokens) -> Fragment:
    """The groups of tokens that begin and end at common ends, without open ends."""
    if not len(tokens.a):
        return replace(EMPTY, cut=True)
    a, a_ends, b, b_ends = tokens.parts()
    low, high = min(int(a_ends[0]), int(b_ends[0])), int(a_ends[-1])
    ends_a, ends_b = np.zeros((2, high - low + 1), bool)
    ends_a[a_ends - low] = True
    ends_b[b_ends - low] = True
    common = ends_a & ends_b
    # Groups in order, in each A's tokens and then B's: a token's place counts those of the other kind before it.
    a_last, b_last = common[a_ends - low], common[b_ends - low]
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    b_upto, a_upto = np.append(0, np.flatnonzero(b_last) + 1), np.flatnonzero(a_last) + 1
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + b_upto[a_group]] = a * 4 + a_last
    codes[np.arange(len(b)) + a_upto[b_group]] = b * 4 + 2 + b_last
    text = "".join(map(_shown().__getitem__, codes.tolist()))
    # Between two neighbouring ends of any kind lies one link: the tokens that the ends before it leave open.
    ends = np.flatnonzero(ends_a | ends_b)
    at_a, at_b = ends_a[ends], ends_b[ends]
    links = (a[np.cumsum(at_a) - at_a] << _LOW) | b[np.cumsum(at_b) - at_b]
    pairs, times = np.unique(links, return_counts=True)
    return Fragment(True, True, Tokens(), Tokens(), text.encode(), len(a), len(b), int(common.sum()), pairs, times)


def fragment(tokens: Tokens, ok: bool = True) -> Fragment:
    """The fragment of a range's tokens: those that end in it, whole tokens all."""
    common = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
    if not ok or not len(common):
        return Fragment(ok, False, tokens, Tokens())
    first, last = int(common[0]), int(common[-1])
    inner = closed(tokens.between(first, last))
    return replace(inner, head=tokens.between(-1, first), tail=tokens.between(last, 1 << 62))


def _summed(parts: list[Fragment]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
    return pairs, np.bincount(at, np.concatenate([p.times for p in parts]), len(pairs)).astype(np.int64)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two adjoining ranges. Associative; EMPTY is neutral."""
    if not (x.ok and y.ok):
        return Fragment(False, False, Tokens(), Tokens())
    if not x.cut:
        return replace(y, head=x.head + y.head)
    if not y.cut:
        return replace(x, tail=x.tail + y.head)
    parts = [x, closed(x.tail + y.head), y]
    pairs, times = _summed(parts)
    n_a, n_b, n_groups = (sum(getattr(p, n) for p in parts) for n in ("n_a", "n_b", "n_groups"))
    return Fragment(True, True, x.head, y.tail, b"".join(p.groups for p in parts), n_a, n_b, n_groups, pairs, times)


def finished(whole: Fragment) -> Fragment:
    """A whole document: what is open at its begin is its first group. Without tokens where the bytes differ."""
    if not whole.ok or not whole.cut or len(whole.tail.a) or len(whole.tail.b):
        return replace(EMPTY, cut=True)
    start = Fragment(True, True, Tokens(), Tokens())
    return compose(start, whole)


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


def vocabularies() -> tuple[tuple[str, str], str]:
    """A's file and its ranks, and B's file, where the task runs."""
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.path("piece_bpe_32k.model")


@cache
def _tokenizers(paths: tuple[tuple[str, str], str] | None) -> tuple[Callable, Callable, list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Encoders of both, the bytes of their ids, and how many they are."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_paths, b_path = paths or vocabularies()
    own = Tokenizer.from_file(a_paths[0])
    # Byte-level entries write each byte as a character: printable ones as themselves, the others from U+0100 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    entries = own.get_vocab(with_added_tokens=True)
    a_bytes = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        a_bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = [piece_bytes(b.id_to_piece(i), b.is_byte(i)) for i in range(b.get_piece_size())]
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a_bytes, b_bytes)]
    return encoder(a_paths, added=False), lambda text: b.encode(text, num_threads=1), a_bytes, b_bytes, *sizes


def tokens_of(chunk: bytes, base: int, paths: tuple[tuple[str, str], str] | None = None) -> Tokens | None:
    """Tokens of a stretch that begins with a space at byte `base` of its document, or None where the bytes differ."""
    encode_a, encode_b, a_bytes, b_bytes, a_sizes, b_sizes = _tokenizers(paths)
    text = chunk.decode()
    a, b = encode_a(text), encode_b(text[1:])
    if b"".join(map(a_bytes.__getitem__, a)) != chunk or b"".join(map(b_bytes.__getitem__, b)) != chunk:
        return None
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return Tokens(a, base + np.cumsum(a_sizes[a]), b, base + np.cumsum(b_sizes[b]))


def ranges(text: str, size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(low, high, base, stretch) of the byte ranges of a text with its space before it.

    Ranges end at multiples of `size`. Each comes with the stretch around it up to the next places at which both
    tokenizers start anew, which begins at byte `base`. A range's end is left out where such a stretch is longer than a range, so
    that no byte is tokenized more than a few times.
    """
    stretches = [s.encode() for s in _SAFE.split(" " + text)]
    safe = np.concatenate([[0], np.cumsum([len(s) for s in stretches])])
    total = int(safe[-1])
    ends = [e for e in range(size, total, size) if _fits(safe, e, size)] + [total]
    whole = b"".join(stretches)
    low = 0
    for high in ends:
        start = int(safe[np.searchsorted(safe, low, "right") - 1])
        stop = int(safe[np.searchsorted(safe, high, "left")])
        yield low, high, start, whole[start:stop]
        low = high


def _fits(safe: np.ndarray, end: int, size: int) -> bool:
    at = np.searchsorted(safe, end, "left")
    return bool(safe[at] - safe[at - 1] <= size)


def fragment_of(low: int, high: int, base: int, stretch: bytes, paths: tuple[tuple[str, str], str] | None = None) -> Fragment:
    """The fragment of one byte range: the tokens that end above low, up to high."""
    tokens = tokens_of(stretch, base, paths)
    return Fragment(False, False, Tokens(), Tokens()) if tokens is None else fragment(tokens.between(low, high))


_FRAGMENT = "ok boolean, cut boolean, head binary, tail binary, groups binary, n_a long, n_b long, n_groups long, pairs binary, times binary"
_KINDS = [pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [part.split()[0] for part in _FRAGMENT.split(", ")]


def _stored(f: Fragment) -> tuple:
    return (f.ok, f.cut, f.head.packed(), f.tail.packed(), f.groups, f.n_a, f.n_b, f.n_groups, f.pairs.astype("<u4").tobytes(), f.times.astype("<u4").tobytes())


def _loaded(row: dict) -> Fragment:
    pairs, times = np.frombuffer(row["pairs"], "<u4").astype(np.int64), np.frombuffer(row["times"], "<u4").astype(np.int64)
    return Fragment(row["ok"], row["cut"], Tokens.unpacked(row["head"]), Tokens.unpacked(row["tail"]), row["groups"], row["n_a"], row["n_b"], row["n_groups"], pairs, times)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _scanned(docs: DataFrame, doc_id: str, text: str, size: int, digest: bool, paths: tuple[tuple[str, str], str] | None) -> DataFrame:
    """(row, doc_id, part, low, high, base, stretch, fragment…): a document of one range is finished, a longer one a row per range."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (None,) * len(_KINDS)
        kinds = None

        def made(batch: pa.RecordBatch) -> Iterator[tuple]:
            for row, key, value in zip(*[c.to_pylist() for c in batch.columns]):
                data = b" " + (value or "").encode()
                if len(data) <= size:
                    tokens = tokens_of(data, 0, paths) if value else None
                    yield row, key, None, 0, 0, 0, None, *_stored(_shut(closed(tokens or Tokens()), digest))
                else:
                    for part, piece in enumerate(ranges(value, size)):
                        yield row, key, part, *piece, *nothing

        for batch in batches:
            kinds = [pa.int64(), batch.schema.types[1], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *_KINDS]
            yield from _batches(made(batch), ["row", "doc_id", "part", "low", "high", "base", "stretch", *_NAMES], kinds)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, part int, low long, high long, base long, stretch binary, {_FRAGMENT}")


def _shut(whole: Fragment, digest: bool) -> Fragment:
    """Groups without the last semicolon, or their digest; nothing where there are no tokens."""
    groups = whole.groups[:-1]
    return replace(whole, groups=hashlib.sha256(groups).hexdigest().encode() if digest and groups else groups)


def _reduced(parts: DataFrame, digest: bool, paths: tuple[tuple[str, str], str] | None, fanout: int) -> DataFrame:
    """(row, fragment…) of whole documents from the ranges (row, part, low, high, base, stretch) of the long ones."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((e["row"], e["part"], *_stored(fragment_of(e["low"], e["high"], e["base"], e["stretch"], paths))) for e in _entries(batches))
        yield from _batches(rows, ["row", "part", *_NAMES], [pa.int64(), pa.int32(), *_KINDS], 16)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (row, up), members in groupby(_entries(batches), key=lambda e: (e["row"], e["part"] // fanout)):
                whole = EMPTY
                for member in members:
                    whole = compose(whole, _loaded(member))
                yield row, up, *_stored(whole)

        yield from _batches(made(), ["row", "part", *_NAMES], [pa.int64(), pa.int32(), *_KINDS], 16)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((e["row"], *_stored(_shut(finished(_loaded(e)), digest))) for e in _entries(batches))
        yield from _batches(rows, ["row", *_NAMES], [pa.int64(), *_KINDS], 16)

    schema = f"row long, part int, {_FRAGMENT}"
    longest = parts.agg(F.max("part").alias("p")).first()["p"] or 0
    level = checkpointed(parts.repartition("row", "part").mapInArrow(first, schema))
    while longest > 0:
        up = F.expr(f"part div {fanout}")
        level = checkpointed(level.repartition(F.col("row"), up).sortWithinPartitions("row", "part").mapInArrow(joined, schema))
        longest //= fanout
    return level.mapInArrow(last, f"row long, {_FRAGMENT}")


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False, size: int = RANGE, fanout: int = FANOUT, paths: tuple[tuple[str, str], str] | None = None) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups, pairs, times) per row of `docs`; `row` numbers the rows.

    `groups` (binary) is the text `a1,a2|b1;a3|b2`: the ids of A and B of each group in order, or with `digest`
    its SHA-256 in hex. `pairs` (binary) holds the distinct linked id pairs as unsigned 32-bit integers, A's id
    above B's 16 bits, `times` how often each is linked.
    """
    scanned = checkpointed(_scanned(docs, doc_id, text, size, digest, paths))
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"]
    parts = scanned.filter("part is not null").select("row", "part", "low", "high", "base", "stretch")
    long = _reduced(parts, digest, paths, fanout).join(scanned.filter("part = 0").select("row", "doc_id"), "row")
    return checkpointed(scanned.filter("part is null").select(*columns).unionByName(long.select(*columns)))


def _counted(lists: DataFrame) -> DataFrame:
    """(pair, n): in how many documents a pair is linked, from a column `pairs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, held = [], [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            pair, at = np.unique(np.concatenate(kept), return_inverse=True)
            return pair, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        def made(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], ["pair", "n"])

        for batch in batches:
            pair, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), return_counts=True)
            kept.append(pair)
            counts.append(n)
            held += len(pair)
            if held > HELD:
                pair, n = folded()
                kept, counts, held = [pair], [n], len(pair)
                if held > HELD // 2:
                    yield made(pair, n)
                    kept, counts, held = [], [], 0
        if kept:
            yield made(*folded())

    return lists.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and whether no pair of its A id is linked in more."""
    counts = checkpointed(_counted(lists.select("pairs")))
    most = counts.groupBy(F.shiftright("pair", _LOW).alias("a")).agg(F.max("n").alias("most"))
    joined = counts.withColumn("a", F.shiftright("pair", _LOW)).join(most, "a")
    return checkpointed(joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _least_sent(counts: DataFrame, most: int) -> int:
    """The least count, a power of two, that at most `most` pairs reach."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("pairs")).collect()
    left, bits = most, 63
    for row in sorted(sizes, key=lambda r: -r["bits"]):
        left -= row["pairs"]
        if left < 0:
            break
        bits = row["bits"]
    return 1 << (bits - 1)


def _scored(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """Adds n_links, and n_best and count_sum over frequent pairs; `rest` lists the other pairs."""
    table = frequent.orderBy("pair").toArrow()
    known = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    sent = docs.sparkSession.sparkContext.broadcast((known[0].astype("<u4"), known[1], known[2].astype(np.int64)))
    rest = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = sent.value
        for batch in batches:
            links, bests, sums, others = [], [], [], []
            for pairs, times in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                pairs, times = np.frombuffer(pairs, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
                at = np.searchsorted(pair, pairs)
                found = at < len(pair)
                found[found] = pair[at[found]] == pairs[found]
                hit, seen = at[found], times[found]
                links.append(int(times.sum()))
                bests.append(int(best[hit] @ seen))
                sums.append(int(n[hit] @ seen))
                others.append([{"pair": p, "times": t} for p, t in zip(pairs[~found].tolist(), times[~found].tolist())])
            columns = [*batch.columns[:6], *[pa.array(c, pa.int64()) for c in (links, bests, sums)], pa.array(others, rest)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in ("n_links", "n_best", "count_sum"))
    return docs.mapInArrow(run, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, groups binary, {numbers}, rest array<struct<pair:long,times:long>>")


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False, size: int = RANGE, fanout: int = FANOUT, most_sent: int = MAX_SENT, paths: tuple[tuple[str, str], str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per row of `docs`.

    Groups and links as in `documents`. A pair's count is the number of rows that hold it linked; count_sum adds
    the counts of all links, n_best counts the links whose count is the highest of their A id, ties included.

    Null and empty texts, and texts whose tokens' bytes are not those of the text, have no tokens: zeros and an
    empty `groups`. Repeated rows are documents of their own. A text longer than `size` bytes is dealt out in
    ranges, so that a task holds one text and the tokens of a few ranges. Other columns are not
    looked at, whatever their names; an empty table gives no rows.
    """
    held = documents(docs, doc_id, text, digest, size, fanout, paths)
    counts = pair_counts(held)
    least = _least_sent(counts, most_sent)
    scored = checkpointed(_scored(held, counts.filter(F.col("n") >= least)))
    rest = scored.select("row", F.inline("rest")).join(counts.filter(F.col("n") < least), "pair")
    sums = rest.groupBy("row").agg(
        F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )

    def plus(column: str, more: str) -> Column:
        return (F.col(column) + F.coalesce(more, F.lit(0))).alias(column)

    return scored.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), F.col("groups").cast("string").alias("groups")
    )
