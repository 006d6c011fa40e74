"""Packing token pieces into sequences of limited length, balanced by attention cost."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_ID = 1
CAPACITY = 2048
#: UTF-8 bytes that share one packing group: about 2,000 sequences, so that the padding of a group's last one is nothing.
GROUP_BYTES = 8 << 20
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 512

_SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
_PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def vocabulary_paths() -> tuple[str, str]:
    """The tokenizer's file, and the same vocabulary as ranks. Found on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(paths: tuple[str, str] | None = None, added: bool = True) -> Callable[[str], list[int]]:
    """Text to ids, no token being put around it.

    The ids are those of the tokenizer file. Its vocabulary is read as ranks by a faster
    library (seven times here); a text on which that library gives up goes to the file's own,
    and so does one that holds the string of an added token. With `added` such a string is
    that token, else it is text like any other.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own, ranks_file = paths or vocabulary_paths()
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(own)
    slow.encode_special_tokens = not added
    strings = [t.content for t in slow.get_added_tokens_decoder().values()] if added else []

    def encode(text: str) -> list[int]:
        if not any(s in text for s in strings):
            try:
                return fast.encode_ordinary(text)
            except BaseException as error:  # the library panics on some very long runs
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Each document's ids and END_ID, cut into full pieces and a rest; only rests carry their ids (16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(paths)
        for batch in batches:
            out: list[tuple] = []
            for key, value in zip(batch.column(0), batch.column(1).to_pylist()):
                ids = np.frombuffer(array("H", encode(value or "")), np.uint16)
                ids = np.append(ids, np.uint16(END_ID))
                n, end = len(ids), len(ids) // capacity * capacity
                wide = ids[:end].astype("<u4")
                for at in range(0, end, capacity):
                    out.append((key, at, capacity, zlib.crc32(wide[at : at + capacity]), n, None))
                if n > end:
                    out.append((key, end, n - end, None, n, ids[end:].tobytes()))
            columns = list(zip(*out)) or [()] * 6
            kinds = [batch.schema.types[0], *[pa.int64()] * 4, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            keys = pa.array([k.as_py() for k in columns[0]], kinds[0])
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, k) for c, k in zip(columns[1:], kinds[1:])]], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _PIECES.format(rows.schema["doc_id"].dataType.simpleString()))


def balance(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Place pieces, given in descending length, as (piece, from, length, sequence).

    There are as few sequences as the tokens need. Each piece goes to the sequence of
    lowest cost that has room for it. One that fits nowhere is cut over the sequences
    with most room.
    """
    count = -(-int(lengths.sum()) // capacity)
    room = np.full(count, capacity, np.int64)
    cost = np.zeros(count)
    placed = []
    for piece, n in enumerate(lengths.tolist()):
        at = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[at] >= n:
            parts = [(0, n, at)]
        else:
            parts, start = [], 0
            while start < n:
                at = int(np.argmax(room)) if not parts else int(np.argmax(np.where(np.isin(np.arange(count), [p[2] for p in parts]), -1, room)))
                size = min(int(room[at]), n - start)
                parts.append((start, size, at))
                start += size
        for start, size, at in parts:
            room[at] -= size
            cost[at] += LINEAR * size + QUADRATIC * size * size
            placed.append((piece, start, size, at))
    return placed


def _pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    base = int(group["_group"].iloc[0]) << 32
    order = ["length", "doc_id", "start"]
    group = group.sort_values(order, ascending=[False, True, True], kind="stable", na_position="last")
    full, rest = group[group["length"] == capacity], group[group["length"] < capacity]
    out = [full.assign(sequence_id=base + np.arange(len(full), dtype=np.int64), offset=0)]
    if len(rest):
        base += len(full)
        used: dict[int, int] = {}
        rows = []
        starts, totals, ids = rest["start"].to_numpy(), rest["doc_tokens"].to_numpy(), list(rest["ids"])
        keys = rest["doc_id"].tolist()
        for piece, start, size, at in balance(rest["length"].to_numpy(), capacity):
            crc = zlib.crc32(np.frombuffer(ids[piece], np.uint16)[start : start + size].astype("<u4"))
            offset = used.get(at, 0)
            used[at] = offset + size
            rows.append((keys[piece], starts[piece] + start, size, crc, totals[piece], base + at, offset))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        table = pd.DataFrame(rows, columns=names)
        table["doc_id"] = table["doc_id"].astype(rest["doc_id"].dtype)
        out.append(table)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pd.concat([t[names] for t in out if len(t)], ignore_index=True)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, paths: tuple[str, str] | None = None) -> DataFrame:
    """Every id of every document in one piece of one sequence of at most `capacity` ids.

    Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). Full pieces
    fill a sequence each. Rests meet in groups of a fixed size, dealt by hash of document,
    place and row, so that repeated or missing ids spread as well, and are balanced by cost inside each group, so a group's work is bounded
    and all but the few tokens of its last sequence are filled. A null text is empty and
    has END_ID alone; repeated rows are packed as often as they occur; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    weight = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    groups = max(1, weight // GROUP_BYTES)
    dealt = pieces(rows, "doc_id", "text", capacity, paths).withColumn(
        "_group", F.pmod(F.xxhash64("doc_id", "start", "length", F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    )
    # Ids pass through pandas as text: beside a null a large integer would lose digits there.
    kind = rows.schema["doc_id"].dataType.simpleString()
    named = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = named.groupBy("_group").applyInPandas(lambda g: _pack_group(g, capacity), _SCHEMA.format("string"))
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind))
