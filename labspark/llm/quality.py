"""Quality scores by votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labspark.operators.reshape import quoted
from labspark.session import bounded

#: At most so many labelled documents are learnt from: those of lowest text hash.
MAX_LABELLED = 4_000
DIMENSIONS = 24
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Documents whose cosines are taken at once.
BLOCK = 256

# Classes of bytes. Terms of style are pairs of neighbouring classes and two counts of repeated words; the others are words.
_CLASSES = np.full(256, 0, np.uint8)
for _code, _members in enumerate(
    [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\r\x0b\x0c", b"\n", b".,;:?", b"!", b"|"]
    + [bytes([c]) for c in b"&#%$*@/<>=_-\"'()[]{}+~^\\`"],
    start=1,
):
    _CLASSES[np.frombuffer(_members, np.uint8)] = _code
_CLASSES[128:192] = _CLASSES.max() + 1
_CLASSES[192:] = _CLASSES.max() + 1
_WIDTH = int(_CLASSES.max()) + 1
STYLE = _WIDTH * _WIDTH + 2
#: Counts that words and pairs of neighbouring words share by hash.
WORDS = 2_048
TERMS = STYLE + WORDS
#: What style and words count for in a document's vector.
BLOCK_WEIGHTS = (0.7, 1.0)


def terms(text: bytes | None) -> np.ndarray:
    """Term counts of one UTF-8 text; empty texts have no terms."""
    out = np.zeros(TERMS)
    if not text:
        return out
    codes = _CLASSES[np.frombuffer(text, np.uint8)].astype(np.int32)
    if len(codes) > 1:
        out[: _WIDTH * _WIDTH] = np.bincount(codes[:-1] * _WIDTH + codes[1:], minlength=_WIDTH * _WIDTH)
    words = text.lower().split()
    out[STYLE - 2] = sum(map(bytes.__eq__, words, words[1:]))
    out[STYLE - 1] = len(words) - len(set(words))
    codes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    out[STYLE:] = np.bincount(np.concatenate([codes, codes[:-1] * 31 + codes[1:]]) % WORDS, minlength=WORDS)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows /= np.where(norms > 0, norms, 1)
    return rows


def _weighted(counts: np.ndarray, weights: np.ndarray, style: int) -> np.ndarray:
    """Counts in place as weighted logarithms; the first `style` columns and the others are each brought to their block's length."""
    np.log1p(counts, out=counts)
    counts *= weights
    for block, weight in zip((counts[:, :style], counts[:, style:]), BLOCK_WEIGHTS):
        _unit(block)
        block *= weight
    return _unit(counts)


def leading_axes(rows: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors by subspace iteration from a fixed start; no matrix beyond a few times `count` columns is made."""
    axes = np.random.default_rng(0).standard_normal((rows.shape[1], min(count + 8, *rows.shape))).astype(rows.dtype)
    for _ in range(rounds):
        axes, _ = np.linalg.qr(rows.T @ (rows @ axes))
    _, _, turn = np.linalg.svd(rows @ axes, full_matrices=False)
    return np.ascontiguousarray((axes @ turn.T)[:, :count])


@dataclass(frozen=True)
class Votes:
    """A fitted classifier: the terms it knows, their weights, the projection, the labelled vectors and their labels.

    About a megabyte.
    """

    known: np.ndarray
    weights: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; a document without terms has the zero vector."""
        style = int(np.searchsorted(self.known, STYLE))
        return _unit(_weighted(counts[:, self.known], self.weights, style) @ self.projection)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Exact cosines with all labelled vectors, then the vote of the nearest, weighted by similarity; of equal ones the first count."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        near = np.round(self.latent(counts) @ self.vectors.T, 9)  # the last digits depend on how many documents are taken at once
        k = min(self.neighbours, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, [near.shape[1] - k]]
        equal = near == least
        left = k - (near > least).sum(axis=1, keepdims=True)
        kept = (near > least) | (equal & (np.cumsum(equal, axis=1) <= left))
        weight = np.where(kept, np.maximum(near, 0.0), 0.0)
        for _ in range(3):
            weight *= weight
        total = weight.sum(axis=1)
        vote = weight @ self.labels
        return np.where(total > 1e-9, vote / np.where(total > 1e-9, total, 1), prior)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> Votes:
    """Learn from the labelled rows of `labels` (doc_id, label 0 or 1) that have a text in `docs`.

    At most `most` of them, those of lowest text hash, are brought to the driver as term
    counts; null labels and null texts are left out, equal texts with equal labels count
    once. Latent dimensions are the leading singular vectors of their weighted terms.
    """
    known = labels.select(F.col(doc_id).alias("_k"), F.col(label).cast("double").alias("y")).filter("y in (0.0, 1.0)")
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
    # Ids and hashes find the sample; only the texts of the sample are then fetched.
    named = rows.select("d", "h").join(known.distinct(), F.col("d") == F.col("_k"))
    sample = named.groupBy("h", "y").agg(F.min("d").alias("_k")).orderBy("h", "y").limit(most)
    sample = sample.withColumnRenamed("h", "_h")
    labelled = rows.join(bounded(sample, most), (F.col("d") == F.col("_k")) & (F.col("h") == F.col("_h"))).select("h", "y", "t")
    found = _counted(labelled).groupBy("h", "y").agg(F.first("counts").alias("counts")).orderBy("h", "y").limit(most).toArrow()
    y = found.column("y").to_numpy()
    # Few of the terms occur in a text, and few of all terms occur at all: the driver holds one matrix of those that do.
    rows = [np.frombuffer(c.as_buffer(), _COUNT) for c in found.column("counts")]
    present = np.bincount(np.concatenate([np.zeros(0, "<u2"), *[r["term"] for r in rows]]), minlength=TERMS)
    known = np.flatnonzero(present)
    place = np.zeros(TERMS, np.int64)
    place[known] = np.arange(len(known))
    counts = np.zeros((len(rows), len(known)), np.float32)
    for row, held in zip(counts, rows):
        row[place[held["term"]]] = held["n"]
    del rows, found
    weights = np.log((1 + len(counts)) / (1 + present[known])) + 0.2
    if not len(known) or not len(y):
        return Votes(known, weights, np.zeros((len(known), 1)), np.zeros((len(y), 1)), y, NEIGHBOURS)
    weighted = _weighted(counts, weights.astype(np.float32), int(np.searchsorted(known, STYLE)))
    projection = leading_axes(weighted, DIMENSIONS).astype(float)
    vectors = _unit((weighted @ projection.astype(np.float32)).astype(float))
    return Votes(known, weights, projection, vectors, y, NEIGHBOURS)


#: A term that occurs in a text, and how often.
_COUNT = np.dtype([("term", "<u2"), ("n", "<f4")])


def _sparse(counts: np.ndarray) -> bytes:
    out = np.empty(np.count_nonzero(counts), _COUNT)
    out["term"] = np.flatnonzero(counts)
    out["n"] = counts[out["term"]]
    return out.tobytes()


def _counted(rows: DataFrame) -> DataFrame:
    """(h, y, t) to (h, y, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            counts = pa.array([_sparse(terms(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["h", "y", "counts"])

    return rows.mapInArrow(run, "h long, y double, counts binary")


def with_scores(docs: DataFrame, model: Votes, text: str = "text", score: str = "score") -> DataFrame:
    """`docs` with the score added: 0 to 1, higher means that label 1 is likelier.

    The text alone counts. Null and empty texts get the share of label 1 among the
    labelled; repeated rows get the same score. All columns are passed on, whatever their names; one that is
    called like the score is replaced. A text is one row's work, of any length: its terms are counts of fixed
    number. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != score]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = sent.value
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            parts = [
                votes.scores(np.stack([terms(t) for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)
            ]
            scores = np.clip(np.concatenate(parts) if parts else np.zeros(0), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    # Columns go by plain names through Arrow, where a dot in a name would not do.
    plain = docs.select(*[F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(kept)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{kinds}, score double").toDF(*kept, score)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept out of learning: crc32 of the id as text has no rest. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))
