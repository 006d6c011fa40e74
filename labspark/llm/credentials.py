"""Secrets in texts: fixed rules, and likelihoods under automata inferred from the secrets that the rules find."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labspark.llm.automata import Automaton
from labspark.session import checkpointed

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_NAMES = ("passw", "secret", "token", "api")

#: Labelled credentials to learn from, per kind, and ordinary tokens: those of lowest hash.
MAX_LABELLED = 400
#: A kind with fewer labelled credentials gets no automaton.
MIN_LABELLED = 10
#: A candidate is a secret if some format is this much likelier than an ordinary token, in nats per character.
MARGIN = 0.5


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by the fixed rules, leftmost and without overlap per kind; kind is an index into KINDS."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def tokens(text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Candidates: runs of at least 16 characters that secrets are made of, apart from the spans taken."""
    edge = sorted((s, e) for s, _, e, _ in taken)
    at = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(edge) and edge[at][1] <= start:
            at += 1
        if not any(s < end and start < e for s, e in edge[at:] if s < end):
            yield start, end, m[0]


@dataclass(frozen=True)
class Formats:
    """An automaton per kind of credential and one of ordinary tokens."""

    kinds: tuple[Automaton, ...]
    ordinary: Automaton | None

    def is_secret(self, token: str) -> bool:
        if not self.kinds or self.ordinary is None:
            return False
        best = max(a.log_likelihood(token) for a in self.kinds)
        return best - self.ordinary.log_likelihood(token) > MARGIN * len(token)


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, value): the values of base spans, and with kind 3 tokens that no rule takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, str]] = set()
            for value in batch.column(0).to_pylist():
                spans = base_spans(value or "")
                seen.update((kind, secret) for _, kind, _, secret in spans)
                seen.update((3, token) for _, _, token in tokens(value or "", spans))
            rows = list(zip(*seen)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.string())], ["kind", "value"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "kind int, value string")


def learn(docs: DataFrame, text: str = "text", most: int = MAX_LABELLED) -> Formats:
    """Infer the formats from `most` credentials per kind, labelled by the fixed rules, and as many ordinary tokens."""
    values = labelled(docs, text).select("kind", F.xxhash64("value").alias("h"), "value")
    # The k smallest hashes per kind: first per task's group of hashes, then overall, so that no kind is sorted as a whole.
    least = values.groupBy("kind", F.pmod("h", F.lit(64)).alias("part"), "h").agg(F.min("value").alias("value"))
    rows = checkpointed(_lowest(_lowest(least, ["kind", "part"], most), ["kind"], most)).collect()
    by_kind = {k: sorted(r.value for r in rows if r.kind == k) for k in range(4)}
    kinds = tuple(Automaton(v) for k, v in by_kind.items() if k < 3 and len(v) >= MIN_LABELLED)
    return Formats(kinds, Automaton(by_kind[3]) if by_kind[3] else None)


def _lowest(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(f"_n <= {n}").drop("_n")


def scan(docs: DataFrame, formats: Formats, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans) with spans array<struct<start,kind,end>>.

    The automata add spans of kind `format` to what the fixed rules find: every other
    candidate that is likelier as a credential. Offsets are code points, the end
    exclusive. Every row of `docs` gives a row; null texts are empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(formats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_secret = lru_cache(1 << 16)(sent.value.is_secret)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column(1).to_pylist():
                base = base_spans(value or "")
                added = [(s, 3, e, t) for s, e, t in tokens(value or "", base) if is_secret(t)]
                for kind in range(3):
                    out[kind].append(sum(span[1] == kind for span in base))
                out[3].append(len(added))
                shown = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
                out[4].append(sha256(shown.encode()).hexdigest())
                out[5].append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e, _ in sorted(base + added)])
            span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
            kinds = [*[pa.int64()] * 4, pa.string(), span]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = "n_assign long, n_access long, n_hex long, n_format long"
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans array<struct<start:bigint,kind:string,end:bigint>>")
