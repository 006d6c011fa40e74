"""Plain versions of the operators, on one machine, for comparison."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None) -> int:
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(count: int, links) -> list[int]:
    up = list(range(count))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(count)]


def simhash_groups(docs: list[tuple]) -> list[tuple]:
    prints = [simhash(text) for _, text in docs]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(len(docs), near)
    first = {}
    for (key, _), r in zip(docs, root):
        if key is not None:
            first[r] = min(key, first.get(r, key))
    return [(key, f"{p:016x}", first.get(r)) for (key, _), p, r in zip(docs, prints, root)]


def substring_dedup(docs: list[tuple], window: int = 20) -> list[tuple]:
    seen, out = set(), []
    for key, text in sorted(docs):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone[i : i + window] = [True] * window
            seen.add(run)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((key, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def documents(folder: str) -> pd.DataFrame:
    return pd.read_parquet(f"{folder}/documents.parquet").sort_values("doc_id", ignore_index=True)
