"""SQL of the queries that it can express."""

from __future__ import annotations

from labspark.llm.license_texts import KNOWN
from labspark.llm.licenses import COPYRIGHT_LINE, SPELLINGS

# Every window as a text; all but its first occurrence in (doc_id, start) order cover their words.
SUBSTRING_DEDUP = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS path FROM s),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY path ORDER BY doc_id, i) AS n FROM p) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS at FROM m),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS at FROM w WHERE len(ws) > 0),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.at) AS kept, count(*) AS n_kept
  FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.at = e.at WHERE g.at IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelled(text: str) -> str:
    for old, new in SPELLINGS:
        text = f"replace({text}, '{old}', '{new}')"
    return text


def _canonical(column: str) -> str:
    low = f"lower(coalesce({column}, ''))"
    marks = " OR ".join(f"contains({low}, '{mark}')" for mark in ("copyright", "©", "(c)", "all rights reserved"))
    bare = f"CASE WHEN {marks} THEN regexp_replace({low}, '{COPYRIGHT_LINE}', '', 'g') ELSE {low} END"
    return _spelled(f"regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')")


_WHOLE = _spelled("trim(regexp_replace(c, '[ \\n]+', ' ', 'g'))")
_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)

LICENSE_DIGESTS = f"""WITH texts AS (SELECT * FROM (VALUES {_KNOWN}) AS t(license_id, text)),
known AS (SELECT digest, min(license_id) AS license_id FROM (
  SELECT license_id, sha256({_WHOLE}) AS digest FROM (SELECT license_id, {_canonical("text")} AS c FROM texts)) GROUP BY digest),
d AS (SELECT doc_id, {_canonical("text")} AS c FROM documents),
wholes AS (SELECT doc_id, CASE WHEN line <> '' THEN sha256(line) END AS digest FROM (SELECT doc_id, {_WHOLE} AS line FROM d)),
each AS (SELECT doc_id, sha256(trim(line)) AS digest FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS line FROM d) WHERE trim(line) <> ''),
found AS (SELECT doc_id, license_id, count(*) AS n FROM each JOIN known USING (digest) GROUP BY ALL),
notes AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_notices, string_agg(license_id, ',' ORDER BY license_id) AS notices FROM found GROUP BY doc_id)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM wholes w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN notes USING (doc_id)"""

# Windows of every length that an item has, as texts; the words of a document that they cover, and the items.
POSITIONAL_INDEX = r"""WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
starts AS (SELECT item_id, ws, least(10, len(ws)) AS size, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i+size-1], ' ') AS phrase FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM docs, sizes WHERE len(ws) >= size),
found AS (SELECT doc_id, i, p.size, item_id FROM (SELECT doc_id, size, i, array_to_string(ws[i:i+size-1], ' ') AS phrase FROM places) p
  JOIN windows w ON w.phrase = p.phrase AND w.size = p.size),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""
