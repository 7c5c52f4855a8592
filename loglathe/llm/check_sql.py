"""Check SQL of the operators that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD_GROUPS = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')]
        ELSE [] END AS shingles
    FROM w
), s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b
    FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n
    HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reached AS (
    SELECT doc_id AS node, doc_id AS root FROM sets
    UNION
    SELECT links.b, reached.root FROM reached JOIN links ON reached.node = links.a
), groups AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node)
SELECT doc_id, len(shingles) AS n_shingles, component_id,
    CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(shingles)) END AS class_id
FROM sets JOIN groups ON node = doc_id
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC_RECORDS = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digits FROM pages),
d AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id,
        list_transform(range(8), lambda i: CAST('0x' || substr(digits, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT)) AS parts
    FROM p
)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
    array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
        lambda k: substr('{_BASE32}', CAST((v >> k) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

_LOWERED_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

LEAKS = f"""
WITH d AS (SELECT doc_id, {_LOWERED_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_LOWERED_WORDS} AS w FROM benchmark)),
windows AS (
    SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM b, unnest(range(1, len(w) - n + 2)) t(s) WHERE n > 0
), runs AS (
    SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
    FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) t(s)
), hits AS (SELECT doc_id, n, s, item FROM runs JOIN windows USING (n, win)),
spans AS (SELECT DISTINCT doc_id, n, s FROM hits),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM spans, unnest(range(s, s + n)) u(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
