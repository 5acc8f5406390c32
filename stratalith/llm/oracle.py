"""SQL for DuckDB over the same tables, for the queries that SQL can express.

Written plainly and on the words themselves, not on hashes, so that nothing is shared with the operators but the contract.
Left out are classifiers and language models (op1, op5), merges by rank (op2), terms by co-occurrence (op6), the sequential
flow of a ring (op9), and the pipeline, which holds some of these. They are tested against brute force instead.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"

HOST_QUALITY = rf"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
    FROM documents
), each AS MATERIALIZED (
    SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), w AS (
    SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS s FROM each WINDOW o AS (PARTITION BY r ORDER BY i)
), g AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM w WHERE s IS NOT NULL
), covered AS (
    SELECT r, count(DISTINCT i + k) AS n FROM g, range(3) AS t(k) WHERE c > 1 GROUP BY r
), own AS MATERIALIZED (
    SELECT doc_id, source, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN covered USING (r)
), judged AS MATERIALIZED (
    SELECT doc_id, source, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM own
), hosts AS (
    SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS bad
    FROM judged WHERE source IS NOT NULL GROUP BY source
), moments AS (
    SELECT avg(bad / n) AS m, coalesce(var_pop(bad / n), 0) AS v, avg(1 / n) AS w FROM hosts
), weighed AS (
    SELECT m, greatest(1.0, least(1e4, m * (1 - m) / greatest(v - m * (1 - m) * w, 1e-6) - 1)) AS weight FROM moments
), shrunk AS (
    SELECT source, bad + m * weight AS a, n - bad + (1 - m) * weight AS b FROM hosts, weighed
), verdicts AS (
    SELECT source, a / (a + b) AS rate, sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS spread FROM shrunk
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT coalesce(rate - 2 * spread > 0.5, false) AS kept, round(rate, 9) AS host_rate
FROM judged LEFT JOIN verdicts USING (source)
"""

SUBSTRING_DEDUP = rf"""
WITH d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), each AS MATERIALIZED (
    SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), two AS (
    SELECT *, word || ' ' || lead(word) OVER o AS w2 FROM each WINDOW o AS (PARTITION BY r ORDER BY i)
), four AS (
    SELECT *, w2 || ' ' || lead(w2, 2) OVER o AS w4 FROM two WINDOW o AS (PARTITION BY r ORDER BY i)
), eight AS (
    SELECT *, w4 || ' ' || lead(w4, 4) OVER o AS w8 FROM four WINDOW o AS (PARTITION BY r ORDER BY i)
), sixteen AS (
    SELECT *, w8 || ' ' || lead(w8, 8) OVER o AS w16 FROM eight WINDOW o AS (PARTITION BY r ORDER BY i)
), fifty AS (
    SELECT r, doc_id, i, w16 || ' ' || lead(w16, 16) OVER o || ' ' || lead(w16, 32) OVER o || ' ' || lead(w2, 48) OVER o AS s
    FROM sixteen WINDOW o AS (PARTITION BY r ORDER BY i)
), w AS MATERIALIZED (
    SELECT * FROM fifty WHERE s IS NOT NULL
), low AS (
    SELECT s, min(doc_id) AS low FROM w GROUP BY s
), gone AS (
    SELECT DISTINCT r, i + k AS i FROM w JOIN low USING (s), range(50) AS t(k) WHERE doc_id > low
), kept AS (
    SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE t AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{WORD}') AS words FROM documents
), each AS (
    SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM t
), gram AS (
    SELECT r, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM each WINDOW o AS (PARTITION BY r ORDER BY i)
    UNION ALL
    SELECT r, array_to_string(words, ' ') FROM t WHERE len(words) IN (1, 2)
), own AS (
    SELECT r, list(DISTINCT g ORDER BY g) AS grams FROM gram WHERE g IS NOT NULL GROUP BY r
), s AS MATERIALIZED (
    SELECT r, doc_id, coalesce(grams, []) AS grams FROM t LEFT JOIN own USING (r)
), class AS MATERIALIZED (
    SELECT min(r) AS k, min(doc_id) AS first, len(grams) AS n, grams FROM s WHERE len(grams) > 0 GROUP BY grams
), entry AS MATERIALIZED (
    SELECT k, n, unnest(grams) AS gram FROM class
), pair AS MATERIALIZED (
    SELECT a.k AS x, b.k AS y FROM entry a JOIN entry b ON a.gram = b.gram AND a.k <> b.k
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
    SELECT k AS x, k AS y FROM class
    UNION
    SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x
), component AS (
    SELECT reach.x AS k, min(first) AS least FROM reach JOIN class ON class.k = reach.y GROUP BY reach.x
)
SELECT doc_id, len(s.grams)::BIGINT AS n_shingles, CASE WHEN len(s.grams) > 0 THEN least ELSE doc_id END AS component_id
FROM s LEFT JOIN class ON s.grams = class.grams LEFT JOIN component USING (k)
"""

NOT_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = rf"""
WITH item AS (
    SELECT item_id, regexp_extract_all({LOWER}, '{NOT_ALNUM}') AS words FROM benchmark
), spot AS (
    SELECT item_id, words, least(10, len(words)) AS l, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i
    FROM item WHERE len(words) > 0
), win AS MATERIALIZED (
    SELECT DISTINCT item_id, l, array_to_string(words[i:i + l - 1], ' ') AS s FROM spot
), d AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{NOT_ALNUM}') AS words FROM documents
), each AS (
    SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), ten AS (
    SELECT r, i, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next FROM each
), seen AS (
    SELECT r, l, i, array_to_string(next[1:l], ' ') AS s FROM ten, (SELECT DISTINCT l FROM win) WHERE len(next) >= l
), found AS MATERIALIZED (
    SELECT seen.r, seen.l, seen.i, win.item_id FROM seen JOIN win ON seen.l = win.l AND seen.s = win.s
), hit AS (
    SELECT r, count(DISTINCT i + k) AS n FROM found, range(10) AS t(k) WHERE k < l GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

#: The four letters of base 32 that five hexadecimal digits make.
_QUAD = "(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * g + 1, 5))::INT >> (15 - 5 * k)) & 31) + 1, 1), '' ORDER BY g, k) FROM range(8) AS a(g), range(4) AS b(k))"

WARC = f"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages
), last AS (
    SELECT payload, max(page_id) AS last, sha1(payload) AS hex FROM p GROUP BY payload
), digest AS (
    SELECT payload, last, {_QUAD} AS digest FROM last
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN last IS NULL OR page_id = last THEN NULL ELSE last END AS refers_to
FROM p JOIN digest USING (payload)
"""

ORACLE_SQL = {
    "op3_host_quality": HOST_QUALITY,
    "op4_substring_dedup": SUBSTRING_DEDUP,
    "op7_jaccard_join": JACCARD_JOIN,
    "op8_decontaminate": DECONTAMINATE,
    "op10_warc": WARC,
}
