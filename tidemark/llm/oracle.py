"""SQL counterparts of the text queries that SQL can state."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark
), sized AS (
    SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents
), places AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
    SELECT r, i, p.n, item FROM places p JOIN windows v ON p.win = v.win AND p.n = v.n
), words AS (
    SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), found AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

WARC = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), w AS (
    SELECT page_id, n, d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) END AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM w
"""

URL_VERDICTS = r"""
WITH p AS (
    SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host,
           TIMESTAMP '2024-01-01' + to_minutes(page_id * 37 % 525600) AS t,
           list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'),
                       lambda s: s <> '') AS parts
    FROM pages
), hosts AS (
    SELECT *, string_split(host, '.') AS labels FROM p WHERE contains(host, '.')
), listed AS (
    SELECT DISTINCT 'domains' AS list, array_to_string(labels[-2:], '.') AS key, 'block' AS action FROM hosts
    UNION SELECT 'trusted', host, 'allow' FROM hosts
    UNION SELECT 'paths', host || '/' || parts[1], 'block' FROM hosts WHERE len(parts) > 0
), numbered AS (
    SELECT *, CAST('0x' || substr(md5(key), 1, 4) AS INTEGER) AS n FROM listed
), spans AS (
    SELECT list, key, action, a, b FROM (
        SELECT list, key, action, n % 6000 AS a, n % 6000 + 700 + n % 500 AS b FROM numbered
        UNION ALL SELECT list, key, action, n % 6000 + 1500 + n % 900, NULL FROM numbered)
), keys AS (
    SELECT page_id, t, unnest(list_concat(
        list_transform(range(1, greatest(len(labels), 2)), lambda i: array_to_string(labels[i:], '.')),
        list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS key
    FROM (SELECT *, string_split(host, '.') AS labels FROM p WHERE host <> '')
), active AS (
    SELECT page_id, s.list, s.key, s.action, row_number() OVER (PARTITION BY page_id ORDER BY
        len(string_split(s.key, '/')) DESC, len(string_split(string_split(s.key, '/')[1], '.')) DESC,
        s.action <> 'block', s.list, s.key) AS k
    FROM keys JOIN spans s USING (key)
    WHERE TIMESTAMP '2024-01-01' + to_hours(a) <= t AND (b IS NULL OR t < TIMESTAMP '2024-01-01' + to_hours(b))
)
SELECT page_id, CAST(epoch(p.t) AS BIGINT) AS fetched_s, coalesce(action, 'none') AS verdict, list, key
FROM p LEFT JOIN (SELECT * FROM active WHERE k = 1) USING (page_id)
"""

HARD_NEGATIVES = """
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.l AS anchor_l, b.vec_id AS id, b.l,
           CAST(list_dot_product(a.q, b.q) AS BIGINT) AS s
    FROM e a JOIN e b ON len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, s AS positive_score FROM s WHERE l = anchor_l AND id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5
)
SELECT anchor_id, positive_id, positive_score, id AS negative_id, s AS negative_score,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) AS INTEGER) AS rank
FROM p JOIN s USING (anchor_id)
WHERE l <> anchor_l AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
QUALIFY rank <= 3
"""

FILTER_INTERACTIONS = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), marks AS (
    SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic
    FROM labels GROUP BY doc_id
), masks AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
           + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER)
           + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
           + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask
    FROM d LEFT JOIN marks USING (doc_id)
), letters AS (
    SELECT chr(65 + i::INTEGER) AS letter, CAST(1 << i AS INTEGER) AS bit FROM range(5) r(i)
), prefixes AS (
    SELECT '' AS prefix, 0 AS applied, 0 AS bit, 0 AS before
    UNION ALL
    SELECT prefix || letter, applied | l.bit, l.bit, applied FROM prefixes p JOIN letters l ON p.applied & l.bit = 0
), steps AS (
    SELECT part, prefix, count(*) FILTER (mask & applied = 0) AS kept,
           count(*) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
           count(*) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
           count(*) FILTER (mask = bit) AS unique_fails,
           count(*) FILTER (mask & bit <> 0 AND mask & before = 0 AND good = 1) AS good_lost,
           count(*) FILTER (mask & bit <> 0 AND mask & before = 0 AND toxic = 1) AS toxic_lost
    FROM masks, prefixes WHERE bit > 0 GROUP BY part, prefix
), orders AS (
    SELECT prefix AS filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM prefixes WHERE length(prefix) = 5
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley
FROM orders JOIN steps ON prefix = substr(filter_order, 1, step)
"""

ORACLE = {
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_filter_interactions": FILTER_INTERACTIONS,
    "op6_url_filters": URL_VERDICTS,
    "op2_warc": WARC,
    "op4_decontaminate": DECONTAMINATE,
}
