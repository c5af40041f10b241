"""SQL for the results of the text queries that SQL can express."""

#: Rows of equal normalised texts.
EXACT_GROUPS = r"""
WITH hashed AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents
), groups AS (
    SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM hashed JOIN groups USING (text_sha256)
"""

#: All pairs of different shingle sets compared, and the connected ones walked.
NEAR_DUPLICATES = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS words FROM documents
), s AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5
        THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS shingles FROM w
), c AS (
    SELECT min(doc_id) AS copy_id, count(*) AS n_copies, shingles FROM s GROUP BY shingles
), u AS (
    SELECT copy_id, len(shingles) AS n, unnest(shingles) AS shingle FROM c
), p AS (
    SELECT a.copy_id AS a, b.copy_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.copy_id < b.copy_id
    GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))
), e AS (
    SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
    WITH RECURSIVE reach AS (
        SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
    ) SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a
), l AS (
    SELECT a, count(*) AS n_links FROM e GROUP BY a
)
SELECT s.doc_id, coalesce(r.class_id, c.copy_id) AS class_id, c.copy_id, c.n_copies, coalesce(l.n_links, 0) AS n_links
FROM s JOIN c USING (shingles) LEFT JOIN r ON r.a = c.copy_id LEFT JOIN l ON l.a = c.copy_id
"""

#: Base forms and Markov models with the parameters of ``secrets.Markov``.
SECRETS = r"""
WITH forms AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS named_values
    FROM documents
), patterns(number, kind, pattern) AS (VALUES
    (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    (1, 'access', 'AKIA[A-Z0-9]{14,}'), (2, 'hex', '[0-9a-f]{16,}'), (3, 'random', '[A-Za-z0-9+/_=-]{16,}')
), pieces AS (
    SELECT doc_id, number, kind, named_values, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS parts FROM forms, patterns
), placed AS (
    SELECT doc_id, number, kind, unnest(range(1, len(found) + 1)) AS k, found, parts, named_values FROM pieces
), spans AS (
    SELECT doc_id, number, kind, found[k] AS token, named_values[k] AS own_value,
        CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM placed
), base AS (
    SELECT doc_id, number, kind, token, own_value, start, start + length(token) AS stop FROM spans
    WHERE kind IN ('access', 'hex') OR kind = 'assign' AND length(own_value) >= 12
), samples AS (
    SELECT doc_id, own_value AS token FROM spans WHERE kind = 'assign' AND length(own_value) >= 16
    UNION SELECT doc_id, token FROM spans WHERE kind IN ('access', 'hex')
), labelled AS (
    SELECT true AS random, token FROM samples
    UNION SELECT false, t.token FROM spans t WHERE t.kind = 'random'
        AND NOT EXISTS (SELECT 1 FROM samples v WHERE v.doc_id = t.doc_id AND (contains(t.token, v.token) OR contains(v.token, t.token)))
), pairs AS (
    SELECT random, unnest(list_transform(range(1, length(token)), lambda i: token[i:i + 1])) AS pair FROM labelled
), counts AS (
    SELECT random, pair, count(*) - CASE WHEN random THEN 0 ELSE 1 END AS n FROM pairs GROUP BY random, pair
), alphabet AS (
    SELECT unnest(string_split('+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz', '')) AS c
), every AS (
    SELECT f.random, a.c AS x, b.c AS y, coalesce(n, 0) AS n FROM (VALUES (true), (false)) f(random), alphabet a, alphabet b
    LEFT JOIN counts ON counts.random = f.random AND counts.pair = a.c || b.c
), single AS (
    SELECT random, y, (sum(n) + 0.5::DOUBLE) / (sum(sum(n)) OVER (PARTITION BY random) + 0.5::DOUBLE * 67) AS p FROM every GROUP BY random, y
), first AS (
    SELECT random, x, sum(n) AS seen FROM every GROUP BY random, x
), odds AS (
    SELECT random, x || y AS pair, (n + 30.0::DOUBLE * p) / (seen + 30.0::DOUBLE) AS q FROM every JOIN single USING (random, y) JOIN first USING (random, x)
), ratios AS (
    SELECT pair, ln(max(q) FILTER (WHERE random) / max(q) FILTER (WHERE NOT random)) AS ratio FROM odds GROUP BY pair
), tokens AS (
    SELECT DISTINCT token FROM spans WHERE kind = 'random'
), judged AS (
    SELECT token FROM (SELECT token, unnest(list_transform(range(1, length(token)), lambda i: token[i:i + 1])) AS pair FROM tokens) JOIN ratios USING (pair)
    GROUP BY token HAVING sum(ratio) >= 10
), findings AS (
    SELECT doc_id, number, kind, start, stop FROM base
    UNION ALL SELECT t.doc_id, t.number, t.kind, t.start, t.start + length(t.token) FROM spans t SEMI JOIN judged USING (token)
    WHERE t.kind = 'random' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = t.doc_id AND b.start < t.start + length(t.token) AND b.stop > t.start)
), listed AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
        count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'random') AS n_random,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number, stop) FILTER (WHERE kind <> 'random') AS base_text,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, number, stop) AS spans FROM findings GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_random, 0) AS n_random,
    sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed ON listed.doc_id = d.doc_id
"""

#: Every document scored for every item.
RANKED_SEARCH = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), counted AS (
    SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term
), lengths AS (
    SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id
), whole AS (
    SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole
), parts AS (
    SELECT c.doc_id, c.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * texts) // whole.terms)))) AS part
    FROM counted c JOIN lengths USING (doc_id) JOIN weights USING (term), whole
), asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id HAVING sum(part) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

#: Every anchor measured with every row.
HARD_NEGATIVES = r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
    SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
