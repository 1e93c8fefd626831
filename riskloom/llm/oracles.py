"""DuckDB forms of the queries that SQL can express. They compare everything with everything: small tables only."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM doc),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM shingled),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM pair WHERE 100 * k >= 80 * (n + m - k)),
step AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM shingled JOIN least_id USING (doc_id)"""

REPEATED_SUBSTRINGS = r"""
WITH doc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 49)) AS p, x FROM doc WHERE len(x) >= 100),
str AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM win),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS f FROM str) WHERE doc_id > f),
mark AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM hit),
run AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM mark),
span AS (SELECT doc_id, r, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY ALL),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM span),
cut AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
         string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept FROM piece JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id)"""

HARD_NEGATIVES = r"""
WITH vec AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score
  FROM vec a JOIN vec x ON a.vec_id <> x.vec_id WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pair n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
QUALIFY rank <= 5"""

PREFIX_TRIE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM said),
conv AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base,
  CAST(conv_id AS VARCHAR) AS s FROM own),
-- CRC-32 of the decimal id, byte by byte, modulo 4.
crc AS (
  SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::UBIGINT)),
    lambda r, c: xor(r >> 8, list_reduce(list_prepend(xor(r, c) & 255, list_transform(range(8), lambda k: 0::UBIGINT)),
      lambda t, z: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::UBIGINT) ELSE t >> 1 END))), 4294967295::UBIGINT) % 4 AS h FROM conv),
built AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.id, o.text FROM crc c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.id, o.text FROM crc c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h),
seq AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(id, '') OVER w AS path,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
way AS (SELECT conv_id, depth, path, words FROM seq UNION ALL SELECT conv_id, 0, '', 0 FROM conv),
size AS (SELECT conv_id, max(depth) AS n FROM way GROUP BY 1),
node AS (
  SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM way JOIN size USING (conv_id) GROUP BY depth, path),
child AS (SELECT left(path, 32 * (depth - 1)) AS up, depth - 1 AS depth, count(*) AS k FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT n.*, coalesce(k, 0) AS k FROM node n LEFT JOIN child c ON c.up = n.path AND c.depth = n.depth),
above AS (SELECT n.depth, n.k, n.n_convs, n.words, unnest(range(0, n.depth + 1)) AS d, n.path FROM full_node n),
total AS (
  SELECT d AS depth, left(path, 32 * d) AS path, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM above GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.k AS BIGINT) AS n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN total t ON t.depth = n.depth AND t.path = n.path
LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = left(n.path, 32 * (n.depth - 1))"""


def license_notices(templates, phrases, containment, step) -> str:
    """Every block of every text against every template; the templates are literal rows."""
    quoted = ", ".join(f"({k}, '{label}', '{text.lower()}')" for k, (label, text) in enumerate(templates))
    places = ", ".join(f"('{label}', string_split('{text}', ' '))" for text, label in phrases)
    lower, word = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH doc AS (SELECT doc_id, list_filter(string_split_regex({lower}, '{word}'), lambda w: w <> '') AS w FROM documents),
template AS (SELECT k, label, list_distinct(list_filter(string_split_regex(t, '{word}'), lambda w: w <> '')) AS s FROM (VALUES {quoted}) v(k, label, t)),
larger AS (SELECT a.k, list(b.k) AS more FROM template a JOIN template b ON len(a.s) < len(b.s) AND list_has_all(b.s, a.s) GROUP BY a.k),
block AS (SELECT doc_id, b, list_distinct(w[b * {step} + 1:(b + 2) * {step}]) AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(1, (len(w) + {step} - 1) // {step} - 1))) AS b FROM doc)),
met AS (SELECT doc_id, b, k, label, len(list_intersect(block.s, t.s)) AS c, len(t.s) AS n FROM block JOIN template t
  ON len(list_intersect(block.s, t.s)) * {containment.denominator} >= len(t.s) * {containment.numerator}),
own AS (SELECT doc_id, list(label) AS labels, max(c / n) AS score
  FROM (SELECT m.*, list(k) OVER (PARTITION BY doc_id, b) AS here, more FROM met m LEFT JOIN larger USING (k))
  WHERE more IS NULL OR NOT list_has_any(here, more) GROUP BY doc_id),
place AS (SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, label, p, w, unnest(range(1, len(w) + 1)) AS i FROM doc, (VALUES {places}) v(label, p))
  WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list(label) AS labels FROM place GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list_distinct(base.labels)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.labels, own.labels))), ','), '') AS labels,
       CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(own.score, 0) END AS DOUBLE) AS score
FROM doc LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)"""
