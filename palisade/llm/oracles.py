"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = "reach(a, b) AS (SELECT id, id FROM {ids} UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x), root AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
both_ AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id),
links AS (SELECT x, y FROM both_ JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE c * 5 >= (p.n + q.n - c) * 4),
{_REACH.format(ids='w')}
SELECT w.id AS doc_id, root.m AS class_id, (SELECT count(*) FROM links WHERE x = w.id) AS n_links, w.id = root.m AS kept FROM w JOIN root ON root.a = w.id
"""

EMBEDDINGS = f"""
WITH RECURSIVE e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 95e-2),
{_REACH.format(ids='e')}
SELECT e.id AS vec_id, (SELECT count(*) FROM links WHERE x = e.id) AS n_links, root.m AS component_id, e.id = root.m AS kept FROM e JOIN root ON root.a = e.id
"""

REPEATS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT win.doc_id, win.i + k.k AS j FROM win JOIN least ON win.h = least.h AND win.doc_id > least.m CROSS JOIN (SELECT unnest(range(0, 50)) AS k) k),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT each.doc_id, count(*) AS n, string_agg(each.word, ' ' ORDER BY each.j) AS t FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.j = each.j WHERE gone.j IS NULL GROUP BY each.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, len(w.ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_PIECES = f"regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')"
PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest({_PIECES}), '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT lang, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i:i+1], ' ')), list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')))) AS g FROM p),
grams AS (SELECT lang, g, count(*) AS n FROM g GROUP BY lang, g HAVING count(*) >= 10),
totals AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, g, n AS a, string_split(g, ' ') AS w FROM grams WHERE contains(g, ' ')),
cuts AS (SELECT lang, g, a, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k+1:], ' ') AS y FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < len(w)),
scored AS (SELECT c.lang, c.g, a, p.n AS l, q.n AS r, k, (1000000::HUGEINT * a * a) // (p.n::HUGEINT * q.n) AS score FROM cuts c JOIN grams p ON p.lang = c.lang AND p.g = x JOIN grams q ON q.lang = c.lang AND q.g = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
parts AS (SELECT lang, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) AS g, a FROM c WHERE len(w) = 3),
longest AS (SELECT lang, g, max(a) AS m FROM parts GROUP BY lang, g),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank FROM best b LEFT JOIN longest o ON o.lang = b.lang AND o.g = b.g WHERE m IS NULL OR 100 * m < 50 * a)
SELECT r.lang, rank, r.g AS phrase, a, l, r, t.n::BIGINT AS n, score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""

HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id AS id, b.label AS bl, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND al <> bl AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
