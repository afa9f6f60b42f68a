"""SQL with the rows of the thin queries, where SQL can express them."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS o
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
c AS (
  SELECT *, 1.5::DOUBLE * (sum(n) OVER ())::DOUBLE AS total,
         coalesce(sum(2.0::DOUBLE * n) OVER before, 0)::DOUBLE AS capped,
         ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0))::DOUBLE AS weight,
         2.0::DOUBLE * n / w AS bend, row_number() OVER ordered AS i
  FROM s
  WINDOW ordered AS (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST),
         before AS (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT i, (total - capped) / weight AS level FROM c
  WHERE (total - capped) / weight <= bend ORDER BY i LIMIT 1),
t AS (
  SELECT source, n, CASE WHEN c.i >= l.i THEN level * w ELSE 2.0::DOUBLE * n END AS target
  FROM c LEFT JOIN l ON true),
q AS (
  SELECT source, n, coalesce(target, 2.0::DOUBLE * n) AS target,
         CASE WHEN n > 0 THEN floor(target + 0.5)::BIGINT // n ELSE 0 END AS times,
         CASE WHEN n > 0 THEN floor(target + 0.5)::BIGINT % n ELSE 0 END AS rest FROM t),
r AS (
  SELECT d.*, q.n AS source_size, q.target, q.times, q.rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (times + CASE WHEN rest > 0 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
""",
    "op7_decontamination": rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS phrase, least(len(w), 10) AS n
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS phrase
  FROM d, lens, unnest(range(1, len(w) - n + 2)) AS u(i)),
m AS (SELECT rid, i, g.n, item_id FROM grams g JOIN win USING (phrase, n)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS u(p) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
""",
    "op2_suffixes": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL),
t AS (SELECT text, any_value(w) AS w, count(*) AS copies FROM d GROUP BY text HAVING len(any_value(w)) >= 50),
g AS (
  SELECT text, i, hash(array_to_string(w[i:i+49], ' ')) AS h
  FROM t, unnest(range(1, len(w) - 48)) AS u(i)),
r AS (SELECT h FROM g GROUP BY h HAVING count(DISTINCT text) > 1),
p AS (SELECT DISTINCT text, x FROM g JOIN r USING (h), unnest(range(i - 1, i + 49)) AS u(x)),
runs AS (SELECT text, x, x - row_number() OVER (PARTITION BY text ORDER BY x) AS run FROM p),
spans AS (SELECT text, min(x) AS a, max(x) + 1 AS z FROM runs GROUP BY text, run)
SELECT doc_id, 0 AS start, len(t.w)::INT AS "end", true AS whole FROM d JOIN t USING (text) WHERE copies > 1
UNION ALL
SELECT doc_id, a::INT, z::INT, false FROM d JOIN t USING (text) JOIN spans USING (text) WHERE copies = 1
""",
    "op5_topk": r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.rid AS rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op9_lines": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, dense_rank() OVER (ORDER BY doc_id, text) AS doc FROM documents),
parts AS (SELECT rid, doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (
  SELECT rid, doc, i, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w
  FROM parts),
k AS MATERIALIZED (SELECT rid, doc, i, w, dense_rank() OVER (ORDER BY w) AS line FROM l WHERE len(w) >= 3),
n AS MATERIALIZED (SELECT line, any_value(w) AS w, len(any_value(w)) AS size, any_value(w)[1:3] AS lead, count(DISTINCT doc) AS n_docs FROM k GROUP BY line),
t AS (SELECT line, size, lead, n_docs, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM n),
f AS (SELECT size, lead, pos, tok FROM t GROUP BY size, lead, pos, tok HAVING sum(n_docs) >= 10),
p AS (SELECT line, size, lead, list(pos || ' ' || tok ORDER BY pos) AS kept FROM t JOIN f USING (size, lead, pos, tok) GROUP BY line, size, lead HAVING count(*) >= 0.7 * size - 1e-9),
q AS (SELECT size, lead, kept FROM k JOIN p USING (line) GROUP BY size, lead, kept HAVING count(DISTINCT doc) >= 10),
r AS (SELECT DISTINCT rid, i FROM k JOIN p USING (line) JOIN q USING (size, lead, kept)),
o AS (SELECT rid, count(*) AS n_dropped FROM r GROUP BY rid),
left_ AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS rest FROM parts ANTI JOIN r USING (rid, i) GROUP BY rid)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::INT AS n_lines, coalesce(n_dropped, 0)::INT AS n_dropped,
       CASE WHEN n_dropped IS NULL THEN text ELSE coalesce(rest, '') END AS text
FROM d LEFT JOIN o USING (rid) LEFT JOIN left_ USING (rid)
""",
    "op8_toolcalls": r"""
WITH RECURSIVE c AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, turn, CASE role WHEN 'system' THEN 'configure' ELSE 'answer' END AS name, role, text
  FROM conversations WHERE role IN ('system', 'user')),
r AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn AS result_turn, text AS content FROM conversations WHERE role = 'assistant'),
l AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, turn, result_turn, name, role, text, content,
         CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id),
lev AS (
  SELECT conv_id, call_id, turn, 0 AS level FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.call_id, c.turn, lev.level + 1 FROM c JOIN lev ON c.conv_id = lev.conv_id AND c.turn = lev.turn + 2)
SELECT l.conv_id, l.call_id, l.turn, result_turn, name, status, 0::BIGINT AS repeats, level,
       row_number() OVER (PARTITION BY l.conv_id ORDER BY level NULLS LAST, l.turn NULLS LAST, l.call_id, result_turn, content) - 1 AS position,
       CASE WHEN status = 'orphan' THEN 'no call' WHEN text IS NULL THEN 'text not string' ELSE '' END AS faults,
       json_object('arguments', CASE WHEN status <> 'orphan' THEN json_object('role', role, 'text', text, 'turn', l.turn) END,
                   'call_id', l.call_id, 'content', content, 'name', name, 'status', status)::VARCHAR AS json
FROM l LEFT JOIN lev USING (conv_id, call_id)
""",
}
