"""SQL for the training-data queries that SQL can express; plain and quadratic, for tables of a thousand documents."""

from __future__ import annotations

ORACLES = {
    "op5_line_dedup": r"""WITH l AS (SELECT doc_id, i AS pos, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10)))+1)) AS i)),
 w AS (SELECT doc_id, pos, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
 d AS (SELECT ws, len(ws) AS n, min((doc_id, pos)) AS place FROM w WHERE len(ws) > 0 GROUP BY ws),
 v AS (SELECT place, n, i, CASE WHEN i = 0 THEN ws ELSE list_concat(ws[1:i-1], ws[i+1:n]) END AS v FROM d, LATERAL (SELECT unnest(range(0, n+1)) AS i) WHERE n >= 8),
 f AS (SELECT place, i, min(CASE WHEN i > 0 THEN place END) OVER (PARTITION BY v, n, i) AS same, min(CASE WHEN i = 0 THEN place END) OVER (PARTITION BY v) AS short, min(CASE WHEN i > 0 THEN place END) OVER (PARTITION BY v) AS long FROM v),
 near AS (SELECT DISTINCT place FROM f WHERE (i > 0 AND (same < place OR short < place)) OR (i = 0 AND long < place)),
 t AS (SELECT w.doc_id, w.pos, w.line, len(w.ws) > 0 AS worded, len(w.ws) > 0 AND ((w.doc_id, w.pos) <> d.place OR d.place IN (SELECT place FROM near)) AS gone FROM w LEFT JOIN d ON w.ws = d.ws)
 SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) FILTER (worded) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM t GROUP BY doc_id""",
    "op6_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op7_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws)-4, least(len(ws), 1))+1)) AS i)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
 r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
 SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op11_filter_audit": r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 m AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS m FROM d),
 l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
 x AS (SELECT part, m, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
 b(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
 o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs FROM b p, b q, b r, b s, b t WHERE p.b | q.b | r.b | s.b | t.b = 31),
 s AS (SELECT filter_order, step, bs[step] AS f, coalesce(list_sum(bs[1:step-1]), 0)::INT AS before FROM o, LATERAL (SELECT unnest(range(1, 6))::INT AS step)),
 a AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (m & (before | f) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (m & before = 0 AND m & f <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (m & before <> 0 AND m & f <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (m = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (m & before = 0 AND m & f <> 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (m & before = 0 AND m & f <> 0 AND toxic), 0)::BIGINT AS toxic_lost FROM x, s GROUP BY ALL)
 SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM a""",
    "op13_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
 k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3),
 v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d),
 c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
 x AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
 y AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS n, sum(c) OVER (PARTITION BY lang, term) AS lc, sum(c) OVER (PARTITION BY lang) AS ln FROM x),
 p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v) AS p, 1 + (1000000000::HUGEINT * (lc + 1)) // (ln + v) AS q FROM y JOIN v USING (lang)),
 pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
 terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
 SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pairs
 UNION ALL SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= 200""",
}
