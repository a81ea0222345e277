"""SQL for DuckDB with the rows of the queries that SQL can express on whole tables.

op1, op3, op8 and op9 need a tokeniser or a trained model, op5's verdict a learned list, op10's added
spans a CRC-32 in base 62; tests hold these against brute force.
"""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ITEM_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SUFFIX = """
WITH t AS (SELECT doc_id, hex(coalesce(text, '')) AS h, length(hex(coalesce(text, ''))) // 2 AS n FROM documents
), c AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 1122) AS h FROM (SELECT *, unnest(range(0, n, 512)) AS c FROM t)
), s AS (SELECT doc_id, c + i AS i, substr(h, 2 * i - 1, 100) AS x FROM (SELECT *, unnest(range(1, least(512, n - c - 49) + 1)) AS i FROM c WHERE n - c >= 50)
), f AS (SELECT x, min(doc_id) AS d FROM s GROUP BY x HAVING min(doc_id) < max(doc_id)
), r AS (SELECT s.doc_id, s.i FROM s JOIN f USING (x) WHERE s.doc_id > f.d
), o AS (SELECT doc_id, c + i AS p, substr(h, 2 * i - 1, 2) AS b FROM (SELECT *, unnest(range(1, least(512, n - c) + 1)) AS i FROM c)
), p AS (SELECT o.*, max(r.i) OVER (PARTITION BY o.doc_id ORDER BY o.p) AS last FROM o LEFT JOIN r ON r.doc_id = o.doc_id AND r.i = o.p
), g AS (SELECT *, coalesce(last > p - 50, false) AS gone FROM p
), e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS head FROM g
), k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY p) FILTER (NOT gone), ''))) AS kept_sha256 FROM e GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, coalesce(k.kept_sha256, sha256('')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_WORDS}) AS ws FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c.c >= 90 * (x.n + y.n - c.c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a
), k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""

PHRASES = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents
), c AS (SELECT doc_id, c, ws[c + 1 : c + 531] AS ws FROM (SELECT *, unnest(range(0, len(ws) - 19, 512)) AS c FROM w WHERE len(ws) >= 20)
), s AS (SELECT doc_id, c + i AS i, array_to_string(ws[i : i + 19], ' ') AS x FROM (SELECT *, unnest(range(1, least(512, len(ws) - 19) + 1)) AS i FROM c)
), r AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1
), p AS (SELECT w.doc_id, w.p, w.word, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS last FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.p
), g AS (SELECT *, coalesce(last > p - 20, false) AS gone FROM p
), k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.kept_sha256, sha256('')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

LEAKS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_ITEM_WORDS}) AS ws FROM documents
), i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(coalesce({_LOWER}, ''), {_ITEM_WORDS}) AS ws FROM benchmark
), b AS (SELECT DISTINCT item, k, array_to_string(ws[j : j + k - 1], ' ') AS x FROM (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0)
), s AS (SELECT doc_id, k, j, array_to_string(ws[j : j + k - 1], ' ') AS x FROM (SELECT w.doc_id, w.ws, l.k, unnest(range(1, len(w.ws) - l.k + 2)) AS j FROM w CROSS JOIN (SELECT DISTINCT k FROM b) l WHERE len(w.ws) >= l.k)
), h AS (SELECT s.doc_id, s.j, s.k, b.item FROM s JOIN b ON b.k = s.k AND b.x = s.x
), c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

RUNS = rf"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws, string_split(doc_id::VARCHAR, '') AS cs FROM documents
), h AS (SELECT doc_id, ws, len(ws) AS n, xor(list_reduce(list_concat([4294967295], list_transform(cs, lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM d CROSS JOIN crc
), g AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM h
), w AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(ws[: a], list_transform(range(a, n), lambda i: ws[a + (i - a) % (1 + (n - a) // (3 + e)) + 1])) ELSE ws END AS ws FROM g
), u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i, len(ws) AS n FROM w
), m AS (SELECT x.doc_id, y.i - x.i AS q, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS k FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM m GROUP BY doc_id, q, k HAVING count(*) >= 3 * q AND count(*) + q >= 6
), r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length
), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1
), l AS (SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id
), x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN x ON x.doc_id = u.doc_id AND x.i = u.i GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(l.n, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(l.runs, '')) AS runs_sha256, sha256(coalesce(k.kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) % 32 + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

REVISITS = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), m AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m"""

NEGATIVES = """
WITH e AS (SELECT vec_id::BIGINT AS v, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT a.v AS a, b.v AS b, a.l = b.l AS same, list_inner_product(a.x, b.x)::BIGINT AS s FROM e a JOIN e b ON a.v % 100 = 0 AND a.v <> b.v AND len(a.x) = len(b.x)
), p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
), w AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INTEGER AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same WHERE 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT * FROM w WHERE rank <= 10"""

SQL = {"op11_periodic_runs": RUNS, "op12_warc": REVISITS, "op13_hard_negatives": NEGATIVES, "op2_suffix_dedup": SUFFIX, "op4_jaccard_join": JACCARD, "op6_phrase_dedup": PHRASES, "op7_decontamination": LEAKS}
