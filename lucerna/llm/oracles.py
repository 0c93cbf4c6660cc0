"""SQL of the numbered queries that SQL can express, for the same tables."""

import string

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP1 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.a, reach.r FROM p JOIN reach ON p.b = reach.id),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT v.vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.id = v.vec_id"""

OP5 = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, pos, line, f.key IS NOT NULL AND last <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

OP6 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 49)) AS p FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE first < w.doc_id),
g AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM g),
spans AS (SELECT doc_id, span, min(p) AS lo, max(p) + 50 AS hi FROM r GROUP BY 1, 2),
gaps AS (SELECT s.doc_id, s.lo AS place, substr(h, 2 * coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0) + 1, 2 * (lo - coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0))) AS piece FROM spans s JOIN d USING (doc_id)
  UNION ALL SELECT d.doc_id, 1000000000, substr(h, 2 * coalesce(last, 0) + 1) FROM d LEFT JOIN (SELECT doc_id, max(hi) AS last FROM spans GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY place) AS k FROM gaps GROUP BY 1)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(k)) / 2 AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM spans GROUP BY 1) USING (doc_id)"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT p.a, reach.r FROM p JOIN reach ON p.b = reach.id),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP11 = """WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""

#: CRC32 of the decimal id; fixed values: the reflected polynomial 0xEDB88320 and the start and end mask.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)
OP12 = f"""WITH t AS (SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(m ORDER BY p) AS own FROM t GROUP BY c),
h AS (SELECT c, own, {_CRC} % 4 AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.own[:h], []), h.own[h + 1:]) AS s FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
m AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r),
n AS (SELECT s[:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN len(s) = d THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM m GROUP BY 1, 2),
w AS (SELECT *, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].text, '[^\\x20\\x09-\\x0D]+')) END AS own FROM n),
kids AS (SELECT k[:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
up AS (SELECT unnest(list_transform(range(0, d + 1), lambda e: w.k[:e])) AS k, own, (kids.k IS NULL)::INT AS leaf FROM w LEFT JOIN kids ON kids.k = w.k),
sub AS (SELECT k, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM up GROUP BY 1)
SELECT w.conv_id, w.d AS depth, a.conv_id AS parent_conv_id, w.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(w.ends) AS ends_sha256
FROM w JOIN sub ON sub.k = w.k LEFT JOIN kids ON kids.k = w.k LEFT JOIN n a ON w.d > 0 AND a.k = w.k[:w.d - 1]"""

ORACLES = {"op1_embedding_dedup": OP1, "op5_line_dedup": OP5, "op6_suffix_dedup": OP6, "op8_decontamination": OP8, "op9_minhash_dedup": OP9, "op11_exact_topk": OP11, "op12_prefix_trie": OP12}
