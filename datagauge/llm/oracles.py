"""DuckDB SQL for the operators that SQL can express."""

OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), u AS MATERIALIZED (SELECT vec_id, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM v),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.95),
r(id, x) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a), c AS (SELECT id, min(x) AS m FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, least(vec_id, coalesce(m, vec_id)) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.id = vec_id"""

OP3 = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END)) AS g FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
h AS MATERIALIZED (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)), l AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(id, x) AS (SELECT a, b FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.x = l.a), c AS (SELECT id, min(x) AS m FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""

OP10 = """
WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, h, unnest(range(n - 199)) AS p FROM t WHERE n >= 200), k AS MATERIALIZED (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 400)) AS k FROM p),
m AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1), x AS (SELECT doc_id, p, p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 200 AS first FROM k SEMI JOIN m USING (k)),
i AS (SELECT doc_id, p, sum(CAST(first AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM x), s AS (SELECT doc_id, island, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY ALL),
e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM s),
f AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, count(*) AS spans, sum(b - a) AS removed FROM e JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN f USING (doc_id)"""

ORACLES = {"op2_embedding_dedup": OP2, "op3_minhash_dedup": OP3, "op10_suffix_dedup": OP10}
