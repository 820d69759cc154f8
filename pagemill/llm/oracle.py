"""DuckDB SQL for those queries of the ten problems that SQL can express over whole tables."""

_WS = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

ORACLE = {
    "p3_found": rf"""
WITH t AS (SELECT document_id, page_no, min(text) AS t FROM document_pages WHERE text IS NOT NULL GROUP BY ALL),
c AS (
  SELECT id, document_id, page_no, ordinal, coalesce(char_start, 0) AS cs, coalesce(char_end, 0) AS ce,
         coalesce(text, '') AS x, coalesce(embed_text, '') AS e
  FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, char_start, char_end, text, embed_text) = 1),
w AS (
  SELECT c.*, coalesce(t.t, '') AS t, lag(cs) OVER o AS prev,
         coalesce(max(ce) OVER (PARTITION BY c.document_id, c.page_no ORDER BY ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach
  FROM c LEFT JOIN t USING (document_id, page_no) WINDOW o AS (PARTITION BY c.document_id, c.page_no ORDER BY ordinal, id)),
v AS (
  SELECT *, substring(t, cs + 1, greatest(ce - cs, 0)) AS own,
         CASE WHEN prev IS NULL THEN cs ELSE greatest(prev, cs - 60, 0) END AS s,
         [substring(t, p, 1) FOR p IN [cs, cs + 1, ce, ce + 1]] AS ch FROM w),
f AS (
  SELECT id, unnest([
    CASE WHEN ce - cs > 700 THEN 'oversized' END,
    CASE WHEN regexp_matches(own, '{_WS}') AND (
           (cs > 0 AND ch[1] <> '' AND ch[2] <> '' AND NOT regexp_matches(ch[1], '{_WS}') AND NOT regexp_matches(ch[2], '{_WS}'))
        OR (ce > 0 AND ch[3] <> '' AND ch[4] <> '' AND NOT regexp_matches(ch[3], '{_WS}') AND NOT regexp_matches(ch[4], '{_WS}'))) THEN 'mid_word' END,
    CASE WHEN own <> x THEN 'stale' END,
    CASE WHEN cs > reach AND regexp_replace(substring(t, reach + 1, cs - reach), '{_WS}', '', 'g') <> '' THEN 'gap' END,
    CASE WHEN e <> substring(t, s + 1, cs - s) || x THEN 'overlap' END]) AS kind FROM v)
SELECT id, kind FROM f WHERE kind IS NOT NULL
""",
    "p4_found": r"""
WITH r AS (
  SELECT DISTINCT 'page' AS kind, document_id || ':' || page_no AS key, text FROM document_pages WHERE text IS NOT NULL
  UNION SELECT DISTINCT 'chunk', id, text FROM chunks WHERE text IS NOT NULL),
w AS (SELECT kind, key, row_number() OVER () AS n, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM r),
s AS (SELECT kind, key, n, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 30),
e AS (SELECT kind, key, n, len(s) AS m, unnest(s) AS t FROM s),
p AS (SELECT a.key AS key_a, b.key AS key_b, any_value(a.m) + any_value(b.m) AS m, count(*) AS c FROM e a JOIN e b ON a.kind = b.kind AND a.t = b.t AND a.key < b.key GROUP BY a.key, b.key, a.n, b.n)
SELECT DISTINCT key_a, key_b FROM p WHERE c >= 0.4 * (m - c)
""",
    "p6_found": """
WITH f AS (SELECT vectors_path, min({'model': model, 'dim': dim}) AS f FROM document_embeddings WHERE model IS NOT NULL GROUP BY 1),
v AS (SELECT f.model AS model, chunk_id, min(dense)::DOUBLE[] AS v FROM vector_rows JOIN f USING (vectors_path)
      WHERE chunk_id IS NOT NULL AND len(dense) = f.dim AND list_sum(list_transform(dense, lambda x: x::DOUBLE * x)) > 0 GROUP BY 1, 2),
c AS (SELECT a.chunk_id AS x, b.chunk_id AS y, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM v a JOIN v b ON a.model = b.model AND a.chunk_id <> b.chunk_id),
k AS (SELECT x, y FROM c WHERE s >= 0.9 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 5)
SELECT least(x, y) AS chunk_a, greatest(x, y) AS chunk_b FROM k GROUP BY 1, 2 HAVING count(*) = 2
""",
}
