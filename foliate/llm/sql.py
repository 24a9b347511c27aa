"""DuckDB forms of the corpus queries that SQL can express."""

OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS k FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM g),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE n > 1) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

OP3 = r"""
WITH t AS (SELECT doc_id, coalesce(length(text), 0) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS kept, sha256(norm) AS text_sha256
FROM t
"""

OP5 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS low FROM p)
SELECT page_id, strlen(body) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * g + 1)::INT, 5))::INT >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN low = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN low < page_id THEN low END AS refers_to
FROM first
"""

OP4 = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[s + 1 : s + 10] AS win FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
dw AS (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
h AS (SELECT DISTINCT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.w[dw.s + 1 : dw.s + dw.n] = iw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a AS doc_id, b AS node FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT doc_id, min(node) AS low FROM r GROUP BY 1)
SELECT s.doc_id, len(g) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id, least(s.doc_id, coalesce(low, s.doc_id)) = s.doc_id AS kept
FROM s LEFT JOIN c USING (doc_id)
"""

INTEGERS = """SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _codes() -> str:
    """Two rounds and the last assignment, each a step over all parts and entries."""
    steps = [
        f"v AS MATERIALIZED ({INTEGERS})",
        "p AS MATERIALIZED (SELECT vec_id, j, v[j * w + 1 : (j + 1) * w] AS x FROM (SELECT *, len(v) // 16 AS w, unnest(range(16)) AS j FROM v))",
        "b0 AS MATERIALIZED (SELECT j, n - 1 AS e, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM v) USING (vec_id) WHERE n <= 64)",
    ]
    for r in range(3):
        gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, j, arg_min(e, (d, e)) AS e, min(d) AS d, any_value(x) AS x FROM (SELECT vec_id, j, e, x, {gap} AS d FROM p JOIN b{r} USING (j)) GROUP BY vec_id, j)")
        if r < 2:
            mean = "SELECT j, e, list(m ORDER BY i) AS m FROM (SELECT j, e, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM (SELECT j, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY j, e, i) GROUP BY j, e"
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT j, e, coalesce(m, c) AS c FROM b{r} LEFT JOIN ({mean.replace('{r}', str(r))}) USING (j, e))")
    steps.append("o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)")
    steps.append("s AS (SELECT sha256(string_agg(c[i]::VARCHAR, ',' ORDER BY j, e, i)) AS codebooks_sha256 FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM b2))")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (vec_id), s"


OP13 = f"""
WITH v AS MATERIALIZED ({INTEGERS}),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES = {"op12_vector_codes": _codes(), "op13_top_products": OP13, "op1_substring_dedup": OP1, "op10_minhash": OP10, "op3_exact_dedup": OP3, "op4_decontaminate": OP4, "op5_warc": OP5}
