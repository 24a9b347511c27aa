"""DuckDB twins of the fixtures: common table expressions by name, with what each needs."""

from __future__ import annotations

from foliate.plans.fixtures import OBJECTS, STATUSES


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


CTES: dict[str, tuple[list[str], str]] = {
    "document": ([], f"""
        SELECT doc_id AS document_id, source AS project_id, doc_id % 7 AS user_id, 'doc_' || doc_id || '.' || (['pdf', 'png', 'docx', 'txt', 'csv', 'bin'])[doc_id % 6 + 1] AS file_name,
               ({_list(STATUSES)})[doc_id % 9 + 1] AS status, TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS created_at,
               CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) + INTERVAL 1 DAY END AS deleted_at FROM documents"""),
    "line": ([], """
        SELECT document_id, p::INT AS p, (p // 20 + 1)::INT AS page_number, regexp_replace(l[p + 1], '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS line
        FROM (SELECT doc_id AS document_id, l, unnest(range(len(l))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""),
    "marked_text": (["line"], """
        SELECT document_id, page_number, string_agg(CASE WHEN p % 11 = 0 THEN '# ' WHEN p % 11 = 4 THEN '## ' WHEN p % 11 = 7 THEN '### ' WHEN p % 5 = 3 THEN '- ' ELSE '' END || line || CASE WHEN p % 6 = 5 THEN chr(10) ELSE '' END, chr(10) ORDER BY p) AS raw_text
        FROM line GROUP BY ALL"""),
    "element": (["line"], """
        SELECT document_id, document_id || '_' || p AS block_id, NULL::VARCHAR AS parent_block_id, page_number,
               CASE WHEN p % 11 IN (0, 4, 7) THEN 'heading' WHEN p % 5 = 3 THEN 'bullet_list' WHEN p % 13 = 6 THEN 'table' WHEN p % 13 = 9 THEN 'image' WHEN p % 13 = 10 THEN 'caption' ELSE 'paragraph' END AS element_type,
               line AS content, p AS reading_order, CASE WHEN p % 11 = 0 THEN 1 WHEN p % 11 = 4 THEN 2 WHEN p % 11 = 7 THEN 3 ELSE 4 END AS level,
               [p::DOUBLE, 2.0 * p, p + 50.0, 2.0 * p + 10] AS bounding_box FROM line WHERE line <> ''"""),
    "chunk": (["line", "document"], """
        SELECT document_id * 1000 + p AS chunk_id, document_id, project_id, file_name, deleted_at, page_number, p AS chunk_index, line AS content FROM line JOIN document USING (document_id) WHERE line <> ''"""),
    "embedding": (["line"], """
        SELECT document_id * 1000 + p AS chunk_id, embedding, 'm' || (vec_id % 2) AS model_name
        FROM embeddings JOIN (SELECT document_id, min(p) AS p FROM line WHERE line <> '' GROUP BY 1) ON vec_id = document_id"""),
    "query": ([], """
        SELECT item_id * 5 + s AS query_id, 'src' || ((item_id * 5 + s) % 20) AS project_id, array_to_string((list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))[1:6], ' ') || '?' AS query_text, embedding AS query_vec
        FROM benchmark JOIN embeddings ON vec_id = item_id, range(5) AS r(s)"""),
    "entity": ([], """
        SELECT p_partkey AS entity_id, p_partkey % 3 AS project_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN '  ' || p_name ELSE p_name || ' ' END AS name,
               CASE WHEN p_partkey % 97 = 0 THEN 'unknown' WHEN p_partkey % 89 = 0 THEN NULL ELSE p_type END AS entity_type,
               CASE WHEN p_partkey % 2 = 1 THEN p_brand || ' ' || p_size END AS description, TIMESTAMP '2024-01-01' + to_minutes((p_partkey * 7 % 1000)::INT) AS created_at FROM part"""),
    "fact": ([], f"""
        SELECT o_orderkey AS fact_id, o_custkey % 3 AS project_id, o_custkey AS subject_id, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN lower(o_orderstatus) ELSE ' ' || o_orderstatus END AS predicate,
               ({_list(OBJECTS)})[o_orderkey % 12 + 1] AS object_text, 0.5::DOUBLE + (o_orderkey % 50)::DOUBLE / 100 AS confidence, (['unverified', 'verified', 'pending', 'conflicted', 'rejected'])[o_orderkey % 5 + 1] AS status,
               o_orderdate AS created_at, CASE WHEN o_orderkey % 23 = 0 THEN o_orderdate END AS deleted_at FROM orders"""),
    "evidence": (["fact", "chunk"], """
        SELECT DISTINCT fact_id, unnest(CASE WHEN fact_id % 7 = 0 THEN [a, b] ELSE [a] END) AS chunk_id, 'v' || fact_id AS verbatim
        FROM fact JOIN (SELECT document_id, min(chunk_id) AS a, max(chunk_id) AS b FROM chunk GROUP BY 1) c ON c.document_id = fact_id % (SELECT count(*) FROM documents)"""),
    "conflict": (["fact"], """
        SELECT subject_id AS conflict_id, subject_id % 3 AS project_id, x[1] AS first_fact_id, x[2] AS second_fact_id, CASE subject_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'active' WHEN 2 THEN 'ignored' ELSE 'resolved' END AS status
        FROM (SELECT subject_id, list_sort(list(fact_id)) AS x FROM fact WHERE deleted_at IS NULL GROUP BY 1) WHERE len(x) >= 2"""),
    "decision": (["conflict"], """
        SELECT conflict_id, CASE conflict_id % 3 WHEN 0 THEN 'resolve' WHEN 1 THEN 'ignore' ELSE 'merge' END AS action, CASE WHEN conflict_id % 5 = 0 THEN -1 WHEN conflict_id % 2 = 0 THEN first_fact_id ELSE second_fact_id END AS winner_id, 'merged ' || conflict_id AS merged_text FROM conflict"""),
    "question": (["fact"], """
        SELECT fact_id + 100000 AS question_id, project_id, fact_id, CASE fact_id % 8 WHEN 1 THEN 'low_confidence' ELSE 'missing_value' END AS trigger_type, CASE fact_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'answered' ELSE 'dismissed' END AS status,
               CASE WHEN fact_id % 5 = 0 THEN 'q' || fact_id ELSE '{"question":"q' || fact_id || '","priority":"high"}' END AS question FROM fact WHERE fact_id % 4 = 1"""),
    "review_log": ([], """
        SELECT event_id, event_id % 3000 AS fact_id, CASE event_type WHEN 'click' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'purchase' THEN 'modify' WHEN 'view' THEN 'undo' ELSE 'other' END AS action, ts AS created_at, 'new' || event_id AS new_object FROM events"""),
    "grid": ([], """
        SELECT p_partkey // 45 AS sheet_id, p_partkey % 45 + 2 + CASE WHEN (p_partkey // 45) % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 45 >= 20 THEN 1 ELSE 0 END AS rn, [p_name, p_brand, p_size::VARCHAR, p_retailprice::VARCHAR] AS cells FROM part
        UNION ALL SELECT DISTINCT p_partkey // 45, 1 + CASE WHEN (p_partkey // 45) % 2 = 0 THEN 1 ELSE 0 END, ['name', 'brand', 'size', 'price'] FROM part
        UNION ALL SELECT s, unnest(CASE WHEN s % 2 = 0 THEN [1, 23] ELSE [22, 48, 49, 50] END), ['', '', '', ''] FROM (SELECT DISTINCT p_partkey // 45 AS s FROM part)"""),
    "message": ([], "SELECT conv_id AS conversation_id, turn AS seq, role, text AS content FROM conversations"),
    "usage": ([], """
        SELECT event_id, user_id % 5 AS project_id, (['openai/gpt-oss-120b', 'llama-3.3-70b-versatile', 'gpt-4o-mini', 'claude-3-5-sonnet', 'gemini-1.5-pro', 'llama3', 'other'])[event_id % 7 + 1] AS model,
               json_extract_string(props, '$.k')::BIGINT * 100 AS prompt_tokens, floor(value * 10)::BIGINT AS completion_tokens FROM events"""),
}


def sql(needs: str, body: str) -> str:
    """The body after the expressions it needs, in order. Bodies that begin with WITH go on with the same list."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    body = body.strip()
    own = ""
    if body.upper().startswith("WITH RECURSIVE "):
        own, body = ", ", body[15:]
    elif body.upper().startswith("WITH "):
        own, body = ", ", body[5:]
    if not order:
        return ("WITH RECURSIVE " if own else "") + body
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + (own or " ") + body
