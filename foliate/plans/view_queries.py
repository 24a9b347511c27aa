"""Queries over listings, data quality, conversations and event logs, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate import sources
from foliate.operators import conversations, events, quality, views
from foliate.plans.fixtures import Fixtures
from foliate.plans.fixtures_sql import sql

QUERIES, ORACLES = {}, {}


def query(needs: str | None = None, oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = sql(needs or "", oracle)
        return f

    return add


@query("document", "WITH m AS (SELECT * FROM document WHERE project_id = 'src2' AND contains(lower(file_name), '2') AND created_at >= TIMESTAMP '2024-01-03') SELECT document_id, file_name, (SELECT count(*) FROM m) AS total FROM m ORDER BY created_at DESC, document_id OFFSET 5 LIMIT 10")
def b02_list_documents(x: Fixtures) -> DataFrame:
    return views.list_documents(x.document(), project="src2", text="2", since="2024-01-03", until="not a date", skip=5, limit=10).select("document_id", "file_name", "total")


@query("fact entity evidence chunk", """WITH v AS (SELECT fact_id, list(DISTINCT lower(file_name)) AS files FROM evidence JOIN chunk USING (chunk_id) GROUP BY 1)
SELECT fact_id, confidence FROM fact LEFT JOIN entity ON entity_id = subject_id LEFT JOIN v USING (fact_id) WHERE confidence >= 0.7 AND status = 'verified' AND (contains(lower(name), 'mg') OR contains(lower(entity_type), 'mg') OR contains(lower(predicate), 'mg') OR contains(lower(object_text), 'mg') OR len(list_filter(files, lambda f: contains(f, 'mg'))) > 0)""")
def b03_browse_facts(x: Fixtures) -> DataFrame:
    return views.browse_facts(x.fact(), x.entity(), x.evidence(), x.chunk(), "MG", "verified", 0.7).select("fact_id", "confidence")


@query("", "SELECT doc_id, len(regexp_extract_all(text, '(?i)the\\.'))::INT AS n, regexp_replace(text, '(?i)(the\\.)', '<mark>\\1</mark>', 'g') AS marked FROM documents")
def b06_highlight(x: Fixtures) -> DataFrame:
    return x.t("documents").select("doc_id", views.match_count(F.col("text"), "the.").alias("n"), views.highlighted(F.col("text"), "the.").alias("marked"))


@query("document", """SELECT document_id, CASE WHEN status = 'cancelled' THEN 'cancelled' WHEN status = 'failed' THEN 'failed' WHEN status IN ('ready_for_chat', 'completed') THEN 'ready' ELSE 'running' END AS class,
CASE status WHEN 'uploaded' THEN 5 WHEN 'ocr_running' THEN 20 WHEN 'ready_for_chunking' THEN 40 WHEN 'chunking_running' THEN 40 WHEN 'ready_for_embedding' THEN 60 WHEN 'ready_for_chat' THEN 100 ELSE 0 END AS percent FROM document""")
def b08_status(x: Fixtures) -> DataFrame:
    return x.document().select("document_id", views.status_class(F.col("status")).alias("class"), views.progress(F.col("status")).alias("percent"))


MEMBER = "m AS (SELECT c_nationkey AS project_id, c_custkey AS user_id, CASE c_custkey % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'editor' ELSE 'viewer' END AS role FROM customer)"


def _members(x: Fixtures) -> DataFrame:
    return x.t("customer").selectExpr("c_nationkey AS project_id", "c_custkey AS user_id", "CASE c_custkey % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'editor' ELSE 'viewer' END AS role")


@query("", "WITH " + MEMBER + " SELECT project_id, user_id, c_name AS name, role, nth, owners FROM (SELECT m.*, c_name, row_number() OVER (PARTITION BY project_id ORDER BY user_id) AS nth, count(*) FILTER (role = 'owner') OVER (PARTITION BY project_id) AS owners FROM m JOIN customer ON c_custkey = user_id) WHERE nth > 5 AND nth <= 15")
def b09_roster(x: Fixtures) -> DataFrame:
    users = x.t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return views.roster(_members(x), users, 5, 10).select("project_id", "user_id", "name", "role", "nth", "owners")


@query("", "WITH " + MEMBER + " SELECT project_id, role FROM m WHERE user_id = 7")
def b09_projects(x: Fixtures) -> DataFrame:
    return views.projects_of(_members(x), 7)


CONV = "conv AS (SELECT conv_id AS conversation_id, conv_id % 50 AS document_id, CASE conv_id % 4 WHEN 0 THEN 'ARCHIVED' WHEN 1 THEN 'DELETED' ELSE 'ACTIVE' END AS status, max(turn) AS updated_at, arg_min(text, turn) AS title FROM conversations GROUP BY 1)"


def _conversations(x: Fixtures) -> DataFrame:
    rows = x.t("conversations").groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("turn").alias("updated_at"), F.min_by("text", "turn").alias("title"))
    return rows.withColumn("document_id", F.col("conversation_id") % 50).withColumn("status", F.expr("CASE conversation_id % 4 WHEN 0 THEN 'ARCHIVED' WHEN 1 THEN 'DELETED' ELSE 'ACTIVE' END"))


@query("", "WITH " + CONV + " SELECT conversation_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, conversation_id) AS position FROM conv WHERE status IN ('ACTIVE', 'ARCHIVED') AND contains(lower(title), 'e')")
def b10_conversations(x: Fixtures) -> DataFrame:
    return views.list_conversations(_conversations(x), True, "E").select("conversation_id", "document_id", "position")


@query("document message marked_text", "WITH " + CONV + """, l AS (SELECT document_id, arg_max(conversation_id, (updated_at, conversation_id)) AS conversation_id FROM conv WHERE status = 'ACTIVE' GROUP BY 1), s AS (SELECT conversation_id, list(role ORDER BY seq) AS roles FROM message GROUP BY 1), p AS (SELECT document_id, list(page_number ORDER BY page_number) AS pages FROM marked_text GROUP BY 1)
SELECT document_id, conversation_id, roles, pages FROM document LEFT JOIN l USING (document_id) LEFT JOIN s USING (conversation_id) LEFT JOIN p USING (document_id)""")
def b11_workspace(x: Fixtures) -> DataFrame:
    return views.workspace(x.document(), _conversations(x), x.message(), x.marked_text())


@query("document", "SELECT document_id, status, length(text)::INT AS n FROM document LEFT JOIN documents ON doc_id = document_id AND doc_id % 3 = 0")
def b13_detail(x: Fixtures) -> DataFrame:
    results = x.t("documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("document_id"), F.length("text").alias("n"))
    return views.with_result(x.document().select("document_id", "status"), results)


# ---- data quality

BAD = """bad AS (SELECT document_id, block_id, CASE WHEN reading_order % 10 = 2 THEN document_id || '_nowhere' WHEN reading_order % 10 = 3 THEN document_id || '_' || (reading_order + 1) WHEN reading_order % 10 = 4 THEN document_id || '_' || (reading_order - 1) WHEN reading_order % 10 = 5 THEN block_id WHEN reading_order % 10 = 6 THEN document_id || '_' || (reading_order - 1) END AS parent_block_id, page_number,
CASE WHEN reading_order % 10 = 7 THEN 'heading' ELSE element_type END AS element_type, CASE WHEN reading_order % 10 = 7 THEN '  ' ELSE content END AS content, CASE WHEN reading_order % 10 = 1 THEN -1 ELSE reading_order END AS reading_order,
CASE WHEN reading_order % 10 = 8 THEN bounding_box[1:3] WHEN reading_order % 10 = 9 THEN [bounding_box[3], bounding_box[2], bounding_box[1], bounding_box[4]] ELSE bounding_box END AS bounding_box FROM element)"""


def _bad(x: Fixtures) -> DataFrame:
    r = F.col("reading_order")
    other = lambda n: F.concat_ws("_", "document_id", r + n)
    parent = F.when(r % 10 == 2, F.concat(F.col("document_id"), F.lit("_nowhere"))).when(r % 10 == 3, other(1)).when(r % 10 == 4, other(-1)).when(r % 10 == 5, F.col("block_id")).when(r % 10 == 6, other(-1))
    b = F.col("bounding_box")
    box = F.when(r % 10 == 8, F.slice(b, 1, 3)).when(r % 10 == 9, F.array(b[2], b[1], b[0], b[3])).otherwise(b)
    return x.element().select("document_id", "block_id", parent.alias("parent_block_id"), "page_number", F.when(r % 10 == 7, "heading").otherwise(F.col("element_type")).alias("element_type"), F.when(r % 10 == 7, "  ").otherwise(F.col("content")).alias("content"), F.when(r % 10 == 1, -1).otherwise(r).alias("reading_order"), box.alias("bounding_box"))


PAGES = "badpages AS (SELECT document_id, page_number FROM marked_text WHERE NOT (document_id % 10 = 1 AND page_number = 2) AND document_id % 10 <> 3 UNION ALL SELECT document_id, 1 FROM marked_text WHERE document_id % 10 = 2 AND page_number = 1)"


def _pages(x: Fixtures) -> DataFrame:
    p = x.marked_text().select("document_id", "page_number")
    return p.filter("not (document_id % 10 = 1 and page_number = 2) and document_id % 10 <> 3").unionByName(p.filter("document_id % 10 = 2 and page_number = 1"))


DOCQ = """docq AS (SELECT document_id, 'DOC_NOT_FOUND' AS code, 'critical' AS severity, document_id::VARCHAR AS item FROM (SELECT document_id + 3 AS document_id FROM document) WHERE document_id NOT IN (SELECT document_id FROM document) UNION ALL SELECT document_id, 'DOC_STATUS_FAILED', 'critical', status FROM document WHERE status = 'failed' AND document_id >= 3
UNION ALL SELECT document_id, 'DOC_METADATA_MISSING', 'minor', document_id::VARCHAR FROM document WHERE document_id % 6 = 5 AND document_id >= 3)"""


def _typed(x: Fixtures) -> DataFrame:
    kind = sources.file_type(F.col("file_name"))
    return x.document().withColumn("file_type", F.when(kind != "unknown", kind))


@query("document", "WITH " + DOCQ + " SELECT * FROM docq")
def g01_document_rules(x: Fixtures) -> DataFrame:
    return quality.document_issues(x.document().select((F.col("document_id") + 3).alias("document_id")), _typed(x))


PAGEQ = """pageq AS (SELECT document_id, 'NO_PAGES_FOUND' AS code, 'critical' AS severity, document_id::VARCHAR AS item FROM document WHERE document_id NOT IN (SELECT document_id FROM badpages)
UNION ALL SELECT document_id, 'PAGE_NUMBER_GAP', 'major', nth::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS nth FROM badpages) WHERE nth <> page_number
UNION ALL SELECT document_id, 'DUPLICATE_PAGE_NUMBER', 'major', page_number::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page_number) AS again FROM badpages) WHERE again > 1)"""


@query("document marked_text", f"WITH {PAGES}, {PAGEQ} SELECT * FROM pageq WHERE code = 'NO_PAGES_FOUND'")
def g02_no_pages(x: Fixtures) -> DataFrame:
    return quality.page_issues(x.document(), _pages(x)).filter("code = 'NO_PAGES_FOUND'")


@query("document marked_text", f"WITH {PAGES}, {PAGEQ} SELECT * FROM pageq WHERE code = 'PAGE_NUMBER_GAP'")
def g03_page_gaps(x: Fixtures) -> DataFrame:
    return quality.page_issues(x.document(), _pages(x)).filter("code = 'PAGE_NUMBER_GAP'")


@query("document marked_text", f"WITH {PAGES}, {PAGEQ} SELECT * FROM pageq WHERE code = 'DUPLICATE_PAGE_NUMBER'")
def g04_page_repeats(x: Fixtures) -> DataFrame:
    return quality.page_issues(x.document(), _pages(x)).filter("code = 'DUPLICATE_PAGE_NUMBER'")


ELEMQ = """chain AS (SELECT document_id, block_id, parent_block_id AS up, 1 AS n FROM bad WHERE parent_block_id IS NOT NULL UNION ALL SELECT c.document_id, c.block_id, b.parent_block_id, n + 1 FROM chain c JOIN bad b ON b.document_id = c.document_id AND b.block_id = c.up WHERE b.parent_block_id IS NOT NULL AND n < 64),
elemq AS (SELECT document_id, 'INVALID_READING_ORDER' AS code, 'minor' AS severity, block_id AS item FROM bad WHERE reading_order < 0
UNION ALL SELECT document_id, 'INVALID_BBOX_FORMAT', 'minor', block_id FROM bad WHERE len(bounding_box) <> 4
UNION ALL SELECT document_id, 'INCONSISTENT_BBOX_BOUNDS', 'minor', block_id FROM bad WHERE len(bounding_box) = 4 AND (bounding_box[1] > bounding_box[3] OR bounding_box[2] > bounding_box[4])
UNION ALL SELECT document_id, 'ORPHAN_ELEMENT_PARENT', 'major', block_id FROM bad a WHERE parent_block_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.document_id = a.document_id AND b.block_id = a.parent_block_id)
UNION ALL SELECT DISTINCT document_id, 'CYCLIC_ELEMENT_REFERENCE', 'major', block_id FROM chain WHERE n = 64
UNION ALL SELECT document_id, 'EMPTY_HEADING_ELEMENT', 'warning', block_id FROM bad WHERE element_type = 'heading' AND trim(content) = '')"""


def _rule(name: str, code: str) -> None:
    def run(x: Fixtures) -> DataFrame:
        return quality.element_issues(_bad(x)).filter(F.col("code").isin(code.split("|")))

    run.__name__ = name
    codes = ", ".join(f"'{c}'" for c in code.split("|"))
    query("element", f"WITH RECURSIVE {BAD}, {ELEMQ} SELECT * FROM elemq WHERE code IN ({codes})")(run)


for _name, _code in (("g05_reading_order", "INVALID_READING_ORDER"), ("g06_bbox", "INVALID_BBOX_FORMAT|INCONSISTENT_BBOX_BOUNDS"), ("g07_orphans", "ORPHAN_ELEMENT_PARENT"), ("g08_cycles", "CYCLIC_ELEMENT_REFERENCE"), ("g09_empty_headings", "EMPTY_HEADING_ELEMENT")):
    _rule(_name, _code)

CHUNKQ = """badchunk AS (SELECT document_id, chunk_id, CASE WHEN chunk_index % 7 = 3 THEN ' ' WHEN chunk_index % 7 = 5 THEN 'same text' ELSE content END AS content, chunk_index + CASE WHEN document_id % 4 = 0 THEN 1 ELSE 0 END AS chunk_index FROM chunk),
chunkq AS (SELECT document_id, 'EMPTY_CHUNK' AS code, 'major' AS severity, chunk_id::VARCHAR AS item FROM badchunk WHERE trim(content) = ''
UNION ALL SELECT document_id, 'DUPLICATE_CHUNK_CONTENT', 'warning', chunk_id::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY document_id, trim(content) ORDER BY chunk_index) AS again FROM badchunk WHERE trim(content) <> '') WHERE again > 1
UNION ALL SELECT document_id, 'INVALID_CHUNK_ORDERING', 'minor', chunk_id::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS nth FROM badchunk) WHERE nth <> chunk_index)"""


def _chunks(x: Fixtures) -> DataFrame:
    i = F.col("chunk_index")
    return x.chunk().select("document_id", "chunk_id", F.when(i % 7 == 3, " ").when(i % 7 == 5, "same text").otherwise(F.col("content")).alias("content"), (i + F.when(F.col("document_id") % 4 == 0, 1).otherwise(0)).alias("chunk_index"))


def _chunk_rule(name: str, code: str) -> None:
    def run(x: Fixtures) -> DataFrame:
        return quality.chunk_issues(_chunks(x)).filter(F.col("code") == code)

    run.__name__ = name
    query("chunk", f"WITH {CHUNKQ} SELECT * FROM chunkq WHERE code = '{code}'")(run)


for _name, _code in (("g10_empty_chunks", "EMPTY_CHUNK"), ("g11_chunk_repeats", "DUPLICATE_CHUNK_CONTENT"), ("g12_chunk_order", "INVALID_CHUNK_ORDERING")):
    _chunk_rule(_name, _code)

EMBQ = """bademb AS (SELECT vec_id AS document_id, vec_id * 10 AS chunk_id, CASE vec_id % 50 WHEN 0 THEN []::FLOAT[] WHEN 1 THEN list_append(embedding[1:63], 'nan'::FLOAT) WHEN 2 THEN list_append(embedding[1:63], 'inf'::FLOAT) WHEN 3 THEN list_transform(embedding, lambda x: 0::FLOAT) WHEN 4 THEN embedding[1:63] ELSE embedding END AS embedding FROM embeddings),
embq AS (SELECT document_id, 'EMPTY_EMBEDDING_VECTOR' AS code, 'critical' AS severity, chunk_id::VARCHAR AS item FROM bademb WHERE len(embedding) = 0
UNION ALL SELECT document_id, 'EMBEDDING_NAN_DETECTION', 'critical', chunk_id::VARCHAR FROM bademb WHERE len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0
UNION ALL SELECT document_id, 'ZERO_EMBEDDING_VECTOR', 'major', chunk_id::VARCHAR FROM bademb WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) = 0
UNION ALL SELECT document_id, 'INVALID_EMBEDDING_DIMENSION', 'major', chunk_id::VARCHAR FROM bademb WHERE len(embedding) > 0 AND len(embedding) <> 64)"""


def _embeddings(x: Fixtures) -> DataFrame:
    e, k = F.col("embedding"), F.col("vec_id") % 50
    odd = lambda v: F.concat(F.slice(e, 1, 63), F.array(F.lit(v).cast("float")))
    made = F.when(k == 0, F.array().cast("array<float>")).when(k == 1, odd("NaN")).when(k == 2, odd("Infinity")).when(k == 3, F.transform(e, lambda v: F.lit(0).cast("float"))).when(k == 4, F.slice(e, 1, 63)).otherwise(e)
    return x.t("embeddings").select(F.col("vec_id").alias("document_id"), (F.col("vec_id") * 10).alias("chunk_id"), made.alias("embedding"))


@query("", f"WITH {EMBQ} SELECT * FROM embq")
def g13_embeddings(x: Fixtures) -> DataFrame:
    return quality.embedding_issues(_embeddings(x), 64)


STATS = """cnt AS (SELECT document_id, (SELECT count(*) FROM badpages p WHERE p.document_id = d.document_id) AS pages, (SELECT count(*) FROM element e WHERE e.document_id = d.document_id) AS elements, (SELECT count(*) FROM badchunk c WHERE c.document_id = d.document_id) AS chunks,
coalesce((SELECT sum(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))) FROM badchunk c WHERE c.document_id = d.document_id), 0)::BIGINT AS words, (SELECT count(*) FROM bademb e WHERE e.document_id = d.document_id) AS embeddings FROM document d),
stats AS (SELECT *, round(CASE WHEN elements > 0 THEN least(1.0, chunks / (elements * 0.5)) ELSE 0 END, 6)::DOUBLE AS chunk_coverage, round(CASE WHEN chunks > 0 THEN embeddings::DOUBLE / chunks ELSE 0 END, 6) AS embedding_coverage FROM cnt)"""
ALL = f"{PAGES}, {PAGEQ}, {CHUNKQ}, {EMBQ}"


@query("document marked_text element chunk", f"WITH {ALL}, {STATS} SELECT * FROM stats")
def g14_statistics(x: Fixtures) -> DataFrame:
    return quality.statistics(x.document(), _pages(x), x.element(), _chunks(x), _embeddings(x))


def _issues(x: Fixtures) -> DataFrame:
    return quality.page_issues(x.document(), _pages(x)).unionByName(quality.chunk_issues(_chunks(x))).unionByName(quality.embedding_issues(_embeddings(x), 64))


ISSUES = "issues AS (FROM pageq UNION ALL FROM chunkq UNION ALL FROM embq)"


@query("document marked_text chunk", f"WITH {ALL}, {ISSUES} SELECT d.document_id, count(code) AS n_issues, NOT coalesce(bool_or(severity = 'critical'), false) AS is_valid FROM document d LEFT JOIN issues i ON i.document_id = d.document_id GROUP BY 1")
def g15_verdicts(x: Fixtures) -> DataFrame:
    return quality.verdicts(x.document(), _issues(x))


@query("document marked_text element chunk", f"""WITH {ALL}, {ISSUES}, {STATS}, g AS (SELECT document_id, coalesce(list(code ORDER BY code) FILTER (severity IN ('warning', 'minor')), []) AS warnings, coalesce(list(code ORDER BY code) FILTER (severity IN ('critical', 'major')), []) AS critical_errors FROM issues GROUP BY 1),
r AS (SELECT s.document_id, coalesce(warnings, []) AS warnings, coalesce(critical_errors, []) AS critical_errors, pages, chunks FROM stats s LEFT JOIN g ON g.document_id = s.document_id)
SELECT document_id, warnings, critical_errors, pages || ' pages, ' || chunks || ' chunks, ' || len(warnings) || ' warnings, ' || len(critical_errors) || ' errors' AS summary FROM r""")
def g16_reports(x: Fixtures) -> DataFrame:
    stats = quality.statistics(x.document(), _pages(x), x.element(), _chunks(x), _embeddings(x))
    return quality.reports(x.document(), _issues(x), stats)


@query("document chunk", "SELECT d.document_id, sha256(d.file_name || '_' || d.project_id || '_' || strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS fingerprint, c.h AS chunks FROM document d LEFT JOIN (SELECT document_id, list(sha256(content) ORDER BY chunk_index) AS h FROM chunk GROUP BY 1) c ON c.document_id = d.document_id")
def g17_fingerprints(x: Fixtures) -> DataFrame:
    return quality.fingerprints(x.document(), x.chunk())


@query("marked_text", f"WITH {PAGES} SELECT document_id, page_number, count(*) AS n FROM badpages GROUP BY 1, 2 HAVING count(*) > 1")
def g18_unique_pages(x: Fixtures) -> DataFrame:
    return quality.repeated_keys(_pages(x), "document_id", "page_number")


@query("entity", "SELECT project_id, name, entity_type, count(*) AS n FROM entity GROUP BY 1, 2, 3 HAVING count(*) > 1")
def g18_unique_entities(x: Fixtures) -> DataFrame:
    return quality.repeated_keys(x.entity(), "project_id", "name", "entity_type")


# ---- conversations

WORDS = "list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')"


@query("message", "SELECT conversation_id, seq, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) AS n FROM message) WHERE n > 1 AND n <= 4")
def h01_message_page(x: Fixtures) -> DataFrame:
    return conversations.page(x.message(), 1, 3).select("conversation_id", "seq", "role")


@query("message", f"SELECT conversation_id, sum(len({WORDS}) * 13 // 10)::BIGINT AS tokens, count(*) AS n_messages, greatest(0, 60 - sum(len({WORDS}) * 13 // 10))::BIGINT AS remaining FROM message GROUP BY 1")
def h02_token_usage(x: Fixtures) -> DataFrame:
    return conversations.token_usage(x.message(), 60)


SUMMARY = f"""m AS (SELECT *, {WORDS} AS ws, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS back, sum(len({WORDS})) OVER (PARTITION BY conversation_id) AS total FROM message),
sums AS (SELECT conversation_id, 'Earlier: ' || string_agg(upper(role[1]) || role[2:] || ': ' || array_to_string(ws[1:6], ' ') || '...', '; ' ORDER BY seq) AS summary FROM m WHERE total > 40 AND back > 2 GROUP BY 1)"""


@query("message", f"WITH {SUMMARY} SELECT * FROM sums")
def h03_summaries(x: Fixtures) -> DataFrame:
    return conversations.summaries(x.message(), 40, 2)


@query("message", f"""WITH {SUMMARY}, l AS (SELECT conversation_id, list(role ORDER BY seq) AS roles, list(content ORDER BY seq) AS contents FROM m WHERE back <= 2 GROUP BY 1), u AS (SELECT conversation_id, count(*) AS n_messages, sum(len(ws) * 13 // 10)::BIGINT AS tokens FROM m GROUP BY 1)
SELECT conversation_id, summary, roles, contents, n_messages, tokens, greatest(0, 4000 - tokens)::BIGINT AS remaining FROM u JOIN l USING (conversation_id) LEFT JOIN sums USING (conversation_id)""")
def h04_contexts(x: Fixtures) -> DataFrame:
    return conversations.contexts(x.message(), 40, 2)


@query("message", "WITH q AS (SELECT conversation_id, arg_min(content, seq) AS content FROM message WHERE role = 'user' GROUP BY 1) SELECT conversation_id, array_to_string((%s)[1:6], ' ') || CASE WHEN len(%s) > 6 THEN '...' ELSE '' END AS title FROM q" % (WORDS, WORDS))
def h05_titles(x: Fixtures) -> DataFrame:
    return conversations.titles(x.message())


@query("message", "SELECT conversation_id + 1000000 AS conversation_id, seq, role, content FROM message WHERE conversation_id % 3 = 0")
def h06_copies(x: Fixtures) -> DataFrame:
    ids = x.message().filter("conversation_id % 3 = 0").select("conversation_id").distinct().withColumn("new_id", F.col("conversation_id") + 1000000)
    return conversations.copies(x.message(), ids)


# ---- event logs


def delivery_log(x: Fixtures) -> DataFrame:
    return x.t("events").filter("event_type in ('error', 'purchase') or user_id % 3 = 0").select((F.col("user_id") * 20 + F.col("event_id") % 20).alias("message_id"), F.col("ts").alias("attempt_ts"), "event_id", (F.col("event_type") == "purchase").alias("ok"))


def validation_log(x: Fixtures) -> DataFrame:
    return x.t("events").select((F.col("event_id") % 1000).alias("document_id"), "ts", "event_id", (F.col("value") > 20).alias("is_valid"))


@query("", """WITH RECURSIVE o AS (SELECT user_id * 20 + event_id % 20 AS message_id, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id * 20 + event_id % 20 ORDER BY ts, event_id) AS i FROM events WHERE event_type IN ('error', 'purchase') OR user_id % 3 = 0),
s AS (SELECT message_id, 0::BIGINT AS i, 'pending' AS status, 0 AS retry_count FROM (SELECT DISTINCT message_id FROM o) UNION ALL SELECT o.message_id, o.i, CASE WHEN s.status IN ('completed', 'dead_letter') THEN s.status WHEN o.ok THEN 'completed' WHEN s.retry_count + 1 >= 3 THEN 'dead_letter' ELSE 'pending' END, CASE WHEN s.status IN ('completed', 'dead_letter') OR o.ok THEN s.retry_count ELSE s.retry_count + 1 END FROM s JOIN o ON o.message_id = s.message_id AND o.i = s.i + 1)
SELECT message_id, arg_max(status, i) AS status, arg_max(retry_count, i) AS retry_count FROM s GROUP BY 1""")
def i02_deliveries(x: Fixtures) -> DataFrame:
    return events.delivery_status(delivery_log(x))


@query("", """WITH RECURSIVE o AS (SELECT event_id % 1000 AS document_id, event_id, value > 20 AS ok, row_number() OVER (PARTITION BY event_id % 1000 ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT document_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, '' AS status, 0 AS retry_count FROM (SELECT DISTINCT document_id FROM o) UNION ALL SELECT o.document_id, o.event_id, o.i, CASE WHEN o.ok THEN 'ready_for_chat' WHEN s.retry_count + 1 >= 3 THEN 'failed' ELSE 'ready_for_reindex' END, CASE WHEN o.ok OR s.retry_count + 1 >= 3 THEN 0 ELSE s.retry_count + 1 END FROM s JOIN o ON o.document_id = s.document_id AND o.i = s.i + 1)
SELECT document_id, event_id, status, retry_count FROM s WHERE i > 0""")
def i03_lifecycle(x: Fixtures) -> DataFrame:
    return events.lifecycle(validation_log(x))


@query("document", "SELECT document_id, CASE WHEN status IN ('ocr_running', 'chunking_running', 'embedding_running', 'extraction_running', 'conflict_running', 'clarification_running', 'ready_for_validation') THEN 'failed' ELSE status END AS status FROM document")
def i05_sweep(x: Fixtures) -> DataFrame:
    return events.swept(x.document()).select("document_id", "status")


@query("", "SELECT json_extract_string(props, '$.k')::BIGINT AS document_id, event_id, event_type, row_number() OVER (PARTITION BY json_extract_string(props, '$.k')::BIGINT ORDER BY ts, event_id) AS place FROM events")
def i06_timeline(x: Fixtures) -> DataFrame:
    return events.timeline(x.t("events"))


@query("", "SELECT user_id AS document_id, event_id, event_type AS stage, floor(epoch(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))::BIGINT AS seconds FROM events")
def i07_stage_seconds(x: Fixtures) -> DataFrame:
    return events.stage_seconds(x.t("events").select(F.col("user_id").alias("document_id"), "event_id", "ts", F.col("event_type").alias("stage")))


RATE = "rate AS (SELECT * FROM (VALUES ('openai/gpt-oss-120b', 0.59::DOUBLE, 0.79::DOUBLE), ('llama-3.3-70b-versatile', 0.59, 0.79), ('gpt-4o-mini', 0.15, 0.60), ('claude-3-5-sonnet', 3.0, 15.0), ('gemini-1.5-pro', 1.25, 5.0), ('llama3', 0.0, 0.0)) v(model, a, b)), cost AS (SELECT u.*, round(prompt_tokens::DOUBLE / 1000000 * coalesce(a, 0) + completion_tokens::DOUBLE / 1000000 * coalesce(b, 0), 6) AS cost FROM usage u LEFT JOIN rate r ON r.model = u.model)"


@query("usage", f"WITH {RATE} SELECT event_id, model, cost FROM cost")
def i08_costs(x: Fixtures) -> DataFrame:
    return events.costed(x.usage()).select("event_id", "model", "cost")


@query("usage", f"WITH {RATE} SELECT project_id, model, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, round(sum(cost), 4) AS cost, count(*) AS calls FROM cost GROUP BY 1, 2")
def i08_ledger(x: Fixtures) -> DataFrame:
    return events.ledger(x.usage())


@query("", """WITH n AS (SELECT user_id AS request_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events), g AS (SELECT request_id, min(ts) AS b, min(ts) FILTER (nth > 1) AS f, max(ts) AS l, count(*) - 1 AS n FROM n GROUP BY 1)
SELECT request_id, floor(epoch(f - b))::BIGINT AS first_token_seconds, n AS n_tokens, CASE WHEN floor(epoch(l - b)) > 0 THEN round(n / floor(epoch(l - b)), 6) END AS tokens_per_second FROM g""")
def i09_request_metrics(x: Fixtures) -> DataFrame:
    return events.request_metrics(x.t("events").select(F.col("user_id").alias("request_id"), "ts", "event_id"))


@query("document", "SELECT user_id, count(*) AS n_documents, count(*) * 128 AS kilobytes FROM document GROUP BY 1")
def i10_storage(x: Fixtures) -> DataFrame:
    return events.storage(x.document())


@query("document", "SELECT document_id, status, CASE status WHEN 'uploaded' THEN 'parsing' WHEN 'failed' THEN 'parsing' WHEN 'ocr_running' THEN 'parsing' WHEN 'ready_for_chunking' THEN 'chunking' WHEN 'chunking_running' THEN 'chunking' WHEN 'ready_for_embedding' THEN 'none' WHEN 'completed' THEN 'none' ELSE 'unknown' END AS stage FROM document")
def i11_resume(x: Fixtures) -> DataFrame:
    return events.resume_plan(x.document())
