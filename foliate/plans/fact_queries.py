"""Queries over knowledge facts, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import facts
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


KEY = "lower(trim(%s))"
RAW = """CASE WHEN document_id % 7 = 0 THEN '```json' || chr(10) ELSE '' END || CASE WHEN document_id % 11 = 0 THEN '{"entities":[' ELSE '{"entities":[{"name":"n' || document_id || '","type":"t"}],"facts":[{"subject":"n' || document_id || '",' || CASE WHEN document_id % 5 = 0 THEN '' ELSE '"predicate":"p' || document_id % 3 || '",' END || '"object":"o"' || CASE WHEN document_id % 13 = 0 THEN ',"confidence":1.7' WHEN document_id % 2 = 0 THEN ',"confidence":0.5' ELSE '' END || '}]}' END || CASE WHEN document_id % 7 = 0 THEN chr(10) || '```' ELSE '' END"""


def _outputs(x: Fixtures) -> DataFrame:
    return x.document().select(F.col("document_id").alias("chunk_id"), F.expr(RAW.replace("chr(10)", "'\\n'")).alias("raw"), "document_id")


@query("document", "SELECT document_id AS chunk_id, 'n' || document_id AS subject, 'p' || document_id % 3 AS predicate, 'o' AS object, CASE WHEN document_id % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM document WHERE document_id % 11 <> 0 AND document_id % 5 <> 0 AND document_id % 13 <> 0")
def f01_parse_output(x: Fixtures) -> DataFrame:
    return facts.parsed(_outputs(x))[0].select("chunk_id", "subject", "predicate", "object", "confidence")


@query("document", "SELECT document_id AS chunk_id, CASE WHEN document_id % 11 = 0 THEN 'not the JSON asked for' WHEN document_id % 5 = 0 THEN 'a field is missing' ELSE 'confidence is out of range' END AS reason FROM document WHERE document_id % 11 = 0 OR document_id % 5 = 0 OR document_id % 13 = 0")
def f01_rejected_output(x: Fixtures) -> DataFrame:
    return facts.parsed(_outputs(x))[1].select("chunk_id", "reason")


RES = "res AS (SELECT project_id, lower(trim(name)) AS key_name, lower(trim(coalesce(entity_type, 'unknown'))) AS key_type, arg_min(entity_id, (created_at, entity_id)) AS entity_id, arg_min(description, (created_at, entity_id)) FILTER (description IS NOT NULL) AS description, count(*) AS n FROM entity GROUP BY 1, 2, 3)"


@query("entity", "WITH " + RES + " SELECT * FROM res")
def f02_resolve_entities(x: Fixtures) -> DataFrame:
    return facts.resolved(x.entity())


def _claims(x: Fixtures) -> DataFrame:
    e = x.entity().select("entity_id", "project_id", "name")
    subject = F.when(F.col("entity_id") % 6 == 0, F.concat(F.lit("nobody "), "entity_id")).otherwise(F.col("name"))
    return e.select(F.col("entity_id").alias("chunk_id"), "project_id", subject.alias("subject"), F.lit(" has ").alias("predicate"), F.concat(F.lit(" v"), "entity_id").alias("object"), F.lit(0.9).alias("confidence"))


CLAIMS = RES + ", known AS (SELECT project_id, key_name, min(entity_id) AS subject_id FROM res GROUP BY 1, 2), claims AS (SELECT entity_id AS chunk_id, project_id, CASE WHEN entity_id % 6 = 0 THEN 'nobody ' || entity_id ELSE name END AS subject, ' has ' AS predicate, ' v' || entity_id AS object FROM entity)"


@query("entity", "WITH " + CLAIMS + " SELECT chunk_id, c.project_id, subject_id, trim(predicate) AS predicate, trim(object) AS object_text, 0.9::DOUBLE AS confidence, 'unverified' AS status, concat_ws(' ', subject, predicate, object) AS verbatim FROM claims c JOIN known k ON k.project_id = c.project_id AND k.key_name = lower(trim(subject))")
def f03_ingest(x: Fixtures) -> DataFrame:
    return facts.ingested(_claims(x), x.entity())[0]


@query("entity", "WITH " + CLAIMS + " SELECT chunk_id, count(*) AS orphans FROM claims c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.project_id = c.project_id AND k.key_name = lower(trim(subject))) GROUP BY 1")
def f03_orphans(x: Fixtures) -> DataFrame:
    return facts.ingested(_claims(x), x.entity())[1]


MAP = "map AS (SELECT entity_id, first_value(entity_id) OVER (PARTITION BY project_id, lower(trim(name)), lower(trim(coalesce(entity_type, 'unknown'))) ORDER BY created_at, entity_id) AS canonical_id FROM entity)"


@query("entity fact", "WITH " + MAP + " SELECT fact_id, coalesce(canonical_id, subject_id) AS subject_id FROM fact LEFT JOIN map ON entity_id = subject_id")
def f04_merge_entities(x: Fixtures) -> DataFrame:
    return facts.redirected(x.fact(), facts.merge_map(x.entity())).select("fact_id", "subject_id")


FOLD = """m AS (SELECT project_id, subject_id, lower(trim(predicate)) AS p, lower(trim(object_text)) AS o, list(fact_id ORDER BY created_at, fact_id) AS fact_ids, list(confidence ORDER BY created_at, fact_id) AS c FROM fact WHERE deleted_at IS NULL GROUP BY 1, 2, 3, 4),
merged AS (SELECT fact_ids[1] AS canonical_id, fact_ids, CASE WHEN len(c) = 1 THEN c[1] ELSE list_reduce(c, lambda a, b: least(round(1 - (1 - a) * (1 - b), 4), 0.9999)) END AS confidence FROM m)"""


@query("fact", "WITH " + FOLD + " SELECT * FROM merged")
def f05_merge_facts(x: Fixtures) -> DataFrame:
    return facts.merged_facts(x.fact())


@query("fact", "WITH " + FOLD + " SELECT unnest(fact_ids) AS fact_id, canonical_id FROM merged")
def f05_fact_map(x: Fixtures) -> DataFrame:
    return facts.fact_map(x.fact())


HOT = "fact AS MATERIALIZED (SELECT * REPLACE (CASE WHEN fact_id % 3 = 0 THEN 1 ELSE project_id END AS project_id, CASE WHEN fact_id % 3 = 0 THEN 1 ELSE subject_id END AS subject_id, CASE WHEN fact_id % 3 = 0 THEN 'is' ELSE predicate END AS predicate, CASE WHEN fact_id % 3 = 0 THEN 'so' ELSE object_text END AS object_text, CASE WHEN fact_id % 3 = 0 THEN confidence / 1000 ELSE confidence END AS confidence) FROM fact)"


@query("fact", "WITH " + HOT.replace("fact AS", "hot AS", 1) + ", " + FOLD.replace("FROM fact ", "FROM hot ") + " SELECT canonical_id, len(fact_ids) AS n_facts, confidence FROM merged")
def f05_folded_confidence(x: Fixtures) -> DataFrame:
    """A third of all facts say the same, each with little confidence."""
    third = F.col("fact_id") % 3 == 0
    hot = {"project_id": F.lit(1), "subject_id": F.lit(1), "predicate": F.lit("is"), "object_text": F.lit("so"), "confidence": F.col("confidence") / 1000}
    return facts.folded_confidence(x.fact().withColumns({c: F.when(third, v).otherwise(F.col(c)) for c, v in hot.items()}), few=100)


@query("fact evidence", "WITH " + FOLD + ", t AS (SELECT canonical_id, unnest(fact_ids) AS fact_id FROM merged) SELECT DISTINCT coalesce(canonical_id, e.fact_id) AS fact_id, chunk_id, verbatim FROM evidence e LEFT JOIN t USING (fact_id)")
def f06_relink(x: Fixtures) -> DataFrame:
    return facts.relinked(x.evidence(), facts.merged_facts(x.fact()))[0]


@query("fact", "WITH " + FOLD + ", t AS (SELECT canonical_id, unnest(fact_ids) AS fact_id FROM merged) SELECT 'FACT_MERGED' AS action, fact_id, canonical_id FROM t WHERE fact_id <> canonical_id")
def f06_audit(x: Fixtures) -> DataFrame:
    return facts.relinked(x.evidence(), facts.merged_facts(x.fact()))[1]


def _norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[^\p{{L}}\p{{N}}_\s.]', '', 'g'), '\b({'|'.join(facts.UNITS)})\b', '', 'g'), '\s+', ' ', 'g'))"


def _num(c: str) -> str:
    return rf"try_cast(nullif(regexp_extract({c}, '\b\d+(?:\.\d+)?\b'), '') AS DOUBLE)"


def _kind(a: str, b: str) -> str:
    year = lambda c: rf"nullif(regexp_extract({c}, '\b(?:19|20)\d{{2}}\b'), '')"
    return f"CASE WHEN {_norm(a)} = {_norm(b)} THEN 'duplicate' WHEN {_num(a)} <> {_num(b)} THEN 'numeric' WHEN {year(a)} <> {year(b)} THEN 'temporal' ELSE 'needs_llm' END"


@query("fact", f"SELECT fact_id, {_norm('object_text')} AS value FROM fact")
def f07_normal_value(x: Fixtures) -> DataFrame:
    return x.fact().select("fact_id", facts.normal_value(F.col("object_text")).alias("value"))


@query("fact", f"SELECT fact_id, {_num('object_text')} AS number FROM fact")
def f08_number(x: Fixtures) -> DataFrame:
    return x.fact().select("fact_id", facts.number_in(F.col("object_text")).alias("number"))


@query("fact", f"WITH o AS (SELECT DISTINCT object_text FROM fact) SELECT a.object_text AS a, b.object_text AS b, {_kind('a.object_text', 'b.object_text')} AS kind FROM o a, o b WHERE a.object_text <= b.object_text")
def f09_pair_kind(x: Fixtures) -> DataFrame:
    o = x.fact().select(F.col("object_text").alias("a"), F.lit(1).alias("one")).distinct()
    return o.join(o.withColumnRenamed("a", "b"), "one").filter("a <= b").select("a", "b", facts.pair_kind(F.col("a"), F.col("b")).alias("kind"))


CAND = f"""cand AS (SELECT a.fact_id AS first_fact_id, b.fact_id AS second_fact_id, lower(trim(a.predicate)) AS p, a.object_text AS first_object, b.object_text AS second_object, a.confidence AS first_confidence, b.confidence AS second_confidence, {_kind('a.object_text', 'b.object_text')} AS kind
FROM fact a JOIN fact b ON a.project_id = b.project_id AND a.subject_id = b.subject_id AND lower(trim(a.predicate)) = lower(trim(b.predicate)) AND a.fact_id < b.fact_id AND lower(a.object_text) <> lower(b.object_text)
WHERE a.deleted_at IS NULL AND b.deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM conflict c WHERE c.status = 'open' AND c.first_fact_id = a.fact_id AND c.second_fact_id = b.fact_id))"""


@query("fact conflict", "WITH " + CAND + " SELECT first_fact_id, second_fact_id, kind FROM cand")
def f10_conflicts(x: Fixtures) -> DataFrame:
    return facts.with_kind(facts.candidates(x.fact(), x.conflict())).select("first_fact_id", "second_fact_id", "kind")


def recent(facts: DataFrame) -> DataFrame:
    """Those that count as new: made on or after the first day of 1998."""
    return facts.filter("created_at >= date'1998-01-01'")


def _inc(statuses: str, strict: bool) -> str:
    kind = _kind("n.object_text", "s.object_text")
    if strict:
        kind = f"CASE WHEN lower(trim(n.predicate)) = lower(trim(s.predicate)) AND lower(trim(n.object_text)) = lower(trim(s.object_text)) THEN 'duplicate' ELSE {kind} END"
    return f"""SELECT DISTINCT least(n.fact_id, s.fact_id) AS first_fact_id, greatest(n.fact_id, s.fact_id) AS second_fact_id, {kind} AS kind FROM fact n JOIN fact s ON n.project_id = s.project_id AND n.subject_id = s.subject_id AND n.fact_id <> s.fact_id
WHERE n.created_at >= DATE '1998-01-01' AND s.deleted_at IS NULL AND s.status IN ({statuses}) AND NOT EXISTS (SELECT 1 FROM conflict c WHERE c.status = 'open' AND c.first_fact_id = least(n.fact_id, s.fact_id) AND c.second_fact_id = greatest(n.fact_id, s.fact_id))"""


@query("fact conflict", _inc("'pending', 'verified', 'unverified', 'conflicted'", False))
def f11_incremental(x: Fixtures) -> DataFrame:
    return facts.incremental(recent(x.fact()), x.fact(), x.conflict()).select("first_fact_id", "second_fact_id", "kind")


@query("fact conflict", _inc("'verified', 'unverified'", True))
def f11_incremental_strict(x: Fixtures) -> DataFrame:
    return facts.incremental(recent(x.fact()), x.fact(), x.conflict(), True).select("first_fact_id", "second_fact_id", "kind")


@query("fact conflict", "WITH " + CAND + """ SELECT first_fact_id, second_fact_id, kind, CASE kind WHEN 'duplicate' THEN 'Deterministic duplicate fact: ''' || p || ': ' || first_object || '''.' WHEN 'numeric' THEN 'Numeric mismatch: ''' || p || ''' values differ between ''' || first_object || ''' and ''' || second_object || '''.' ELSE 'Temporal mismatch: values differ between ''' || first_object || ''' and ''' || second_object || '''.' END AS reasoning,
CASE kind WHEN 'duplicate' THEN 'Merge duplicate assertions.' WHEN 'numeric' THEN 'Verify dosage/measurement units and values.' ELSE 'Check temporal timeline records.' END AS recommendation, CASE kind WHEN 'duplicate' THEN 0.95 ELSE round((first_confidence + second_confidence) / 2, 6) END::DOUBLE AS score FROM cand WHERE kind <> 'needs_llm'""")
def f12_reports(x: Fixtures) -> DataFrame:
    return facts.reports_of(facts.with_kind(facts.candidates(x.fact(), x.conflict())))


@query("fact conflict", "WITH " + CAND + ", i AS (SELECT first_fact_id AS fact_id FROM cand WHERE kind <> 'needs_llm' UNION SELECT second_fact_id FROM cand WHERE kind <> 'needs_llm') SELECT fact_id, CASE WHEN fact_id IN (FROM i) THEN 'conflicted' ELSE status END AS status FROM fact")
def f12_marked(x: Fixtures) -> DataFrame:
    return facts.marked(x.fact(), facts.reports_of(facts.with_kind(facts.candidates(x.fact(), x.conflict())))).select("fact_id", "status")


JUDGED = "judged AS (SELECT conflict_id, action, winner_id, merged_text, first_fact_id, second_fact_id, CASE WHEN status = 'resolved' THEN 'already resolved' WHEN action = 'resolve' AND winner_id NOT IN (first_fact_id, second_fact_id) THEN 'winner is not in the pair' END AS reason FROM decision JOIN conflict USING (conflict_id))"


@query("decision", "WITH " + JUDGED + ", e AS (SELECT conflict_id, action, winner_id, unnest([first_fact_id, second_fact_id]) AS fact_id FROM judged WHERE reason IS NULL) SELECT conflict_id, fact_id, CASE WHEN action = 'merge' THEN 'superseded' WHEN action = 'resolve' AND fact_id <> winner_id THEN 'rejected' ELSE 'verified' END AS new_status, action = 'merge' OR (action = 'resolve' AND fact_id <> winner_id) AS removed FROM e")
def f13_decisions(x: Fixtures) -> DataFrame:
    return facts.decided(x.conflict(), x.decision())[0]


@query("decision", "WITH " + JUDGED + " SELECT conflict_id, action, reason FROM judged WHERE reason IS NOT NULL")
def f13_rejected(x: Fixtures) -> DataFrame:
    return facts.decided(x.conflict(), x.decision())[1]


@query("decision fact evidence", "WITH " + JUDGED + ", c AS (SELECT j.conflict_id, list_sort(list(DISTINCT e.chunk_id)) AS chunk_ids FROM judged j JOIN evidence e ON e.fact_id IN (j.first_fact_id, j.second_fact_id) WHERE action = 'merge' GROUP BY 1) SELECT conflict_id, subject_id, predicate, merged_text AS object_text, 1.0::DOUBLE AS confidence, 'verified' AS status, chunk_ids FROM judged JOIN fact ON fact_id = first_fact_id LEFT JOIN c USING (conflict_id) WHERE action = 'merge' AND reason IS NULL")
def f13_merged(x: Fixtures) -> DataFrame:
    return facts.merged_by_decision(x.conflict(), x.decision(), x.fact(), x.evidence())


TRIG = """t AS (SELECT 'missing_entity' AS trigger_type, entity_id, NULL::BIGINT AS fact_id, NULL::BIGINT AS conflict_id, 'medium' AS priority FROM entity WHERE (entity_type IS NULL OR entity_type = 'unknown' OR lower(name) LIKE '%unknown%'){es}
UNION ALL SELECT 'low_confidence', NULL, fact_id, NULL, 'low' FROM fact WHERE deleted_at IS NULL AND confidence < 0.75{fs}
UNION ALL SELECT 'missing_value', NULL, fact_id, NULL, 'medium' FROM fact WHERE deleted_at IS NULL AND lower(trim(object_text)) IN ('', 'n/a', 'unknown', 'none', 'nil', 'null', 'undefined'){fs}
UNION ALL SELECT 'conflict', NULL, NULL, conflict_id, 'high' FROM conflict WHERE status = 'open')
SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM question q WHERE q.status = 'open' AND q.trigger_type = t.trigger_type AND q.fact_id = t.fact_id)"""


@query("entity fact conflict question", "WITH " + TRIG.format(es="", fs=""))
def f14_triggers(x: Fixtures) -> DataFrame:
    return facts.triggers(x.entity(), x.fact(), x.conflict(), x.question())


@query("entity fact conflict question", "WITH " + TRIG.format(es=" AND entity_id IN (SELECT subject_id FROM fact WHERE deleted_at IS NULL AND created_at >= DATE '1998-01-01')", fs=" AND created_at >= DATE '1998-01-01'"))
def f14_triggers_scoped(x: Fixtures) -> DataFrame:
    return facts.triggers(x.entity(), x.fact(), x.conflict(), x.question(), recent(x.fact()).select("fact_id"))


@query("question fact", "SELECT question_id, CASE question_id % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' ELSE 'answered' END AS new_status, q.fact_id, CASE WHEN question_id % 3 = 0 AND question_id % 2 = 0 THEN 'a' || question_id ELSE object_text END AS object_text, CASE WHEN question_id % 3 = 0 THEN 'verified' ELSE f.status END AS fact_status FROM question q LEFT JOIN fact f USING (fact_id)")
def f15_answers(x: Fixtures) -> DataFrame:
    answers = x.question().selectExpr("question_id", "CASE question_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'dismiss' ELSE 'answer' END AS action", "CASE WHEN question_id % 2 = 0 THEN concat('a', question_id) END AS answer")
    return facts.answered(x.question(), answers, x.fact())


@query("fact review_log", """WITH a AS (SELECT fact_id, arg_max(action, (created_at, event_id)) AS action, arg_max(new_object, (created_at, event_id)) AS new_object FROM review_log WHERE action IN ('approve', 'reject', 'modify') GROUP BY 1)
SELECT fact_id, action, status AS prior_status, CASE action WHEN 'reject' THEN 'rejected' ELSE 'verified' END AS status, CASE action WHEN 'reject' THEN confidence ELSE 1.0 END AS confidence, CASE action WHEN 'modify' THEN new_object ELSE object_text END AS object_text, action = 'reject' OR deleted_at IS NOT NULL AS removed FROM fact JOIN a USING (fact_id)""")
def f16_review(x: Fixtures) -> DataFrame:
    return facts.reviewed(x.fact(), x.review_log())


@query("review_log", """WITH RECURSIVE o AS (SELECT fact_id, event_id, action, row_number() OVER (PARTITION BY fact_id ORDER BY created_at, event_id) AS i FROM review_log WHERE action <> 'other'),
s AS (SELECT fact_id, 0::BIGINT AS i, []::BIGINT[] AS stack FROM (SELECT DISTINCT fact_id FROM o) UNION ALL SELECT o.fact_id, o.i, CASE WHEN o.action = 'undo' THEN stack[1 : greatest(len(stack) - 1, 0)] ELSE list_append(stack, o.event_id) END FROM s JOIN o ON o.fact_id = s.fact_id AND o.i = s.i + 1),
l AS (SELECT fact_id, arg_max(stack, i) AS stack FROM s GROUP BY 1) SELECT fact_id, stack[len(stack)] AS event_id, len(stack)::INT AS depth FROM l""")
def f17_undo(x: Fixtures) -> DataFrame:
    return facts.undone(x.review_log())


@query("review_log", "SELECT event_id, fact_id, action FROM review_log WHERE fact_id = 42 AND action <> 'other'")
def f18_history(x: Fixtures) -> DataFrame:
    return facts.history(x.review_log(), 42).select("event_id", "fact_id", "action")


@query("fact entity evidence chunk", """WITH p AS (SELECT fact_id, min(chunk_id) AS chunk_id FROM evidence GROUP BY 1), l AS (SELECT document_id, page_number, max(chunk_index) AS last FROM chunk GROUP BY 1, 2)
SELECT fact_id, c.document_id, c.page_number, last + row_number() OVER (PARTITION BY c.document_id, c.page_number ORDER BY fact_id) AS chunk_index, 'Fact ID: ' || fact_id || ' - ' || trim(name) || ' ' || trim(predicate) || ' is ' || object_text AS content
FROM fact f JOIN entity e ON e.entity_id = f.subject_id JOIN p USING (fact_id) JOIN chunk c USING (chunk_id) JOIN l ON l.document_id = c.document_id AND l.page_number = c.page_number WHERE f.deleted_at IS NULL AND f.status = 'verified'""")
def f19_index(x: Fixtures) -> DataFrame:
    return facts.index_rows(x.fact(), x.entity(), x.evidence(), x.chunk())


@query("entity fact", "SELECT entity_id, trim(name) AS label, entity_type, count(fact_id) AS degree FROM entity LEFT JOIN fact ON subject_id = entity_id AND fact.deleted_at IS NULL GROUP BY ALL")
def f20_graph_nodes(x: Fixtures) -> DataFrame:
    return facts.graph(x.entity(), x.fact())[0]


@query("fact", "SELECT fact_id, subject_id AS source, object_text AS target, trim(predicate) AS label, status, confidence FROM fact WHERE deleted_at IS NULL")
def f20_graph_edges(x: Fixtures) -> DataFrame:
    return facts.graph(x.entity(), x.fact())[1]


PROV = "prov AS (SELECT f.fact_id, coalesce(trim(name), 'Unknown') AS subject, trim(predicate) AS predicate, object_text, verbatim, coalesce(c.file_name, 'Unknown') AS file_name, coalesce(c.page_number, 1) AS page_number FROM fact f LEFT JOIN entity e ON e.entity_id = f.subject_id LEFT JOIN (SELECT fact_id, min(chunk_id) AS chunk_id, arg_min(verbatim, chunk_id) AS verbatim FROM evidence GROUP BY 1) USING (fact_id) LEFT JOIN chunk c USING (chunk_id))"


@query("fact entity evidence chunk", "WITH " + PROV + " SELECT * FROM prov")
def f21_provenance(x: Fixtures) -> DataFrame:
    return facts.provenance(x.fact(), x.entity(), x.evidence(), x.chunk())


@query("fact evidence chunk", """WITH e AS (SELECT fact_id, list(file_name ORDER BY chunk_id) AS files, list(page_number ORDER BY chunk_id) AS pages, list(CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END ORDER BY chunk_id) AS snippets FROM evidence JOIN chunk USING (chunk_id) GROUP BY 1)
SELECT fact_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, fact_id DESC) AS position, files, pages, snippets FROM fact LEFT JOIN e USING (fact_id) WHERE deleted_at IS NULL""")
def f22_review_list(x: Fixtures) -> DataFrame:
    return facts.review_list(x.fact(), x.evidence(), x.chunk())


@query("conflict fact entity evidence chunk", "WITH " + PROV + " SELECT conflict_id, status, first_fact_id, a.subject AS first_subject, a.object_text AS first_object, a.file_name AS first_file, second_fact_id, b.subject AS second_subject, b.object_text AS second_object, b.file_name AS second_file FROM conflict LEFT JOIN prov a ON a.fact_id = first_fact_id LEFT JOIN prov b ON b.fact_id = second_fact_id")
def f23_conflict_list(x: Fixtures) -> DataFrame:
    return facts.conflict_list(x.conflict(), facts.provenance(x.fact(), x.entity(), x.evidence(), x.chunk()))


@query("entity fact conflict question", """SELECT p.project_id, (SELECT count(*) FROM entity e WHERE e.project_id = p.project_id) AS entities, (SELECT count(*) FROM fact f WHERE f.project_id = p.project_id AND deleted_at IS NULL AND status = 'verified') AS verified,
(SELECT count(*) FROM fact f WHERE f.project_id = p.project_id AND deleted_at IS NULL AND status = 'unverified') AS unverified, (SELECT count(*) FROM conflict c WHERE c.project_id = p.project_id AND status = 'open') AS open_conflicts, (SELECT count(*) FROM question q WHERE q.project_id = p.project_id AND status = 'open') AS open_questions FROM (SELECT DISTINCT project_id FROM entity) p""")
def f24_dashboard(x: Fixtures) -> DataFrame:
    return facts.dashboard(x.entity().select("project_id").distinct(), x.entity(), x.fact(), x.conflict(), x.question())


@query("evidence fact", "SELECT chunk_id, count(DISTINCT subject_id) AS n_entities, count(*) AS n_facts, list_sort(list(DISTINCT subject_id)) AS subjects FROM (SELECT DISTINCT fact_id, chunk_id FROM evidence) JOIN fact USING (fact_id) WHERE deleted_at IS NULL GROUP BY 1")
def f25_monitor(x: Fixtures) -> DataFrame:
    return facts.monitor(x.evidence(), x.fact())


@query("fact entity", "SELECT f.project_id, lower(trim(predicate)) AS predicate, arg_max(object_text, (f.created_at, fact_id)) AS object_text FROM fact f JOIN entity ON entity_id = subject_id WHERE deleted_at IS NULL AND status = 'verified' AND regexp_matches(lower(entity_type), 'patient|profile|standard') GROUP BY 1, 2")
def f26_report_values(x: Fixtures) -> DataFrame:
    return facts.report_values(x.fact(), x.entity())


@query("fact entity", "SELECT f.project_id, subject_id, '## ' || trim(name) || chr(10) || string_agg('- ' || trim(predicate) || ': ' || object_text, chr(10) ORDER BY f.created_at, fact_id) AS body FROM fact f JOIN entity ON entity_id = subject_id WHERE deleted_at IS NULL AND status = 'verified' GROUP BY f.project_id, subject_id, name")
def f27_rendered(x: Fixtures) -> DataFrame:
    return facts.rendered(x.fact(), x.entity())


@query("question fact entity", "SELECT question_id, CASE WHEN question LIKE '{%' THEN json_extract_string(question, '$.question') ELSE question END AS text, CASE WHEN question LIKE '{%' THEN 'high' ELSE 'medium' END AS priority, trigger_type, q.status, q.fact_id, predicate, object_text, name FROM question q LEFT JOIN fact f USING (fact_id) LEFT JOIN entity ON entity_id = subject_id")
def f28_question_list(x: Fixtures) -> DataFrame:
    return facts.question_list(x.question(), x.fact(), x.entity())
