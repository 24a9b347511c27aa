"""Queries over embeddings and retrieval, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions import cosine, estimated_tokens, norm, snippet
from foliate.operators import postings, search, vectors
from foliate.plans.fixtures import Fixtures
from foliate.plans.fixtures_sql import sql
from foliate.sources import cut, shared_folder

QUERIES, ORACLES = {}, {}
MODEL = "m0"


def query(needs: str | None = None, oracle: str | None = None):
    """Register a query; its oracle's body follows the expressions it needs."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if oracle is not None:
            ORACLES[f.__name__] = sql(needs or "", oracle)
        return f

    return add


COS = """WITH cos AS (SELECT query_id, chunk_id, document_id, page_number, chunk_index, content, file_name, query_text,
  round(coalesce(list_sum(list_transform(range(1, len(query_vec) + 1), lambda i: query_vec[i]::DOUBLE * embedding[i]::DOUBLE)) / nullif(sqrt(list_sum(list_transform(query_vec, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 0), 0), 6) AS score
  FROM query JOIN chunk USING (project_id) JOIN embedding USING (chunk_id) WHERE model_name = 'm0' AND deleted_at IS NULL)"""
VEC = COS + """, vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cos QUALIFY rank <= 20)"""
LEX = """lexs AS (SELECT query_id, chunk_id, list_sum(list_transform(list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda w: w <> ''), lambda w: (length(lower(content)) - length(replace(lower(content), w, ''))) / length(w)))::BIGINT AS score
  FROM query JOIN chunk USING (project_id) WHERE deleted_at IS NULL),
  lex AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lexs WHERE score > 0 QUALIFY rank <= 20)"""
HYB = VEC + ", " + LEX + """, hyb AS (SELECT query_id, chunk_id, v.rank AS vector_rank, x.rank AS lexical_rank, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 6) AS score
  FROM vec v FULL JOIN lex x USING (query_id, chunk_id)), top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hyb QUALIFY rank <= 5)"""
ITEMS = VEC + """, items AS (SELECT *, list_bool_or(list_transform(kw, lambda k: contains(lower(content), k))) AS keyword_matched FROM
  (SELECT *, CASE WHEN len(list_filter(ws, lambda w: NOT list_contains(stop, w) AND length(w) > 2)) > 0 THEN list_filter(ws, lambda w: NOT list_contains(stop, w) AND length(w) > 2) ELSE ws END AS kw FROM
   (SELECT *, list_filter(regexp_split_to_array(translate(lower(query_text), '?.!,', ''), '\\s+'), lambda w: w <> '') AS ws, %s AS stop FROM vec)))""" % ("[" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + "]")
BASE = "query chunk embedding"


def _items(x: Fixtures) -> DataFrame:
    """The best vector hits of each query, with their chunks."""
    hits = cut(search.vector_search(x.query(), x.chunk(), x.embedding(), MODEL))
    chunk = x.chunk().select("chunk_id", "document_id", "page_number", "chunk_index", "content", "file_name")
    q = search.sized(x.query().select("query_id", "query_text"))
    kw = F.exists(search.keywords(F.col("query_text")), lambda w: F.lower("content").contains(w))
    return hits.join(chunk, "chunk_id").join(q, "query_id").withColumn("keyword_matched", kw)


@query("chunk", "SELECT chunk_id, 384 AS size, 1.0::DOUBLE AS norm FROM chunk")
def d01_embed(x: Fixtures) -> DataFrame:
    made = x.chunk().select("chunk_id", "content", vectors.embed(F.col("content"), "all-MiniLM-L6-v2").alias("v"))
    return made.select("chunk_id", F.size("v").alias("size"), F.round(norm(F.col("v")), 3).alias("norm"))


@query("embedding", "SELECT chunk_id, model_name, CASE WHEN chunk_id % 3 = 0 THEN 'new' ELSE 'old' END AS made FROM embedding UNION ALL SELECT chunk_id + 1, model_name, 'new' FROM embedding WHERE chunk_id % 3 = 0")
def d02_upsert(x: Fixtures) -> DataFrame:
    old = x.embedding().select("chunk_id", "model_name", F.lit("old").alias("made"))
    some = old.filter("chunk_id % 3 = 0").select("chunk_id", "model_name", F.lit("new").alias("made"))
    return vectors.upsert(old, some.unionByName(some.withColumn("chunk_id", F.col("chunk_id") + 1)), "chunk_id", "model_name")


@query("chunk embedding", "SELECT chunk_id FROM chunk WHERE NOT EXISTS (SELECT 1 FROM embedding e WHERE e.chunk_id = chunk.chunk_id AND model_name = 'm0')")
def d03_work_list(x: Fixtures) -> DataFrame:
    return vectors.work_list(x.chunk().select("chunk_id"), x.embedding(), MODEL)


@query("", """SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def d04_cosine(x: Fixtures) -> DataFrame:
    a, b = x.t("embeddings").select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("va")), x.t("embeddings").select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1).select("a_id", "b_id", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


@query("query message", """WITH w AS (SELECT conversation_id, seq, pos, word FROM (SELECT conversation_id, seq, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT *, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') AS ws FROM message)) WHERE length(word) > 4),
f AS (SELECT conversation_id, word, min((seq, pos)) AS place FROM w GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY place DESC) AS r FROM f QUALIFY r <= 5),
t AS (SELECT conversation_id, string_agg(word, ' ' ORDER BY place) AS tail FROM l GROUP BY 1)
SELECT query_id, trim(query_text) || coalesce(' ' || tail, '') AS rewritten FROM query LEFT JOIN t ON conversation_id = query_id // 5""")
def e01_rewrite(x: Fixtures) -> DataFrame:
    history = x.message().join(search.sized(x.query().select("query_id")), F.col("conversation_id") == F.floor(F.col("query_id") / 5)).select("query_id", "seq", "content")
    return search.rewritten(history, x.query())


@query("query", "WITH a AS (SELECT query_id, list_filter(regexp_split_to_array(translate(lower(query_text), '?.!,', ''), '\\s+'), lambda w: w <> '') AS ws FROM query), b AS (SELECT *, list_filter(ws, lambda w: NOT list_contains(%s, w) AND length(w) > 2) AS kw FROM a) SELECT query_id, CASE WHEN len(kw) > 0 THEN kw ELSE ws END AS keywords FROM b" % ("[" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + "]"))
def e02_keywords(x: Fixtures) -> DataFrame:
    return x.query().select("query_id", search.keywords(F.col("query_text")).alias("keywords"))


@query(BASE, VEC + " SELECT query_id, chunk_id, score, rank FROM vec")
def e03_vector_search(x: Fixtures) -> DataFrame:
    return search.vector_search(x.query(), x.chunk(), x.embedding(), MODEL)


@query(BASE, "WITH " + LEX + " SELECT query_id, chunk_id, score, rank FROM lex")
def e04_lexical_search(x: Fixtures) -> DataFrame:
    return search.lexical_search(x.query(), x.chunk())


@query(BASE, "WITH " + LEX.replace("WHERE deleted_at IS NULL", "WHERE deleted_at IS NULL AND document_id % 10 <> 7") + " SELECT query_id, chunk_id, score, rank FROM lex")
def e04_stored_index(x: Fixtures) -> DataFrame:
    """An index of all chunks in which every tenth document still has another text; then the new texts come in, and every tenth document goes."""
    path, rows = shared_folder(x.spark), search.live(x.chunk())
    other = F.when(F.col("document_id") % 10 == 3, F.concat(F.lit("old "), F.reverse("content"))).otherwise(F.col("content"))
    postings.build(rows.withColumn("content", other), path)
    postings.upsert(rows.filter("document_id % 10 = 3"), path, rows.filter("document_id % 10 = 7").select("document_id"))
    return search.lexical_search(x.query(), rows, index=path)


@query(BASE, HYB + " SELECT query_id, chunk_id, vector_rank, lexical_rank, score, rank FROM top")
def e05_hybrid_search(x: Fixtures) -> DataFrame:
    return search.hybrid_search(x.query(), x.chunk(), x.embedding(), MODEL)


@query(BASE, HYB + " SELECT query_id, top.rank, chunk_id, content, vector_rank, lexical_rank, score, document_id, file_name, page_number FROM top JOIN chunk USING (chunk_id)")
def e06_cited_search(x: Fixtures) -> DataFrame:
    hits = search.cited(search.hybrid_search(x.query(), x.chunk(), x.embedding(), MODEL), x.chunk())
    return hits.select("query_id", "rank", "chunk_id", "content", "ranks.*", "citation.*")


@query(BASE, ITEMS.replace("FROM vec)", "FROM cos)") + " SELECT query_id, chunk_id, score, keyword_matched, row_number() OVER (PARTITION BY query_id ORDER BY keyword_matched DESC, score DESC, chunk_id) AS rank FROM items WHERE keyword_matched OR score >= 0.1")
def e07_keyword_override(x: Fixtures) -> DataFrame:
    return search.search_with_keywords(x.query(), x.chunk(), x.embedding(), MODEL, 0.1)


COSINE = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda x: x::DOUBLE * x::DOUBLE))))"


@query(BASE, VEC.replace("WITH cos AS", "WITH RECURSIVE cos AS", 1) + f""", cand AS (SELECT vec.query_id, vec.chunk_id, rank, e.embedding AS v, {COSINE.format(a="q.query_vec", b="e.embedding")} AS near FROM vec JOIN embedding e ON e.chunk_id = vec.chunk_id AND e.model_name = 'm0' JOIN query q ON q.query_id = vec.query_id),
alike AS (SELECT a.query_id, a.chunk_id, b.chunk_id AS other, {COSINE.format(a="a.v", b="b.v")} AS s FROM cand a JOIN cand b USING (query_id)),
picks AS (SELECT query_id, chunk_id, 1 AS pick, [chunk_id] AS chosen FROM cand WHERE rank = 1 UNION ALL
  SELECT query_id, chunk_id, pick + 1, list_append(chosen, chunk_id) FROM (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS first FROM
    (SELECT p.query_id, p.pick, p.chosen, c.chunk_id, c.rank, round(0.5 * c.near - 0.5 * max(alike.s), 9) AS gain FROM picks p JOIN cand c ON c.query_id = p.query_id AND NOT list_contains(p.chosen, c.chunk_id) JOIN alike ON alike.query_id = c.query_id AND alike.chunk_id = c.chunk_id AND list_contains(p.chosen, alike.other)
     WHERE p.pick < 5 GROUP BY p.query_id, p.pick, p.chosen, c.chunk_id, c.rank, c.near) g) WHERE first = 1)
SELECT query_id, chunk_id, pick FROM picks""")
def e08_diversify(x: Fixtures) -> DataFrame:
    hits = search.vector_search(x.query(), x.chunk(), x.embedding(), MODEL)
    c = hits.join(x.embedding().filter(F.col("model_name") == MODEL).select("chunk_id", "embedding"), "chunk_id").join(search.sized(x.query().select("query_id", "query_vec")), "query_id")
    return search.diversify(c)


@query(BASE, VEC + " SELECT query_id, least(count(*), 5) AS picks, least(count(*), 5) AS different, 0::BIGINT AS foreign_picks, min(CASE WHEN rank = 1 THEN chunk_id END) AS first_pick FROM vec GROUP BY 1")
def e08_diversify_properties(x: Fixtures) -> DataFrame:
    """Picks are distinct candidates, as many as asked for, and begin with the best one."""
    hits = search.vector_search(x.query(), x.chunk(), x.embedding(), MODEL)
    c = hits.join(x.embedding().filter(F.col("model_name") == MODEL).select("chunk_id", "embedding"), "chunk_id").join(search.sized(x.query().select("query_id", "query_vec")), "query_id")
    picked = search.diversify(c).join(hits.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")
    return picked.groupBy("query_id").agg(F.count(F.lit(1)).alias("picks"), F.count_distinct("chunk_id").alias("different"), F.count_if(F.col("rank").isNull()).alias("foreign_picks"), F.min(F.when(F.col("pick") == 1, F.col("chunk_id"))).alias("first_pick"))


@query(BASE, VEC + """, r AS (SELECT query_id, chunk_id, round(0.7 * score + 0.3 * 0.05 * len(list_intersect(list_filter(regexp_split_to_array(lower(query_text), '\\s+'), lambda w: w <> ''), list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> ''))), 7) AS reranked FROM vec)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, chunk_id) AS rank FROM r""")
def e09_rerank(x: Fixtures) -> DataFrame:
    return search.rerank(_items(x).drop("rank"))


@query("chunk", "SELECT a.chunk_id, concat_ws(chr(10) || chr(10), b.content, a.content, c.content) AS expanded FROM chunk a LEFT JOIN chunk b ON b.document_id = a.document_id AND b.page_number = a.page_number AND b.chunk_index = a.chunk_index - 1 LEFT JOIN chunk c ON c.document_id = a.document_id AND c.page_number = a.page_number AND c.chunk_index = a.chunk_index + 1")
def e10_neighbours(x: Fixtures) -> DataFrame:
    return search.with_neighbours(x.chunk())


@query(BASE, VEC + """, n AS (SELECT *, list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '') AS ws FROM vec), s AS (SELECT *, sum(len(ws)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM n)
SELECT query_id, rank, chunk_id, CASE WHEN total <= 300 THEN content ELSE array_to_string(ws[1 : (300 - (total - len(ws)))::INT], ' ') || '...' END AS content FROM s WHERE total <= 300 OR (total - len(ws) <= 300 AND 300 - (total - len(ws)) > 20)""")
def e11_compress(x: Fixtures) -> DataFrame:
    return search.compress(_items(x).select("query_id", "rank", "chunk_id", "content"), 300)


@query(BASE + " element", VEC + """, m AS (SELECT query_id, chunk_id, block_id, bounding_box, CASE WHEN element_type = 'heading' THEN e.content END AS heading, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY reading_order) AS nth
FROM vec JOIN element e ON e.document_id = vec.document_id AND length(e.content) > 20 AND (contains(vec.content, e.content) OR contains(e.content, vec.content)) QUALIFY nth = 1)
SELECT vec.query_id, vec.chunk_id, block_id, bounding_box, heading FROM vec LEFT JOIN m USING (query_id, chunk_id)""")
def e12_layout(x: Fixtures) -> DataFrame:
    return search.layout_of(_items(x).select("query_id", "chunk_id", "document_id", "content"), x.element())


NEAR = ITEMS + """, near AS (SELECT query_id, c.chunk_id, c.document_id, c.page_number, c.chunk_index, c.content, max(i.score) AS score, bool_or(i.keyword_matched) AS keyword_matched
FROM items i JOIN chunk c ON c.document_id = i.document_id AND c.page_number = i.page_number AND c.chunk_index BETWEEN i.chunk_index - 1 AND i.chunk_index + 3 GROUP BY ALL),
runs AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, document_id, page_number ORDER BY chunk_index) AS run FROM near),
pairs AS (SELECT *, (row_number() OVER (PARTITION BY query_id, document_id, page_number, run ORDER BY chunk_index) - 1) // 2 AS pair FROM runs),
made AS (SELECT query_id, document_id, page_number, min(chunk_index) AS chunk_index, min(chunk_id) AS chunk_id, list(content ORDER BY chunk_index) AS c, max(score) AS score, bool_or(keyword_matched) AS keyword_matched FROM pairs GROUP BY query_id, document_id, page_number, run, pair),
merged AS (SELECT query_id, document_id, page_number, chunk_index, chunk_id, CASE WHEN len(c) = 1 OR contains(c[1], c[2]) THEN c[1] ELSE c[1] || chr(10) || chr(10) || c[2] END AS content, score, keyword_matched, row_number() OVER (PARTITION BY query_id ORDER BY document_id, page_number, chunk_index) AS position FROM made)"""


def _near(x: Fixtures) -> DataFrame:
    """The best vector hits of each query with the chunks about them: one before, three after."""
    hits = _items(x).select("query_id", "document_id", "page_number", F.explode(F.sequence(F.col("chunk_index") - 1, F.col("chunk_index") + 3)).alias("chunk_index"), "score", "keyword_matched")
    hits = hits.groupBy("query_id", "document_id", "page_number", "chunk_index").agg(F.max("score").alias("score"), F.max("keyword_matched").alias("keyword_matched"))
    return hits.join(x.chunk().select("document_id", "page_number", "chunk_index", "chunk_id", "content"), ["document_id", "page_number", "chunk_index"])


@query(BASE, NEAR + " SELECT * FROM merged")
def e13_merge_adjacent(x: Fixtures) -> DataFrame:
    return search.merge_adjacent(_near(x))


@query(BASE, NEAR + " SELECT query_id, list(chunk_id ORDER BY position) AS chunk_ids FROM merged GROUP BY 1")
def e14_document_order(x: Fixtures) -> DataFrame:
    made = search.merge_adjacent(_near(x)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))).alias("a"))
    return made.select("query_id", F.col("a.chunk_id").alias("chunk_ids"))


@query(BASE, NEAR + """ SELECT query_id, list(chunk_id ORDER BY position) AS chunk_ids, list(page_number ORDER BY position) AS pages, list(score ORDER BY position) AS scores, floor((2 * sum(round(score * 1e6)::BIGINT) + count(*))::DOUBLE / (2 * count(*))) / 1e6 AS avg_score, count(DISTINCT (document_id, page_number)) AS n_pages, count(*) AS n_chunks, round(least(1.0, floor((2 * sum(round(score * 1e6)::BIGINT) + count(*))::DOUBLE / (2 * count(*))) / 1e6 * 1.2), 6) AS confidence FROM merged GROUP BY 1""")
def e15_assemble(x: Fixtures) -> DataFrame:
    made = search.assemble(search.merge_adjacent(_near(x)))
    return made.select("query_id", F.col("hits.chunk_id").alias("chunk_ids"), F.col("hits.page_number").alias("pages"), F.col("hits.score").alias("scores"), "avg_score", "n_pages", "n_chunks", "confidence")


@query(BASE + " element", VEC + """, m AS (SELECT query_id, chunk_id, e.content AS heading, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY reading_order DESC) AS nth FROM vec JOIN element e ON e.document_id = vec.document_id AND e.page_number = vec.page_number AND element_type = 'heading' AND reading_order <= chunk_index QUALIFY nth = 1)
SELECT vec.query_id, vec.chunk_id, coalesce(heading, '') AS heading FROM vec LEFT JOIN m USING (query_id, chunk_id)""")
def e16_heading_per_row(x: Fixtures) -> DataFrame:
    items = _items(x).select("query_id", "chunk_id", "document_id", "page_number", "chunk_index")
    heads = x.element().filter("element_type = 'heading'").select("document_id", "page_number", "reading_order", F.col("content").alias("heading"))
    last = items.join(heads, ["document_id", "page_number"]).filter("reading_order <= chunk_index").groupBy("query_id", "chunk_id").agg(F.max_by("heading", "reading_order").alias("heading"))
    return items.select("query_id", "chunk_id").join(last, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("heading", F.lit("")).alias("heading"))


GATE = ITEMS + ", gate AS (SELECT q.query_id, count(i.chunk_id) AS n_items, max(i.score) AS best_score, count(i.chunk_id) = 0 OR (NOT bool_or(i.keyword_matched) AND max(i.score) < 0.35) AS refused FROM query q LEFT JOIN items i USING (query_id) GROUP BY 1)"


@query(BASE, GATE + " SELECT * FROM gate")
def e17_evidence_gate(x: Fixtures) -> DataFrame:
    return search.evidence_gate(x.query(), _items(x))


def _answers(x: Fixtures) -> DataFrame:
    b = x.t("benchmark")
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("o"))
    text = F.when(F.col("item_id") % 5 == 0, F.lit(search.REFUSAL)).otherwise(F.concat("text", F.lit(" Entirely unrelated zzzz qqqq sentence. "), "o"))
    return b.join(other, "item_id").select(F.col("item_id").alias("query_id"), text.alias("answer"))


ANSWERS = "answers AS (SELECT b.item_id AS query_id, CASE WHEN b.item_id % 5 = 0 THEN 'I couldn''t find this information in the uploaded document.' ELSE b.text || ' Entirely unrelated zzzz qqqq sentence. ' || o.text END AS answer FROM benchmark b JOIN benchmark o ON o.item_id + 1 = b.item_id)"


@query("", "WITH " + ANSWERS + """, ctx AS (SELECT item_id AS query_id, lower(text) AS c FROM benchmark),
s AS (SELECT query_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS sentence FROM (SELECT query_id, string_split(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM answers WHERE NOT contains(lower(answer), 'couldn''t find') AND NOT contains(lower(answer), 'not contain enough')) ),
w AS (SELECT *, translate(lower(trim(sentence)), ',.?!', '') AS s, list_filter(regexp_split_to_array(translate(lower(trim(sentence)), ',.?!', ''), '\\s+'), lambda x: length(x) > 3) AS lw FROM s WHERE trim(sentence) <> ''),
k AS (SELECT DISTINCT query_id, pos, sentence FROM w JOIN ctx USING (query_id) WHERE len(lw) = 0 OR contains(c, s) OR contains(s, c) OR len(list_filter(lw, lambda x: contains(c, x)))::DOUBLE / len(lw) >= 0.4),
t AS (SELECT query_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM k GROUP BY 1)
SELECT query_id, CASE WHEN contains(lower(answer), 'couldn''t find') OR contains(lower(answer), 'not contain enough') THEN answer ELSE coalesce(text, '') END AS grounded FROM answers LEFT JOIN t USING (query_id)""")
def e18_ground(x: Fixtures) -> DataFrame:
    return search.ground(_answers(x), x.t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("content")))


@query(BASE, VEC + """, a AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'See [Doc: doc_' || (query_id // 4) || '.pdf, Page: 1] and [Doc: doc_' || (query_id // 4 + 6) || '.pdf, Page: 1][Doc: none.txt, Page: 3]' ELSE 'No source.' END AS answer FROM query),
p AS (SELECT query_id, unnest(regexp_extract_all(answer, '\\[Doc:\\s*([^,\\]]+),\\s*Page:\\s*(\\d+)\\]', 1)) AS file_name, unnest(regexp_extract_all(answer, '\\[Doc:\\s*([^,\\]]+),\\s*Page:\\s*(\\d+)\\]', 2))::INT AS page_number FROM a),
n AS (SELECT query_id, count(*) AS n_parsed FROM p GROUP BY 1),
f AS (SELECT DISTINCT p.query_id, p.file_name, p.page_number, c.chunk_id, coalesce(v.score, -1) AS score FROM p JOIN chunk c ON c.file_name = p.file_name AND c.page_number = p.page_number AND c.deleted_at IS NULL LEFT JOIN vec v ON v.query_id = p.query_id AND v.chunk_id = c.chunk_id)
SELECT query_id, file_name, page_number, arg_max(chunk_id, (score, -chunk_id)) AS chunk_id, any_value(n_parsed) AS n_parsed FROM f JOIN n USING (query_id) GROUP BY 1, 2, 3""")
def e19_citations(x: Fixtures) -> DataFrame:
    i = F.floor(F.col("query_id") / 4)
    cite = F.concat(F.lit("See [Doc: doc_"), i, F.lit(".pdf, Page: 1] and [Doc: doc_"), i + 6, F.lit(".pdf, Page: 1][Doc: none.txt, Page: 3]"))
    answers = x.query().select("query_id", F.when(F.col("query_id") % 4 == 0, cite).otherwise("No source.").alias("answer"))
    return search.citations(answers, x.chunk(), search.vector_search(x.query(), x.chunk(), x.embedding(), MODEL))


MODES_SQL = "modes AS (SELECT unnest(%s) AS mode, unnest(%s) AS instruction)" % tuple("[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in vs) + "]" for vs in (search.MODES.keys(), search.MODES.values()))


@query(BASE, HYB + ", " + MODES_SQL + """, q AS (SELECT query_id, query_text, CASE query_id % 3 WHEN 0 THEN 'Summary' WHEN 1 THEN 'flashcards' ELSE 'nosuch' END AS mode FROM query),
b AS (SELECT query_id, string_agg('Context Block ' || top.rank || ':' || chr(10) || 'Document:' || chr(10) || file_name || repeat(chr(10), 2) || 'Page:' || chr(10) || page_number || repeat(chr(10), 2) || 'Chunk:' || chr(10) || chunk_id || repeat(chr(10), 2) || 'Text:' || chr(10) || trim(content), repeat(chr(10), 2) || '---' || repeat(chr(10), 2) ORDER BY top.rank) AS blocks, count(*) AS n_blocks FROM top JOIN chunk USING (chunk_id) GROUP BY 1),
u AS (SELECT query_id, coalesce(instruction, (SELECT instruction FROM modes WHERE mode = 'detailed')) AS instruction, coalesce(blocks, 'Document:' || chr(10) || 'None' || repeat(chr(10), 2) || 'Page:' || chr(10) || 'None' || repeat(chr(10), 2) || 'Chunk:' || chr(10) || 'None' || repeat(chr(10), 2) || 'Text:' || chr(10) || 'None') || repeat(chr(10), 2) || 'Question:' || chr(10) || query_text AS user_prompt, coalesce(n_blocks, 0) AS n_blocks FROM q LEFT JOIN modes ON modes.mode = lower(q.mode) LEFT JOIN b USING (query_id)),
n AS (SELECT *, len(list_filter(regexp_split_to_array(user_prompt, '\\s+'), lambda w: w <> '')) + len(list_filter(regexp_split_to_array(instruction, '\\s+'), lambda w: w <> '')) AS n FROM u)
SELECT query_id, instruction, user_prompt, n_blocks, greatest(50, 400 - n) AS words_left, floor(n * 13 / 10) > 400 AS over_budget FROM n""")
def e20_prompts(x: Fixtures) -> DataFrame:
    q = x.query().select("query_id", "query_text", F.expr("CASE query_id % 3 WHEN 0 THEN 'Summary' WHEN 1 THEN 'flashcards' ELSE 'nosuch' END AS mode"))
    hits = search.hybrid_search(x.query(), x.chunk(), x.embedding(), MODEL)
    context = cut(hits.select("query_id", "chunk_id", F.col("rank").alias("position"))).join(x.chunk().select("chunk_id", "file_name", "page_number", "content"), "chunk_id")
    return search.prompts(q, context, 400)


@query(BASE, HYB + """, l AS (SELECT query_id, string_agg('Source [' || file_name || ', Page ' || page_number || ']: ' || CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END, chr(10) ORDER BY top.rank) AS lines FROM top JOIN chunk USING (chunk_id) WHERE top.rank <= 3 GROUP BY 1)
SELECT query_id, 'Source Context:' || chr(10) || coalesce(lines, '') || repeat(chr(10), 2) || 'Question: ' || query_text AS prompt FROM query LEFT JOIN l USING (query_id)""")
def e20_short_prompt(x: Fixtures) -> DataFrame:
    return search.short_prompt(x.query(), search.hybrid_search(x.query(), x.chunk(), x.embedding(), MODEL), x.chunk())


@query(BASE, GATE + """, g AS (SELECT query_id, list_sort(list(DISTINCT chunk_id)) AS chunk_ids, list_sort(list(DISTINCT page_number)) AS pages FROM items GROUP BY 1)
SELECT query_id, chunk_ids, pages, best_score, refused, CASE WHEN n_items = 0 THEN 'no chunk was found' WHEN refused THEN 'no keyword, and all scores are low' ELSE 'accepted' END AS explanation FROM gate LEFT JOIN g USING (query_id)""")
def e21_diagnostics(x: Fixtures) -> DataFrame:
    return search.diagnostics(x.query(), _items(x))


@query("chunk", "SELECT chunk_id, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) * 13 // 10 AS tokens FROM chunk")
def c01_tokens(x: Fixtures) -> DataFrame:
    return x.chunk().select("chunk_id", estimated_tokens(F.col("content")).alias("tokens"))


@query("chunk", "SELECT chunk_id, CASE WHEN length(content) > 200 THEN left(content, 200) || '...' ELSE content END AS snippet FROM chunk")
def b12_snippet(x: Fixtures) -> DataFrame:
    return x.chunk().select("chunk_id", snippet(F.col("content")).alias("snippet"))


@query("chunk document", "SELECT chunk_id, document_id, page_number FROM chunk WHERE deleted_at IS NULL AND document_id IN (SELECT document_id FROM document WHERE user_id = 3) AND page_number BETWEEN 1 AND 2")
def b07_scope(x: Fixtures) -> DataFrame:
    return search.scoped(x.chunk(), x.document().filter("user_id = 3"), 1, 2).select("chunk_id", "document_id", "page_number")


@query("chunk", "SELECT chunk_id, project_id FROM chunk WHERE project_id = 'src1' AND deleted_at IS NULL")
def b01_tenant(x: Fixtures) -> DataFrame:
    return search.live(x.chunk()).filter("project_id = 'src1'").select("chunk_id", "project_id")
