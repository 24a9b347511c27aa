"""Queries over sources, sheets, blocks and chunks, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate import sources
from foliate.operators import chunking, sheets
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


@query("document", r"""WITH e AS (SELECT document_id, file_name AS name, (document_id * 7919 % 20000000) AS length, lower(regexp_extract(file_name, '\.([^./]+)$', 1)) AS extension FROM document)
SELECT *, CASE WHEN extension IN ('jpg', 'jpeg', 'png') THEN 'image' WHEN extension = 'txt' THEN 'text' WHEN extension IN ('csv', 'xls', 'xlsx') THEN 'spreadsheet' WHEN extension IN ('pdf', 'docx') THEN extension ELSE 'unknown' END AS file_type,
CASE WHEN extension NOT IN ('pdf', 'jpg', 'jpeg', 'png', 'docx', 'txt', 'csv', 'xlsx', 'xls') THEN 'unsupported format' WHEN length > 10485760 THEN 'too large' END AS problem FROM e""")
def a01_catalog(x: Fixtures) -> DataFrame:
    return sources.classified(x.document().select("document_id", F.col("file_name").alias("name"), (F.col("document_id") * 7919 % 20000000).alias("length")))


@query("", "SELECT doc_id, text FROM documents")
def a02_decode(x: Fixtures) -> DataFrame:
    latin = F.col("text").rlike(r"^[\x00-\xFF]*$") & (F.col("doc_id") % 2 == 1)
    data = F.when(latin, F.encode(F.when(latin, F.col("text")).otherwise(""), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return x.t("documents").select("doc_id", sources.decode_text(data).alias("text"))


FULL = "len(list_filter(cells, lambda c: c <> '')) > 0"


@query("grid", f"SELECT sheet_id, rn, cells FROM (SELECT *, max(CASE WHEN {FULL} THEN rn END) OVER (PARTITION BY sheet_id) AS last FROM grid) WHERE rn <= last")
def a03_trim_sheet(x: Fixtures) -> DataFrame:
    return sources.trimmed(x.grid())


@query("", "SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(text, '')) AS text_md5, 3 AS n_cells FROM documents")
def a03_load_sheets(x: Fixtures) -> DataFrame:
    """All documents written as delimited files, with the line breaks of their texts in quotes, and read back in blocks."""
    folder = sources.shared_folder(x.spark)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    x.t("documents").select(F.concat_ws(",", "doc_id", quoted(F.col("source")), quoted(F.col("text"))).alias("value")).write.text(folder)
    rows = sources.load_sheets(x.spark, folder, sep=",")
    return rows.select(F.col("cells")[0].cast("bigint").alias("doc_id"), F.col("cells")[1].alias("source"), F.md5(F.col("cells")[2]).alias("text_md5"), F.size("cells").alias("n_cells"))


@query("grid", f"SELECT sheet_id, min(rn) AS header_rn, arg_min(cells, rn) AS header FROM grid WHERE {FULL} GROUP BY 1")
def a04_header(x: Fixtures) -> DataFrame:
    return sheets.header_rows(x.grid())


@query("", "SELECT p_partkey, coalesce(trim(p_name), '') AS name, CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day FROM part JOIN orders ON o_orderkey = p_partkey")
def a05_cell_text(x: Fixtures) -> DataFrame:
    rows = x.t("part").join(x.t("orders"), F.col("o_orderkey") == F.col("p_partkey"))
    return rows.select("p_partkey", sheets.cell_text(F.col("p_name"), "string").alias("name"), sheets.cell_text(F.col("p_retailprice"), "double").alias("price"), sheets.cell_text(F.col("o_orderdate"), "timestamp").alias("day"))


HEAD = f"head AS (SELECT sheet_id, min(rn) AS header_rn, arg_min(cells, rn) AS header FROM grid WHERE {FULL} GROUP BY 1)"


@query("grid", f"WITH {HEAD} SELECT sheet_id, rn, array_to_string(cells, ' | ') AS content, ['A' || rn, 'B' || rn, 'C' || rn, 'D' || rn] AS names, cells[2] AS b FROM grid JOIN head USING (sheet_id) WHERE rn > header_rn AND {FULL}")
def a06_row_elements(x: Fixtures) -> DataFrame:
    made = sheets.row_elements(x.grid())
    return made.select("sheet_id", "rn", "content", F.array_sort(F.map_keys("coordinates")).alias("names"), F.element_at("coordinates", F.concat(F.lit("B"), F.col("rn").cast("string"))).alias("b"))


@query("grid", """WITH c AS (SELECT sheet_id, rn, unnest(range(1, 5)) AS cn, unnest(cells) AS value FROM grid),
r AS (SELECT * FROM (VALUES (3, 5, 1, 2), (8, 9, 3, 4)) v(a, b, c, d))
SELECT c.sheet_id, c.rn, c.cn, coalesce(t.value, c.value) AS value FROM c LEFT JOIN r ON c.rn BETWEEN r.a AND r.b AND c.cn BETWEEN r.c AND r.d LEFT JOIN c t ON t.sheet_id = c.sheet_id AND t.rn = r.a AND t.cn = r.c""")
def a07_merged_cells(x: Fixtures) -> DataFrame:
    cells = x.grid().select("sheet_id", "rn", F.posexplode("cells").alias("pos", "value")).select("sheet_id", "rn", (F.col("pos") + 1).cast("bigint").alias("cn"), "value")
    ranges = F.array(*[F.struct(F.lit(a).cast("bigint").alias("min_row"), F.lit(b).cast("bigint").alias("max_row"), F.lit(c).cast("bigint").alias("min_col"), F.lit(d).cast("bigint").alias("max_col")) for a, b, c, d in ((3, 5, 1, 2), (8, 9, 3, 4))])
    merges = x.grid().select("sheet_id").distinct().select("sheet_id", F.inline(ranges))
    return sheets.fill_merged(cells, merges)


@query("grid", """SELECT sheet_id, '<table>' || string_agg('<tr>' || array_to_string(list_transform(cells, lambda c: '<td>' || replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>'), '') || '</tr>', '' ORDER BY rn) || '</table>' AS html FROM grid GROUP BY 1""")
def a08_html(x: Fixtures) -> DataFrame:
    return sheets.as_html(x.grid())


@query("marked_text", "SELECT document_id, string_agg(raw_text, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM marked_text GROUP BY 1")
def a09_full_text(x: Fixtures) -> DataFrame:
    return x.marked_text().groupBy("document_id").agg(chunking.joined(F.collect_list(F.struct("page_number", "raw_text")), "raw_text", "\n\n").alias("full_text"))


@query("document", """WITH f AS (SELECT document_id, file_name, status, text FROM document JOIN documents ON doc_id = document_id)
SELECT document_id, 0 AS nth, 'meta' AS key, '{"size":' || length(text) || '}' AS value FROM f UNION ALL SELECT document_id, 1, 'name', file_name FROM f UNION ALL SELECT document_id, 2, 'status', status FROM f UNION ALL SELECT document_id, 3, 'full_text', text FROM f""")
def a10_export_rows(x: Fixtures) -> DataFrame:
    rows = x.document().join(x.t("documents"), F.col("doc_id") == F.col("document_id"))
    fields = F.create_map(F.lit("name"), "file_name", F.lit("status"), "status", F.lit("meta"), F.to_json(F.struct(F.length("text").alias("size"))))
    return sources.export_rows(rows.select("document_id", fields.alias("fields"), F.col("text").alias("full_text")))


@query("chunk", "SELECT chunk_id, document_id, 'old' AS run FROM chunk WHERE document_id % 10 <> 0 UNION ALL SELECT chunk_id, document_id, 'new' FROM chunk WHERE document_id % 10 = 0 AND chunk_index < 3")
def a11_replace_stage(x: Fixtures) -> DataFrame:
    c = x.chunk().select("chunk_id", "document_id", "chunk_index")
    new = c.filter("document_id % 10 = 0 and chunk_index < 3").select("chunk_id", "document_id", F.lit("new").alias("run"))
    return sources.replace_keys(c.select("chunk_id", "document_id", F.lit("old").alias("run")), new, "document_id")


@query("document", "SELECT document_id, NULL::VARCHAR AS parser, NULL::INT AS pages, file_name FROM document")
def a12_align(x: Fixtures) -> DataFrame:
    schema = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("parser", T.StringType()), T.StructField("pages", T.IntegerType())])
    return sources.aligned(x.document().select("document_id", "file_name"), schema)


@query("document chunk", """WITH k AS (SELECT document_id FROM document WHERE user_id = 3 AND document_id % 2 = 0)
SELECT 'document' AS table_name, count(*) AS deleted FROM document WHERE document_id IN (FROM k) UNION ALL SELECT 'chunk', count(*) FROM chunk WHERE document_id IN (FROM k)""")
def a13_cascade(x: Fixtures) -> DataFrame:
    keys = x.document().filter("user_id = 3 and document_id % 2 = 0").select("document_id")
    return sources.cascade(keys, {"document": x.document(), "chunk": x.chunk()}, "document_id")[1]


@query("grid", "SELECT sheet_id, rn FROM grid WHERE rn <= 1000 AND len(list_filter(cells, lambda c: contains(lower(c), 'brand#1'))) > 0")
def b04_search_grid(x: Fixtures) -> DataFrame:
    return sheets.search_grid(x.grid(), "Brand#1", 1000).select("sheet_id", "rn")


@query("grid", "SELECT sheet_id, rn, cells[3] AS cell, row_number() OVER (PARTITION BY sheet_id ORDER BY try_cast(cells[3] AS DOUBLE) NULLS LAST, cells[3], rn) AS place FROM grid")
def b05_mixed_order(x: Fixtures) -> DataFrame:
    return sheets.mixed_order(x.grid(), 2)


BLOCKS = r"""l AS (SELECT document_id, page_number, unnest(range(len(s))) AS pos, trim(regexp_replace(unnest(s), '^\s+|\s+$', '', 'g')) AS line FROM (SELECT *, string_split(raw_text, chr(10)) AS s FROM marked_text)),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s+') THEN 'heading' WHEN regexp_matches(line, '^(\*|-|\d+\.)\s+') THEN 'list_item' ELSE 'paragraph' END AS kind FROM l),
b AS (SELECT *, lag(kind) OVER (PARTITION BY document_id, page_number ORDER BY pos) AS before FROM k),
r AS (SELECT *, sum(CASE WHEN kind <> 'paragraph' OR before IS NULL OR before <> 'paragraph' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page_number ORDER BY pos) AS run FROM b),
g AS (SELECT document_id, page_number, run, any_value(kind) AS block_type, string_agg(line, ' ' ORDER BY pos) AS content FROM r WHERE kind <> 'blank' GROUP BY 1, 2, 3),
blocks AS (SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY run) AS block_index, block_type, CASE WHEN block_type = 'heading' THEN length(regexp_extract(content, '^(#{1,6})\s', 1)) END AS level, content FROM g)"""
SECTIONS = BLOCKS + r""", t AS (SELECT *, CASE WHEN level = 1 THEN trim(regexp_replace(content, '^#{1,6}\s+', '')) END AS h1, CASE WHEN level = 2 THEN trim(regexp_replace(content, '^#{1,6}\s+', '')) END AS h2, CASE WHEN level >= 3 THEN trim(regexp_replace(content, '^#{1,6}\s+', '')) END AS h3 FROM blocks),
s AS (SELECT t.*, (SELECT arg_max(h1, block_index) FROM t a WHERE a.document_id = t.document_id AND a.page_number = t.page_number AND a.block_index <= t.block_index AND a.level = 1) AS p1,
 (SELECT max(block_index) FROM t a WHERE a.document_id = t.document_id AND a.page_number = t.page_number AND a.block_index <= t.block_index AND a.level = 1) AS i1 FROM t),
s2 AS (SELECT s.*, (SELECT arg_max(h2, block_index) FROM t a WHERE a.document_id = s.document_id AND a.page_number = s.page_number AND a.block_index <= s.block_index AND a.level = 2 AND a.block_index > coalesce(s.i1, 0)) AS p2,
 (SELECT max(block_index) FROM t a WHERE a.document_id = s.document_id AND a.page_number = s.page_number AND a.block_index <= s.block_index AND a.level = 2 AND a.block_index > coalesce(s.i1, 0)) AS i2 FROM s),
sections AS (SELECT document_id, page_number, block_index, block_type, content, coalesce(nullif(concat_ws(' > ', nullif(p1, ''), nullif(p2, ''), nullif((SELECT arg_max(h3, block_index) FROM t a WHERE a.document_id = s2.document_id AND a.page_number = s2.page_number AND a.block_index <= s2.block_index AND a.level >= 3 AND a.block_index > greatest(coalesce(s2.i1, 0), coalesce(s2.i2, 0))), '')), ''), 'Introduction') AS section_path FROM s2)"""


@query("marked_text", "WITH " + BLOCKS + " SELECT * FROM blocks")
def c02_blocks(x: Fixtures) -> DataFrame:
    return chunking.blocks(x.marked_text())


@query("marked_text", "WITH " + SECTIONS + " SELECT * FROM sections")
def c03_sections(x: Fixtures) -> DataFrame:
    return chunking.with_sections(chunking.blocks(x.marked_text()))


def _n_words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def _head(path: str) -> str:
    return f"('Document: ' || file_name || chr(10) || 'Page: ' || page_number || chr(10) || 'Section Path: ' || {path} || chr(10) || '---' || chr(10))"


def _packed(target: int, most: int, overlap: int, where: str = "true") -> str:
    """The packing as a recursion over a page's blocks: what is held, its section, and what each block makes come out."""
    lap = int(overlap * 0.75)
    return SECTIONS + f""", pieces AS (SELECT s.document_id, page_number, file_name, block_index AS i, section_path AS path, content AS block, {_head('section_path')} AS head, floor({_n_words(_head('section_path') + " || content")} * 1.3::DOUBLE) AS whole, floor({_n_words(_head('section_path'))} * 1.3::DOUBLE) AS own FROM sections s JOIN document USING (document_id) WHERE {where}),
steps AS (SELECT document_id, page_number, 0::BIGINT AS i, '' AS held, 'Introduction' AS section, []::VARCHAR[] AS made FROM (SELECT DISTINCT document_id, page_number FROM pieces)
 UNION ALL SELECT document_id, page_number, i, CASE WHEN fits THEN longer WHEN big THEN '' WHEN tail = '' THEN block ELSE tail || chr(10) || chr(10) || block END, CASE WHEN big AND NOT fits THEN section ELSE path END,
  CASE WHEN fits THEN [] ELSE list_concat(CASE WHEN held = '' THEN [] ELSE [{_head('section')} || held] END, CASE WHEN big THEN list_transform(range(0, len(ws), size - CASE WHEN {lap} >= size THEN size // 5 ELSE {lap} END), lambda j: head || array_to_string(ws[j + 1 : j + size], ' ')) ELSE [] END) END
 FROM (SELECT *, floor({_n_words("head || longer")} * 1.3::DOUBLE) <= {target} AS fits, CASE WHEN trunc(({target} - own) * 0.75)::INT > 0 THEN trunc(({target} - own) * 0.75)::INT ELSE 50 END AS size,
   CASE WHEN len(hs) <= {lap} THEN held ELSE array_to_string(hs[len(hs) - {lap - 1} :], ' ') END AS tail
  FROM (SELECT b.*, s.held, s.section, whole > {most} AS big, CASE WHEN s.held = '' THEN block ELSE s.held || chr(10) || chr(10) || block END AS longer, {_words("block")} AS ws, {_words("s.held")} AS hs
   FROM steps s JOIN pieces b ON b.document_id = s.document_id AND b.page_number = s.page_number AND b.i = s.i + 1))),
last AS (SELECT document_id, page_number, max(i) AS i FROM steps GROUP BY 1, 2),
parts AS (SELECT document_id, page_number, i, unnest(made) AS content, unnest(range(len(made))) AS j FROM steps
 UNION ALL SELECT s.document_id, s.page_number, s.i + 1, {_head('section')} || held, 0 FROM steps s JOIN last USING (document_id, page_number, i) JOIN document USING (document_id) WHERE held <> '')"""


PACKED_PAGES = "WITH RECURSIVE " + _packed(120, 200, 30) + " SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY i, j) - 1 AS nth, content FROM parts"


@query("marked_text document", PACKED_PAGES)
def c04_pack_pages(x: Fixtures) -> DataFrame:
    rows = chunking.with_sections(chunking.blocks(x.marked_text())).join(x.document().select("document_id", "file_name"), "document_id")
    return chunking.pack_pages(rows, 120, 200, 30)


@query("marked_text document", PACKED_PAGES)
def c04_table_function(x: Fixtures) -> DataFrame:
    """The same rows by the table function, from SQL."""
    rows = chunking.with_sections(chunking.blocks(x.marked_text())).join(x.document().select("document_id", "file_name"), "document_id")
    x.spark.udtf.register("pack_pages", chunking.PackPages)
    return x.spark.sql("SELECT * FROM pack_pages(TABLE({rows}) PARTITION BY (document_id, page_number) ORDER BY (block_index), 120, 200, 30)", rows=rows)


@query("marked_text", "SELECT document_id, count(*) AS n_pages, 0::BIGINT AS n_without_header FROM marked_text WHERE trim(raw_text, ' ' || chr(10)) <> '' GROUP BY 1")
def c04_pages_packed(x: Fixtures) -> DataFrame:
    """Each page with text has chunks, and each chunk its page's header."""
    rows = chunking.with_sections(chunking.blocks(x.marked_text())).join(x.document().select("document_id", "file_name"), "document_id")
    made = chunking.pack_pages(rows, 120, 200, 30)
    headed = F.col("content").startswith("Document: doc_") & F.col("content").contains(F.concat(F.lit("\nPage: "), "page_number", F.lit("\nSection Path: ")))
    return made.groupBy("document_id").agg(F.count_distinct("page_number").alias("n_pages"), F.count_if(~headed).alias("n_without_header"))


@query("", r"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws, floor((60 - floor(3 * 13 / 10)) * 3 / 4)::INT AS size FROM documents),
w AS (SELECT *, size - CASE WHEN 15 >= size THEN size // 5 ELSE 15 END AS step FROM t), a AS (SELECT *, unnest(range(0, len(ws), step)) AS place FROM w)
SELECT id, place // step AS "window", 'Doc x y ' || array_to_string(ws[place + 1 : place + size], ' ') AS content FROM a""")
def c05_windows(x: Fixtures) -> DataFrame:
    return chunking.windows(x.t("documents").select(F.col("doc_id").alias("id"), F.lit("Doc x y ").alias("header"), F.col("text").alias("content")), 60, 20)


@query("marked_text document", "WITH " + SECTIONS + " SELECT document_id, page_number, block_index, 'Document: ' || file_name || chr(10) || 'Page: ' || page_number || chr(10) || 'Section Path: ' || section_path || chr(10) || '---' || chr(10) || content AS content FROM sections JOIN document USING (document_id)")
def c06_header(x: Fixtures) -> DataFrame:
    rows = chunking.with_sections(chunking.blocks(x.marked_text())).join(x.document().select("document_id", "file_name"), "document_id")
    return rows.select("document_id", "page_number", "block_index", F.concat(chunking.header(F.col("file_name"), F.col("page_number"), F.col("section_path")), "content").alias("content"))


HELD = "array_to_string(list_transform({0}, lambda x: x.t), chr(10) || chr(10))"


def _grouped(most: int, overlap: int, where: str = "true", own: str = "") -> str:
    """The same for elements of a document: a list of what is held, and what each element makes come out. own: an ending of the tables' names."""
    return f"""n{own} AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY reading_order) AS i, element_type IN ({", ".join(f"'{k}'" for k in chunking.ATOMIC)}) AS atomic, {{'t': content, 'k': {_n_words("content")}, 'p': page_number}} AS e FROM element WHERE {where}),
steps{own} AS (SELECT document_id, 0::BIGINT AS i, []::STRUCT(t VARCHAR, k BIGINT, p INT)[] AS held, []::STRUCT(c VARCHAR, p INT)[] AS made FROM (SELECT DISTINCT document_id FROM n{own})
 UNION ALL SELECT document_id, i, CASE WHEN atomic THEN [] ELSE now END, list_concat(CASE WHEN over THEN [{{'c': {HELD.format("held")}, 'p': held[1].p}}] ELSE [] END, CASE WHEN atomic THEN [{{'c': {HELD.format("now")}, 'p': now[1].p}}] ELSE [] END)
 FROM (SELECT *, list_append(CASE WHEN over THEN list_filter(held, lambda x, j: list_sum(list_transform(held[j:], lambda y: y.k)) <= {overlap}) ELSE held END, e) AS now
  FROM (SELECT n.document_id, n.i, n.atomic, n.e, s.held, len(s.held) > 0 AND list_sum(list_transform(s.held, lambda x: x.k)) + n.e.k > {most} AS over FROM steps{own} s JOIN n{own} n ON n.document_id = s.document_id AND n.i = s.i + 1))),
last{own} AS (SELECT document_id, max(i) AS i FROM steps{own} GROUP BY 1),
parts{own} AS (SELECT document_id, i, unnest(made) AS x, unnest(range(len(made))) AS j FROM steps{own} UNION ALL SELECT document_id, i + 1, {{'c': {HELD.format("held")}, 'p': held[1].p}}, 0 FROM steps{own} JOIN last{own} USING (document_id, i) WHERE len(held) > 0)"""


@query("element", "WITH RECURSIVE " + _grouped(120, 30) + " SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i, j) - 1 AS chunk_index, x.p AS page_number, x.c AS content FROM parts")
def c07_pack_elements(x: Fixtures) -> DataFrame:
    return chunking.pack_elements(x.element(), 120, 30)


@query("element", "SELECT document_id, count(*) AS n_elements, 0::BIGINT AS n_lost FROM element GROUP BY 1")
def c07_nothing_lost(x: Fixtures) -> DataFrame:
    """Each element is in some chunk of its document."""
    chunks = chunking.pack_elements(x.element(), 120, 30).groupBy("document_id").agg(F.collect_list("content").alias("chunks"))
    rows = x.element().join(chunks, "document_id").withColumn("held", F.exists("chunks", lambda c: c.contains(F.col("content"))))
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_elements"), F.count_if(~F.col("held")).alias("n_lost"))


@query("element", """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY reading_order) AS i FROM element),
w AS (SELECT document_id, page_number, i, 1 AS grp, element_type IN ('table', 'image') AS fig, element_type = 'heading' AS only_head, CASE WHEN element_type = 'heading' THEN content ELSE 'Introduction' END AS section FROM n WHERE i = 1
UNION ALL SELECT n.document_id, n.page_number, n.i,
 w.grp + CASE WHEN n.element_type = 'heading' THEN 1 WHEN n.element_type IN ('table', 'image') THEN CASE WHEN w.only_head THEN 0 ELSE 1 END WHEN w.fig AND n.element_type <> 'caption' THEN 1 ELSE 0 END,
 CASE WHEN n.element_type IN ('table', 'image') THEN true WHEN w.fig AND n.element_type = 'caption' THEN true ELSE false END, n.element_type = 'heading', CASE WHEN n.element_type = 'heading' THEN n.content ELSE w.section END
 FROM w JOIN n ON n.document_id = w.document_id AND n.page_number = w.page_number AND n.i = w.i + 1),
g AS (SELECT n.document_id, n.page_number, grp, arg_min(section, n.i) AS section, list(block_id ORDER BY n.i) AS block_ids, [min(bounding_box[1]), min(bounding_box[2]), max(bounding_box[3]), max(bounding_box[4])] AS bbox, min(reading_order) AS reading_order, string_agg(content, chr(10) || chr(10) ORDER BY n.i) AS content FROM n JOIN w USING (document_id, page_number, i) GROUP BY 1, 2, 3)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, grp) - 1 AS chunk_index, page_number, section, block_ids, bbox, reading_order, content FROM g""")
def c08_boundary_chunks(x: Fixtures) -> DataFrame:
    return chunking.boundary_chunks(x.element())


@query("element", "SELECT document_id, page_number, min(bounding_box[1]) AS l, min(bounding_box[2]) AS t, max(bounding_box[3]) AS r, max(bounding_box[4]) AS b FROM element GROUP BY 1, 2")
def c09_bbox(x: Fixtures) -> DataFrame:
    b = F.col("bounding_box")
    return x.element().groupBy("document_id", "page_number").agg(F.min(b[0]).alias("l"), F.min(b[1]).alias("t"), F.max(b[2]).alias("r"), F.max(b[3]).alias("b"))


@query("grid", f"""WITH {HEAD}, r AS (SELECT *, (row_number() OVER (PARTITION BY sheet_id ORDER BY rn) - 1) // 20 AS chunk_index FROM grid JOIN head USING (sheet_id) WHERE rn > header_rn AND {FULL})
SELECT sheet_id, chunk_index, 'Sheet: ' || sheet_id || chr(10) || 'Columns: ' || array_to_string(any_value(header), ', ') || chr(10) || '---' || chr(10) || string_agg('Row ' || rn || ': ' || array_to_string(cells, ' | '), chr(10) ORDER BY rn) AS content FROM r GROUP BY 1, 2""")
def c10_sheet_chunks(x: Fixtures) -> DataFrame:
    return sheets.sheet_chunks(x.grid())


PARENTS = "parents AS (SELECT e.document_id, e.block_id, (SELECT arg_max(p.block_id, p.reading_order) FROM element p WHERE p.document_id = e.document_id AND p.reading_order < e.reading_order AND p.level < e.level) AS parent_block_id FROM element e)"


def _tree(x: Fixtures) -> DataFrame:
    return x.element().drop("parent_block_id").join(chunking.parents(x.element()), ["document_id", "block_id"])


@query("element", "WITH RECURSIVE " + PARENTS + ", f AS (SELECT document_id, block_id, 0 AS level_down FROM parents WHERE parent_block_id IS NULL UNION ALL SELECT p.document_id, p.block_id, f.level_down + 1 FROM f JOIN parents p ON p.document_id = f.document_id AND p.parent_block_id = f.block_id) SELECT * FROM f")
def c11_flatten(x: Fixtures) -> DataFrame:
    return chunking.flattened(_tree(x))


@query("element", "WITH RECURSIVE " + PARENTS + """, t AS MATERIALIZED (SELECT p.*, e.reading_order FROM parents p JOIN element e USING (document_id, block_id)),
f AS (SELECT document_id, block_id, parent_block_id, 0 AS level_down, [(reading_order, block_id)] AS path FROM t WHERE parent_block_id IS NULL
  UNION ALL SELECT t.document_id, t.block_id, t.parent_block_id, f.level_down + 1, list_append(f.path, (t.reading_order, t.block_id)) FROM f JOIN t ON t.document_id = f.document_id AND t.parent_block_id = f.block_id)
SELECT document_id, block_id, parent_block_id, level_down, row_number() OVER (PARTITION BY document_id ORDER BY path) AS position FROM f""")
def c11_tree_order(x: Fixtures) -> DataFrame:
    return chunking.tree_order(_tree(x))


@query("element", "WITH " + PARENTS + " SELECT * FROM parents")
def c12_parents(x: Fixtures) -> DataFrame:
    return chunking.parents(x.element())


@query("element", "WITH " + PARENTS + """, t AS (SELECT e.document_id, e.block_id, e.page_number, q.page_number AS of_page FROM element e JOIN parents p USING (document_id, block_id) LEFT JOIN element q ON q.document_id = e.document_id AND q.block_id = p.parent_block_id),
g AS (SELECT document_id, page_number, list_sort(list(block_id)) AS roots FROM t WHERE of_page IS NULL OR of_page <> page_number GROUP BY 1, 2), n AS (SELECT document_id, unnest(range(1, max(page_number) + 1)) AS page_number FROM element GROUP BY 1)
SELECT document_id, page_number, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, coalesce(roots, []) AS roots FROM n LEFT JOIN g USING (document_id, page_number)""")
def c13_page_roots(x: Fixtures) -> DataFrame:
    return chunking.page_roots(_tree(x))


@query("line", r"""WITH t AS (SELECT document_id, p, (['title', 'list_item', 'page_header', 'Caption', 'reference', 'text', 'LIST_ITEM', 'code'])[p % 8 + 1] AS label, CASE WHEN p % 16 = 6 THEN '2. ' ELSE '' END || line AS s FROM line)
SELECT document_id, p, CASE lower(label) WHEN 'title' THEN 'heading' WHEN 'page_header' THEN 'header' WHEN 'caption' THEN 'caption' WHEN 'code' THEN 'code' WHEN 'reference' THEN 'quote' WHEN 'list_item' THEN CASE WHEN regexp_matches(s, '^\s*\d+[.)]') THEN 'numbered_list' ELSE 'bullet_list' END ELSE 'paragraph' END AS element_type FROM t""")
def c14_element_type(x: Fixtures) -> DataFrame:
    label = F.get(F.array(*map(F.lit, ["title", "list_item", "page_header", "Caption", "reference", "text", "LIST_ITEM", "code"])), F.col("p") % 8)
    return x.line().select("document_id", "p", chunking.element_type(label, F.concat(F.when(F.col("p") % 16 == 6, "2. ").otherwise(""), "line")).alias("element_type"))


@query("marked_text document element grid", "WITH RECURSIVE " + _packed(500, 800, 100, "document_id % 2 = 1 OR document_id NOT IN (SELECT document_id FROM element)") + ", " + _grouped(400, 80, "document_id % 2 = 0", "_e") + f""", {HEAD}, sheet AS (SELECT DISTINCT sheet_id, (row_number() OVER (PARTITION BY sheet_id ORDER BY rn) - 1) // 20 AS c FROM grid JOIN head USING (sheet_id) WHERE rn > header_rn AND {FULL})
SELECT sheet_id + 1000000 AS document_id, 'sheet' AS strategy, count(*) AS n_chunks FROM sheet GROUP BY 1 UNION ALL SELECT document_id, 'elements', count(*) FROM parts_e GROUP BY 1 UNION ALL SELECT document_id, 'text', count(*) FROM parts GROUP BY 1""")
def c15_routed(x: Fixtures) -> DataFrame:
    names = x.document().select("document_id", "file_name")
    return chunking.routed(x.element().filter("document_id % 2 = 0"), x.marked_text(), names, x.grid().withColumn("sheet_id", F.col("sheet_id") + 1000000))
