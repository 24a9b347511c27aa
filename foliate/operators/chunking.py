"""Texts to blocks to chunks: layout blocks, section paths, packing and windows, element trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliate.functions import joined, n_words, words
from foliate.sources import cut

#: Element types that close a chunk.
ATOMIC = ["table", "bullet_list", "numbered_list", "heading", "code", "image", "caption", "formula", "footnote"]
INTRODUCTION = "Introduction"


def blocks(pages: DataFrame) -> DataFrame:
    """pages(document_id, page_number, raw_text): block_type, level, content, in order of block_index.

    A heading or list item is a block of its own; other lines join until an empty line or such a block.
    """
    page = W.partitionBy("document_id", "page_number")
    lines = pages.select("document_id", "page_number", F.posexplode(F.split("raw_text", "\n")).alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")))
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").rlike(r"^#{1,6}\s+"), "heading").when(F.col("line").rlike(r"^(\*|-|\d+\.)\s+"), "list_item").otherwise("paragraph")
    typed = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(page.orderBy("pos")))
    begins = (F.col("kind") != "paragraph") | F.col("before").isNull() | (F.col("before") != "paragraph")
    runs = typed.withColumn("run", F.sum(begins.cast("int")).over(page.orderBy("pos"))).filter("kind <> 'blank'")
    made = runs.groupBy("document_id", "page_number", "run").agg(F.first("kind").alias("block_type"), joined(F.collect_list(F.struct("pos", "line")), "line", " ").alias("content"))
    level = F.when(F.col("block_type") == "heading", F.length(F.regexp_extract("content", r"^(#{1,6})\s", 1)))
    return made.select("document_id", "page_number", F.row_number().over(page.orderBy("run")).alias("block_index"), "block_type", level.alias("level"), "content")


def with_sections(rows: DataFrame) -> DataFrame:
    """Blocks with their section path. A first-level title clears both below it, a second-level one the third."""
    order = W.partitionBy("document_id", "page_number").orderBy("block_index")
    title = F.trim(F.regexp_replace("content", r"^#{1,6}\s+", ""))
    t = rows.withColumn("h1", F.when(F.col("level") == 1, title)).withColumn("h2", F.when(F.col("level") == 2, title)).withColumn("h3", F.when(F.col("level") >= 3, title))
    t = t.withColumn("run1", F.count("h1").over(order)).withColumn("p1", F.last("h1", True).over(order))
    in1 = W.partitionBy("document_id", "page_number", "run1").orderBy("block_index")
    t = t.withColumn("run2", F.count("h2").over(in1)).withColumn("p2", F.last("h2", True).over(in1))
    in2 = W.partitionBy("document_id", "page_number", "run1", "run2").orderBy("block_index")
    t = t.withColumn("p3", F.last("h3", True).over(in2))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    path = F.concat_ws(" > ", some("p1"), some("p2"), some("p3"))
    return t.select("document_id", "page_number", "block_index", "block_type", "content", F.when(path == "", INTRODUCTION).otherwise(path).alias("section_path"))


def header(name: Column, page: Column, section: Column) -> Column:
    return F.concat(F.lit("Document: "), name, F.lit("\nPage: "), page.cast("string"), F.lit("\nSection Path: "), section, F.lit("\n---\n"))


def windows(rows: DataFrame, target: int, overlap: int) -> DataFrame:
    """rows(id, header, content): overlapping windows of words that fit beside the header: id, window, content."""
    size = F.floor((F.lit(target) - F.floor(n_words(F.col("header")) * F.lit(13) / F.lit(10))) * 3 / 4).cast("int")
    own = rows.withColumn("ws", words(F.col("content"))).withColumn("size", F.when(size <= 0, 50).otherwise(size))
    lap = F.lit(int(overlap * 0.75))
    own = own.withColumn("step", F.col("size") - F.when(lap >= F.col("size"), F.floor(F.col("size") / 5)).otherwise(lap)).filter(F.size("ws") > 0)
    at = own.select("id", "header", "ws", "size", F.posexplode(F.sequence(F.lit(0), F.size("ws") - 1, F.col("step").cast("int"))).alias("window", "at"))
    return at.select("id", "window", F.concat("header", F.array_join(F.slice("ws", F.col("at") + 1, F.col("size")), " ")).alias("content"))


def tokens(text: str) -> int:
    return int(len(text.split()) * 1.3)


class Packer:
    """Chunks of one page's (section, text) blocks, as they come: filled to a target of tokens, with the tail of the last one carried over."""

    def __init__(self, head, target: int, most: int, overlap: int):
        self.head, self.target, self.most, self.overlap = head, target, most, overlap
        self.text, self.section = "", INTRODUCTION

    def add(self, path: str, block: str) -> list[str]:
        """The chunks that this block closes."""
        head, both = self.head(path), f"{self.text}\n\n{block}" if self.text else block
        if tokens(head + both) <= self.target:
            self.text, self.section = both, path
            return []
        out = self.end()
        if tokens(head + block) > self.most:
            ws, size, lap = block.split(), int((self.target - tokens(head)) * 0.75), int(self.overlap * 0.75)
            size = size if size > 0 else 50
            step = size - (size // 5 if lap >= size else lap)
            self.text = ""
            return out + [head + " ".join(ws[i : i + size]) for i in range(0, len(ws), step)]
        ws, n = self.text.split(), int(self.overlap * 0.75)
        tail = self.text if n >= len(ws) else " ".join(ws[len(ws) - n :])
        self.text, self.section = f"{tail}\n\n{block}" if tail else block, path
        return out

    def end(self) -> list[str]:
        return [self.head(self.section) + self.text] if self.text else []


def page_head(name: str, page: int):
    return lambda section: f"Document: {name}\nPage: {page}\nSection Path: {section}\n---\n"


def packed(page: list[tuple[str, str]], head, target: int, most: int, overlap: int) -> list[str]:
    """All chunks of one page's (section, text) blocks."""
    p = Packer(head, target, most, overlap)
    return [chunk for path, block in page for chunk in p.add(path, block)] + p.end()


@F.udtf(returnType="document_id bigint, page_number int, nth bigint, content string")
class PackPages:
    """Table function over TABLE(blocks) PARTITION BY (document_id, page_number) ORDER BY block_index, with target, most and overlap: the chunks of each page.

    A page's blocks come one by one and its chunks go out as they close, so no page has to lie in memory. The table has the columns that pack_pages takes.
    """

    def __init__(self):
        self.packer, self.nth = None, 0

    def rows(self, chunks: list[str]):
        for chunk in chunks:
            yield (*self.page, self.nth, chunk)
            self.nth += 1

    def eval(self, row, target: int, most: int, overlap: int):
        if self.packer is None:
            self.page = row["document_id"], row["page_number"]
            self.packer = Packer(page_head(row["file_name"], row["page_number"]), target, most, overlap)
        yield from self.rows(self.packer.add(row["section_path"], row["content"]))

    def terminate(self):
        if self.packer is not None:
            yield from self.rows(self.packer.end())


def in_order(rows: DataFrame, keys: list[str], order: str, columns: list[str], begin, add, made, schema: str) -> DataFrame:
    """Rows of each key in order through a packer: begin(first row) makes it, add(packer, row) and its end() give chunks, made(chunk) their columns. Many keys pass in
    one stream of batches, and no key has to lie in memory. schema begins with the keys; the next column counts a key's chunks.
    """
    kinds = rows.sparkSession.createDataFrame([], schema).schema
    # the window brings a key's rows together in order; its first row has place 1
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.asc_nulls_last(order)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, packer, key, nth = [], None, None, 0

        def keep(chunks: list) -> None:
            nonlocal nth
            for x in chunks:
                out.append((*key, nth, *made(x)))
                nth += 1

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            for place, *row in zip(*lists):
                if place == 1:
                    if packer is not None:
                        keep(packer.end())
                    packer, key, nth = begin(row), row[: len(keys)], 0
                keep(add(packer, row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=kinds.names)
                out.clear()
        if packer is not None:
            keep(packer.end())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=kinds.names)

    types = [{"bigint": pa.int64(), "int": pa.int32()}.get(f.dataType.simpleString(), pa.string()) for f in kinds]
    return rows.select(place.alias("place"), *keys, *columns).mapInArrow(run, schema)


def pack_pages(rows: DataFrame, target: int = 500, most: int = 800, overlap: int = 100) -> DataFrame:
    """Sectioned blocks with file_name: document_id, page_number, nth, content. The packing of a page is sequential."""
    return in_order(rows, ["document_id", "page_number"], "block_index", ["file_name", "section_path", "content"], lambda row: Packer(page_head(row[2], row[1]), target, most, overlap), lambda packer, row: packer.add(row[3], row[4]), lambda chunk: (chunk,), "document_id long, page_number int, nth long, content string")


class ElementPacker:
    """Contents and first page of the chunks of one document's elements, as they come: whole elements, up to a number of words, with the last ones carried over."""

    def __init__(self, most: int, overlap: int):
        self.most, self.overlap, self.held, self.total = most, overlap, [], 0

    def add(self, kind: str, text: str, page: int) -> list[tuple[list[str], int]]:
        """The chunks that this element closes."""
        n, out = len(text.split()), []
        if self.held and self.total + n > self.most:
            out, back, total = self.end(), [], 0
            for x in reversed(self.held):
                if total + x[1] > self.overlap:
                    break
                back, total = [x, *back], total + x[1]
            self.held, self.total = back, total
        self.held.append((text, n, page))
        self.total += n
        if kind in ATOMIC:
            out = out + self.end()
            self.held, self.total = [], 0
        return out

    def end(self) -> list[tuple[list[str], int]]:
        full = [x[0] for x in self.held if x[0].strip()]
        return [(full, self.held[0][2])] if full else []


def grouped(elements: list[tuple[str, str, int]], most: int, overlap: int) -> list[tuple[list[str], int]]:
    """All chunks of one document's (type, content, page) elements in order."""
    p = ElementPacker(most, overlap)
    return [chunk for x in elements for chunk in p.add(*x)] + p.end()


def pack_elements(elements: DataFrame, most: int = 400, overlap: int = 80) -> DataFrame:
    """document_id, chunk_index, page_number, content: whole elements packed to a number of words. The packing of a document is sequential."""
    return in_order(
        elements, ["document_id"], "reading_order", ["page_number", "element_type", "content"], lambda row: ElementPacker(most, overlap), lambda packer, row: packer.add(row[2], row[3] or "", row[1]),
        lambda chunk: (chunk[1], "\n\n".join(chunk[0])), "document_id long, chunk_index long, page_number int, content string",
    )


def boundary_chunks(elements: DataFrame) -> DataFrame:
    """Chunks that begin at headings and at tables or images (a heading keeps its table; a caption joins it), page by page.

    document_id, chunk_index, page_number, section, block_ids, bbox, reading_order, content.
    """
    order = W.partitionBy("document_id", "page_number").orderBy("reading_order")
    big = F.col("element_type").isin("table", "image")
    # what the open group holds before this element: the last element that is no caption, and whether a figure is in the group
    base = F.when(F.col("element_type") == "caption", F.lit(None)).otherwise(F.col("element_type"))
    t = elements.withColumn("before", F.lag("element_type").over(order)).withColumn("base", F.last(base, True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    figure = F.col("base").isin("table", "image")
    heads = F.col("element_type") == "heading"
    begins = F.when(F.col("before").isNull() | heads, True).when(big, ~((F.col("before") == "heading") | F.lit(False))).when(figure, F.col("element_type") != "caption").otherwise(False)
    # a table or image after another one, or after its caption, opens a group unless only headings stand before it
    t = t.withColumn("grp", F.sum(begins.cast("int")).over(order)).withColumn("section", F.coalesce(F.last(F.when(heads, F.col("content")), True).over(order), F.lit(INTRODUCTION)))
    got = t.groupBy("document_id", "page_number", "grp").agg(
        F.first("section").alias("section"), F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "content"))).alias("parts"),
        F.array(F.min(F.col("bounding_box")[0]), F.min(F.col("bounding_box")[1]), F.max(F.col("bounding_box")[2]), F.max(F.col("bounding_box")[3])).alias("bbox"), F.min("reading_order").alias("reading_order"),
    )
    nth = F.row_number().over(W.partitionBy("document_id").orderBy("page_number", "grp")) - 1
    return got.select("document_id", nth.alias("chunk_index"), "page_number", "section", F.col("parts.block_id").alias("block_ids"), "bbox", "reading_order", F.array_join(F.col("parts.content"), "\n\n").alias("content"))


def parents(elements: DataFrame) -> DataFrame:
    """document_id, block_id, parent_block_id: the nearest element before with a smaller level, whatever levels there are."""
    before = W.partitionBy("document_id").orderBy("reading_order").rowsBetween(W.unboundedPreceding, -1)
    levels = sorted(r.level for r in elements.select("level").distinct().collect() if r.level is not None)[:-1]  # a row for each level; the last is nobody's parent
    own = [F.last(F.when(F.col("level") == i, F.struct("reading_order", "block_id")), True).over(before).alias(f"l{k}") for k, i in enumerate(levels)]
    found = elements.select("document_id", "block_id", "level", *own)
    none = F.lit(None).cast(elements.select(F.struct("reading_order", "block_id").alias("x")).schema["x"].dataType)
    best = F.array_max(F.array(none, *[F.when(F.col("level") > i, F.col(f"l{k}")) for k, i in enumerate(levels)]))
    return found.select("document_id", "block_id", best["block_id"].alias("parent_block_id"))


def flattened(elements: DataFrame, depth: int | None = None) -> DataFrame:
    """document_id, block_id, level_down: roots at 0, their children below, level by level to the last (or to a depth). What hangs on a cycle is under no root."""
    rows = cut(elements.select("document_id", "block_id", "parent_block_id"))  # read again for each level
    at = rows.filter("parent_block_id is null").select("document_id", "block_id", F.lit(0).alias("level_down"))
    found = []
    while depth is None or len(found) < depth:
        at = cut(at)
        if found and at.isEmpty():
            break
        found.append(at)
        above = at.select("document_id", F.col("block_id").alias("parent_block_id"))
        at = rows.join(above, ["document_id", "parent_block_id"]).select("document_id", "block_id", F.lit(len(found)).alias("level_down"))
    return reduce(DataFrame.unionByName, found)


def tree_order(elements: DataFrame) -> DataFrame:
    """document_id, block_id, parent_block_id, level_down, position: each element's place in a walk of its document's trees, parents first, siblings by reading_order
    (then block_id), from 1 on.

    The walk goes down into each element and up out of it again; each step knows the next one. By pointer doubling every step learns how many elements
    are still to come and how far down it is, so a chain of any depth takes as many rounds as its length has binary digits. Each round is a
    written table of the documents that are large enough to need it. What hangs on a cycle, or on an element that is not there, is under no root and left out. block_id is unique in a document.
    """
    doc = ["document_id"]
    rows = cut(elements.select(*doc, "block_id", "parent_block_id", "reading_order", F.monotonically_increasing_id().alias("node")))
    siblings = W.partitionBy(*doc, "parent_block_id").orderBy("reading_order", "block_id")
    placed = rows.withColumn("next_sibling", F.lead("node").over(siblings)).withColumn("nth", F.row_number().over(siblings))
    first = placed.filter("nth = 1 and parent_block_id is not null").select(*doc, F.col("parent_block_id").alias("block_id"), F.col("node").alias("first_child"))
    above = rows.select(*doc, F.col("block_id").alias("parent_block_id"), F.col("node").alias("parent"))
    # 2 n steps are gone through once 2^rounds is as many
    rounds = F.ceil(F.log2(2 * F.count(F.lit(1)).over(W.partitionBy(*doc)))).cast("int")
    known = cut(placed.join(first, [*doc, "block_id"], "left").join(above, [*doc, "parent_block_id"], "left").withColumn("rounds", rounds))
    # steps: 2 node for the way down, 2 node + 1 for the way up; a step whose parent is missing leads to itself, so it never ends
    down = known.select((F.col("node") * 2).alias("step"), F.coalesce(F.col("first_child") * 2, F.col("node") * 2 + 1).alias("next"), F.lit(1).cast("long").alias("left"), F.lit(1).cast("long").alias("rise"), "rounds")
    after = F.coalesce(F.col("next_sibling") * 2, F.col("parent") * 2 + 1, F.when(F.col("parent_block_id").isNotNull(), F.col("node") * 2 + 1))
    up = known.select((F.col("node") * 2 + 1).alias("step"), after.alias("next"), F.lit(0).cast("long").alias("left"), F.lit(-1).cast("long").alias("rise"), "rounds")
    steps = cut(down.unionByName(up))
    last, ended = steps.agg(F.max("rounds")).first()[0] or 0, []
    for k in range(1, last + 1):
        to = steps.select(F.col("step").alias("next"), F.col("next").alias("then"), F.col("left").alias("more"), F.col("rise").alias("further"))
        going = steps.filter("next is not null").join(to, "next").select("step", F.col("then").alias("next"), (F.col("left") + F.col("more")).alias("left"), (F.col("rise") + F.col("further")).alias("rise"), "rounds")
        made = cut(steps.filter("next is null").unionByName(going))
        ended.append(made.filter(F.col("rounds") == k))
        steps = made.filter(F.col("rounds") > k)
    done = reduce(DataFrame.unionByName, ended or [steps]).filter("next is null and step % 2 = 0")
    found = done.select((F.col("step") / 2).cast("long").alias("node"), "left", (-F.col("rise")).cast("int").alias("level_down"))
    whole = cut(known.select(*doc, "block_id", "parent_block_id", "node").join(found, "node"))
    sizes = whole.groupBy(*doc).agg(F.count(F.lit(1)).alias("n"))
    return whole.join(sizes, "document_id").select("document_id", "block_id", "parent_block_id", "level_down", (F.col("n") - F.col("left") + 1).alias("position"))


def page_roots(elements: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """document_id, page_number, width, height, roots for every page up to the last: blocks whose parent is not on their page."""
    parent = elements.select("document_id", F.col("block_id").alias("parent_block_id"), F.col("page_number").alias("of_page"))
    roots = elements.join(parent, ["document_id", "parent_block_id"], "left").filter("of_page is null or of_page <> page_number")
    got = roots.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list("block_id")).alias("roots"))
    pages = elements.groupBy("document_id").agg(F.max("page_number").alias("n")).select("document_id", F.explode(F.sequence(F.lit(1), "n")).alias("page_number"))
    return pages.join(got, ["document_id", "page_number"], "left").select("document_id", "page_number", F.lit(width).alias("width"), F.lit(height).alias("height"), F.coalesce("roots", F.array().cast("array<string>")).alias("roots"))


#: Element types of a parser's labels.
LABELS = {"title": "heading", "section_header": "heading", "page_header": "header", "page_footer": "footer", "caption": "caption", "code": "code", "footnote": "footnote", "formula": "formula", "reference": "quote", "quote": "quote"}


def element_type(label: Column, text: Column) -> Column:
    out = F.lit("paragraph")
    for name, kind in LABELS.items():
        out = F.when(F.lower(label) == name, kind).otherwise(out)
    return F.when(F.lower(label) == "list_item", F.when(text.rlike(r"^\s*\d+[.)]"), "numbered_list").otherwise("bullet_list")).otherwise(out)


def routed(elements: DataFrame, pages: DataFrame, names: DataFrame, grid: DataFrame) -> DataFrame:
    """document_id, strategy, n_chunks: sheets in batches of rows, elements by packing, pages without elements by their text."""
    sheets = sheet_count(grid).withColumn("strategy", F.lit("sheet"))
    own = pack_elements(elements).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks")).withColumn("strategy", F.lit("elements"))
    rest = pages.join(elements.select("document_id").distinct(), "document_id", "left_anti")
    text = pack_pages(with_sections(blocks(rest)).join(names, "document_id")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks")).withColumn("strategy", F.lit("text"))
    return sheets.unionByName(own).unionByName(text)


def sheet_count(grid: DataFrame) -> DataFrame:
    from foliate.operators.sheets import sheet_chunks

    return sheet_chunks(grid).groupBy(F.col("sheet_id").alias("document_id")).agg(F.count(F.lit(1)).alias("n_chunks"))


