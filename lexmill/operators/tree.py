"""Section trees over paged documents, as flat tables of entries and nodes.

An entry is (doc_id, ord, level, title, start_page).  A node adds end_page,
parent_ord, node_id, depth and summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_title, local_summary, tokens

LEAST_ENTRIES = 3
_DASH = r"\s*[:.–—-]\s*"
_CAPITAL = "[A-Z]"
_NAME, _REST = rf"\s+({_CAPITAL}.{{2,80}})$", r"\s+(.{3,80})$"
_N = r"\d\d?"
_ROMAN = "[IVXLCDM]"
#: (pattern, level, group of the title; 0 for the whole line)
HEADINGS = [
    (rf"^(?:Chapter|CHAPTER)\s+(\d+){_DASH}(.+)", 1, 2),
    (rf"^(?:Part|PART)\s+(\d+|{_ROMAN}+){_DASH}(.+)", 1, 2),
    (rf"^({_N})\.{_NAME}", 1, 2),
    (rf"^({_N}\.{_N})\.?{_REST}", 2, 2),
    (rf"^({_N}\.{_N}\.{_N})\.?{_REST}", 3, 2),
    (rf"^(?:SECTION|Section)\s+(\d+(?:\.\d+)*){_DASH}(.+)", 2, 2),
    (rf"^({_ROMAN}{{1,5}})\.{_NAME}", 1, 2),
    (rf"^([A-Z])\.{_NAME}", 2, 2),
    (rf"^(?:APPENDIX|Appendix)\s+([A-Z]){_DASH}(.+)", 1, 2),
    (r"^([A-Z][A-Z\s]{8,60})$", 1, 0),
]


def heading(line: Column) -> Column:
    """A struct (level, title) of a line that reads like a heading, else null."""
    out = None
    for i, (pattern, level, group) in enumerate(HEADINGS):
        title = F.trim(F.regexp_extract(line, pattern, group))
        test = line.rlike(pattern) & (F.length(title) >= 3) & ~title.rlike(r"^\d+$")
        if group == 0:
            test = test & (F.size(F.split(title, r"\s+")) >= 2) & (F.length(title) <= 50)
        value = F.struct(F.lit(level).alias("level"), F.left(title, F.lit(120)).alias("title"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.when(F.length(line).between(3, 200), out)


def first_of_each_title(entries: DataFrame) -> DataFrame:
    """Entries without those that repeat a title's first 50 characters on a page, numbered anew."""
    w = Window.partitionBy("doc_id", F.left("title", F.lit(50)), "start_page").orderBy("ord")
    kept = entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))


def pattern_entries(pages: DataFrame) -> DataFrame:
    """Entries of the headings found in (doc_id, page, text)."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t")).withColumn("h", heading(F.trim("t"))).where("h is not null")
    return first_of_each_title(lines.select("doc_id", (F.col("page") * 1_000_000 + F.col("line")).alias("ord"), "h.level", "h.title", F.col("page").alias("start_page")))


def outline_entries(outline: DataFrame) -> DataFrame:
    """Entries of a document's own table of contents; none where it has fewer than two."""
    many = F.count("*").over(Window.partitionBy("doc_id")) >= 2
    kept = outline.withColumn("_m", many).where(F.col("_m") & (F.trim("title") != "") & (F.col("start_page") >= 1))
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).alias("ord"), "level", F.trim("title").alias("title"), "start_page")


def font_entries(blocks: DataFrame) -> DataFrame:
    """Entries of lines set larger than the body, or bold, from (doc_id, page, text, font_size, is_bold, block_idx).

    The body's size is the commonest among longer texts, the first met of those
    as common; up to four larger sizes are levels.  Without larger ones the
    body's size is the only level.
    """
    b = blocks.withColumn("size", F.bround("font_size", 0)).withColumn("at", F.col("page") * 1_000_000 + F.col("block_idx")).withColumn("len", F.length(F.trim("text")))
    sizes = b.where("len > 10").groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))
    larger = b.join(body, "doc_id").where((F.col("size") > F.col("body") * 1.15) & (F.col("len") > 2) & (F.col("len") < 200)).select("doc_id", "size").distinct()
    levels = larger.withColumn("level", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).where("level <= 4")
    levels = levels.unionByName(body.join(levels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.col("body").alias("size"), F.lit(1).alias("level")))
    least = levels.groupBy("doc_id").agg(F.max("level").alias("deepest"), F.min("size").alias("smallest"))
    sized = b.join(body, "doc_id").join(levels, ["doc_id", "size"], "left").join(least, "doc_id")
    level = F.coalesce("level", F.when(F.col("is_bold") & (F.col("size") >= F.col("body")) & (F.col("size") < F.col("smallest")), F.col("deepest") + 1))
    fit = sized.withColumn("level", level).where(F.col("level").isNotNull() & (F.col("len") >= 2) & (F.col("len") <= 150) & ~F.trim("text").rlike(r"^\d+$"))
    return first_of_each_title(fit.select("doc_id", F.col("at").alias("ord"), F.col("level").cast("int").alias("level"), F.trim("text").alias("title"), F.col("page").alias("start_page")))


def even_entries(pages: DataFrame) -> DataFrame:
    """Entries of equal runs of pages, titled by the first line that reads like a title."""
    total = pages.groupBy("doc_id").agg(F.max("page").alias("total"))
    size = F.when(F.col("total") <= 5, 1).when(F.col("total") <= 20, 5).when(F.col("total") <= 100, 10).otherwise(F.greatest(F.lit(10), F.expr("total div 10")))
    placed = pages.join(total, "doc_id").withColumn("size", size).withColumn("ord", F.expr("(page - 1) div size + 1").cast("int"))
    runs = placed.groupBy("doc_id", "ord").agg(F.min("page").alias("start_page"), F.max("page").alias("last"), F.min_by("text", "page").alias("text"))
    title = F.coalesce(first_title(F.col("text")), F.format_string("Pages %d–%d", "start_page", "last"))
    return runs.select("doc_id", "ord", F.lit(1).alias("level"), title.alias("title"), "start_page")


def markdown_entries(files: DataFrame) -> DataFrame:
    """Entries of the headings of (doc_id, text) in Markdown; a heading's page is its line."""
    lines = files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(F.col("t").rlike(r"^#{1,6} "))
    return lines.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")).alias("ord"), F.length(F.regexp_extract("t", "^(#{1,6}) ", 1)).alias("level"), F.trim(F.regexp_extract("t", "^#{1,6} (.*)$", 1)).alias("title"), (F.col("line") + 1).cast("int").alias("start_page"))


def best_entries(*strategies: DataFrame) -> DataFrame:
    """For each document the entries of the first strategy that has ``LEAST_ENTRIES``; the last one's otherwise."""
    ranked = None
    for i, s in enumerate(strategies):
        some = s.select("doc_id", "ord", F.col("level").cast("int").alias("level"), "title", F.col("start_page").cast("int").alias("start_page"), F.lit(i).alias("strategy"))
        ranked = some if ranked is None else ranked.unionByName(some)
    many = (F.count("*").over(Window.partitionBy("doc_id", "strategy")) >= LEAST_ENTRIES) | (F.col("strategy") == len(strategies) - 1)
    fit = ranked.withColumn("_m", many).where("_m").drop("_m")
    return fit.withColumn("_s", F.min("strategy").over(Window.partitionBy("doc_id"))).where("strategy = _s").drop("_s")


def build(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """Nodes of entries; ``totals``: (doc_id, total_pages).

    A section ends before the next entry of its level or above; its parent is
    the nearest entry before it of a lower level; siblings are numbered in order.
    Each document's entries are one array, so that this takes one shuffle.
    """
    one = F.struct("ord", "level", "title", "start_page")
    docs = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("e")).join(totals, "doc_id")
    rows = docs.select("doc_id", "e", "total_pages", F.explode("e").alias("x"))
    after = F.get(F.filter("e", lambda y: (y["ord"] > F.col("x.ord")) & (y["level"] <= F.col("x.level"))), F.lit(0))
    # the entries that enclose this one: each the nearest before, of a lower level than all after it
    before = F.reverse(F.filter("e", lambda y: (y["ord"] < F.col("x.ord")) & (y["level"] < F.col("x.level"))))
    chain = F.aggregate(before, F.array(F.col("x")), lambda acc, y: F.when(y["level"] < F.element_at(acc, -1)["level"], F.concat(acc, F.array(y))).otherwise(acc))
    placed = rows.select("doc_id", "e", "x", F.when(after.isNotNull(), F.greatest(F.col("x.start_page"), after["start_page"] - 1)).otherwise(F.col("total_pages")).alias("end_page"), F.reverse(chain).alias("chain"))

    def parent(ord_: Column) -> Column:
        """``ord`` of the parent of the entry in ``e`` with this ord, -1 for none."""
        own = F.filter("e", lambda y: y["ord"] == ord_)[0]
        return F.coalesce(F.try_element_at(F.filter("e", lambda y: (y["ord"] < ord_) & (y["level"] < own["level"])), F.lit(-1))["ord"].cast("long"), F.lit(-1).cast("long"))

    parents = F.transform("e", lambda y: F.struct(y["ord"].alias("ord"), parent(y["ord"]).alias("parent")))
    placed = placed.withColumn("p", parents)

    def number(step: Column) -> Column:
        up = F.filter("p", lambda y: y["ord"] == step["ord"])[0]["parent"]
        return F.lpad(F.size(F.filter("p", lambda y: (y["parent"] == up) & (y["ord"] <= step["ord"]))).cast("string"), 4, "0")

    return placed.select(
        "doc_id", F.array_join(F.transform("chain", number), ".").alias("node_id"), F.col("x.ord").alias("ord"), F.col("x.level").alias("level"), F.size("chain").alias("depth"),
        F.col("x.title").alias("title"), F.col("x.start_page").alias("start_page"), F.col("end_page").cast("int").alias("end_page"),
        F.when(F.size("chain") > 1, F.array_join(F.transform(F.slice("chain", F.lit(1), F.size("chain") - 1), number), ".")).alias("parent_id"))


def node_pages(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, node_id, page, text) of every page of every node: ranges are spelled out and joined by equality."""
    spelled = nodes.where("start_page <= end_page").select("doc_id", "node_id", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return spelled.join(pages, ["doc_id", "page"])


def summaries(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, node_id, summary): the first sentences of each node's pages."""
    texts = node_pages(nodes, pages).groupBy("doc_id", "node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("t"))
    return texts.select("doc_id", "node_id", local_summary(F.col("t")).alias("summary"))


def extract(nodes: DataFrame, pages: DataFrame, selection: DataFrame) -> DataFrame:
    """(doc_id, sel_ord, node_id, title, pages, text) of the selected (doc_id, node_id, sel_ord).

    A page goes to the first selected node that has it; nodes left without text
    are dropped, unknown ones too.
    """
    chosen = nodes.join(selection, ["doc_id", "node_id"])
    taken = node_pages(chosen, pages).join(chosen.select("doc_id", "node_id", "sel_ord", "title"), ["doc_id", "node_id"])
    first = taken.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("sel_ord"))).where("_n = 1")
    rows = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("page", "text"))))
    return first.groupBy("doc_id", "sel_ord", "node_id", "title").agg(rows.alias("r")).where(F.size("r") > 0).select("doc_id", "sel_ord", "node_id", "title", F.transform("r", lambda x: x["page"]).alias("pages"), F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))


def select_nodes(nodes: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, doc_id, node_id, sel_ord): the default navigator, by words shared with title and summary.

    Nodes that share no word with a question aren't picked for it.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("w"))
    said = nodes.select("doc_id", "node_id", "ord", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "title", "summary")))).alias("w"))
    shared = asked.join(said, "w").groupBy("query_id", "doc_id", "node_id", "ord").agg(F.count("*").alias("s"))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("s"), "ord")
    return shared.withColumn("sel_ord", F.row_number().over(order)).where(F.col("sel_ord") <= k).select("query_id", "doc_id", "node_id", "sel_ord")


def outline(nodes: DataFrame) -> DataFrame:
    """(doc_id, outline): a line per node, indented by depth."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("["), "node_id", F.lit("] "), "title", F.lit(" (pages "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"), F.lit(")"))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("outline"))


def page_view(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text, char_count) of all pages."""
    return pages.select("doc_id", "page", "text", F.length("text").alias("char_count"))


def raw_view(pages: DataFrame) -> DataFrame:
    """(doc_id, text): each document's pages, one after the other."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def node_view(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, node_id, text) of each node's pages; a page may be in several nodes."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return node_pages(nodes, pages).groupBy("doc_id", "node_id").agg(F.array_join(rows, "\n\n").alias("text"))


def query(nodes: DataFrame, pages: DataFrame, queries: DataFrame, k: int = 3, navigator=select_nodes) -> DataFrame:
    """(query_id, doc_id, node_id, sel_ord, pages, text): for each question and document the nodes that ``navigator`` picks, texts cut to 2000 characters."""
    picked = navigator(nodes, queries, k)
    keyed = picked.select(F.concat_ws("\u0001", F.col("query_id").cast("string"), "doc_id").alias("key"), "query_id", "doc_id", "node_id", "sel_ord")
    own = keyed.select("key", "query_id", "doc_id").distinct()
    some_nodes = nodes.join(own, "doc_id").drop("doc_id", "query_id").withColumnRenamed("key", "doc_id")
    some_pages = pages.join(own, "doc_id").select(F.col("key").alias("doc_id"), "page", "text")
    got = extract(some_nodes, some_pages, keyed.select(F.col("key").alias("doc_id"), "node_id", "sel_ord"))
    return got.withColumnRenamed("doc_id", "key").join(own, "key").select("query_id", "doc_id", "node_id", "sel_ord", "pages", F.left("text", F.lit(2000)).alias("text"))
