"""Document structure: major parts, chapters and appendices with sections, content lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import text as tx

SECTION = "struct<title:string,content:string,page:int,is_table:boolean>"
CHAPTER_HEAD = r"(?:C\s*h\s*a\s*p\s*t\s*e\s*r)\s*\d+"
APPENDIX_HEAD = r"(?:A\s*p\s*p\s*e\s*n\s*d\s*i\s*x)\s+[A-Z]"


def _at(x: Column, p: str) -> Column:
    """Zero-based place of the first match of p, or null."""
    head = F.regexp_extract(x, "(?s)" + tx.pattern(rf"^(.*?)(?:{p})", ignore_case=True, multiline=True), 1)
    return F.when(x.rlike(tx.pattern(p, True, True)), F.length(head))


def major_parts(x, names: tuple[str, str, str, str] = ("preface", "contents", "main_content", "appendices"), literal: bool = False) -> Column:
    """struct of the text before "Contents" on a line, from there to the heading of chapter 1,
    from there to the first appendix after it, and the rest; what is not found is empty. A
    line of the contents that ends in a page number is no heading, unless `literal`. Contents
    without a chapter 1 make all that follows main content."""
    y = tx._c(x)
    tail = "" if literal else r"(?![^\n]*\s\d+[^\S\n]*$)"
    contents = _at(y, r"^[^\S\n]*C\s*o\s*n\s*t\s*e\s*n\s*t\s*s[^\S\n]*$")
    start = F.coalesce(contents, F.lit(0))
    chapter = start + _at(F.substring(y, start + 1, F.length(y)), rf"^[^\S\n]*C\s*h\s*a\s*p\s*t\s*e\s*r\s*1\s*:{tail}")
    rest = F.substring(y, chapter + 1, F.length(y))
    appendix = chapter + _at(rest, rf"^[^\S\n]*A\s*p\s*p\s*e\s*n\s*d\s*i\s*x\s+[A-Z]\b{tail}")
    n = F.length(y)
    piece = lambda a, b: tx.ustrip(F.substring(y, a + 1, b - a))
    parts = (
        piece(F.lit(0), F.coalesce(contents, chapter)), F.when(contents.isNotNull() & chapter.isNotNull(), piece(contents, chapter)),
        F.coalesce(piece(chapter, F.coalesce(appendix, n)), piece(contents, n)), piece(appendix, n),
    )
    return F.struct(*[F.coalesce(p, F.lit("")).alias(name) for p, name in zip(parts, names)])


def split_at_heads(x, head: str) -> Column:
    """array of the pieces that start with a heading, and what precedes the first if not blank."""
    pieces = F.split(tx._c(x), tx.pattern(rf"(?=^\s*{head})", ignore_case=True, multiline=True), -1)
    return F.filter(F.transform(pieces, tx.ustrip), lambda s: s != "")


def split_chapters(x) -> Column:
    return split_at_heads(x, CHAPTER_HEAD)


def split_appendices(x) -> Column:
    return split_at_heads(x, APPENDIX_HEAD)


def content_list(x) -> Column:
    """array of (title, page) of a list: "title • page" lines after the first, numbers alone left out."""
    rest = F.slice(tx.lines(x), 2, 1 << 30)
    clean = F.filter(F.transform(rest, tx.ustrip), lambda s: s != "")
    item = r"^(.*?)(?:\s*•\s*(\d+))?$"
    made = F.transform(clean, lambda s: F.struct(tx.ustrip(tx.join_split_capitals(F.regexp_extract(s, tx.pattern(item), 1))).alias("title"), F.nullif(F.regexp_extract(s, tx.pattern(item), 2), F.lit("")).cast("int").alias("page")))
    return F.filter(made, lambda i: (i["title"] != "") & ~tx.has(i["title"], r"^\d+$"))


def is_list_like(x) -> Column:
    return tx._c(x).rlike(tx.pattern(r"\.{3,}|\s+\d+\s*$", multiline=True))


def is_title(x) -> Column:
    """A short line that starts with a capital and has no full stop."""
    return tx.has(x, r"^[A-Z][^.]+$") & (F.length(tx._c(x)) <= 60)


def sections(x, rest_title: str | None = None) -> Column:
    """array of (title, content, page, is_table): titles open sections; lines before the first
    are dropped, or with rest_title make one section if there is no title at all."""
    lines = F.filter(F.transform(tx.lines(x), tx.ustrip), lambda s: s != "")
    zero = F.struct(F.array().cast("array<struct<title:string,content:array<string>>>").alias("done"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("body"))
    flush = lambda s: F.when(s["title"].isNull(), s["done"]).otherwise(F.array_append(s["done"], F.struct(s["title"].alias("title"), s["body"].alias("content"))))

    def step(s: Column, y: Column) -> Column:
        opened = F.struct(flush(s).alias("done"), y.alias("title"), F.array().cast("array<string>").alias("body"))
        more = F.struct(s["done"].alias("done"), s["title"].alias("title"), F.array_append(s["body"], y).alias("body"))
        return F.when(is_title(y), opened).when(s["title"].isNotNull(), more).otherwise(s)

    found = F.transform(F.aggregate(lines, zero, step, flush), lambda s: F.struct(s["title"].alias("title"), F.array_join(s["content"], "\n").alias("content"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("is_table")))
    if rest_title is None:
        return found
    whole = F.array(F.struct(F.lit(rest_title).alias("title"), F.array_join(lines, "\n").alias("content"), F.lit(None).cast("int").alias("page"), F.lit(False).alias("is_table")))
    return F.when((F.size(found) == 0) & (F.size(lines) > 0), whole).otherwise(found)


def _body(x: Column) -> Column:
    return F.substring(x, F.instr(F.concat(x, F.lit("\n")), "\n") + 1, F.length(x))


def chapter(x) -> Column:
    """struct(number, title, sections) of a chapter's text, heading first."""
    y = tx._c(x)
    first = F.element_at(F.split(y, "\n", 2), 1)
    head = tx.pattern(r"^\s*(?:C\s*h\s*a\s*p\s*t\s*e\s*r)\s*(\d+)\s*:?\s*(.*)$", True)
    listed = F.transform(content_list(y), lambda i: F.struct(i["title"].alias("title"), F.lit("").alias("content"), i["page"].alias("page"), F.lit(False).alias("is_table")))
    number = F.nullif(F.regexp_extract(first, head, 1), F.lit("")).cast("int")
    title = F.coalesce(F.nullif(tx.ustrip(F.regexp_extract(first, head, 2)), F.lit("")), F.concat(F.lit("Chapter "), number.cast("string")))
    return F.struct(number.alias("number"), title.alias("title"), F.when(is_list_like(y), listed).otherwise(sections(_body(y), "Main Content")).alias("sections"))


def appendix(x) -> Column:
    """struct(letter, title, content, sections) of an appendix's text, heading first; without
    titles one section, "Main Content"."""
    y = tx._c(x)
    first = F.element_at(F.split(y, "\n", 2), 1)
    head = tx.pattern(r"^\s*(?:A\s*p\s*p\s*e\s*n\s*d\s*i\s*x)\s+([A-Z])\s*:?\s*(.*)$", True)
    return F.struct(F.upper(F.regexp_extract(first, head, 1)).alias("letter"), tx.ustrip(F.regexp_extract(first, head, 2)).alias("title"), tx.ustrip(_body(y)).alias("content"), sections(_body(y), "Main Content").alias("sections"))


def metadata(title: str = "Document", kind: str = "Book") -> Column:
    return F.struct(F.lit(title).alias("title"), F.lit(kind).alias("type"))


TOC_ENTRY = "array<struct<type:string,number:int,letter:string,title:string,page:int,sections:array<struct<title:string,page:int>>>>"


def structured(docs: DataFrame, key: str = "doc_id", title: str = "Document", kind: str = "Book", clean: bool = True) -> DataFrame:
    """key, metadata, table_of_contents, chapters, appendices of docs (key, text)."""
    from inkmill.operators.segment import raw_lines, toc

    rows = docs.select(key, (tx.clean_text("text") if clean else F.col("text")).alias("text")).withColumn("parts", major_parts("text"))
    entries = toc(raw_lines(rows.select(key, F.col("parts.contents").alias("text")), key), key)
    entries = entries.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("ord", "type", "number", "letter", "title", "page", "sections"))).alias("l"))
    bare = F.transform("l", lambda e: F.struct(*[e[c].alias(c) for c in ("type", "number", "letter", "title", "page", "sections")]))
    out = rows.join(entries, F.col(key) == F.col("_k"), "left")
    return out.select(
        key, metadata(title, kind).alias("metadata"), F.coalesce(bare, F.array().cast(TOC_ENTRY)).alias("table_of_contents"),
        F.filter(F.transform(split_chapters("parts.main_content"), chapter), lambda c: c["number"].isNotNull()).alias("chapters"),
        F.transform(split_appendices("parts.appendices"), appendix).alias("appendices"),
    )


def sections_of_lines(x) -> Column:
    """Chapters of a text by order: number, title and sections, where lines as "Title" or
    "Title • page" open sections and a chapter without has one, "Main Content"."""
    pieces = split_chapters(x)
    return F.transform(pieces, lambda p, i: F.struct((i + 1).alias("number"), F.element_at(F.split(p, "\n", 2), 1).alias("title"), sections(_body(p), "Main Content").alias("sections")))


def lettered_appendices(x) -> Column:
    """Appendices of a text by order, lettered from A."""
    return F.transform(split_appendices(x), lambda p, i: F.struct(F.char(i + 65).alias("letter"), F.element_at(F.split(p, "\n", 2), 1).alias("title"), tx.ustrip(_body(p)).alias("content"), sections(_body(p), "Main Content").alias("sections")))


def sections_of_chapters(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """From segmented chapters (number, title, main_content, subchapters, line_count and maybe
    tables): key, chapter_seq, number, title, sections. Main content becomes a section of that
    name, tables titled sections, subchapters sections; lines are joined by blank lines."""
    join = lambda a: F.array_join(F.filter(a, lambda s: tx.ustrip(s) != ""), "\n\n")
    made = lambda t, c, table: F.struct(t.alias("title"), c.alias("content"), F.lit(None).cast("int").alias("page"), F.lit(table).alias("is_table"))
    keep = lambda a: F.filter(a, lambda s: s["content"] != "")
    main = keep(F.array(made(F.lit("Main Content"), join("main_content"), False)))
    subs = keep(F.transform("subchapters", lambda s: made(s["title"], join(s["lines"]), False)))
    parts = [main, subs]
    if "tables" in found.columns:
        from inkmill.operators.tables import markdown_table

        parts.insert(1, F.transform("tables", lambda t: made(tx.title_of_stem(t["table_type"]), markdown_table(t["columns"], t["rows"]), True)))
    return found.select(key, "chapter_seq", "number", "title", F.concat(*parts).alias("sections"))


def toc_of_chapters(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, table_of_contents from chapters with sections: those numbered over 0, without the
    sections named Main Content."""
    entry = F.struct("chapter_seq", "number", "title", F.transform(F.filter("sections", lambda s: s["title"] != "Main Content"), lambda s: s["title"]).alias("sections"))
    return found.filter("number > 0").groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("table_of_contents"))
