"""Segmentation: lines, chapters, Markdown sections and chapters, contents, samples, joins of lines.

Running ids are window sums over (document, line order) with ROWS frames. A document is a
window partition; texts are cut into lines first, so rows are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.functions import text as tx

KEY, ORDER = "doc_id", "line_no"


def _up_to_here(key: str = KEY, order: str = ORDER):
    return W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)


def raw_lines(docs: DataFrame, key: str = KEY) -> DataFrame:
    """key, line_no (from 0), text: every line as it is."""
    return docs.select(key, F.posexplode(tx.lines("text")).alias(ORDER, "text"))


def split_lines(docs: DataFrame, key: str = KEY, split_long: bool = True) -> DataFrame:
    """key, line_no, text: lines cleaned, empty ones dropped, over-long ones split at sentences."""
    # Blank lines go by the line as it is: a filter on the cleaned line would clean it twice.
    rows = raw_lines(docs, key).filter(tx.has("text", r"\S")).withColumn("text", tx.clean_line("text"))
    if not split_long:
        return rows
    parts = rows.select(key, F.col(ORDER).alias("at"), F.posexplode(tx.split_long_line("text")).alias("part", "text"))
    number = F.row_number().over(W.partitionBy(key).orderBy("at", "part")) - 1
    return parts.select(key, number.alias(ORDER), "text")


def line_stats(rows: DataFrame, key: str = KEY) -> DataFrame:
    """key, total_lines, avg_line_length, max_line_length; zeros instead of nothing."""
    n = F.length("text")
    return rows.groupBy(key).agg(
        F.count("text").alias("total_lines"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_line_length"), F.coalesce(F.max(n), F.lit(0)).alias("max_line_length")
    )


def document_line_stats(docs: DataFrame, key: str = KEY, split_long: bool = True) -> DataFrame:
    """line_stats() of the cleaned lines of each row of docs (key, text), zeros for rows
    without lines. Lines stay arrays, so nothing is shuffled."""
    kept = F.filter(tx.lines("text"), lambda x: tx.has(x, r"\S"))
    cleaned = F.transform(kept, tx.clean_line)
    if split_long:
        long_ = F.exists(cleaned, lambda x: F.length(x) > 2000)
        cleaned = F.when(long_, F.flatten(F.transform(cleaned, lambda x: tx.split_long_line(x)))).otherwise(cleaned)
    sizes = docs.select(key, F.transform(F.coalesce(cleaned, F.array().cast("array<string>")), lambda x: F.length(x)).alias("n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n)
    return sizes.select(
        key, F.size("n").cast("long").alias("total_lines"), F.when(F.size("n") > 0, total / F.size("n")).otherwise(0.0).alias("avg_line_length"), F.coalesce(F.array_max("n"), F.lit(0)).alias("max_line_length")
    )


# --- chapters ---------------------------------------------------------------------------
def chapter_lines(rows: DataFrame, key: str = KEY, spaced_only: bool = True) -> DataFrame:
    """rows (key, line_no, text) with is_chapter, is_sub, chapter_seq (0: front matter),
    sub_seq within the chapter, and text collapsed unless it is a heading. With spaced_only
    a chapter heading must be letter-spaced, as extraction leaves it."""
    flat = tx.collapse_spaced_letters("text")
    spaced = tx.has_spaced_text("text")
    # One projection computes the collapsed line; what follows only reads it.
    rows = rows.withColumn("flat", flat).withColumn("spaced", spaced)
    title = tx.is_chapter_title("flat")
    rows = rows.withColumn("is_chapter", F.when(F.col("spaced"), title).otherwise(F.lit(False) if spaced_only else title))
    rows = rows.withColumn("is_sub", ~F.col("is_chapter") & tx.is_subchapter_title("text"))
    rows = rows.withColumn("chapter_seq", F.sum(F.col("is_chapter").cast("int")).over(_up_to_here(key)))
    inner = W.partitionBy(key, "chapter_seq").orderBy(ORDER).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("sub_seq", F.sum(F.col("is_sub").cast("int")).over(inner)).drop("spaced")


def chapter_header(x) -> Column:
    """struct(number, title) of a chapter heading."""
    y = tx.ustrip(x)
    chapter = tx.pattern(r"^Chapter\s+(\d+)\s*:?\s*(.+)$", ignore_case=True)
    joined = tx.pattern(r"^Chapter\s+(\d+)\s*:?\s*([Pp]ersonalityand\s*.*)$")
    made = lambda n, t: F.struct(n.cast("int").alias("number"), t.alias("title"))
    return (
        F.when(tx.has(y, tx.rules.STEP_BY_STEP, True), made(F.lit(1), F.lit("Step-by-Step Characters")))
        .when(y.rlike(joined), made(F.regexp_extract(y, joined, 1), tx.ustrip(tx.sub(F.regexp_extract(y, joined, 2), "[Pp]ersonalityand", "Personality and"))))
        .when(y.rlike(chapter), made(F.regexp_extract(y, chapter, 1), tx.ustrip(F.regexp_extract(y, chapter, 2))))
        .when(tx.has(y, r"^\d+\s*$"), made(F.regexp_extract(y, r"^(\d+)", 1), F.concat(F.lit("Chapter "), F.regexp_extract(y, r"^(\d+)", 1))))
        .otherwise(made(F.lit(0), y))
    )


def chapters(rows: DataFrame, key: str = KEY, spaced_only: bool = True, last_buffer_count: bool = False) -> DataFrame:
    """One row per chapter: key, chapter_seq, number, title, original_line, main_content,
    subchapters (title, original_line, lines), line_count. The front matter is chapter 0 and
    is left out if it has no lines. With last_buffer_count, line_count counts only the lines
    after the last subheading."""
    marked = chapter_lines(rows, key, spaced_only)
    head = F.max(F.when(F.col("is_chapter"), F.struct("flat", "text")))
    body = marked.groupBy(key, "chapter_seq", "sub_seq").agg(
        head.alias("head"),
        F.max(F.when(F.col("is_sub"), F.struct(tx.subchapter_title("text").alias("title"), F.col("text").alias("line")))).alias("sub"),
        F.array_sort(F.collect_list(F.when(~F.col("is_chapter") & ~F.col("is_sub"), F.struct(ORDER, "flat")))).alias("body"),
    )
    body = body.withColumn("lines", F.transform("body", lambda x: x["flat"]))
    packed = body.groupBy(key, "chapter_seq").agg(F.array_sort(F.collect_list(F.struct("sub_seq", "head", "sub", "lines"))).alias("parts"))
    subs = F.transform(F.filter("parts", lambda p: p["sub_seq"] > 0), lambda p: F.struct(p["sub"]["title"].alias("title"), p["sub"]["line"].alias("original_line"), p["lines"].alias("lines")))
    first = F.col("parts")[0]
    main = F.when(first["sub_seq"] == 0, first["lines"]).otherwise(F.array().cast("array<string>"))
    info = F.when(F.col("chapter_seq") > 0, chapter_header(first["head"]["flat"])).otherwise(F.struct(F.lit(0).alias("number"), F.lit("Front Matter").alias("title")))
    count = F.size(F.element_at("parts", -1)["lines"]) if last_buffer_count else F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["lines"]))
    out = packed.select(
        key, F.col("chapter_seq").cast("int").alias("chapter_seq"), info.alias("info"), first["head"]["text"].alias("original_line"), main.alias("main_content"), subs.alias("subchapters"), count.alias("line_count")
    )
    out = out.select(key, "chapter_seq", "info.number", "info.title", "original_line", "main_content", "subchapters", "line_count")
    return out.filter((F.col("chapter_seq") > 0) | (F.size("main_content") > 0) | (F.size("subchapters") > 0))


def chapter_stats(found: DataFrame, key: str = KEY) -> DataFrame:
    """key, total_chapters, avg_chapter_length in lines."""
    n = F.size("main_content") + F.aggregate("subchapters", F.lit(0), lambda a, s: a + F.size(s["lines"]))
    return found.groupBy(key).agg(F.count("*").alias("total_chapters"), F.avg(n).alias("avg_chapter_length"))


# --- Markdown ---------------------------------------------------------------------------
def md_sections(rows: DataFrame, key: str = KEY, ignore_code: bool = True) -> DataFrame:
    """key, sec_no, type, start_line, end_line, text of the text and fenced code runs of
    rows (key, line_no, text). A text section starts after its fence, a code section at its;
    an unclosed fence makes the rest code. Empty runs are left out."""
    fence = tx.is_fence("text")
    rows = rows.withColumn("fence", fence).withColumn("seen", F.sum(F.col("fence").cast("int")).over(_up_to_here(key)))
    # A closing fence still belongs to the code it closes.
    rows = rows.withColumn("sec", F.when(F.col("fence") & (F.col("seen") % 2 == 0), F.col("seen") - 1).otherwise(F.col("seen")))
    out = rows.groupBy(key, "sec").agg(
        F.min(ORDER).alias("start_line"), (F.max(ORDER) + 1).alias("stop"), F.array_sort(F.collect_list(F.struct(ORDER, "text"))).alias("l"), F.max("seen").alias("last")
    )
    code = F.col("sec") % 2 == 1
    end = F.when(code & (F.col("last") > F.col("sec")), F.col("stop") - 1).otherwise(F.col("stop"))
    out = out.select(key, F.col("sec").cast("int").alias("sec_no"), F.when(code, "code").otherwise("text").alias("type"), "start_line", end.alias("end_line"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    return out.filter("type = 'text'") if ignore_code else out


def md_chapters(docs: DataFrame, key: str = KEY, most: int = 50_000) -> DataFrame:
    """key, chunk_no, text: with two headings or more (one or two "#") a chunk per heading and
    one for what precedes; else texts over `most` characters packed by lines; else the whole."""
    marked = docs.withColumn("_l", tx.lines("text")).withColumn("_h", F.aggregate("_l", F.lit(0), lambda n, x: n + tx.is_heading(x).cast("int")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("n"))

    def pack(cut) -> Column:
        def step(s: Column, x: Column) -> Column:
            more = F.struct(s["done"].alias("done"), F.when(s["now"].isNull(), x).otherwise(F.concat(s["now"], F.lit("\n"), x)).alias("now"), (s["n"] + F.length(x) + 1).alias("n"))
            new = F.struct(F.array_append(s["done"], s["now"]).alias("done"), x.alias("now"), (F.length(x) + 1).alias("n"))
            return F.when(s["now"].isNotNull() & cut(s, x), new).otherwise(more)

        return F.aggregate("_l", start, step, lambda s: F.array_append(s["done"], s["now"]))

    chunks = (
        F.when(F.col("_h") >= 2, pack(lambda s, x: tx.is_heading(x)))
        .when(F.length("text") > most, pack(lambda s, x: s["n"] + F.length(x) + 1 > most))
        .otherwise(F.array("text"))
    )
    return marked.select(key, F.posexplode(chunks).alias("chunk_no", "text"))


def chunks(x, most: int = 100_000) -> Column:
    """array of pieces of at most `most` characters, cut after the last blank line, else after
    the last sentence, else hard."""
    y = tx._c(x)
    start = F.struct(F.array().cast("array<string>").alias("done"), y.alias("rest"))

    def step(s: Column, _: Column) -> Column:
        head = F.substring(s["rest"], 1, most)
        back = F.reverse(head)
        blank, full = F.instr(back, "\n\n"), F.instr(back, " .")
        at = F.when(blank > 0, F.length(head) - blank + 1).when(full > 0, F.length(head) - full + 1).otherwise(F.length(head))
        cut = F.struct(F.array_append(s["done"], F.substring(head, F.lit(1), at)).alias("done"), F.substring(s["rest"], at + 1, F.length(s["rest"])).alias("rest"))
        return F.when(F.length(s["rest"]) > most, cut).otherwise(s)

    # Every cut takes a blank line, a sentence's end or `most` characters with it.
    n = F.when(F.length(y) > most, F.ceil(F.length(y) / most).cast("int") + F.regexp_count(y, F.lit(r"\n\n|\. ")) + 1).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.when(s["rest"] != "", F.array_append(s["done"], s["rest"])).otherwise(s["done"]))


# --- contents ---------------------------------------------------------------------------
TOC_CHAPTER = r"(?:Chapter|C\s*h\s*a\s*p\s*t\s*e\s*r)\s*(\d+)\s*:?\s*(.*?)(?:\s*\d+)?\s*$"
TOC_APPENDIX = r"(?:Appendix|A\s*p\s*p\s*e\s*n\s*d\s*i\s*x)\s+([A-Z])\s*:?\s*(.*?)(?:\s*\d+)?\s*$"


def toc(rows: DataFrame, key: str = KEY) -> DataFrame:
    """key, ord, type, number, letter, title, page, sections (title, page) from rows (key,
    line_no, text): chapter and appendix lines, and "title.page" lines below a chapter; an
    appendix closes the chapter before it."""
    line = tx.ustrip("text")
    ch, ap = tx.pattern("^" + TOC_CHAPTER, True), tx.pattern("^" + TOC_APPENDIX, True)
    rows = rows.withColumn("t", line).filter("t <> ''")
    kind = F.when(F.col("t").rlike(ch), "chapter").when(F.col("t").rlike(ap), "appendix")
    rows = rows.withColumn("kind", kind).withColumn("ord", F.sum(F.col("kind").isNotNull().cast("int")).over(_up_to_here(key))).filter("ord > 0")
    page = F.nullif(F.regexp_extract("t", r"\.\s*(\d+)\s*$", 1), F.lit(""))
    section = F.when(F.col("kind").isNull() & page.isNotNull(), F.struct(F.col(ORDER).alias("at"), tx.ustrip(F.regexp_extract("t", r"^(.*)\.\s*\d+\s*$", 1)).alias("title"), page.cast("int").alias("page")))
    out = rows.groupBy(key, "ord").agg(F.max("kind").alias("type"), F.max(F.when(F.col("kind").isNotNull(), F.col("t"))).alias("t"), F.array_sort(F.collect_list(section)).alias("s"))
    chapter = F.col("type") == "chapter"
    none = F.array().cast("array<struct<title:string,page:int>>")
    return out.select(
        key, F.col("ord").cast("int").alias("ord"), "type",
        F.when(chapter, F.regexp_extract("t", ch, 1).cast("int")).alias("number"), F.when(~chapter, F.upper(F.regexp_extract("t", ap, 1))).alias("letter"),
        tx.ustrip(F.when(chapter, F.regexp_extract("t", ch, 2)).otherwise(F.regexp_extract("t", ap, 2))).alias("title"),
        F.nullif(F.regexp_extract("t", r"(?U)\s(\d+)\s*$", 1), F.lit("")).cast("int").alias("page"),
        F.when(chapter, F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["page"].alias("page")))).otherwise(none).alias("sections"),
    )


# --- joining lines ----------------------------------------------------------------------
def paragraphs(rows: DataFrame, key: str = KEY, clean: bool = True) -> DataFrame:
    """key, text: lines put together to paragraphs. A line goes on where the one before has
    no full stop, or ends in a comma, semicolon or colon, or the line starts in lower case or
    with a joining word. Paragraphs are separated by a blank line."""
    rows = rows.withColumn("t", tx.clean_content_text("text") if clean else tx.ustrip("text")).filter("t <> ''")
    before = F.lag("t").over(W.partitionBy(key).orderBy(ORDER))
    joins = rf"^({'|'.join(tx.rules.CONJUNCTIONS)})\b"
    goes_on = ~tx.has("_p", r"[.!?]$") | tx.has("t", r"^[a-z]") | tx.has("t", joins, True) | tx.has("_p", r"[,;:]$")
    rows = rows.withColumn("_p", before).withColumn("new", (F.col("_p").isNull() | ~goes_on).cast("int"))
    rows = rows.withColumn("para", F.sum("new").over(_up_to_here(key)))
    each = rows.groupBy(key, "para").agg(F.array_sort(F.collect_list(F.struct(ORDER, "t"))).alias("l"))
    each = each.select(key, "para", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["t"]), " "), " +", " ").alias("t"))
    whole = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("para", "t"))).alias("l"))
    return whole.select(key, F.array_join(F.transform("l", lambda x: x["t"]), "\n\n").alias("text"))


def merge_lines(rows: DataFrame, key: str = KEY, ignore_case: bool = False) -> DataFrame:
    """key, line_no, text: maximal runs of lines that go on from each other as one line; a
    hyphen at a line end joins without it, and no space comes before , . ; : ? or !."""
    before = F.lag("text").over(W.partitionBy(key).orderBy(ORDER))
    rows = rows.withColumn("_p", before).withColumn("new", (~F.coalesce(tx.is_continuation("text", "_p", ignore_case), F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(_up_to_here(key)))
    out = rows.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct(ORDER, "text"))).alias("l"))

    def put(a: Column, x: Column) -> Column:
        t = x["text"]
        return F.when(a.isNull(), t).when(F.endswith(a, F.lit("-")), F.concat(F.regexp_replace(a, "-$", ""), t)).when(tx.has(t, r"^[,.;:?!]"), F.concat(a, t)).otherwise(F.concat(a, F.lit(" "), t))

    return out.select(key, (F.col("run") - 1).cast("int").alias(ORDER), F.aggregate("l", F.lit(None).cast("string"), put).alias("text"))


def vertical_text(rows: DataFrame, key: str = KEY, most: int = 5) -> DataFrame:
    """key, line_no, text, consumed: runs of up to `most` single-letter lines as one word."""
    rows = rows.filter(F.col("text").isNotNull()).withColumn("one", tx.has("text", r"^[a-zA-Z]$"))
    rows = rows.withColumn("g", F.sum((~F.col("one")).cast("int")).over(_up_to_here(key))).filter("one")
    rows = rows.withColumn("k", F.floor((F.row_number().over(W.partitionBy(key, "g").orderBy(ORDER)) - 1) / most))
    out = rows.groupBy(key, "g", "k").agg(F.min(ORDER).alias(ORDER), F.array_sort(F.collect_list(F.struct(F.col(ORDER).alias("at"), "text"))).alias("l"))
    return out.select(key, ORDER, F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"), F.size("l").alias("consumed"))


# --- samples ----------------------------------------------------------------------------
def systematic_sample(rows: DataFrame, key: str = KEY, most: int = 50) -> DataFrame:
    """At most `most` lines a document, at i * n div most; all if there are no more."""
    n, at = F.count("*").over(W.partitionBy(key)), F.row_number().over(W.partitionBy(key).orderBy(ORDER)) - 1
    rows = rows.withColumn("n", n).withColumn("rn", at)
    k = F.least(F.col("n"), F.lit(most))
    picked = F.exists(F.sequence(F.lit(0), k.cast("int") - 1), lambda i: F.floor(i * F.col("n") / k) == F.col("rn"))
    return rows.filter(picked).drop("n", "rn")


def edge_sample(rows: DataFrame, key: str = KEY) -> DataFrame:
    """First, last and, of more than ten, middle line of a document."""
    n, at = F.count("*").over(W.partitionBy(key)), F.row_number().over(W.partitionBy(key).orderBy(ORDER)) - 1
    rows = rows.withColumn("n", n).withColumn("rn", at)
    return rows.filter((F.col("rn") == 0) | (F.col("rn") == F.col("n") - 1) | ((F.col("n") > 10) & (F.col("rn") == F.floor(F.col("n") / 2)))).drop("n", "rn")
