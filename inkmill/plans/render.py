"""Markdown rendering of structured documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.functions import text as tx


def _link(text: Column, indent: str = "") -> Column:
    return F.concat(F.lit(f"{indent}- ["), text, F.lit("](#"), tx.anchor(text), F.lit(")"))


def chapter_title(number: Column, title: Column) -> Column:
    return F.when(F.coalesce(number, F.lit(0)) > 0, F.concat(number.cast("string"), F.lit(". "), tx.normalize_title(title))).otherwise(tx.normalize_title(title))


def appendix_title(letter: Column, title: Column) -> Column:
    return F.concat(F.lit("Appendix "), letter, F.lit(": "), tx.normalize_title(title))


def section_lines(s: Column, clean) -> Column:
    """A section: its heading, unless it is the main content, and its text; tables as they are."""
    body = F.when(s["is_table"], s["content"]).otherwise(clean(s["content"]))
    head = F.when(s["title"] == "Main Content", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("### "), tx.normalize_title(s["title"])), F.lit("")))
    return F.concat(head, F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(body, F.lit(""))))


def contents_entry(e: Column, kind: T.StructType) -> Column:
    """The lines of an entry of a contents list: number, title and sections (titles or structs
    that have one); with type and letter an appendix."""
    title = tx.normalize_title(e["title"])
    head = F.concat(F.coalesce(e["number"].cast("string"), F.lit("")), F.lit(". "), title)
    if "letter" in kind.names:
        appendix = (e["type"] == "appendix") & (F.coalesce(e["letter"], F.lit("")) != "")
        head = F.when(appendix, appendix_title(e["letter"], e["title"])).otherwise(head)
    sections = e["sections"]
    if isinstance(kind["sections"].dataType.elementType, T.StructType):
        sections = F.transform(sections, lambda s: s["title"])
    named = F.filter(F.coalesce(sections, F.array().cast("array<string>")), lambda s: ~F.coalesce(s, F.lit("")).isin("", "Main Content"))
    return F.concat(F.array(_link(head)), F.transform(named, lambda s: _link(s, "  ")))


def markdown(docs: DataFrame, key: str = "doc_id", toc: bool = True, extracted_on: Column | None = None, cleaning: str = "none") -> DataFrame:
    """key, markdown of docs (key, metadata, chapters, appendices, and table_of_contents if there
    is one): title, date, contents, chapters and appendices. Contents follow a document's own
    list, in its order, or where that is null or empty its chapters and appendices. `cleaning`
    is a level of clean_paragraph() for section texts."""
    clean = (lambda x: tx.clean_paragraph(x, cleaning)) if cleaning != "none" else (lambda x: x)
    heads = lambda ss: F.transform(F.filter(ss, lambda s: s["title"] != "Main Content"), lambda s: _link(tx.normalize_title(s["title"]), "  "))
    parts = [F.array(F.concat(F.lit("# "), tx.normalize_title(F.col("metadata.title"))), F.lit(""))]
    if extracted_on is not None:
        parts.append(F.array(F.concat(F.lit("*Extracted on: "), extracted_on, F.lit("*")), F.lit("")))
    if toc:
        listed = F.flatten(F.transform("chapters", lambda c: F.concat(F.array(_link(chapter_title(c["number"], c["title"]))), heads(c["sections"]))))
        more = F.transform("appendices", lambda a: _link(appendix_title(a["letter"], a["title"])))
        entries = F.concat(listed, more)
        if "table_of_contents" in docs.columns:
            kind = docs.schema["table_of_contents"].dataType.elementType
            own = F.flatten(F.transform("table_of_contents", lambda e: contents_entry(e, kind)))
            entries = F.when(F.coalesce(F.size("table_of_contents"), F.lit(0)) > 0, own).otherwise(entries)
        parts += [F.array(F.lit("## Table of Contents"), F.lit("")), entries, F.array(F.lit(""))]
    body = F.transform("chapters", lambda c: F.concat(F.array(F.concat(F.lit("## "), chapter_title(c["number"], c["title"])), F.lit("")), F.flatten(F.transform(c["sections"], lambda s: section_lines(s, clean)))))
    tail = F.transform("appendices", lambda a: F.concat(
        F.array(F.concat(F.lit("## "), appendix_title(a["letter"], a["title"])), F.lit("")),
        F.when(F.size(a["sections"]) > 0, F.flatten(F.transform(a["sections"], lambda s: section_lines(s, clean)))).otherwise(F.array(clean(a["content"]), F.lit(""))),
    ))
    return docs.select(key, F.array_join(F.concat(*parts, F.flatten(body), F.flatten(tail)), "\n").alias("markdown"))


def lines_markdown(rows: DataFrame, title: Column, key: str = "doc_id") -> DataFrame:
    """key, markdown of documents that are lines only: their paragraphs below a title."""
    from inkmill.operators.segment import paragraphs

    return paragraphs(rows, key, clean=False).select(key, F.concat(F.lit("# "), title, F.lit("\n\n"), F.col("text")).alias("markdown"))


def outline(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, outline: chapters and their subchapters as indented lines, for reading."""
    line = F.concat(F.array(F.concat(F.col("number").cast("string"), F.lit(" "), F.col("title"))), F.transform("subchapters", lambda s: F.concat(F.lit("  "), s["title"])))
    return found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chapter_seq", line.alias("l")))).alias("a")).select(key, F.array_join(F.flatten(F.transform("a", lambda x: x["l"])), "\n").alias("outline"))
