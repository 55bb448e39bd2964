"""From texts to an output type, planning only the stages it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import text as tx
from inkmill.operators import quality, segment, structure
from inkmill.plans import render

OUTPUT_TYPES = ("raw", "lines", "lines_chapters", "processed", "validated", "markdown")


def process(docs: DataFrame, output_type: str = "raw", key: str = "doc_id", title: str = "Document", kind: str = "Book", spaced_only: bool = True, extracted_on: Column | None = None, toc: bool = True, cleaning: str = "none") -> DataFrame:
    """docs (key, text) as `output_type`. Nothing runs here: a stage that the type does not
    need is not in the plan.

    raw: key, text, cleaned. lines: key, line_no, text. lines_chapters: one row per chapter.
    processed: metadata, table_of_contents, chapters, appendices. validated: quality of the
    cleaned text. markdown: the processed document rendered.
    """
    if output_type not in OUTPUT_TYPES:
        raise ValueError(f"output type {output_type!r} is none of {', '.join(OUTPUT_TYPES)}")
    clean = docs.select(key, tx.clean_extracted_text("text").alias("text"))
    if output_type == "raw":
        return clean
    if output_type == "validated":
        return quality.issues(clean, key)
    lines = segment.split_lines(clean, key)
    if output_type == "lines":
        return lines
    found = segment.chapters(lines, key, spaced_only)
    if output_type == "lines_chapters":
        return found
    made = structure.sections_of_chapters(found, key)
    chapters = F.array_sort(F.collect_list(F.struct("chapter_seq", "number", "title", "sections")))
    packed = made.groupBy(key).agg(chapters.alias("c"))
    contents = structure.toc_of_chapters(made, key).withColumnRenamed(key, "_k")
    none = F.array().cast("array<struct<chapter_seq:int,number:int,title:string,sections:array<string>>>")
    processed = packed.join(contents, F.col(key) == F.col("_k"), "left").select(
        key, structure.metadata(title, kind).alias("metadata"), F.coalesce("table_of_contents", none).alias("table_of_contents"),
        F.transform("c", lambda c: F.struct(c["number"].alias("number"), c["title"].alias("title"), c["sections"].alias("sections"))).alias("chapters"),
        F.array().cast(f"array<struct<letter:string,title:string,content:string,sections:array<{structure.SECTION}>>>").alias("appendices"),
    )
    return processed if output_type == "processed" else render.markdown(processed, key, toc, extracted_on, cleaning)
