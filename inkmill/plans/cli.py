"""Command line, for spark-submit: process texts or PDFs, convert documents, lint Markdown.

    spark-submit inkmill/plans/cli.py process INPUT OUTPUT --type markdown
    spark-submit inkmill/plans/cli.py process INPUT OUTPUT --type processed --to-markdown
    spark-submit inkmill/plans/cli.py convert INPUT OUTPUT --no-toc
    spark-submit inkmill/plans/cli.py lint INPUT OUTPUT --confidence 0.85 [--fix] [--advanced]

Folders are read with what is below them. --include-validation and --keep-front-matter are
taken and change nothing: there are no validation results or front matter in what is converted.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import lint, structure
from inkmill.plans import pipeline, render
from inkmill.sources import files, sinks

ENVELOPE = f"""filename string, extraction_date string, output_type string,
content struct<metadata:struct<title:string,type:string>, chapters:array<struct<number:int,title:string,sections:array<{structure.SECTION}>>>,
appendices:array<struct<letter:string,title:string,content:string,sections:array<{structure.SECTION}>>>>"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkmill")
    sub = p.add_subparsers(dest="command", required=True)
    process, convert, check = (sub.add_parser(n) for n in ("process", "convert", "lint"))
    for s in (process, convert, check):
        s.add_argument("input")
        s.add_argument("output")
    process.add_argument("--type", choices=pipeline.OUTPUT_TYPES, default="raw")
    process.add_argument("--format", choices=("json", "yaml", "txt"), default="json")
    process.add_argument("--pattern", default="*.txt", help="*.pdf extracts by backends")
    for s in (process, convert):
        s.add_argument("--no-toc", action="store_true")
        s.add_argument("--clean-text", choices=("none", "basic", "light", "advanced"), default="none")
    process.add_argument("--to-markdown", action="store_true", help="write Markdown beside what is asked for")
    convert.add_argument("--recursive", action="store_true", default=True)
    convert.add_argument("--include-validation", action="store_true")
    convert.add_argument("--keep-front-matter", action="store_true")
    check.add_argument("--confidence", type=float, default=0.85)
    check.add_argument("--advanced", action="store_true", help="split and joined words by the advanced rules")
    check.add_argument("--preview", type=int, default=0, help="print so many lines of each report")
    check.add_argument("--ignore-code", action="store_true")
    check.add_argument("--fix", action="store_true", help="write mended texts beside the reports")
    return p


def read(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, text of text files, or of PDFs by the extraction cascade."""
    if pattern.lower().endswith(".pdf"):
        return files.extract(files.find_files(spark, folder, pattern)).select("path", "text")
    return files.read_texts(spark, folder, pattern)


def named(df: DataFrame, column: str, folder: str, extension: str) -> DataFrame:
    """name, text: one file per document, mirroring the input's folders."""
    inner = F.regexp_replace(files.relative_path(F.col("path"), folder), F.lit(r"\.[^./]*$"), F.lit(""))
    return df.select(F.concat(inner, F.lit(extension)).alias("name"), F.col(column).alias("text"))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Writes what is asked for; returns the number of files."""
    if args.command == "process":
        texts, how = read(spark, args.input, args.pattern), {"toc": not args.no_toc, "cleaning": args.clean_text}
        made = pipeline.process(texts, args.type, "path", **how)
        if args.type == "markdown":
            return sinks.write_files(named(made, "markdown", args.input, ".md"), args.output).count()
        more = 0
        if args.to_markdown:
            more = sinks.write_files(named(pipeline.process(texts, "markdown", "path", **how), "markdown", args.input, ".md"), f"{args.output}/markdown").count()
        if args.type == "lines":
            made = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l")).select("path", F.transform("l", lambda x: x["text"]).alias("content"))
        elif args.type == "lines_chapters":
            made = made.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*[c for c in made.columns if c != "path"]))).alias("content"))
        elif args.type == "raw":
            made = made.withColumnRenamed("text", "content")
        else:
            made = made.select("path", F.struct(*[c for c in made.columns if c != "path"]).alias("content"))
        body = F.struct(files.relative_path(F.col("path"), args.input).alias("filename"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("extraction_date"), F.lit(args.type).alias("output_type"), "content")
        text = {"json": sinks.pretty_json(body), "yaml": sinks.json_to_yaml(F.to_json(body)), "txt": F.col("content") if args.type == "raw" else F.to_json("content")}[args.format]
        return sinks.write_files(named(made.withColumn("body", text), "body", args.input, f".{args.format}"), f"{args.output}/{args.type}").count() + more
    if args.command == "convert":
        found = files.read_structured(spark, args.input, ENVELOPE).filter("value is not null").select("path", "value.extraction_date", "value.content.*")
        lists = {c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("chapters", "appendices")}
        made = render.markdown(found.select("path", "metadata", *lists.values(), "extraction_date"), "path", not args.no_toc, None, args.clean_text)
        return sinks.write_files(named(made, "markdown", args.input, ".md"), args.output).count()
    texts = files.read_texts(spark, args.input, "*.md")
    if args.advanced:
        errors = lint.lint_text(texts, "path", args.confidence)
    else:
        errors = lint.lint_markdown(texts, "path", ignore_code=args.ignore_code, word_confidence=args.confidence)
    errors = lint.with_context(errors, texts, "path")
    reports = texts.select("path").join(lint.report(errors, "path"), "path", "left").select("path", F.coalesce("report", F.lit("No errors found!")).alias("report"))
    n = sinks.write_files(named(reports, "report", args.input, ".report.txt"), args.output).count()
    if args.preview:
        for r in reports.select("path", lint.preview(F.col("report"), args.preview).alias("p")).toLocalIterator():
            print(r.path, r.p, sep="\n")
    if args.fix:
        n += sinks.write_files(named(lint.fix_text(texts, "path"), "text", args.input, ".fixed.md"), args.output).count()
    return n


if __name__ == "__main__":
    arguments = parser().parse_args()
    print(run(SparkSession.builder.appName("inkmill").getOrCreate(), arguments), "files written")
