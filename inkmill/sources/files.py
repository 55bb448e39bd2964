"""Readers: files of a folder as rows, documents by suffix, pages by extraction backends."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.functions import text as tx


def find_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", content: bool = True) -> DataFrame:
    """path, length, modificationTime (and content) of the files below a folder whose names
    fit the pattern; without content by path, so that no file's bytes are sorted. A folder that
    is not there: no rows; empty files hold nothing to extract and are left out."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    schema = "path string, modificationTime timestamp, length long, content binary"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        found = spark.createDataFrame([], schema)
    else:
        found = reader.load(folder)
    if content:
        return found.select("path", "length", "modificationTime", "content")
    return found.select("path", "length", "modificationTime").orderBy("path")


def read_texts(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, text of whole UTF-8 files. A path that is not there is an error."""
    reader = spark.read.option("pathGlobFilter", pattern)
    reader = reader.option("recursiveFileLookup", "true") if recursive else reader
    return reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by key over all cores if it is read by fewer tasks than there are cores: one
    small file is one task otherwise. Windows and groups by the key then need no shuffle of
    their own. Larger tables stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n, key)


def relative_path(path: Column, root: str) -> Column:
    """The part of a path below root, for outputs that mirror their inputs."""
    clean = root.rstrip("/").split("://")[-1]
    return F.regexp_replace(path, F.lit(r"^.*?\Q" + clean + r"\E/"), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


@F.pandas_udf(T.StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """YAML (safe subset) as JSON; null for what is not YAML. Dates become text."""
    import yaml

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, set)):
            return [plain(v) for v in x]
        return x.isoformat(" ") if isinstance(x, datetime) else x.isoformat() if isinstance(x, date) else x

    def run(text):
        try:
            return None if text is None else json.dumps(plain(yaml.safe_load(text)), ensure_ascii=False)
        except (yaml.YAMLError, TypeError, ValueError):
            return None

    return texts.map(run)


def read_structured(spark: SparkSession, folder: str, schema: str, recursive: bool = True) -> DataFrame:
    """path, value (of schema), error of JSON and YAML files; other suffixes and files that do
    not parse have an error instead of a value."""
    files = read_texts(spark, folder, "*", recursive)
    kind = suffix(F.col("path"))
    yaml_ = files.filter(kind.isin(".yaml", ".yml")).select("path", yaml_to_json("text").alias("json"))
    plain = files.filter(kind == ".json").select("path", F.col("text").alias("json"))
    other = files.filter(~kind.isin(".yaml", ".yml", ".json")).select("path", F.lit(None).cast("string").alias("json"))
    value = F.from_json("json", schema)
    wrong = F.when(~suffix(F.col("path")).isin(".yaml", ".yml", ".json"), F.concat(F.lit("Unsupported file type: "), suffix(F.col("path")))).when(value.isNull() | F.try_parse_json("json").isNull(), F.lit("File does not parse"))
    return yaml_.unionByName(plain).unionByName(other).select("path", F.when(wrong.isNull(), value).alias("value"), wrong.alias("error"))


# --- extraction -------------------------------------------------------------------------
#: name -> function (bytes, pages or None) -> list of (page number from 0, text).
Backend = Callable[[bytes, Sequence[int] | None], list[tuple[int, str]]]
BACKENDS: dict[str, Backend] = {}


def register_backend(name: str, run: Backend) -> None:
    BACKENDS[name] = run


def _pymupdf(data: bytes, pages: Sequence[int] | None) -> list[tuple[int, str]]:
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        return [(i, doc[i].get_text()) for i in (pages or range(len(doc))) if 0 <= i < len(doc)]


def _pypdf(data: bytes, pages: Sequence[int] | None) -> list[tuple[int, str]]:
    import io

    import pypdf

    doc = pypdf.PdfReader(io.BytesIO(data)).pages
    return [(i, doc[i].extract_text() or "") for i in (pages or range(len(doc))) if 0 <= i < len(doc)]


def ocr_backend(language: str = "eng", dpi: int = 300, psm: int = 1, oem: int = 3) -> Backend:
    """Pages rendered at dpi and read by Tesseract."""

    def run(data: bytes, pages: Sequence[int] | None) -> list[tuple[int, str]]:
        import io

        import fitz
        import pytesseract
        from PIL import Image

        out = []
        with fitz.open(stream=data, filetype="pdf") as doc:
            for i in pages or range(len(doc)):
                if 0 <= i < len(doc):
                    image = Image.open(io.BytesIO(doc[i].get_pixmap(dpi=dpi).tobytes("png")))
                    out.append((i, pytesseract.image_to_string(image, lang=language, config=f"--psm {psm} --oem {oem}")))
        return out

    return run


def image_backend(language: str = "eng", psm: int = 1, oem: int = 3) -> Backend:
    """One image as one page."""

    def run(data: bytes, pages: Sequence[int] | None) -> list[tuple[int, str]]:
        import io

        import pytesseract
        from PIL import Image

        return [(0, pytesseract.image_to_string(Image.open(io.BytesIO(data)), lang=language, config=f"--psm {psm} --oem {oem}"))]

    return run


for _name, _run in (("pymupdf", _pymupdf), ("pypdf", _pypdf), ("ocr", ocr_backend()), ("image", image_backend())):
    register_backend(_name, _run)


def extract_pages(files: DataFrame, backend: str | Backend, pages: Sequence[int] | None = None, key: str = "path", strict: bool = False) -> DataFrame:
    """key, page_no, text of files (key, content) by one backend; a file that it cannot read
    has no rows, or if strict is an error. Page numbers out of range are skipped; no page
    numbers: all pages."""
    run = BACKENDS[backend] if isinstance(backend, str) else backend
    chosen = list(pages) if pages else None
    kind = files.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                try:
                    found = run(data.as_py(), chosen)
                except Exception:  # a backend's errors mean: not readable by it
                    if strict:
                        raise
                    continue
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), batch.schema.field(0).type), pa.array([p for p, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string())], names=[key, "page_no", "text"])

    return files.select(key, "content").mapInArrow(read, f"`{key}` {kind}, page_no int, text string")


def join_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """key, text: pages in order, a blank line between."""
    out = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return out.select(key, F.array_join(F.transform("p", lambda p: p["text"]), "\n\n").alias("text"))


def select_pages(pages: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages first to last (from 0, last excluded); none given: all. A filter the scan can take."""
    return pages if first is None and last is None else pages.filter((F.col("page_no") >= (first or 0)) & (F.lit(True) if last is None else F.col("page_no") < last))


def extract(
    files: DataFrame, methods: Sequence[str | Backend] = ("pymupdf", "pypdf", "ocr"), pages: Sequence[int] | None = None, key: str = "path", last: str | Backend | None = None
) -> DataFrame:
    """key, text, method: by the first method that gives any text, cleaned; where all fail by
    `last`, as it is; else the empty text. One pass over the files: each is read once, and a
    method runs on a file only if those before it gave nothing."""
    named = lambda m: (m, BACKENDS[m]) if isinstance(m, str) else (getattr(m, "__name__", "custom"), m)
    steps = [(*named(m), True) for m in methods] + ([] if last is None else [(*named(last), False)])
    chosen, kind = list(pages) if pages else None, files.schema[key].dataType.simpleString()

    def first(data: bytes) -> tuple[str, str | None, bool]:
        for name, run, clean in steps:
            try:
                text = "\n\n".join(t for _, t in sorted(run(data, chosen), key=lambda p: p[0]))
            except Exception:  # a backend's errors mean: not readable by it
                continue
            if text:
                return text, name, clean
        return "", None, False

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text, method, clean = first(batch.column(1)[at].as_py())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 1), pa.array([text], pa.string()), pa.array([method], pa.string()), pa.array([clean], pa.bool_())], names=[key, "text", "method", "clean"]
                )

    made = files.select(key, "content").mapInArrow(read, f"`{key}` {kind}, text string, method string, clean boolean")
    return made.select(key, F.when(F.col("clean"), tx.clean_extracted_text("text")).otherwise(F.col("text")).alias("text"), "method")


# --- HTML -------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """The text of HTML without scripts and styles, by the standard library's parser."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, data):
            if not self.hidden:
                self.parts.append(data)

    def run(page):
        if page is None:
            return None
        t = Text()
        t.feed(page)
        t.close()
        return "".join(t.parts)

    return pages.map(run)


def markdown_text(x: Column | str) -> Column:
    """Markdown without its marks: headings, emphasis, links, images, code, lists and quotes
    keep their text. A documented subset, native."""
    y = tx._c(x)
    y = tx.subs(y, [(r"^\s*```.*$", ""), (r"^#{1,6}\s+", ""), (r"^\s*>\s?", ""), (r"^\s*(?:[-*+]|\d+\.)\s+", "")], multiline=True)
    return tx.subs(y, [(r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"(?:\*\*|__)(.+?)(?:\*\*|__)", r"\1"), (r"(?<!\w)[*_](.+?)[*_](?!\w)", r"\1"), (r"`([^`]*)`", r"\1")])
