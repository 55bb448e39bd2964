"""Writers: files per document, envelopes by output type."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_text(df: DataFrame, folder: str, column: str = "text") -> None:
    """One text per line in as many files as partitions; the scalable form."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(folder)


def write_json(df: DataFrame, folder: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(folder)


def pretty_json(x: Column) -> Column:
    """JSON with indents of two."""
    return F.to_json(x, {"pretty": "true"})


@F.pandas_udf(T.StringType())
def json_to_yaml(texts: pd.Series) -> pd.Series:
    """Block-style YAML with sorted keys of JSON texts."""
    import yaml

    return texts.map(lambda t: None if t is None else yaml.dump(json.loads(t), default_flow_style=False, allow_unicode=True))


def write_files(df: DataFrame, folder: str, name: str = "name", text: str = "text") -> DataFrame:
    """path, length: one UTF-8 file per row (name, text), written by the executors under a
    temporary name and renamed into place, so a task that runs again leaves whole files.
    folder must be one that all executors share. The result is lazy: files are written when
    it is read."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
        for batch in batches:
            paths, sizes = [], []
            for n, t in zip(*(c.to_pylist() for c in batch.columns)):
                data, path = (t or "").encode("utf-8"), f"{root}/{n}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "length": pa.array(sizes, pa.int64())})

    return df.select(F.col(name), F.col(text)).mapInArrow(put, "path string, length long")


def envelope_path(output_type: Column, stem: Column, extension: str, debug: bool = False) -> Column:
    """<output type>/<stem>.<extension>, or debug/<stem>_<output type>.<extension>."""
    return F.concat(F.lit("debug/"), stem, F.lit("_"), output_type, F.lit(f".{extension}")) if debug else F.concat(output_type, F.lit("/"), stem, F.lit(f".{extension}"))


def write_envelopes(df: DataFrame, folder: str, kind: str = "json", debug: bool = False) -> DataFrame:
    """Files of envelopes (filename, extraction_date, output_type, content) as json, yaml or txt (content alone)."""
    stem = F.regexp_extract("filename", r"^(.*?)(\.[^.]*)?$", 1)
    body = pretty_json(F.struct("filename", "extraction_date", "output_type", "content"))
    text = {"json": body, "yaml": json_to_yaml(body) if kind == "yaml" else None, "txt": F.col("content")}[kind]
    return write_files(df.select(envelope_path(F.col("output_type"), stem, kind, debug).alias("name"), text.alias("text")), folder)
