"""A landing folder as a stream: new text files are cleaned and checked as they arrive. The
operators are stateless, so no watermark is needed; sinks see each file once per checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import text as tx
from inkmill.operators import quality


def read_landing(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """path, text of whole text files, as a stream."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    return reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def checked(texts: DataFrame) -> DataFrame:
    """path, is_valid, issues and metrics of cleaned texts; works on streams and tables."""
    return quality.issues(texts.select("path", tx.clean_extracted_text("text").alias("text")), "path")


def write_checked(texts: DataFrame, folder: str, checkpoint: str):
    """Starts the stream into Parquet; returns the query."""
    return checked(texts).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
