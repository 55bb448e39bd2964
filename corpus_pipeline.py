"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Every stage reads all rows and whole texts of its predecessor, keeps the columns as they are
(the last one returns digests), and on an empty table returns no rows. Rows are judged by
what they hold, so a row without doc_id is one like others and rows that share an id have
verdicts of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmill.llm._shared import Scratch
from inkmill.llm.decontamination import drop_contaminated
from inkmill.llm.language import drop_unidentified
from inkmill.llm.mixing import mix
from inkmill.llm.near_duplicates import NearDuplicates, drop_near_duplicates
from inkmill.llm.queries import tokenizer_path
from inkmill.llm.tokens import token_file_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language explains go: null and empty texts without a declared language
    that others have, texts like noise. Equal rows share their verdict."""
    return drop_unidentified(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays: the one with the
    smallest doc_id, null ids last, then the smallest hash of the text; of repeated rows one.
    Null and empty texts are no duplicates of anything and all stay."""
    return drop_near_duplicates(spark, docs, NearDuplicates())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least a twentieth lie in passages of the benchmark go. Null
    and wordless texts stay; items of the benchmark without id or words ask for nothing."""
    return drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows repeat. Null source is a source, the last in
    order; ties of the sampling key are ordered by the hash of id and text, and repeated rows
    are in or out together."""
    return mix(spark, docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all that is left; per document its place and digest in them. Null text: the
    end id alone; null doc_id first; rows of one id are ordered by text."""
    return token_file_digests(spark, docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: Signatures, sampling by Spark's hashes and the tokenizer are beyond SQL; tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again as the next one's."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
