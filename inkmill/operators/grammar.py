"""Grammar and coherence lint by external checkers, which register as backends.

A backend is a function text -> list of (offset, length, rule, message, suggestion, category).
None is shipped; `languagetool()` and `spacy_coherence()` make them where the packages exist.
Spelling rules are sure to 0.9, others to 0.7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Finding = tuple[int, int, str, str, str, str]
Checker = Callable[[str], list[Finding]]
SCHEMA = "start int, line int, column int, text string, suggestion string, confidence double, error_type string, rule_id string, description string"


def languagetool(language: str = "en-US") -> Callable[[], Checker]:
    """A maker of checkers: one server per Python worker."""

    def make() -> Checker:
        import language_tool_python

        tool = language_tool_python.LanguageTool(language)
        return lambda text: [(m.offset, m.errorLength, m.ruleId, m.message, (m.replacements or [""])[0], m.category) for m in tool.check(text)]

    return make


def spacy_coherence(model: str = "en_core_web_sm") -> Callable[[], Checker]:
    """Plural subjects with verbs in -s, but for is and was, in sentences of four tokens or more."""

    def make() -> Checker:
        import spacy

        nlp = spacy.load(model)

        def run(text: str) -> list[Finding]:
            out = []
            for sentence in nlp(text).sents:
                for token in sentence if len(sentence) >= 4 else ():
                    verb = token.head
                    if token.dep_ == "nsubj" and token.text.lower() in ("i", "you", "we", "they") and verb.pos_ == "VERB" and verb.text.endswith("s") and verb.text.lower() not in ("is", "was"):
                        out.append((verb.idx, len(verb.text), "AGREEMENT", f"{token.text} with {verb.text}", verb.text[:-1], "COHERENCE"))
            return out

        return run

    return make


def check(texts: DataFrame, make: Callable[[], Checker], key: str = "doc_id", error_type: str = "grammar", disabled: Sequence[str] = (), min_confidence: float = 0.7, least: int = 5, chunk: int = 100_000) -> DataFrame:
    """key and an error per finding of texts (key, text). Texts under `least` characters are
    skipped; longer ones are checked in chunks, whole. Findings of disabled categories go."""
    from inkmill.operators.segment import chunks

    kind = texts.schema[key].dataType.simpleString()
    parts = texts.filter(F.length("text") >= least).select(key, F.posexplode(chunks("text", chunk)).alias("k", "text"))
    before = W.partitionBy(key).orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        checker = None
        for batch in batches:
            checker = checker or make()
            out = []
            for name, base, text in zip(*(c.to_pylist() for c in batch.columns)):
                for at, n, rule, said, better, category in checker(text):
                    spelling = rule.startswith("MORFOLOGIK")
                    sure = 0.9 if spelling else 0.7
                    if category not in disabled and sure >= min_confidence:
                        head = text[:at].split("\n")
                        out.append((name, base + at, len(head) - 1, len(head[-1]), text[at : at + n], better, sure, "spelling" if spelling else error_type, rule, said))
            if out:
                cols = list(zip(*out))
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[key, *[x.split()[0] for x in SCHEMA.split(", ")]])

    return parts.select(key, "base", "text").mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
