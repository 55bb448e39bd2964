"""Operator 7: language identification by Bayesian evidence fusion.

For each row the log-likelihoods of its text under a trigram model per language are added to
- how far the declared language (of the markup, or of a column) is to be trusted: the
  agreement of declarations with texts, counted over the whole table;
- the language that the address names (last label of the host, or first part of the path);
- the prior of its host, smoothed towards its domain's, smoothed towards the whole table's,
  all summed from the text posteriors by grouped aggregation.
"Undetermined" is one more hypothesis, under which every trigram is as likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm._bytes import BUCKETS, runs, sums, trigrams
from inkmill.llm._shared import Scratch, frugal, lower_ascii, small

#: Languages of country domains.
COUNTRY = {"at": "de", "be": "fr", "ch": "de", "de": "de", "es": "es", "fr": "fr", "mx": "es", "uk": "en", "us": "en"}


@dataclass(frozen=True)
class Identification:
    """Documents per language to fit on; trigrams that count as independent at most; weight
    of a parent prior in rows; prior of "undetermined"; chance that an address misleads;
    least posterior to accept."""

    sample: int = 400
    evidence: float = 60.0
    smoothing: float = 20.0
    undetermined: float = 0.01
    misled: float = 0.1
    least: float = 0.5


def fit(spark: SparkSession, rows: DataFrame, p: Identification) -> tuple[list[str], np.ndarray]:
    """Languages, and log-probabilities of trigram buckets by language, from a bounded sample
    of rows (id, text, declared): for each declared language, of which there are as many as
    the table names (128 KB of model each), the p.sample rows with the smallest hashes."""
    told = rows.filter("declared is not null").groupBy("declared").count().collect()
    sizes = {r[0]: r[1] for r in told}
    names = sorted(sizes)
    if not names:
        return [], np.empty((0, BUCKETS))
    # One pass takes rows with small hashes, about twice as many as are needed; of these, which
    # are few, the smallest are kept.
    hash_ = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    near = F.lit(False)
    for name, n in sizes.items():
        near = near | ((F.col("declared") == name) & (hash_ <= min(1 << 30, (2 * p.sample + 50) * (1 << 30) // n)))
    by = W.partitionBy("d").orderBy("h", "id", "text")
    sample = rows.filter(near).select("id", "text", F.col("declared").alias("d"), hash_.alias("h"))
    sample = sample.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= p.sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            told = np.array(batch.column(0).to_pylist(), object)
            for first, data, offsets in runs(batch.column(1)):
                h, ok = trigrams(data, offsets)
                for i in range(len(offsets) - 1):
                    at = slice(offsets[i], offsets[i + 1])
                    c = np.bincount(h[at][ok[at]], minlength=BUCKETS)
                    total[told[first + i]] = total.get(told[first + i], 0) + c
        if total:
            yield pa.RecordBatch.from_pydict({"d": pa.array(list(total)), "c": pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())})

    counts = np.zeros((len(names), BUCKETS))
    for d, c in sample.select("d", "text").mapInArrow(frugal(count), "d string, c binary").collect():
        counts[names.index(d)] += np.frombuffer(c, "<i8")
    return names, np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))


def text_evidence(rows: DataFrame, model: np.ndarray, p: Identification) -> DataFrame:
    """rows (row, ..., text) -> the columns without text, and ll: log-likelihoods of the
    languages, then of "undetermined"; n: trigrams. A text's mean is taken p.evidence times
    at most, as its trigrams depend on each other."""
    table = np.vstack([model, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float64)
    keep = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n long", "ll array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ll = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, len(table)))
            for first, data, offsets in runs(batch.column(len(names))):
                h, ok = trigrams(data, offsets)
                at = slice(first, first + len(offsets) - 1)
                n[at] = sums(ok.astype(np.int64), offsets)
                for k, row in enumerate(table):
                    ll[at, k] = sums(np.where(ok, row[h], 0.0), offsets)
            ll *= (np.minimum(n, p.evidence) / np.maximum(n, 1))[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(list(ll), pa.list_(pa.float64()))], names=[*names, "n", "ll"])

    return rows.select(*names, "text").mapInArrow(frugal(run), schema)


def _softmax(score: Column) -> Column:
    e = F.transform(score, lambda x: F.exp(x - F.array_max(score)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def address_language(host: Column, path: Column, names: list[str]) -> Column:
    """The language of the path's first part, else of the host's country, else null."""
    first, last = lower_ascii(F.regexp_extract(path, r"^/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)", 1)), F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    country = F.lit(None).cast("string")
    for k, v in COUNTRY.items():
        country = F.when(last == k, F.lit(v)).otherwise(country)
    return F.when(first.isin(names), first).otherwise(F.when(country.isin(names), country)) if names else F.lit(None).cast("string")


def identify(spark: SparkSession, rows: DataFrame, p: Identification = Identification()) -> DataFrame:
    """id, declared, lang, confidence, accepted, and key if rows has one, of every row of rows
    (id, text, declared, address, host, domain); declared, address, host and domain may be
    null and say nothing then.

    lang is null where "undetermined" wins or no language is declared anywhere. Null and
    empty texts are judged by the other evidence alone; if there is none they are not
    accepted. Rows that repeat an id are told apart; repeated rows have one result each.
    Empty table: no rows. Other columns are not read.
    """
    carried = ["key"] if "key" in rows.columns else []
    scratch = Scratch(spark, "language")
    names, model = fit(spark, rows, p)
    k = len(names)
    slim = rows.select(F.monotonically_increasing_id().alias("row"), "id", "declared", "address", "host", "domain", *carried, "text")
    told = scratch.write(text_evidence(slim, model, p), "text")
    if not k:
        return told.select("id", *carried, "declared", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    # What texts alone say, as soft counts.
    flat = np.log(np.array([(1 - p.undetermined) / k] * k + [p.undetermined]))
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    soft = told.withColumn("soft", _softmax(add(F.col("ll"), array(flat)))).filter("n > 0")
    cells = lambda c: [F.sum(F.col(c)[j]).alias(f"p{j}") for j in range(k + 1)]
    gather = lambda prefix="p": F.array(*[F.col(f"{prefix}{j}") for j in range(k + 1)])
    hosts = scratch.write(soft.groupBy("host", "domain").agg(*cells("soft")), "hosts")
    each = [F.sum(f"p{j}").alias(f"p{j}") for j in range(k + 1)]
    top = hosts.agg(*each).first()
    whole = np.array([top[j] or 0.0 for j in range(k + 1)]) + p.smoothing * np.exp(flat)
    whole = whole / whole.sum()
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def shrunk(own: Column, parent: Column) -> Column:
        return F.zip_with(own, parent, lambda a, b: (a + F.lit(p.smoothing) * b) / (size(own) + F.lit(p.smoothing)))

    domains = hosts.groupBy(F.col("domain").alias("d")).agg(*each).select("d", shrunk(gather(), array(whole)).alias("dp"))
    priors = hosts.join(domains, F.col("domain").eqNullSafe(F.col("d"))).select(F.col("host").alias("h"), F.col("domain").alias("hd"), shrunk(gather(), F.col("dp")).alias("hp"))
    priors = scratch.write(priors, "priors")
    # Of the texts that a declaration names l or not, how much is in l: trust[d][l] over all rows.
    pairs = soft.filter(F.col("declared").isin(names)).groupBy("declared").agg(*cells("soft")).collect()
    joint = np.full((k, k + 1), 0.5) + np.eye(k, k + 1) * 4
    for r in pairs:
        joint[names.index(r[0])] += np.array(r[1:], float)
    trust = np.log(joint / joint.sum(0, keepdims=True))
    hint = np.log(np.full((k, k + 1), p.misled / k) + np.eye(k, k + 1) * (1 - p.misled))
    hint[:, k] = np.log(1 / k)
    index = lambda c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)).cast("int")
    table = lambda t: F.array(*[array(r) for r in t])
    of = lambda c, t: F.coalesce(F.try_element_at(table(t), F.nullif(index(c), F.lit(0))), array([0.0] * (k + 1)))
    at = told.join(small(priors), F.col("host").eqNullSafe(F.col("h")) & F.col("domain").eqNullSafe(F.col("hd")), "left")
    prior = F.transform(F.coalesce("hp", array(whole)), lambda x: F.log(x))
    known = (F.col("n") > 0) | F.col("declared").isin(names) | F.col("address").isin(names)
    at = at.withColumn("post", _softmax(add(add(add(F.col("ll"), prior), of("declared", trust)), of("address", hint))))
    best = F.array_position("post", F.array_max("post")).cast("int")
    lang = F.try_element_at(F.array(*[F.lit(n) for n in names]), best)
    known = F.coalesce(known, F.lit(False))
    return at.select(
        "id", *carried, "declared", F.when(known, lang).alias("lang"), F.when(known, F.array_max("post")).otherwise(0.0).alias("confidence"),
        (known & lang.isNotNull() & (F.array_max("post") >= p.least)).alias("accepted"),
    )


def _row_key(docs: DataFrame) -> Column:
    """Equal for rows of docs with equal text, lang and source, which are judged alike."""
    parts = [docs[c].cast("string") for c in ("text", "lang", "source")]
    return F.xxhash64(*[x for c in parts for x in (c.isNull(), c)])


def document_rows(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) as rows to identify: the column lang is the
    declaration and the source the host. Documents have no address."""
    return docs.select(
        docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text"), docs["lang"].alias("declared"), F.lit(None).cast("string").alias("address"),
        docs["source"].alias("host"), F.lit(None).cast("string").alias("domain"), _row_key(docs).alias("key"),
    )


def page_rows(pages: DataFrame, names: list[str]) -> DataFrame:
    """pages (page_id, url, html) as rows: the text between tags, the lang attribute of the
    markup, the address's language and host."""
    from inkmill.llm.urls import host_and_path

    host, path = host_and_path(F.col("url"))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&#?\w+;", " ")
    declared = F.nullif(lower_ascii(F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), declared.alias("declared"), host.alias("host"), path.alias("path"))
    return rows.select("id", "text", "declared", address_language(F.col("host"), F.col("path"), names).alias("address"), F.nullif("host", F.lit("")).alias("host"), F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"))


def drop_unidentified(spark: SparkSession, docs: DataFrame, p: Identification = Identification()) -> DataFrame:
    """docs (doc_id, text, lang, source) without the rows that identify() does not accept, each
    judged for itself: rows with null id go too, and accepted rows that share an id with a
    rejected one stay. Repeated rows share their verdict. Empty table: no rows. Columns
    unchanged."""
    scratch = Scratch(spark, "unidentified")
    gone = identify(spark, document_rows(docs), p).filter("not accepted")
    gone = scratch.write(gone.select(F.col("id").alias("_d"), F.col("key").alias("_t")).distinct(), "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_d"]) & (_row_key(docs) == gone["_t"])
    return docs.join(small(gone), same, "left_anti")
