"""Operator 10: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else is unlabelled, and holds a
share `prior` of toxic documents too. A linear model on the presence of hashed words and
byte n-grams within them is fitted in numpy under the non-negative risk
prior * R(p, +) + max(0, R(u, -) - prior * R(p, -)). No feature is chosen or left out: each
weighs by the logarithm of its share among positives over that in the corpus, shrunk by
pseudo-counts, so rare and inflected forms count together through the n-grams they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm._bytes import FOLD, runs
from inkmill.llm._shared import Scratch, frugal

BITS = 18
GRAMS = (4, 5, 6)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class PositiveUnlabelled:
    """Most positive and unlabelled documents to fit on (the smallest by hash of the id),
    pseudo-count of a feature's shares, unlabelled documents of a step, steps, their rate and
    momentum, weight decay."""

    positives: int = 8_000
    unlabelled: int = 16_000
    pseudo: float = 10.0
    batch: int = 500
    steps: int = 400
    rate: float = 0.3
    momentum: float = 0.9
    decay: float = 1e-4


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text, the distinct buckets of its words and of the byte n-grams in them, each word
    with a space at both ends. Letters of any script are lower-cased."""
    last = np.zeros(1 << BITS, np.int64)
    for _, data, offsets in runs(pc.utf8_lower(pc.fill_null(column, "")), 1 << 18):
        rows = len(offsets) - 1
        x = np.full(len(data) + rows + 1, 32, np.uint8)
        x[np.arange(len(data)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))] = FOLD[data]
        edge = offsets + np.arange(rows + 1)
        # Prefix sums of a polynomial modulo 2^64: any slice's hash is one difference.
        total = np.append(np.uint64(0), np.cumsum((x + np.uint64(1)) * np.cumprod(np.full(len(x), _BASE, np.uint64))))
        back = np.cumprod(np.full(len(x), _INVERSE, np.uint64))
        spaces = np.append(0, np.cumsum(x == 32))
        gap = np.flatnonzero(x == 32)
        starts = [(s := np.arange(max(len(x) - g + 1, 0)))[spaces[s + g - 1] == spaces[s + 1]] for g in GRAMS]
        word = np.diff(gap) > 1
        slices = [*((s, s + g) for s, g in zip(starts, GRAMS)), (gap[:-1][word], gap[1:][word] + 1)]
        codes = [(((total[e] - total[s]) * back[s] * _MIX) >> np.uint64(64 - BITS)).astype(np.uint32) for s, e in slices]
        cuts = [np.searchsorted(s, edge) for s, _ in slices]
        for r in range(rows):
            h = np.concatenate([c[at[r] : at[r + 1]] for c, at in zip(codes, cuts)])
            i = np.arange(len(h))
            last[h] = i
            yield h[last[h] == i]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, p: PositiveUnlabelled) -> tuple[DataFrame, float]:
    """(positive, key, features) rows of a bounded sample outside the held-out rows, and the
    prior: the share of toxic labels among labelled rows. An id labelled more than once is toxic
    if one label says so. Rows with null id or label are not learnt from."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    order = F.xxhash64("doc_id", F.lit(29))
    positive = known.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(p.positives).withColumn("positive", F.lit(1))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(~held_out(F.col("doc_id")))
    other = ids.orderBy(order, "doc_id").limit(p.unlabelled).distinct().withColumn("positive", F.lit(0))
    # At most positives + unlabelled ids: bounded by the parameters.
    chosen = F.broadcast(positive.unionByName(other).withColumnRenamed("doc_id", "i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.sort(f).tobytes() for f in features(part.column(2))]
                yield pa.RecordBatch.from_pydict({"positive": part.column(0), "key": part.column(1), "features": pa.array(found, pa.binary())})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, F.col("doc_id") == F.col("i"))
    key = F.xxhash64("doc_id", F.lit(31)).alias("key")
    return texts.select("positive", key, "text").mapInArrow(frugal(run), "positive int, key long, features binary"), prior


def corpus_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Rows that hold each feature, and rows, of all docs that are learnt from. The driver gets
    one number per bucket; each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for f in features(batch.column(0)):
                n[f] += 1
            n[-1] += batch.num_rows
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int32()), "n": pa.array(n[at])})

    rows = docs.filter("doc_id is not null").filter(~held_out(F.col("doc_id").cast("long"))).select("text")
    counted = rows.mapInArrow(frugal(run), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << BITS) + 1, np.int64)
    n[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    return n[:-1], int(n[-1])


def design(sample: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """The features of each row of the sample in order of its key, and whether it is positive;
    one partition of the sample after the other reaches the driver."""
    rows = [(r.key, bytes(r.features), r.positive) for r in sample.toLocalIterator()]
    rows.sort()
    return [np.frombuffer(f, np.uint32) for _, f, _ in rows], np.array([y for _, _, y in rows], bool)


def evidence(x: list[np.ndarray], y: np.ndarray, counts: np.ndarray, rows: int, p: PositiveUnlabelled) -> np.ndarray:
    """Per feature, the logarithm of the positives that hold it over those that would if they
    were like the corpus, with pseudo-counts."""
    n = np.zeros(1 << BITS)
    for i in np.flatnonzero(y):
        n[x[i]] += 1
    return np.log((n + p.pseudo) / (counts * (y.sum() / max(rows, 1)) + p.pseudo))


def fit(x, y: np.ndarray, prior: float, p: PositiveUnlabelled, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum on the non-negative risk of parts of the
    sample, averaged over the later half; where the negative part of the risk falls below zero,
    its gradient is reversed. x holds the features of each row, scale a value of each feature."""
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    scale = np.ones(1 << BITS) if scale is None else scale
    w, v, mean = (np.zeros(len(scale)) for _ in range(3))
    if not y.any() or y.all():
        return w, bias
    positive, other = np.flatnonzero(y), np.flatnonzero(~y)
    parts = max(1, min(len(other) // p.batch, len(positive) // 8))
    split = lambda rows, k: rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
    b, vb, mean_b = bias, 0.0, 0.0
    for t in range(p.steps):
        xp, xu = ([x[i] for i in split(rows, t % parts)] for rows in (positive, other))
        found = np.concatenate(xp + xu)
        size = np.array([len(f) for f in xp + xu])
        ends = np.cumsum(size)
        total = np.append(0, np.cumsum((w * scale)[found]))
        s = total[ends] - total[ends - size] + b
        sp, su = s[: len(xp)], s[len(xp) :]
        # d/ds softplus(-s) = sigmoid(s) - 1; d/ds softplus(s) = sigmoid(s)
        gp, gu = prior * sigmoid(sp) / len(sp), sigmoid(su) / len(su)
        if np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean() >= 0:
            g = np.append(np.full(len(sp), -prior / len(sp)), gu)
        else:
            g = np.append(gp, -gu)
        grad = np.bincount(found, np.repeat(g, size), len(scale)) * scale + p.decay * w
        v, vb = p.momentum * v - p.rate * grad, p.momentum * vb - p.rate * g.sum()
        w, b = w + v, b + vb
        if t >= p.steps // 2:
            mean, mean_b = mean + w, mean_b + b
    n = p.steps - p.steps // 2
    return mean / n * scale, float(mean_b / n)


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([weights[np.sort(f)].sum() for f in features(batch.column(1))]) + bias
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))), pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, score double")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: PositiveUnlabelled = PositiveUnlabelled()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text); only ids whose
    crc32 (as text) is not a multiple of 5 are learnt from, and scores see the text alone.

    Null and empty texts: the bias's score. Null doc_id: not held out. Repeated rows: one
    result each. Without a positive example every score is the prior. Empty table: no rows.
    """
    sample, prior = training_sample(docs, labels, p)
    x, y = design(Scratch(spark, "toxicity").write(sample, "sample"))
    scale = evidence(x, y, *corpus_counts(docs), p) if y.any() else None
    scored = score(docs, *fit(x, y, prior, p, scale))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
