"""Operator 2: quality by hierarchical empirical Bayes.

A logistic model on surface features of the whole text, fitted in numpy, gives each
document's own evidence, always by a model that was fitted without the document's fold.
Grouped by host and by path of the host, labels are held against what the evidence expects of
the same documents: how many times as many good (and bad) ones a site has is a posterior that
shrinks from the path's to the host's and from the host's to the global 1, by Gamma priors
whose strengths are estimated for either level from the spread within it. A document's
log-odds are its evidence plus its site's log-odds ratio, so what the text explains does not
count twice; and its own label is taken out of its site's counts before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm._shared import Scratch, frugal, small

FEATURES = ("length", "letters", "digits", "symbols", "upper", "spaces", "lines", "word_length", "repeated_words", "repeated_lines", "packed")


@dataclass(frozen=True)
class QualityModel:
    """Most labelled rows to fit on (the smallest by hash of the id), folds, Newton steps,
    ridge, how much of a site's log-odds counts, least score to keep."""

    sample: int = 20_000
    folds: int = 5
    steps: int = 25
    ridge: float = 1.0
    site: float = 1.0
    least: float = 0.5


_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _KIND[_c] = 1 if chr(_c).isalpha() and _c < 128 or _c >= 128 else 2 if 48 <= _c <= 57 else 4 if _c in (32, 10, 9, 13) else 3


def surface(text: str | None) -> list[float]:
    """The features of one whole text; the empty text has zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    x = np.frombuffer(data, np.uint8)
    kind = np.bincount(_KIND[x], minlength=5)
    upper = int(((x >= 65) & (x <= 90)).sum())
    words, lines = text.split(), text.split("\n")
    return [
        np.log1p(n), kind[1] / n, kind[2] / n, kind[3] / n, upper / n, kind[4] / n, len(lines) / n * 100,
        (n - kind[4]) / max(1, len(words)), 1 - len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / len(lines), len(zlib.compress(data, 1)) / (n + 16),
    ]


def features(docs: DataFrame) -> DataFrame:
    """docs with features (array) instead of text; text is the last column."""
    keep = [f for f in docs.schema.fields if f.name != "text"]
    names = [f.name for f in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["features array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [surface(t.as_py()) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*names, "features"])

    return docs.select(*names, "text").mapInArrow(frugal(run), schema)


def fit(x: np.ndarray, y: np.ndarray, p: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Mean, scale, weights (of the features and their squares) and bias by ridge Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / scale, -5, 5)
    z = np.hstack([z, z * z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), p.ridge)
    penalty[-1] = 1e-6
    for _ in range(p.steps):
        g = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (g * (1 - g) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        w = w - np.linalg.solve(h, z.T @ (g - y) + penalty * w)
    return mean, scale, w[:-1], float(w[-1])


def _strength(spread: float, chance: float, expected: float) -> float:
    """The strength of a Gamma prior by moments: of squared differences between what is found and
    expected, what is beyond chance, against the squares of the expected."""
    return float(np.clip(expected / max(spread - chance, 1e-9), 1.0, 1e4))


def _evidence(model: list[tuple], fold: Column) -> Column:
    """The log-odds that the model of a row's fold gives its features."""
    out, k = F.lit(0.0), len(FEATURES)
    for f, (mean, scale, w, bias) in enumerate(model):
        logit = F.lit(bias)
        for j in range(k):
            z = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col("features")[j] - float(mean[j])) / float(scale[j])))
            logit = logit + z * float(w[j]) + z * z * float(w[k + j])
        out = F.when(fold == f, logit).otherwise(out)
    return out


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, p: QualityModel = QualityModel()) -> DataFrame:
    """doc_id, evidence (log-odds of the text), site_rate (posterior share of good documents of
    its site), score, kept of every row of docs (doc_id, host, path, text); labels (doc_id,
    quality).

    A label counts once per id: the mean of its labels. Null labels and ids are not learnt
    from. Null text: as the empty one. Null host or path: a site of its own. Sites without
    labels have their host's posterior, hosts without labels the global one. Repeated rows
    have equal results. No labels at all: evidence 0 and score 0.5. Empty table: no rows.
    Other columns are not read. Texts of any length are read whole.
    """
    scratch = Scratch(spark, "quality")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("i")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "host", "path", "text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(p.folds)).cast("int")
    rows = rows.withColumn("fold", fold).join(known, F.col("doc_id") == F.col("i"), "left").drop("i")
    rows = scratch.write(rows, "features")
    sample = rows.filter("y is not null").select("fold", "features", "y", F.xxhash64("doc_id", F.lit(3)).alias("h"), "doc_id").orderBy("h", "doc_id").limit(p.sample).toArrow()
    n = sample.num_rows
    if not n:
        return rows.select("doc_id", F.lit(0.0).alias("evidence"), F.lit(0.5).alias("site_rate"), F.lit(0.5).alias("score"), F.lit(True).alias("kept"))
    x = np.array(sample.column("features").to_pylist(), float).reshape(n, -1)
    y, at = np.array(sample.column("y").to_pylist(), float), np.array(sample.column("fold").to_pylist())
    whole = fit(x, y, p)
    model = [fit(x[at != f], y[at != f], p) if 0 < (at != f).sum() < n else whole for f in range(p.folds)]
    rows = rows.select("doc_id", "host", "path", "y", _evidence(model, F.col("fold")).alias("evidence"))
    rows = scratch.write(rows.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "evidence")
    scratch.drop("features")
    # Sites: labels, good ones, good ones expected, and their variance by chance.
    sums = [F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("s"), F.sum("p").alias("e"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v")]
    paths = scratch.write(rows.filter("y is not null").groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsev"])
    hosts = scratch.write(hosts.select(F.col("host").alias("h"), *[F.col(c).alias(f"h{c}") for c in "nsev"]), "hosts")
    total = hosts.agg(*[F.sum(f"h{c}") for c in "ns"], F.sum(F.pow(F.col("hs") - F.col("he"), 2)), F.sum("hv"), F.sum(F.pow("he", F.lit(2)))).first()
    rate, kh = (total[1] + 1) / (total[0] + 2), _strength(*total[2:])
    both = paths.join(small(hosts), F.col("host").eqNullSafe(F.col("h")))
    # Of paths against their own host: expected at the host's own ratio.
    here = F.col("e") * (F.col("hs") + kh) / (F.col("he") + kh)
    inner = both.agg(F.sum(F.pow(F.col("s") - here, 2)), F.sum(F.col("v") * (1 - F.col("e") / F.greatest("he", F.lit(1e-9)))), F.sum(F.pow(here, 2))).first()
    kp = _strength(*inner)
    at = rows.join(small(hosts), F.col("host").eqNullSafe(F.col("h")), "left")
    sites = paths.select(F.col("host").alias("ph"), F.col("path").alias("q"), *[F.col(c).alias(f"p{c}") for c in "nse"])
    at = at.join(small(scratch.write(sites, "sites")), F.col("host").eqNullSafe(F.col("ph")) & F.col("path").eqNullSafe(F.col("q")), "left")
    own = {"n": F.when(F.col("y").isNull(), 0.0).otherwise(1.0), "s": F.coalesce(F.col("y").cast("double"), F.lit(0.0)), "e": F.when(F.col("y").isNull(), 0.0).otherwise(F.col("p"))}
    left = {f"{level}{c}": F.greatest(F.coalesce(F.col(f"{level}{c}"), F.lit(0.0)) - own[c], F.lit(0.0)) for level in "hp" for c in "nse"}
    at = at.select("doc_id", "evidence", *[x.alias(k) for k, x in left.items()])

    def ratio(found: str, expected: Column, level_found: str, level_expected: Column) -> Column:
        host = (F.expr(level_found) + kh) / (level_expected + kh)
        return (F.expr(found) + F.lit(kp) * host) / (expected + kp)

    good = ratio("ps", F.col("pe"), "hs", F.col("he"))
    bad = ratio("pn - ps", F.greatest(F.expr("pn - pe"), F.lit(0.0)), "hn - hs", F.greatest(F.expr("hn - he"), F.lit(0.0)))
    host_rate = (F.col("hs") + F.lit(kh * rate)) / (F.col("hn") + kh)
    at = at.select("doc_id", "evidence", ((F.col("ps") + kp * host_rate) / (F.col("pn") + kp)).alias("site_rate"), (F.log(good) - F.log(bad)).alias("site"))
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(p.site) * F.col("site"))))
    return at.select("doc_id", "evidence", "site_rate", score.alias("score"), (score >= p.least).alias("kept"))


def document_sites(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) as rows to judge: host is the source, path the language."""
    return docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text")
