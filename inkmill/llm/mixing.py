"""Operator 4: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w, where u is a uniform number made of
its id and w its quality weight; the smallest keys of a source are a weighted sample
without replacement. A source takes all its documents as often as its target holds its
size (complete epochs); the rest of the target is filled in key order up to the word
budget, found by prefix sums over range-partitioned keys: no source meets in one task. The
document in which the budget ends is taken if that brings the source nearer to its target.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm._shared import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that running prose is not made of.
NOISE = "0123456789#$%&*@^_|~<>{}[]=+\\/"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column) -> Column:
    """A quality weight in [0.05, 1] of the text alone: the share of characters that are not
    NOISE, squared. It needs no join, so no text is shuffled for it."""
    n = F.length(text)
    share = F.length(F.translate(text, NOISE, "")) / F.greatest(n, F.lit(1))
    return F.coalesce(F.greatest(share * share, F.lit(0.05)), F.lit(0.05))


def row_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """Equal for rows of equal id and text only (a null id or text is one of its own)."""
    return F.xxhash64(doc_id.isNull(), doc_id, F.coalesce(text, F.lit("")), F.lit(seed))


def sampling_key(hash_: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the hash: the same in every run."""
    bits = F.shiftrightunsigned(hash_, 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most_epochs: float, share: float) -> DataFrame:
    """source, source_size -> and target. Sources in code point order (null last) weigh
    weights[0], weights[1], ..., repeating; together they get `share` of all sizes. A
    target stops at most_epochs times the source's size, and the excess goes to the others
    by weight until none is above: sorted by the ratio of cap to weight, the sources that
    stop are a prefix. One row per source of the mixture; these are configured, and few."""
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    level = (
        sizes.withColumn("rank", F.row_number().over(by_name) - 1)
        .withColumn("w", w)
        .withColumn("cap", F.col("source_size") * float(most_epochs))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(all_rows) * float(share))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.greatest(F.col("left"), F.lit(0.0)) / F.col("left_w")).over(all_rows))
    )
    return level.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def _keyed(docs: DataFrame, weight: Callable[[Column], Column], seed: int) -> list[Column]:
    doc_id, text = docs["doc_id"].cast("long"), docs["text"]
    hash_ = row_hash(doc_id, text, seed)
    return [docs["source"].alias("source"), sampling_key(hash_, weight(text)).alias("key"), hash_.alias("hash")]


def plan_mixture(
    spark: SparkSession, docs: DataFrame, scratch: Scratch, weights=(1.0, 2.0, 3.0), most_epochs: float = 3.0, share: float = 1.0, seed: int = 17,
    weight: Callable[[Column], Column] = text_quality,
) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, size, source, key, hash; plan: source, source_size, target, epochs,
    last_key, last_hash). A document of a source is taken `epochs` times, and once more if
    (key, hash) is not after (last_key, last_hash); these are null where none is."""
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), n_words(docs["text"]).alias("size"), *_keyed(docs, weight, seed))
    keyed = scratch.write(keyed, "keyed").repartitionByRange("source", "key", "hash").withColumn("part", F.spark_partition_id())
    keyed = scratch.write(keyed, "sorted")
    scratch.drop("keyed")
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size"), F.max(F.struct("key", "hash")).alias("top"))
    parts = scratch.write(parts, "parts")
    goals = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, most_epochs, share)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = scratch.write(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")
    # The part in which a source's budget ends; only that part is summed row by row.
    order = W.partitionBy("source").orderBy("part")
    base = parts.withColumn("base", F.sum("part_size").over(order) - F.col("part_size")).withColumn("before", F.lag("top").over(order))
    base = base.join(small(goals), parts["source"].eqNullSafe(goals["source"])).select(
        parts["source"].alias("s"), F.col("part").alias("p"), "base", "before", "rest", (F.col("base") + F.col("part_size")).alias("upto")
    )
    ends = scratch.write(base.filter("base <= rest and rest < upto").drop("upto"), "ends")
    # Rows of one key are taken together, and one word of the budget more or less is as near.
    inside = keyed.join(small(ends), keyed["source"].eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).groupBy("s", "base", "before", "rest", "key", "hash").agg(F.sum("size").alias("size"))
    inside = inside.withColumn("upto", F.col("base") + F.sum("size").over(W.partitionBy("s").orderBy("key", "hash")))
    taken = (F.col("upto") <= F.col("rest")) | (F.col("upto") - F.col("rest") <= F.col("rest") - (F.col("upto") - F.col("size")))
    last = inside.groupBy("s", "before").agg(F.max(F.when(taken, F.struct("key", "hash"))).alias("last"))
    last = scratch.write(last.select("s", F.coalesce("last", "before").alias("last")), "last")
    plan = goals.join(last, goals["source"].eqNullSafe(F.col("s")), "left")
    plan = plan.select("source", "source_size", "target", "epochs", F.col("last.key").alias("last_key"), F.col("last.hash").alias("last_hash"))
    return keyed, scratch.write(plan, "plan")


def _times() -> Column:
    """How often a row joined to its source's plan is taken."""
    more = F.struct("key", "hash") <= F.struct(F.col("last_key").alias("key"), F.col("last_hash").alias("hash"))
    return F.col("epochs") + F.when(F.col("last_key").isNotNull() & more, 1).otherwise(0)


def mixture_table(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source).

    Null text has size 0 and takes nothing; null source is a source, the last in order; null
    doc_id is an id of its own. Rows of one id and text share a key and are in or out
    together; unlike texts of one id have keys of their own. Equal keys are ordered by the
    rows' hash. Empty table: no rows. Sources of size 0: target 0. Reruns agree. Texts are
    read whole, whatever their length. Other columns are not read.
    """
    scratch = Scratch(spark, "mixing")
    keyed, plan = plan_mixture(spark, docs, scratch, **options)
    at = keyed.join(small(plan.withColumnRenamed("source", "s")), keyed["source"].eqNullSafe(F.col("s")))
    return at.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, seed: int = 17, weight: Callable[[Column], Column] = text_quality, **options) -> DataFrame:
    """The rows of docs as the mix takes them, repeated for every epoch; columns unchanged; see
    mixture_table() for nulls, ties and repeated rows. Each row's key is computed again from
    its text and id, so texts are never shuffled but for a plan too large to broadcast."""
    scratch = Scratch(spark, "mixing")
    _, plan = plan_mixture(spark, docs, scratch, seed=seed, weight=weight, **options)
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_keyed(docs, weight, seed))
    taken = inner.join(small(plan.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).withColumn("times", _times().cast("int"))
    return taken.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
