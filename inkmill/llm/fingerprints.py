"""Operator 8: document fingerprints as Merkle trees (DataFrame and SQL only).

A text is cut into paragraphs: lines, of which short ones go together until they have more than
SHORT characters. A paragraph is cut into leaves: sentences, or of longer ones parts of up to
SHORT characters. A section is a run of paragraphs that ends where a paragraph's own hash says
so, after eight on average, so an edit moves no boundary but those beside it. A leaf's hash
is over its text, every other node's over its children's hashes: 64 bits of MD5 each, and
SHA-256 at the root. A fingerprint is

    root "|" section ":" paragraphs "|" section ":" paragraphs ... "|~" sketch

Equal roots mean equal texts, differing sections show where to look, and differing paragraphs
locate an edit. Leaves are not stored one by one: the sketch holds the SKETCH smallest of their
hashes, from which the likeness of two texts is told, exactly so if they have no more. So a
fingerprint takes 16 characters a paragraph, which is of more than SHORT, and a bounded rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHORT, SKETCH = 48, 64
PARAGRAPH = rf"(?s).{{1,{SHORT}}}[^\n]*\n?"
LEAF = rf"[^.!?\n]{{1,{SHORT}}}[.!?\n]*|[.!?\n]+"
#: Last hex digits of a paragraph after which a section ends.
LAST = ("0", "8")
LOWEST = -(1 << 63)


def _hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with one more column, the fingerprint of column text (null: as the empty text)."""
    whole = F.coalesce(df[text], F.lit(""))
    # One step a projection, so that no step is worked out twice; df's columns go along as one.
    df = df.select(F.struct(*[df[c] for c in df.columns]).alias("own"), F.regexp_extract_all(whole, F.lit(PARAGRAPH), F.lit(0)).alias("paragraphs"))
    leaves = F.transform("paragraphs", lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), _hash))
    df = df.select("own", leaves.alias("leaves"))
    df = df.select("own", F.slice(F.array_sort(F.array_distinct(F.flatten("leaves"))), 1, SKETCH).alias("sketch"), F.transform("leaves", lambda x: _hash(F.array_join(x, ""))).alias("nodes"))
    last = F.size("nodes")
    ends = F.filter(F.transform("nodes", lambda x, i: F.when(F.substring(x, -1, 1).isin(*LAST) | (i + 1 == last), i + 1)), lambda i: i.isNotNull())
    df = df.select("own", "sketch", "nodes", ends.alias("ends"))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))
    sections = F.transform("ends", lambda e, i: F.array_join(F.slice("nodes", before(i) + 1, e - before(i)), ""))
    df = df.select("own", "sketch", F.transform(sections, lambda s: F.struct(_hash(s).alias("h"), s.alias("s"))).alias("sections"))
    root = F.sha2(F.array_join(F.transform("sections", lambda s: s["h"]), ""), 256)
    body = F.transform("sections", lambda s: F.concat(s["h"], F.lit(":"), s["s"]))
    parts = F.concat(F.array(root), body, F.array(F.concat(F.lit("~"), F.array_join("sketch", ""))))
    return df.select("own.*", F.array_join(parts, "|").alias(name))


def _hashes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(".{16}"), F.lit(0))


def sketch_of(fp: Column) -> Column:
    return _hashes(F.substring_index(fp, "~", -1))


def sections_of(fp: Column) -> Column:
    """The sections of a fingerprint: array of (h, its hash, and paragraphs, theirs)."""
    parts = F.split(fp, r"\|")
    body = F.filter(parts, lambda x, i: (i > 0) & ~x.startswith("~"))
    return F.transform(body, lambda x: F.struct(F.substring(x, 1, 16).alias("h"), _hashes(F.substring(x, 18, 1 << 30)).alias("paragraphs")))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints' sketches: with J the share that both have of the smallest hashes of
    either, 2 J / (1 + J), which is what their leaves have in common over what they have on
    average. 1 if both are empty."""
    first = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    share = F.size(F.array_intersect(F.array_intersect(first, a), b)) / F.size(first)
    return F.when(F.size(first) == 0, F.lit(1.0)).otherwise(F.lit(2.0) * share / (share + 1))


def _leading(a: Column, b: Column) -> Column:
    """How many entries at the start of two arrays are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int")
    return F.when(at == 0, F.size(a)).otherwise(at - 1)


def changed_paragraphs(fp_a: Column, fp_b: Column) -> Column:
    """Where two texts differ: (start, end_a, end_b), zero-based paragraphs [start, end_a) of a
    that b has as [start, end_b): inserted ones have end_a = start, deleted ones end_b = start,
    swapped and repeated ones are within. Equal roots: start, end_a and end_b are null. Sections
    that are equal from the start on are not looked into."""
    a, b = sections_of(fp_a), sections_of(fp_b)
    names = lambda s: F.transform(s, lambda x: x["h"])
    inside = lambda s: F.flatten(F.transform(s, lambda x: x["paragraphs"]))
    skip = _leading(names(a), names(b))
    rest = lambda s: inside(F.slice(s, skip + 1, F.size(s)))
    start = F.size(inside(F.slice(a, 1, skip))) + _leading(rest(a), rest(b))
    tail = lambda s: F.reverse(F.slice(inside(s), start + 1, F.size(inside(s))))
    same = F.least(_leading(tail(a), tail(b)), F.size(tail(a)), F.size(tail(b)))
    equal = F.substring(fp_a, 1, 64) == F.substring(fp_b, 1, 64)
    at = lambda x: F.when(~equal, x)
    return F.struct(at(start).alias("start"), at(start + F.size(tail(a)) - same).alias("end_a"), at(start + F.size(tail(b)) - same).alias("end_b"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (text) with one more column, fingerprint, of the whole text. Null text: as the empty
    one, whose fingerprint has no sections. Any length; equal texts, repeated rows among them,
    have equal fingerprints; other columns stay as they are. Empty table: no rows."""
    return with_fingerprint(docs, "text", "fingerprint")


def _literal(numbers: list[int]) -> Column:
    """An array literal, however long: parsed once when the plan is folded."""
    return F.from_json(F.lit(str(numbers)), "array<bigint>")


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below key, by binary search in an array literal."""
    table, steps = _literal(bounds), [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def step(at: Column, by: Column) -> Column:
        to = F.least(at + by, F.lit(len(bounds)))
        return F.when((at + by <= len(bounds)) & (F.element_at(table, to) < key), at + by).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def with_next_text(spark: SparkSession, docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, next_text, fingerprint, next_fingerprint: with each row the text of the
    next document in descending doc_id order, after the last the first. Null text: empty; null doc_id: the smallest; rows of one id
    are ordered by text; a single row follows itself; empty table: no rows.

    The ids are cut at `buckets` of their own quantiles, which are few numbers. Each bucket
    is ordered for itself, and its first row is also sent to the bucket before it, where it
    follows the last: texts are shuffled once and no row waits for another bucket.
    """
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = with_fingerprint(keyed, "text", "fingerprint")
    cuts = [i / buckets for i in range(1, buckets + 1)]
    found = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key")).agg(F.percentile_approx("key", cuts, min(20 * buckets, 1_000_000)), F.max("key")).first()
    bounds = sorted({*(found[0] or []), found[1]} - {None}) or [0]
    # Bucket b holds the keys in (bounds[b - 1], bounds[b]], so bounds[b] is its first key in
    # descending order; it follows the last key of bucket b + 1, or of bucket 0 if b is the top.
    own = F.col("b")
    above = F.when(own + 1 < len(bounds), own + 1).otherwise(F.lit(0))
    home, guest = (F.struct(b.alias("b"), F.lit(g).alias("guest")) for b, g in ((own, False), (above, True)))
    first = F.element_at(_literal(bounds), own + 1) == F.col("key")
    sent = keyed.withColumn("b", _place(F.col("key"), bounds))
    sent = sent.withColumn("to", F.explode(F.when(first, F.array(home, guest)).otherwise(F.array(home))))
    sent = sent.select("key", "doc_id", "text", "fingerprint", "to.b", "to.guest")
    order = W.partitionBy("b").orderBy("guest", F.col("key").desc(), "text")
    sent = sent.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order))
    return sent.filter("not guest").select("doc_id", "text", "next_text", "fingerprint", "next_fingerprint")


def edited_fingerprints(spark: SparkSession, docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every row of docs (doc_id, text); see with_next_text() for nulls and ties.
    The edited text is the text with its last floor(n_chars / 2) characters replaced by the
    first as many (or all) of the next document. Other columns are not read."""
    rows = with_next_text(spark, docs, buckets).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half)
    edited = F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_fingerprint(rows.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("edited")), "edited", "edited_fingerprint")
    own = sketch_of(F.col("fingerprint"))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(own, sketch_of(F.col("edited_fingerprint"))).alias("near_edited"), likeness(own, sketch_of(F.col("next_fingerprint"))).alias("near_next"),
    )
