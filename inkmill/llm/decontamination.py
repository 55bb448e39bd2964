"""Operator 3: benchmark decontamination by a positional inverted index (DataFrame and SQL only).

The index holds one posting (row, position, term) for every occurrence, in the corpus, of a
term that some test window has, and an end marker per row whose position is the number of
its words. Texts are read once. A window is searched from its rarest terms, its anchors:
their postings, moved back by the term's offset in the window, are starts. Per row and window
one pass over the sorted starts finds where the lists of all anchors meet: at one place
(candidates for a phrase) or within `slop` words of it (a proximity match). Candidates are
compared over all terms by counting, per candidate, the window's terms that have a posting at
their place. No list of a term or of a row is ever gathered: postings, starts and candidates
stay rows, so the work is linear in them, and a long text is spread over its positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm._shared import Scratch, lower_ascii, small

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = ""


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


@dataclass
class Windows:
    """window: wid, n, tids (terms in order), items (sorted). term: tid, term."""

    window: DataFrame
    term: DataFrame


def build_windows(benchmark: DataFrame, scratch: Scratch, size: int = 13) -> Windows:
    """The distinct windows of benchmark (item_id, text): `size` consecutive words, or the
    whole of an item with fewer words. Null or wordless items have none; items with null id
    are left out, as no result could name them; repeated items count once."""
    item = benchmark.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = item.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("w"))
    each = scratch.write(each.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    term = each.select(F.explode("w").alias("term")).distinct().select("term", (F.monotonically_increasing_id() + 1).alias("tid"))
    term = scratch.write(term.unionByName(scratch.spark.createDataFrame([(END, 0)], "term string, tid long")), "terms")
    placed = each.select("wid", F.posexplode("w").alias("off", "t")).join(term, F.col("t") == F.col("term"))
    tids = placed.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("off", "tid"))).alias("a"))
    tids = tids.select(F.col("wid").alias("v"), F.transform("a", lambda x: x["tid"]).alias("tids"))
    window = each.join(tids, F.col("wid") == F.col("v")).select("wid", F.size("tids").alias("n"), "tids", "items")
    return Windows(scratch.write(window, "window-terms"), term)


def build_index(docs: DataFrame, windows: Windows, scratch: Scratch) -> DataFrame:
    """rid, pos, tid: one posting per occurrence of a window's term; and per row of docs one
    with tid 0 at the position after its last word, which alone has doc_id and text_key (the
    hash of the text). rid numbers the rows of docs, so rows that repeat an id stay apart."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), _text_key(F.col("text")).alias("text_key"),
        F.concat(words(F.col("text")), F.array(F.lit(END))).alias("words"),
    ).select("rid", "doc_id", "text_key", F.posexplode("words").alias("pos", "word"))
    hit = rows.join(small(windows.term), F.col("word") == F.col("term"))
    last = F.col("tid") == 0
    return scratch.write(hit.select("rid", "pos", "tid", F.when(last, F.col("doc_id")).alias("doc_id"), F.when(last, F.col("text_key")).alias("text_key")), "index")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def anchors(index: DataFrame, windows: Windows, scratch: Scratch, most: int) -> DataFrame:
    """wid, rank, off, tid, ranks: for each window its `most` rarest distinct terms by the
    number of postings, rank 1 the rarest (of equally rare ones the first by code point), at
    every offset at which the window has them. A window with a term that the corpus lacks has none."""
    count = index.groupBy("tid").agg(F.count("*").alias("postings"))
    count = count.join(windows.term.select(F.col("tid").alias("i"), "term"), F.col("tid") == F.col("i")).drop("i")
    count = scratch.write(count, "counts")
    placed = windows.window.select("wid", F.posexplode("tids").alias("off", "t"))
    placed = placed.groupBy("wid", "t").agg(F.collect_list("off").alias("offs")).join(count, F.col("t") == F.col("tid"), "left")
    by = W.partitionBy("wid")
    ranked = placed.withColumn("none", F.max(F.col("postings").isNull()).over(by)).withColumn("rank", F.row_number().over(by.orderBy("postings", "term")))
    ranked = ranked.filter(~F.col("none") & (F.col("rank") <= most)).withColumn("ranks", F.max("rank").over(by))
    return scratch.write(ranked.select("wid", "rank", F.explode("offs").alias("off"), "tid", "ranks"), "anchors")


def meetings(index: DataFrame, anchor: DataFrame, slop: int) -> DataFrame:
    """rid, wid, start, exact, near: the starts of each window's rarest term, and whether the
    lists of all its anchors meet there, or have each a start within slop words of it."""
    key = anchor.select("wid", F.expr("shiftleft(1, rank - 1)").alias("bit"), "off", F.col("tid").alias("t"), F.expr("shiftleft(1, ranks) - 1").alias("mask"))
    at = index.filter("tid > 0").join(small(key), F.col("tid") == F.col("t")).select("rid", "wid", (F.col("pos") - F.col("off")).alias("start"), "bit", "mask")
    by = W.partitionBy("rid", "wid").orderBy("start")
    seen = lambda w: F.bit_or("bit").over(w) == F.col("mask")
    at = at.withColumn("exact", seen(by.rangeBetween(0, 0))).withColumn("near", seen(by.rangeBetween(-slop, slop)))
    return at.filter("bit = 1 and near").select("rid", "wid", "start", "exact", "near")


def phrase_matches(met: DataFrame, index: DataFrame, windows: Windows, scratch: Scratch) -> DataFrame:
    """rid, wid, start, n: every occurrence of every window."""
    one = windows.window.select(F.col("wid").alias("v"), "n", "tids")
    candidate = met.filter("exact and start >= 0").select("rid", "wid", "start").distinct()
    asked = candidate.join(small(one), F.col("wid") == F.col("v")).select("rid", "wid", "start", "n", F.posexplode("tids").alias("off", "t"))
    asked = asked.select("rid", "wid", "start", "n", (F.col("start") + F.col("off")).alias("p"), "t")
    ids = scratch.write(candidate.select(F.col("rid").alias("r")).distinct(), "candidate-rows")
    posting = index.filter("tid > 0").join(small(ids), F.col("rid") == F.col("r"), "left_semi").select(F.col("rid").alias("q"), "pos", "tid")
    there = asked.join(posting, (F.col("rid") == F.col("q")) & (F.col("p") == F.col("pos")) & (F.col("t") == F.col("tid")))
    return there.groupBy("rid", "wid", "start", "n").agg(F.count("*").alias("found")).filter("found = n").drop("found")


def words_hit(found: DataFrame) -> DataFrame:
    """r, n_hit of found (rid, start, n): the words in the union of a row's spans."""
    ends = found.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("n")).alias("upto"))
    before = F.max("upto").over(W.partitionBy("rid").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    new = F.col("upto") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))
    return ends.withColumn("new", F.greatest(new, F.lit(0))).groupBy(F.col("rid").alias("r")).agg(F.sum("new").cast("long").alias("n_hit"))


def _items(rows: DataFrame, windows: Windows, name: str) -> DataFrame:
    """q, name: per row the items of its windows, sorted as strings; as many as the benchmark has at most."""
    item = windows.window.select(F.col("wid").alias("v"), F.explode("items").alias("item"))
    each = rows.select("rid", "wid").distinct().join(small(item), F.col("wid") == F.col("v"))
    return each.groupBy(F.col("rid").alias("q")).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias(name))


def _contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int, least_share: float, slop: int | None) -> DataFrame:
    """contamination() with text_key; without proximity matches where slop is None."""
    scratch = Scratch(spark, "decontamination")
    windows = build_windows(benchmark, scratch, size)
    index = build_index(docs, windows, scratch)
    met = scratch.write(meetings(index, anchors(index, windows, scratch, 3), slop or 0), "met")
    found = scratch.write(phrase_matches(met, index, windows, scratch), "found")
    hits = words_hit(found).join(_items(found, windows, "items"), F.col("r") == F.col("q")).drop("q")
    hits = scratch.write(hits, "hits")
    end = index.filter("tid = 0").select("rid", "doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    out = end.join(hits, F.col("rid") == F.col("r"), "left")
    if slop is None:
        out = out.withColumn("near", F.lit(None).cast("array<string>"))
    else:
        near = scratch.write(_items(met, windows, "near"), "near")
        out = out.join(near, F.col("rid") == F.col("q"), "left")
    none = F.array().cast("array<string>")
    n_hit, items, near = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", none), F.coalesce("near", none)
    share = n_hit * F.lit(round(1 / least_share)) >= F.col("n_words")
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        ((n_hit > 0) & share).alias("contaminated"), F.size(near).cast("long").alias("n_near"), near.alias("near"), "text_key",
    )


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 13, least_share: float = 0.05, slop: int = 8) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated, n_near, near of
    every row of docs (doc_id, text): n_hit words lie in an occurrence of a window of benchmark
    (item_id, text), and a row is contaminated if they are at least least_share of its words.
    near are the items of windows whose up to three rarest terms are all found, each within
    slop words of its place as the rarest one gives it; every phrase match is one.

    Null or wordless text: no words, not contaminated. Null doc_id: a row like others. Rows
    that repeat an id are told apart. Empty docs: no rows; empty benchmark: no hits. Other
    columns are not read. A row's items are gathered; they are items of the benchmark.
    """
    return _contamination(spark, docs, benchmark, size, least_share, slop).drop("text_key")


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """docs without its contaminated rows, each judged by its own text: rows with null id go
    too, and clean rows that share an id with a contaminated one stay. Repeated rows share
    their verdict. Empty tables as in contamination(). Columns unchanged."""
    scratch = Scratch(spark, "contaminated")
    gone = _contamination(spark, docs, benchmark, size, 0.05, None).filter("contaminated")
    gone = scratch.write(gone.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct(), "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_d"]) & (_text_key(docs["text"]) == gone["_t"])
    return docs.join(small(gone), same, "left_anti")
