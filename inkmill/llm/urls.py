"""Operator 9: URL filters by association rules.

Listed rules (a host with its subdomains, a path prefix) judge the URLs they fit. The URLs
so labelled are the examples from which FP-growth mines combinations of URL tokens that go
with a verdict; combinations of enough support and confidence, of which no part says the
same, judge the rest. Mined rules are an inverted index from token to rule: a rule holds
where as many of its items are found as it has.

Tokens that occur in exactly the same labelled URLs are one item, found where any of them is:
they say the same, and a deep path that is repeated is then one item and not 2^tokens sets.
Rules have up to `most` items. FP-growth finds all frequent sets, so it is taken where no URL
has more than LONGEST items; beyond, the same rules are counted level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkmill.llm._shared import Scratch, lower_ascii, small


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The listed rules of the query.
RULES = (
    ListedRule("block", "net", "/"),
    ListedRule("allow", "example.net", "/en/"),
    ListedRule("block", "example.com", "/de/"),
    ListedRule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Mining:
    """Least support (share of the labelled URLs) and least confidence of a rule, and its most items."""

    support: float = 0.005
    confidence: float = 0.95
    most: int = 4


#: Most items of a URL for FP-growth, which may look at 2^LONGEST sets of them.
LONGEST = 14


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from
    there up to "?", "#" or the end. Null or no "://": both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def listed_rule(host: Column, path: Column, rules: tuple[ListedRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest listed rule that fits, else null; of equally long ones
    the first by name."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, F.lit(r.name)) if name is None else name.when(fits, F.lit(r.name))
        verdict = F.when(fits, F.lit(r.verdict)) if verdict is None else verdict.when(fits, F.lit(r.verdict))
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels (h:), the host's last two labels (d:) and words of the path (p:);
    numbers are one token."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    words = F.filter(F.split(lower_ascii(path), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda x: x != "")
    parts = F.transform(words, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))
    return F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), F.array(F.concat(F.lit("d:"), domain)), parts))


def _items(labelled: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """item, token: the tokens of at least `least` labelled rows; those of the same rows share an
    item, their first by code point. Rows are compared by two sums over their hashes."""
    each = labelled.select("row", F.explode("tokens").alias("token"))
    hashed = F.xxhash64("row", F.lit(41))
    same = each.groupBy("token").agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("row", F.lit(43))).alias("x"))
    by = W.partitionBy("n", "s", "x")
    return scratch.write(same.filter(F.col("n") >= least).select(F.min("token").over(by).alias("item"), "token"), "items")


def _frequent_sets(rows: DataFrame, least: float, p: Mining) -> DataFrame:
    """items (array), verdict, n (rows with the items), hits (of them with the verdict), by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    baskets = rows.select(F.array_append("items", F.concat(F.lit("="), F.col("verdict"))).alias("basket"))
    total = rows.count()
    model = FPGrowth(itemsCol="basket", minSupport=p.support, minConfidence=p.confidence, numPartitions=parts).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    hits = F.round(F.col("support") * total).cast("long")
    return rules.filter(F.size("antecedent") <= p.most).select(
        F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], 2, 99).alias("verdict"), F.round(hits / F.col("confidence")).cast("long").alias("n"), hits.alias("hits")
    ).filter(F.col("hits") >= least)


def _counted_sets(rows: DataFrame, least: float, p: Mining, scratch: Scratch) -> DataFrame:
    """What _frequent_sets() returns, but for sets of which a part says the same: level by level,
    the frequent sets of one more item are counted. A set goes on only if its last item took
    rows away and if its rows have more than one verdict; else longer ones say the same."""
    found = None
    at = rows.select("row", "verdict", "items", F.array().cast("array<string>").alias("set"), F.lit(1 << 62).alias("n"))
    for k in range(1, p.most + 1):
        last = F.coalesce(F.element_at("set", -1), F.lit("")) if k > 1 else F.lit("")
        longer = at.select("row", "verdict", "items", F.col("set").alias("part"), F.col("n").alias("m"), F.explode(F.filter("items", lambda x: x > last)).alias("x"))
        longer = longer.select("row", "verdict", "items", F.array_append("part", F.col("x")).alias("set"), "m")
        longer = scratch.write(longer, f"level-{k}")
        count = longer.groupBy("set", "verdict").agg(F.count("*").alias("hits"), F.min("m").alias("m"))
        by = W.partitionBy("set")
        count = count.select("set", "verdict", "hits", "m", F.sum("hits").over(by).alias("n")).filter((F.col("n") >= least) & (F.col("n") < F.col("m")))
        count = scratch.write(count, f"counts-{k}")
        found = count if found is None else found.unionByName(count)
        open_ = scratch.write(count.filter("hits < n").select(F.col("set").alias("s"), F.col("n").alias("k")).distinct(), f"open-{k}")
        at = longer.join(small(open_), F.col("set") == F.col("s")).select("row", "verdict", "items", "set", F.col("k").alias("n"))
    return found.filter((F.col("hits") >= least) & (F.col("hits") >= p.confidence * F.col("n"))).select(F.col("set").alias("items"), "verdict", "n", "hits")


def mine(spark: SparkSession, labelled: DataFrame, p: Mining = Mining(), longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """labelled (tokens, verdict) -> rules (rid, items, verdict, confidence, support) and the
    items' tokens (item, token). A rule goes if a part of its items already gives its verdict.
    Every labelled row is read; what is kept are sets above the least support, whose number
    does not grow with the rows. No labelled rows: no rules."""
    scratch = Scratch(spark, "rules")
    labelled = scratch.write(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "verdict"), "labelled")
    total = labelled.count()
    if not total:
        return spark.createDataFrame([], "rid long, items array<string>, verdict string, confidence double, support double"), spark.createDataFrame([], "item string, token string")
    least = max(1.0, p.support * total)
    items = _items(labelled, least, scratch)
    each = labelled.select("row", F.explode("tokens").alias("t")).join(small(items), F.col("t") == F.col("token")).groupBy(F.col("row").alias("r")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = scratch.write(labelled.select("row", "verdict").join(each, F.col("row") == F.col("r")).select("row", "verdict", "items"), "baskets")
    most = rows.agg(F.max(F.size("items"))).first()[0] or 0
    sets = _frequent_sets(rows, least, p) if most <= longest else _counted_sets(rows, least, p, scratch)
    rules = sets.select("items", "verdict", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / total).alias("support"))
    rules = scratch.write(rules.withColumn("rid", F.monotonically_increasing_id()), "all")
    # A part of fewer items is found through one of the rule's own.
    big, part = rules.select("rid", "verdict", "items", F.explode("items").alias("t")), rules.select(F.col("verdict").alias("v"), F.col("items").alias("few"), F.explode("items").alias("u"))
    same = (F.col("t") == F.col("u")) & (F.col("verdict") == F.col("v")) & (F.size("few") < F.size("items"))
    longer = big.join(part, same).filter(F.size(F.array_intersect("few", "items")) == F.size("few")).select(F.col("rid").alias("r")).distinct()
    return rules.join(longer, F.col("rid") == F.col("r"), "left_anti").select("rid", "items", "verdict", "confidence", "support"), items


def filter_urls(spark: SparkSession, pages: DataFrame, rules: tuple[ListedRule, ...] = RULES, p: Mining = Mining(), otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (items of the mined rule that judged, else
    null) and confidence of every row of pages (page_id, url).

    The listed rule's verdict stands; else that of the mined rule with the highest confidence,
    then support, then the smallest items; else `otherwise`. Urls of any length and number of
    tokens are read whole. Null urls and such without
    "://" have an empty host and path and no tokens. Null or repeated page_id: rows like
    others. Empty table: no rows. Other columns are not read.
    """
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"))
    rows = scratch.write(rows, "rows")
    token = tokens(F.col("host"), F.col("path"))
    rules_, items = mine(spark, rows.filter("rule is not null and host <> ''").select(token.alias("tokens"), F.col("listed").alias("verdict")), p)
    mined = scratch.write(rules_, "mined")
    index = mined.select("rid", F.size("items").alias("size"), F.explode("items").alias("u")).join(items, F.col("u") == F.col("item")).select("rid", "size", "item", "token")
    index = scratch.write(index, "index")
    open_ = rows.filter("rule is null and host <> ''").select("row", F.explode(token).alias("t"))
    hit = open_.join(small(index), F.col("t") == F.col("token")).select("row", "rid", "size", "item").distinct()
    hit = hit.groupBy("row", "rid", "size").agg(F.count("*").alias("n")).filter("n = size")
    body = small(mined.select(F.col("rid").alias("r"), "items", "verdict", "confidence", "support"))
    best = hit.join(body, F.col("rid") == F.col("r")).groupBy(F.col("row").alias("k")).agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.array_join("items", " ").alias("mined"), "verdict")).alias("best")
    )
    return rows.join(best, F.col("row") == F.col("k"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "best.verdict", F.lit(otherwise)).alias("verdict"),
        F.col("best.mined").alias("mined"), (-F.col("best.c")).alias("confidence"),
    )
