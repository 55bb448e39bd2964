"""Operator 6: MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles, a MinHash signature and band keys. Texts
   with equal sets are one class, known by a number of its own; only classes go on.
2. Classes that share a band key are candidates. In each shared bucket all members are
   paired with one pivot: pairs grow with the members, not with their square.
3. Signatures of candidates are compared batch by batch. With a uniform prior and m of n
   equal values, the similarity is Beta(m + 1, n - m + 1); a pair goes when the chance
   that it reaches the threshold falls below `miss`.
4. Survivors are verified on full sets: first each member's likeliest pair, then those
   whose ends are still in different components.
5. Buckets whose members are still in different components are searched whole: members
   meet in blocks, only across components: signatures first, then exactly, on full sets,
   those with a survivor. Pairs stay in numpy; what leaves a block is a forest of links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from inkmill.llm._shared import Scratch, frugal, small
from inkmill.llm.graph import connected_components


@dataclass(frozen=True)
class NearDuplicates:
    """words per shingle; percent of similarity; bands of rows; miss probability of the
    pruning per pair; values compared at a time; members of a block; members up to which
    buckets that share members are searched as one group."""

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    miss: float = 1e-7
    batch: int = 40
    block: int = 256
    group: int = 4096
    seed: int = 7


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of a text (UTF-8) as sorted 64-bit hashes. Words are lower-cased
    in A-Z and parted by ASCII white space, which is what bytes.lower() and split() do. Fewer
    words than `size`: the whole sequence is one shingle; no words: none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    return [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in column]


def _parameters(p: NearDuplicates) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(p.seed)
    n = p.bands * p.rows
    return r.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def _signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of len(a) values for each non-empty set; sets are joined in runs that fit the cache."""
    out = np.empty((len(sets), len(a)), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= 65_536):
            n += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *map(len, sets[i : j - 1])])
        for k in range(len(a)):
            out[i:j, k] = np.minimum.reduceat(x * a[k] + b[k], at)
        i = j
    return out


def _band_keys(sig: np.ndarray, p: NearDuplicates) -> np.ndarray:
    x = sig.reshape(len(sig), p.bands, p.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), x.shape[:2])
    for k in range(p.rows):
        key = _mix(key + x[:, :, k])
    return key.view(np.int64)


SIGNED = "doc_id long, text_key long, n_shingles long, set_key binary, sig binary, keys array<long>"


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: equal rows of one id have one text_key, unlike ones their own."""
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text")


def sign(docs: DataFrame, p: NearDuplicates) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (of equal sets), sig, keys (one per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _parameters(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = _sets(part.column(2), p.words)
                full = [s for s in sets if len(s)]
                sig = _signatures(full, a, b)
                keys = _band_keys(sig, p)
                rows = iter(range(len(full)))
                k = [next(rows) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0),
                    "text_key": part.column(1),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_key": pa.array([None if i is None else hashlib.blake2b(full[i].tobytes(), digest_size=16).digest() for i in k], pa.binary()),
                    "sig": pa.array([None if i is None else sig[i].tobytes() for i in k], pa.binary()),
                    "keys": pa.array([None if i is None else keys[i] for i in k], pa.list_(pa.int64())),
                })

    return _texts(docs).mapInArrow(frugal(run), SIGNED)


def least_matches(p: NearDuplicates) -> list[tuple[int, int]]:
    """(n, m): after n values, pairs with fewer than m equal ones are pruned. The chance that
    the similarity reaches t given m of n is P(Binomial(n + 1, t) <= m)."""
    t, total, out = p.percent / 100, p.bands * p.rows, []
    for n in [*range(p.batch, total, p.batch), total]:
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if chance >= p.miss:
                break
            m += 1
        out.append((n, m))
    return out


def _survive(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs (rows of x and y) that no batch prunes, and their equal values."""
    live, equal, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, m in steps:
        equal = equal + (x[live, done:n] == y[live, done:n]).sum(1)
        live, equal, done = live[equal >= m], equal[equal >= m], n
    return live, equal


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


def prune(pairs: DataFrame, signatures: DataFrame, p: NearDuplicates) -> DataFrame:
    """pairs (member, pivot) -> those that survive, with the number of equal values."""
    steps, width = least_matches(p), p.bands * p.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                live, equal = _survive(_rows(part.column(2), width), _rows(part.column(3), width), steps)
                kept = pa.array(live)
                yield pa.RecordBatch.from_pydict({"member": part.column(0).take(kept), "pivot": part.column(1).take(kept), "equal": pa.array(equal, pa.int64())})

    x, y = (signatures.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}")) for k in ("ix", "iy"))
    both = pairs.join(x, F.col("member") == F.col("ix")).join(y, F.col("pivot") == F.col("iy"))
    return both.select("member", "pivot", "sig_ix", "sig_iy").mapInArrow(frugal(run), "member long, pivot long, equal long")


def set_table(docs: DataFrame, ids: DataFrame, p: NearDuplicates) -> DataFrame:
    """id, shingles (sorted hashes as bytes) of the classes in ids (id, least_id, least_key), read
    from the text of one of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [s.tobytes() for s in _sets(part.column(1), p.words)]
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "shingles": pa.array(sets, pa.binary())})

    same = F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_key") == F.col("least_key"))
    sets = _texts(docs).join(small(ids), same).select("id", "text").mapInArrow(frugal(run), "id long, shingles binary")
    # A row that is repeated gives its set again.
    return sets.groupBy("id").agg(F.first("shingles").alias("shingles"))


def exact_links(pairs: DataFrame, sets: DataFrame, p: NearDuplicates) -> DataFrame:
    """Of pairs (member, pivot), links (a, b) with 100 * intersection >= percent * union on full sets."""
    percent = p.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common and 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict({"a": batch.column(0).take(kept), "b": batch.column(1).take(kept)})

    x, y = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in ("ix", "iy"))
    both = pairs.join(x, F.col("member") == F.col("ix")).join(y, F.col("pivot") == F.col("iy"))
    return both.select("member", "pivot", "set_ix", "set_iy").mapInArrow(frugal(run), "a long, b long")


def _with_component(df: DataFrame, key: str, parts: DataFrame, name: str) -> DataFrame:
    """df with the component of column key, or key itself if it is linked with nothing; parts is a written table."""
    parts = small(parts).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return df.join(parts, F.col(key) == F.col("_n"), "left").withColumn(name, F.coalesce("_c", key)).drop("_n", "_c")


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    both = _with_component(_with_component(pairs, "member", parts, "c1"), "pivot", parts, "c2")
    return both.filter("c1 <> c2").select("member", "pivot")


def _named(ids: DataFrame, reps: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """id, least_id, least_key: where the texts of the classes in ids (id) are found."""
    ids = scratch.write(ids.distinct().withColumnRenamed("id", "i"), f"{name}-distinct")
    return scratch.write(reps.select("id", "least_id", "least_key").join(small(ids), F.col("id") == F.col("i"), "left_semi"), name)


def _verify(docs: DataFrame, survivors: DataFrame, reps: DataFrame, scratch: Scratch, name: str, p: NearDuplicates) -> DataFrame:
    """The links among the survivors, but for such as join what others join already."""
    ends = survivors.select(F.col("member").alias("id")).unionByName(survivors.select(F.col("pivot").alias("id")))
    sets = scratch.write(set_table(docs, _named(ends, reps, scratch, f"{name}-ids"), p), f"{name}-sets")
    # Each member's likeliest pivot; of equals the smallest.
    rank = F.col("equal") * F.lit(1 << 40) + F.pmod(F.xxhash64("pivot"), F.lit(1 << 40))
    ranked = survivors.withColumn("rank", rank)
    top = ranked.groupBy(F.col("member").alias("m")).agg(F.max("rank").alias("r"))
    ranked = scratch.write(ranked.join(top, (F.col("member") == F.col("m")), "left").withColumn("first", F.col("rank") == F.col("r")).select("member", "pivot", "first"), f"{name}-ranked")
    found = exact_links(ranked.filter("first").select("member", "pivot"), sets, p)
    found = scratch.write(found, f"{name}-links-1")
    parts = scratch.write(connected_components(found, scratch, f"{name}-cc"), f"{name}-parts")
    rest = scratch.write(_across(ranked.filter("not first"), parts), f"{name}-rest")
    if rest.limit(1).count():
        found = scratch.write(found.unionByName(exact_links(rest, sets, p)), f"{name}-links-2")
    return found


def _partners(table: pa.Table, p: NearDuplicates, steps: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """Of a group of members (side, id, component, sig): the position of each left member and
    of the right members in other components that no batch of signature values prunes."""
    side, ids, comp = (table.column(k).to_numpy() for k in ("side", "id", "component"))
    width = p.bands * p.rows
    sig = _rows(table.column("sig").combine_chunks(), width)
    right = np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1):
        to = right[(comp[right] != comp[i]) & (ids[right] != ids[i]) & ((side[i] == 0) | (ids[right] > ids[i]))]
        if len(to):
            live, _ = _survive(np.broadcast_to(sig[i], (len(to), width)), sig[to], steps)
            if len(live):
                yield i, to[live]


_GROUP = ("kind", "grp", "bi", "bj")


def _close_members(members: DataFrame, p: NearDuplicates) -> DataFrame:
    """members (kind, grp, bi, bj, side, id, component, sig) -> those, without sig, that have a
    partner across components in their group; no pairs leave the group."""
    steps = least_matches(p)
    names = [*_GROUP, "side", "id", "component"]

    def run(table: pa.Table) -> pa.Table:
        close = np.zeros(table.num_rows, bool)
        for i, to in _partners(table, p, steps):
            close[i] = close[to] = True
        return table.select(names).filter(pa.array(close))

    return members.groupBy(*_GROUP).applyInArrow(run, "kind int, grp long, bi int, bj int, side int, id long, component long")


def _group_links(members: DataFrame, p: NearDuplicates) -> DataFrame:
    """members (kind, grp, bi, bj, side, id, component, sig, shingles) -> links (a, b), exactly
    verified on full sets, that join what was apart: fewer than the group has members."""
    steps, percent = least_matches(p), p.percent

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        _, place = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.append(0, np.cumsum(size))
        root = {int(c): int(c) for c in table.column("component").to_numpy()}
        comp = [int(c) for c in table.column("component").to_numpy()]
        flag = np.zeros(int(place.max()) + 1, bool)

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x] = root[root[x]]
            return x

        out = []
        for i, to in _partners(table, p, steps):
            own = place[ends[i] : ends[i + 1]]
            flag[own] = True
            for j in to:
                x, y = find(comp[i]), find(comp[j])
                if x != y:
                    common = int(flag[place[ends[j] : ends[j + 1]]].sum())
                    if 100 * common >= percent * (int(size[i]) + int(size[j]) - common):
                        root[max(x, y)] = min(x, y)
                        out.append((int(ids[i]), int(ids[j])))
            flag[own] = False
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return members.groupBy(*_GROUP).applyInArrow(run, "a long, b long")


def _groups(crowd: DataFrame, scratch: Scratch, p: NearDuplicates) -> DataFrame:
    """crowd (bucket, id, pivot, component) -> members (kind, grp, id, component, n) of groups
    that hold every pair that shares a bucket. Buckets that share members are one group of
    kind 0, so a document is dealt once however many bands it is in; where such a group
    grows beyond p.group members, its buckets stay groups of kind 1."""
    edges = crowd.select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    nodes = scratch.write(connected_components(edges, scratch, "cc-groups"), "groups")
    sizes = nodes.groupBy(F.col("component").alias("g")).agg(F.count("*").alias("n"))
    at = nodes.select(F.col("node").alias("_n"), F.col("component").alias("grp")).join(sizes, F.col("grp") == F.col("g")).drop("g")
    at = scratch.write(at, "group-sizes")
    own = crowd.select("id", "component").distinct().join(at, F.col("id") == F.col("_n")).filter(F.col("n") <= p.group)
    big = at.filter(F.col("n") > p.group).select("_n")
    rest = crowd.join(big, F.col("id") == F.col("_n"), "left_semi")
    count = rest.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("m"))
    rest = rest.join(count, F.col("bucket") == F.col("b")).select(F.lit(1).alias("kind"), F.col("bucket").alias("grp"), "id", "component", F.col("m").alias("n"))
    return own.select(F.lit(0).alias("kind"), "grp", "id", "component", "n").unionByName(rest)


def _blocks(members: DataFrame, p: NearDuplicates) -> DataFrame:
    """members with bi, bj, side: each is dealt to its own block of about p.block members
    (side 2) and, as left (0) or right (1), to those with every other block of its group."""
    rows = members.withColumn("m", F.ceil(F.col("n") / p.block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return rows.select(
        "kind", "grp", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "id", "component",
    )


def _resolve(spark: SparkSession, docs: DataFrame, p: NearDuplicates, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(every row of docs: doc_id, text_key, n_shingles, set_key; every class: k, its set_key, and
    of its component the smallest id, least_id, with the class, keeper, and the text,
    keeper_key, of a row that has it). Null ids come after all others."""
    signed = scratch.write(sign(docs, p), "signed")
    full = signed.filter("n_shingles > 0")
    # Equal sets have equal signatures, so any will do; a large class meets in aggregates only.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("one")
    reps = full.groupBy("set_key").agg(first, F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    reps = reps.select(F.monotonically_increasing_id().alias("id"), "set_key", F.col("one.doc_id").alias("least_id"), F.col("one.text_key").alias("least_key"), "sig", "keys")
    reps = scratch.write(reps, "reps")

    banded = reps.select("id", F.explode("keys").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("n > 1")
    buckets = scratch.write(buckets.select(F.col("bucket").alias("b"), "n", F.when(F.pmod("bucket", F.lit(2)) == 0, F.col("lo")).otherwise(F.col("hi")).alias("pivot")), "buckets")
    members = scratch.write(banded.join(buckets, F.col("bucket") == F.col("b")).select("bucket", "id", "n", "pivot"), "members")

    pairs = members.filter("id <> pivot").select(F.col("id").alias("member"), "pivot").distinct()
    survivors = scratch.write(prune(pairs, reps, p), "survivors-1")
    links = _verify(docs, survivors, reps, scratch, "star", p)
    parts = scratch.write(connected_components(links, scratch, "cc-1"), "parts-1")

    # Buckets of three or more whose members are not all in one component.
    crowd = _with_component(members.filter("n > 2"), "id", parts, "component").select("bucket", "id", "n", "pivot", "component")
    crowd = scratch.write(crowd, "crowd")
    open_ = crowd.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    open_ = scratch.write(open_.select(F.col("bucket").alias("b")), "open")
    if open_.limit(1).count():
        crowd = scratch.write(crowd.join(open_, F.col("bucket") == F.col("b"), "left_semi"), "open-members")
        signature = reps.select(F.col("id").alias("i"), "sig")
        dealt = scratch.write(_blocks(_groups(crowd, scratch, p), p), "dealt")
        close = scratch.write(_close_members(dealt.join(signature, F.col("id") == F.col("i")).drop("i"), p), "close")
        ids = _named(close.select("id"), reps, scratch, "close-ids")
        if ids.limit(1).count():
            sets = scratch.write(set_table(docs, ids, p), "close-sets").select(F.col("id").alias("j"), "shingles")
            group = close.join(signature, F.col("id") == F.col("i")).drop("i").join(sets, F.col("id") == F.col("j")).drop("j")
            more = scratch.write(_group_links(group, p).distinct(), "close-links")
            links = links.unionByName(more)
            parts = scratch.write(connected_components(links, scratch, "cc-2"), "parts-2")

    # Of each component the class with the smallest id; classes alone are their own.
    one = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "least_key", "id")
    linked = reps.select(one.alias("one")).join(small(parts), F.col("one.id") == F.col("node"))
    least = scratch.write(linked.groupBy(F.col("component").alias("c")).agg(F.min("one").alias("least")), "least")
    own = _with_component(reps.select("set_key", "id", one.alias("one")), "id", parts, "component")
    at = own.join(small(least), F.col("component") == F.col("c"), "left").select(F.col("set_key").alias("k"), "id", F.coalesce("least", "one").alias("one"))
    classes = at.select("k", "id", F.col("one.least_id").alias("least_id"), F.col("one.id").alias("keeper"), F.col("one.least_key").alias("keeper_key"))
    classes = scratch.write(classes, "classes")
    scratch.drop("reps", "members", "star-sets", "close-sets", "crowd", "open-members", "dealt", "close")
    return signed.select("doc_id", "text_key", "n_shingles", "set_key"), classes


def near_duplicates(spark: SparkSession, docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Null or empty texts: no shingles, linked with nothing. Rows of one doc_id with unlike
    texts stand each for itself; with equal texts they share a class and have one result.
    Null doc_id: linked like others; where its component has an id it is not kept, else its
    component_id is null and it is kept. Empty table: no rows. Other columns are not read.
    """
    rows, classes = _resolve(spark, docs, p, Scratch(spark, "near-duplicates"))
    joined = rows.join(classes, F.col("set_key") == F.col("k"), "left")
    component = F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """docs with one row of each component of near_duplicates(): one with the smallest doc_id,
    null ids last; of rows with that id the one with the smallest text hash, and of repeated
    rows one. Each row is judged for itself: a row whose id a dropped one shares stays. Null
    and empty texts all stay. Empty table: no rows. Columns unchanged."""
    scratch = Scratch(spark, "kept")
    rows, classes = _resolve(spark, docs, p, scratch)
    judged = rows.join(classes, F.col("set_key") == F.col("k"))
    keeps = (F.col("id") == F.col("keeper")) & F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("text_key") == F.col("keeper_key"))
    each = judged.groupBy("doc_id", "text_key").agg(F.max(keeps).alias("keeps"), F.count("*").alias("n"))
    each = scratch.write(each.filter("not keeps or n > 1").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "keeps"), "judged")
    gone = small(each.select("_d", "_t"))
    left = docs.join(gone, _same_row(docs, gone), "left_anti")
    if not each.filter("keeps").limit(1).count():
        return left
    repeated = small(each.filter("keeps").select("_d", "_t"))
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.join(repeated, _same_row(docs, repeated)).groupBy(repeated["_d"], repeated["_t"])
    return left.union(rows.agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*"))


def _same_row(docs: DataFrame, keys: DataFrame) -> Column:
    """Whether a row of docs has the id and text that a row of keys (_d, _t) names."""
    return docs["doc_id"].cast("long").eqNullSafe(keys["_d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == keys["_t"])
