"""Operators 1, 3, 4, 6, 8 against brute force, and 2 and 10 on held-out rows."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkmill.llm import queries as q
from inkmill.llm.decontamination import contamination, drop_contaminated
from inkmill.llm.fingerprints import changed_paragraphs, edited_fingerprints, fingerprints, sections_of
from inkmill.llm.graph import connected_components
from inkmill.llm.mixing import mix, mixture_table, plan_mixture
from inkmill.llm.near_duplicates import NearDuplicates, drop_near_duplicates, near_duplicates
from inkmill.llm._shared import Scratch
from inkmill.llm.tokens import encoder, read_part, token_file_digests, write_token_files
from inkmill.llm.toxicity import fit as fit_toxic
from inkmill.llm.toxicity import PositiveUnlabelled
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f"), (2, None), (3, ""), (4, "a b c d e f"), (5, "A  b\tc\nd e f"), (6, "é" * 3000), (None, "x y"), (7, "one")]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, data, more=""):
    return spark.createDataFrame(data, "doc_id long, text string" + more)


# --- 1 ----------------------------------------------------------------------------------
def test_token_files(spark, docs):
    assert rows(q.op1_token_files(spark, SF)) == sorted(brute.token_files(docs, q.tokenizer_path()))


def test_token_files_of_odd_rows(spark):
    got = token_file_digests(spark, table(spark, [(*r, 1) for r in [*ODD, (4, "z")]], ", start int"), q.tokenizer_path())
    assert sorted(got.collect(), key=repr) == sorted(brute.token_files([*ODD, (4, "z")], q.tokenizer_path()), key=repr)
    assert token_file_digests(spark, table(spark, []), q.tokenizer_path()).count() == 0


def test_token_files_wide_ids(spark, tmp_path):
    """A vocabulary past 65536 with the end id is written in four bytes."""
    files = write_token_files(table(spark, ODD[:4]), f"file://{tmp_path}/t", q.tokenizer_path(), end_id=70_000)
    assert files.width == 4
    ids = np.concatenate([ids for p, base, _, _ in files.parts for _, _, ids in read_part(files.folder, p, base)])
    assert (ids == 70_000).sum() == 4


def test_encoder_of_all_texts():
    """Every text of sf0.1, and long ones of mixed scripts, as the library encodes them whole."""
    import duckdb
    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(q.tokenizer_path()), encoder(q.tokenizer_path(), 2, most=5000), random.Random(6)
    texts = [x or "" for (x,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()]
    parts = [r.choice(texts)[:400] for _ in range(40)] + ["Ωμέγα σς ΣΑΣ", "данные И текст", "漢字かな交じり文", "مرحبا بالعالم", "हिन्दी पाठ", "ก็ดี", "e\u0301a\u0308 ﬁ ǅ", "👩‍👩‍👧 🇩🇪", "<|endoftext|>", "\u200b\u00a0\u3000 \x85", "İstanbul ẞ"]
    texts += [r.choice([" ", "\n", ""]).join(r.choice(parts) for _ in range(r.randint(1, 120))) for _ in range(120)]
    for at in range(0, len(texts), 500):
        for x, want in zip(texts[at : at + 500], t.encode_batch(texts[at : at + 500], add_special_tokens=False)):
            assert np.frombuffer(e(x), "<u2").tolist() == want.ids


def test_encoder_of_odd_texts():
    from tokenizers import Tokenizer

    t, e, r = Tokenizer.from_file(q.tokenizer_path()), encoder(q.tokenizer_path(), 2, most=50), random.Random(3)
    letters = "abXY'smtdrevl0123  \n\t.,<|>éÉßİŉΣσς²½ªº×́ 　\x1c\x85\x0b_-€漢🎉ﬁǅ"
    for i in range(1500):
        x = "".join(r.choice(letters) for _ in range(r.randint(0, 30))) + " <|endoftext|>a" * (i % 7 == 0)
        assert list(np.frombuffer(e(x), "<u2")) == t.encode(x, add_special_tokens=False).ids


# --- 3 ----------------------------------------------------------------------------------
def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows(q.op3_decontamination(spark, SF).drop("n_near")) == sorted(brute.contamination(docs, items))


def test_decontamination_of_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (2, "short item"), (2, "short item"), (3, None), (4, "!!"), (None, "never named"), (10, passage)]
    data = [(1, passage), (1, "free text"), (2, f"x {passage.upper()} y " + "z " * 500), (3, None), (4, "a short, item here"), (None, passage), (5, "w0 w1 w2"), (6, " ".join([passage] * 3))]
    got = contamination(spark, table(spark, [(*r, 0) for r in data], ", n_hit int"), spark.createDataFrame(items, "item_id long, text string"))
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute.contamination(data, items), key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in contamination(spark, table(spark, data), none).collect()} == {False}
    assert contamination(spark, table(spark, []), none).count() == 0
    left = drop_contaminated(spark, table(spark, data), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([data[1], data[2], data[3], data[6]], key=repr)


def test_proximity(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(13)]
    items = [(1, " ".join(words)), (2, "a b a c"), (3, "solo"), (4, "w3 missing"), (5, " ".join(r.choice("abcd") for _ in range(15)))]
    data = [(1, " ".join([*words[:6], "other", *words[6:]])), (2, "w0 " + "x " * 50 + "w12"), (3, " ".join(words)), (None, "a solo c"), (5, None)]
    data += [(10 + i, " ".join(r.choice([*"abcdxyz", *words]) for _ in range(r.randint(1, 60)))) for i in range(40)]
    for gap in range(6, 11):
        data.append((100 + gap, " ".join(["b", *["y"] * gap, "a", "c"])))
    for slop in (0, 2, 8):
        got = contamination(spark, table(spark, data), spark.createDataFrame(items, "item_id long, text string"), slop=slop)
        want = [(d, found) for (d, _), found in zip(data, brute.proximity(data, items, slop=slop))]
        assert sorted(((r.doc_id, r.near) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_decontamination_of_a_long_matching_text(spark):
    """A text of 300,000 words that is one occurrence after the other: linear work, no list of it."""
    words = [f"w{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "w3")], "item_id long, text string")
    got = contamination(spark, table(spark, [(1, " ".join(words * 15_000)), (2, "x " * 300_000)]), items).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.n_near) for r in got} == {1: (300_000, 300_000, 2, 2), 2: (300_000, 0, 0, 0)}


# --- 4 ----------------------------------------------------------------------------------
def _check_mix(spark, df, got):
    """Sizes, targets and, from the sampling keys, what is taken, in plain Python."""
    keyed, _ = plan_mixture(spark, df, Scratch(spark, "t"))
    by = {}
    for r in keyed.collect():
        by.setdefault(r.source, []).append(r)
    want = brute.targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    expected = []
    for s, rs in by.items():
        total = sum(r.size for r in rs)
        left = want[s] - want[s] // max(total, 1) * total
        once, at = set(), 0
        for k in sorted({(r.key, r.hash) for r in rs}):
            size = sum(r.size for r in rs if (r.key, r.hash) == k)
            if at + size <= left or at + size - left <= left - at:
                once.add(k)
            at += size
            if at > left:
                break
        expected += [(r.doc_id, r.size, total, round(want[s], 6), r.size * int(want[s] // max(total, 1) + ((r.key, r.hash) in once))) for r in rs]
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r.taken <= 3 * r.size for r in got)
    return want


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = q.op4_mixing(spark, SF).collect()
    assert rows(q.op4_mixing(spark, SF)) == sorted(map(tuple, got))
    want = _check_mix(spark, docs, got)
    source, taken = {r.doc_id: r.source for r in docs.collect()}, {}
    for r in got:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - want[s]) <= largest / 2 for s in want)
    mixed = {r[0]: r[1] for r in mix(spark, docs).groupBy("doc_id").count().collect()}
    assert all(mixed.get(r.doc_id, 0) * r.size == r.taken for r in got if r.size)


def test_mixing_of_odd_rows(spark):
    data = [(i, f"{i} w " * (i % 5), s) for i, s in enumerate(["a", "b", None, "c", "ä"] * 8)] + [(100, None, "a"), (101, "x\x0by", "only"), (102, "", "empty")]
    data += [(None, f"no id {i}", "a") for i in range(6)] + [(5, "unlike text", "a"), (103, "long " * 30_000, "b"), (6, "6 w ", "b"), (6, "6 w ", "b")]
    df = table(spark, [(*r, 1) for r in data], ", source string, target int")
    got = mixture_table(spark, df).collect()
    assert len(got) == len(data)
    _check_mix(spark, df, got)
    assert {r.doc_id: r.size for r in got}[101] == 2
    assert mixture_table(spark, table(spark, [], ", source string")).count() == 0
    assert set(mix(spark, df).columns) == set(df.columns)
    twice = mixture_table(spark, table(spark, [(1, "a b", "s"), (1, "a b", "s")], ", source string")).collect()
    assert [r.taken for r in twice] == [2, 2]


# --- 6 ----------------------------------------------------------------------------------
def test_near_duplicates(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(q.op6_near_duplicates(spark, sf)) == sorted(brute.near_duplicates(docs, 4))


def test_near_duplicates_crowd(spark):
    """Many near copies on either side of the threshold, in blocks smaller than their bucket."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    data = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(60)] = f"x{r.randrange(1000)}"
        data.append((i, " ".join(words)))
    data += [(1000 + i, t) for i, (_, t) in enumerate(data[:40])] + [(2000, ""), (2001, None), (2002, "a b"), (2003, "A B")]
    for group in (4096, 10):
        got = rows(near_duplicates(spark, table(spark, data), NearDuplicates(words=4, block=16, group=group)))
        assert got == sorted(brute.near_duplicates(data, 4))


def test_near_duplicates_of_odd_rows(spark):
    got = {r.doc_id: r for r in near_duplicates(spark, table(spark, [(*r, b"") for r in ODD], ", sig binary"), NearDuplicates(words=4)).collect()}
    assert {k: got[k].component_id for k in (1, 2, 3, 4, 5)} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    assert got[None].component_id is None and got[None].kept
    assert near_duplicates(spark, table(spark, [])).count() == 0
    assert {r.doc_id for r in drop_near_duplicates(spark, table(spark, ODD), NearDuplicates(words=4)).collect()} == {1, 2, 3, 6, 7, None}


def test_near_duplicates_are_dropped_by_row(spark):
    w, other = "a b c d e f g h", "one two three four five six seven"
    data = [(1, w, 0), (5, w, 1), (5, other, 2), (7, f"{other} ", 3), (None, w, 4), (None, "alone in the whole wide world", 5), (1, w, 0), (1, w, 6), (8, None, 7), (8, None, 7)]
    docs = table(spark, data, ", _d int")
    got = sorted(map(tuple, drop_near_duplicates(spark, docs).collect()), key=repr)
    assert got == sorted([(1, w, 0), (5, other, 2), (None, "alone in the whole wide world", 5), (8, None, 7), (8, None, 7)], key=repr)
    found = {(r.doc_id, r.n_shingles): r for r in near_duplicates(spark, docs).collect()}
    assert found[None, 4].component_id == 1 and not found[None, 4].kept and found[None, 2].kept and found[5, 3].kept and not found[5, 4].kept


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc"), "t").collect()}
    root = {i: i for i in range(300)}
    for _ in range(300):
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {i: root[i] for a, b in edges if a is not None and a != b for i in (a, b)}


# --- 8 ----------------------------------------------------------------------------------
def _edited(data):
    order = sorted(data, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        yield d, t, t[: len(t) - half] + nxt[:half], nxt


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_fingerprints(spark, docs, buckets):
    data = [*docs, (5000, None), (5001, "é😀\n" * 50), (-3, "x")]
    got = {r.doc_id: r for r in edited_fingerprints(spark, table(spark, data), buckets).collect()}
    for d, text, edited, nxt in _edited(data):
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, new, after = (brute.fingerprint(t) for t in (text, edited, nxt))
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (own, new)
        assert got[d].near_edited == pytest.approx(brute.likeness(own, new)) and got[d].near_next == pytest.approx(brute.likeness(own, after))
    long_ = [r for r in got.values() if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long_]) > 0.4 > np.mean([r.near_next for r in long_])


def test_fingerprints_of_odd_rows(spark):
    got = edited_fingerprints(spark, table(spark, [(1, "a"), (1, "b"), (None, "c"), (2, None)]), 2).collect()
    assert len(got) == 4 and edited_fingerprints(spark, table(spark, [])).count() == 0
    assert edited_fingerprints(spark, table(spark, [(9, "abcd")])).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_likeness_of_short_texts_is_exact():
    a, b = (brute.fingerprint(" ".join(f"Sentence {i}." for i in x)) for x in (range(40), range(20, 50)))
    assert brute.likeness(a, b) == pytest.approx(2 * 20 / 70, abs=0.03)


def test_fingerprints_are_small(spark):
    data = [(1, "\n" * 20_000), (2, "a\n" * 10_000), (3, "x" * 50_000), (4, "ab. " * 10_000), (5, "\n".join(f"line number {i}" for i in range(5000)))]
    got = fingerprints(table(spark, [(*x, b"") for x in data], ", _leaves binary")).collect()
    assert all(len(r.fingerprint) < len(r.text) / 2 + 1200 for r in got)


def test_edits_are_located(spark):
    lines = [f"this is line number {i} of the text, long enough to be a paragraph" for i in range(60)]
    cases = {
        "same": (lines, None),
        "changed": ([*lines[:40], "another line that is as long as the others are here", *lines[41:]], (40, 41, 41)),
        "inserted": ([*lines[:7], lines[30] + "!", *lines[7:]], (7, 7, 8)),
        "deleted": ([*lines[:50], *lines[51:]], (50, 51, 50)),
        "swapped": ([*lines[:10], lines[11], lines[10], *lines[12:]], (10, 12, 12)),
        "repeated": ([*lines[:20], lines[19], *lines[20:]], (20, 20, 21)),
        "empty": ([], (0, 60, 0)),
    }
    text = lambda x: "".join(y + "\n" for y in x)
    fp = {r.name: r.fingerprint for r in fingerprints(spark.createDataFrame([(k, text(x)) for k, (x, _) in cases.items()], "name string, text string")).collect()}
    for k, (x, where) in cases.items():
        both = spark.createDataFrame([(fp["same"], fp[k])], "a string, b string")
        r = both.select(changed_paragraphs(F.col("a"), F.col("b")).alias("c"), sections_of(F.col("b")).alias("s")).first()
        assert tuple(r.c) == (where or (None,) * 3), k
        assert sum(len(y.paragraphs) for y in r.s) == len(x) and (fp[k] == fp["same"]) == (k == "same")


# --- 2 and 10 ---------------------------------------------------------------------------
def _auc(pairs):
    ranked = sorted(pairs)
    pos = sum(y for _, y in ranked)
    return (sum(i for i, (_, y) in enumerate(ranked, 1) if y) - pos * (pos + 1) / 2) / (pos * (len(ranked) - pos))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = q.op10_toxicity(spark, sf).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert _auc([(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]) > 0.75


def test_toxicity_without_examples():
    assert not fit_toxic(np.ones((10, 2)), np.zeros(10, bool), 0.0, PositiveUnlabelled())[0].any()
    assert fit_toxic(np.empty((0, 0)), np.empty(0, bool), 0.1, PositiveUnlabelled())[1] == pytest.approx(np.log(0.1 / 0.9))


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, 1 if i % 3 == 0 else 0) for i in range(60)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    data = [(i, "vile words" if i % 3 == 0 else "kind words") for i in range(60)] + [(None, "vile"), (70, None), (71, ""), (72, "vile thing")]
    from inkmill.llm.toxicity import toxicity

    got = {r.doc_id: r for r in toxicity(spark, table(spark, [(*r, 0.0) for r in data], ", score double"), labels).collect()}
    assert got[72].score > 0.5 > got[70].score == got[71].score and not got[None].held_out
    assert toxicity(spark, table(spark, []), labels).count() == 0


def test_quality_of_rows_not_fitted_on(spark):
    """Evidence is out of fold and a row's own label is not in its site, so all labelled rows test."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = q.op2_quality(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and 0 < r.site_rate < 1 and r.kept == (r.score >= 0.5) for r in got)
    assert _auc([(r.score, labels[r.doc_id]) for r in got if r.doc_id in labels]) > 0.8


def test_quality_sites_against_brute_force(spark):
    """Sites of many and of few labels: posteriors from counts in plain Python."""
    from inkmill.llm.quality import quality

    r = random.Random(8)
    data, labels = [], []
    for i in range(400):
        host = f"h{min(int(r.expovariate(0.5)), 9)}"
        path = f"p{r.randrange(3)}"
        data.append((i, "word " * r.randint(1, 40) + "x" * r.randint(0, 5), host, path))
        good = r.random() < (0.9 if host in ("h0", "h3") else 0.2 if path == "p1" else 0.5)
        labels += [(i, int(good))] * (1 + i % 2) if i % 5 else []
    data += [(900, "word " * 9, "h0", "new"), (901, "word " * 9, "other", None), (902, None, None, None)]
    got = {x.doc_id: x for x in quality(spark, table(spark, [(*x, 0.0) for x in data], ", host string, path string, p double"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    y = dict(labels)
    p = {d: 1 / (1 + np.exp(-got[d].evidence)) for d, *_ in data}
    add = lambda key: {k: np.sum([(1, y[d], p[d], p[d] * (1 - p[d])) for d, _, *site in data if d in y and tuple(site[: len(k)]) == k], 0) for k in {tuple(site[:key]) for d, _, *site in data if d in y}}
    hosts, paths = add(1), add(2)
    strength = lambda a, b, c: float(np.clip(c / max(a - b, 1e-9), 1, 1e4))
    h = np.array(list(hosts.values()))
    kh = strength(((h[:, 1] - h[:, 2]) ** 2).sum(), h[:, 3].sum(), (h[:, 2] ** 2).sum())
    rate = (h[:, 1].sum() + 1) / (h[:, 0].sum() + 2)
    here = {k: v[2] * (hosts[k[:1]][1] + kh) / (hosts[k[:1]][2] + kh) for k, v in paths.items()}
    kp = strength(sum((v[1] - here[k]) ** 2 for k, v in paths.items()), sum(v[3] * (1 - v[2] / hosts[k[:1]][2]) for k, v in paths.items()), sum(x * x for x in here.values()))
    for d, _, *site in data:
        own = np.array((1, y[d], p[d], 0.0)) if d in y else np.zeros(4)
        hn, hs, he, _ = np.maximum(hosts.get(tuple(site[:1]), np.zeros(4)) - own, 0)
        pn, ps, pe, _ = np.maximum(paths.get(tuple(site), np.zeros(4)) - own, 0)
        good, bad = (ps + kp * (hs + kh) / (he + kh)) / (pe + kp), (pn - ps + kp * (hn - hs + kh) / (max(hn - he, 0) + kh)) / (max(pn - pe, 0) + kp)
        assert got[d].site_rate == pytest.approx((ps + kp * (hs + kh * rate) / (hn + kh)) / (pn + kp))
        assert got[d].score == pytest.approx(1 / (1 + np.exp(-(got[d].evidence + np.log(good / bad)))))
    assert got[901].site_rate == pytest.approx(rate) and got[900].site_rate > rate


def test_quality_of_odd_rows(spark):
    from inkmill.llm.quality import document_sites, quality

    docs = table(spark, [(*r, None, "s") for r in ODD], ", lang string, source string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (5, 1), (5, 0)], "doc_id long, quality int")
    assert quality(spark, document_sites(docs.union(docs)), labels).count() == 2 * len(ODD)
    assert {r.score for r in quality(spark, document_sites(docs), labels.limit(0)).collect()} == {0.5}
    assert quality(spark, document_sites(docs.limit(0)), labels).count() == 0


def test_toxicity_recall_of_each_language(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    known = docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    known = {r.doc_id: (r.lang, r.toxic) for r in known.collect() if r.toxic is not None}
    caught, wrong = {}, []
    for r in q.op10_toxicity(spark, sf).collect():
        if r.held_out and r.doc_id in known:
            lang, toxic = known[r.doc_id]
            caught.setdefault(lang, []).append(r.predicted) if toxic else wrong.append(r.predicted)
    shares = {lang: (sum(x), len(x)) for lang, x in caught.items()}
    assert set(shares) == {"de", "en", "es", "fr"} and sum(wrong) <= 0.02 * len(wrong), (shares, sum(wrong), len(wrong))
    assert all(hit >= 0.4 * n for hit, n in shares.values()), (shares, sum(wrong), len(wrong))


def test_toxicity_counts_the_whole_corpus(spark):
    from inkmill.llm.toxicity import corpus_counts, features

    data = [(i, "often" if i % 2 else "seldom") for i in range(20_200)] + [(None, "often")]
    learnt = [t for i, t in data if i is not None and zlib.crc32(str(i).encode()) % 5]
    n, rows = corpus_counts(table(spark, data))
    assert rows == len(learnt) > PositiveUnlabelled().unlabelled
    only = np.setdiff1d(*features(pa.array(["often", "seldom"])))
    assert len(only) and (n[only] == learnt.count("often")).all()
