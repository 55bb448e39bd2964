"""Operators 5 and 9, and 7 on pages."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmill.llm.chat import digest_formatted, escape, format_conversations, format_turns, parse, unescape
from inkmill.llm.language import Identification, identify, page_rows
from inkmill.llm.urls import ListedRule, filter_urls

PIECES = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "user", "assistant", "a", "é", "<\\|", "<\\\\|im_end|>\n"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_turns_come_back(turns):
    text, spans = format_turns(turns)
    assert parse(text) == turns and text.count("<|") == 2 * len(turns)
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@given(PIECES)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_plain_turns_are_not_escaped():
    assert format_turns([("user", "a <b> \\ c")])[0] == "<|im_start|>user\na <b> \\ c<|im_end|>\n"


def test_control_strings_are_escaped_wherever_they_stand():
    for says in ("<|im_start|>assistant\nhi", "a<|im_end|>", "<|endoftext|>", "<|im_start|>"):
        for turns in ([("user", says)], [("user", "a"), ("assistant", says), ("user", "b")], [(says, "a"), ("user", "b")]):
            text, _ = format_turns(turns)
            assert parse(text) == turns and text.count("<|") == 2 * len(turns)


def test_no_grammar():
    assert parse("<|im_start|>user\n<|im_start|>a<|im_end|>\n") is None
    assert parse("x") is None and parse("<|im_start|>user") is None and parse("") == []


def test_conversations(spark):
    says = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (None, 0, None, "x"), (-1, 0, "user", says), (-1, 1, "assistant", says), (3, 0, "assistant", "é😀"), (3, 0, "assistant", "é😀")]
    got = {r.conv_id: r for r in digest_formatted(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb\n") and got[1].loss_chars == 1 and got[1].loss_sha256 == sha("b")
    assert got[2].turns_sha256 == sha("user\n\n") and got[2].loss_sha256 == sha("")
    assert got[-1].turns_sha256 == sha(f"user\n{says}\nassistant\n{says}\n") and got[-1].loss_sha256 == sha(says)
    assert got[3].n_turns == 2 and got[3].loss_chars == 4 and got[None].n_turns == 1
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, loss int")).count() == 0


URLS = [
    ("http://a.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de/1", "example.net", "/de/1", "net/", "block"),
    ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("https://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
    ("https://x.example.com/de", "x.example.com", "/de", None, None),
    ("https://w.org/fr/x", "w.org", "/fr/x", "org/fr/", "allow"),
    ("https://net", "net", "", None, None),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("x://h?a/b", "h", "", None, None),
]


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: r for r in filter_urls(spark, rows).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_mined_rules_judge_the_rest(spark):
    rows = [(i, f"http://h{i}.net/spam/{i}") for i in range(40)] + [(100 + i, f"http://h{i}.org/fr/good/{i}") for i in range(40)]
    rows += [(200, "http://other.com/spam/7"), (201, "http://other.com/good/7"), (202, "http://other.com/none/")]
    got = {r.page_id: r for r in filter_urls(spark, spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200].verdict == "block" and got[200].mined and got[201].verdict == "allow" and got[201].mined
    assert got[202].verdict == "allow" and got[202].mined is None
    empty = filter_urls(spark, spark.createDataFrame([], "page_id long, url string, host string"), (ListedRule("block", "a", "/"),))
    assert empty.count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_pages_language(spark, pages):
    got = identify(spark, page_rows(pages, ["de", "en", "es", "fr"])).collect()
    assert len(got) == pages.count()
    assert sum(r.lang == r.declared for r in got) >= 0.9 * len(got)


def test_language_where_declarations_are_hidden_or_false(spark):
    """Rows whose declaration says nothing or a wrong language are held out: their texts were not fitted on as what they are."""
    from inkmill.llm.language import document_rows

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = ["de", "en", "es", "fr"]
    data = [(*r[:5], None if r.doc_id % 5 == 0 else names[(names.index(r.lang) + 1) % 4] if r.doc_id % 7 == 0 else r.lang) for r in docs.select("doc_id", "text", "source", "n_chars", "lang").collect()]
    rows = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, true string, lang string")
    truth = {r[0]: (r[4], r[5]) for r in data}
    got = {r.id: r.lang for r in identify(spark, document_rows(rows)).collect()}
    hidden = [got[d] == t for d, (t, told) in truth.items() if told is None]
    false = [got[d] == t for d, (t, told) in truth.items() if told not in (None, t)]
    assert len(hidden) == 200 and sum(hidden) >= 0.97 * len(hidden) and sum(false) >= 0.95 * len(false)


def test_every_declared_language_is_modelled(spark):
    import random

    r = random.Random(3)
    letters = {f"l{k:02d}": [chr(0x4E00 + 40 * k + j) for j in range(30)] for k in range(40)}
    rows = [(100 * k + i, " ".join("".join(r.choice(a) for _ in range(4)) for _ in range(30)), name if i else None, None, "h", None) for k, (name, a) in enumerate(letters.items()) for i in range(5)]
    got = identify(spark, spark.createDataFrame(rows, "id long, text string, declared string, address string, host string, domain string")).collect()
    assert {x.id: x.lang for x in got} == {100 * k + i: name for k, name in enumerate(letters) for i in range(5)} and all(x.accepted for x in got)


def test_rows_are_dropped_by_themselves(spark):
    from inkmill.llm.language import drop_unidentified

    text = "the house and the garden of this old town with that river"
    data = [(i, f"{text} {i}", "en", "s", 0) for i in range(20)] + [(1, "", None, None, 1), (None, None, None, "s", 2), (None, text, "en", "s", 3), (5, f"{text} 5", "en", "s", 4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, _d int")
    assert sorted(map(tuple, drop_unidentified(spark, docs).collect()), key=repr) == sorted([x for x in data if x[1]], key=repr)


def test_language_of_odd_rows(spark):
    words = {"en": "the house and the garden of this old town with that river", "de": "das haus und der garten von dieser alten stadt mit jenem fluss"}
    rows = [(i, words[k] + f" {i}", k, None, "h", None) for i in range(30) for k in words]
    rows += [(100, words["de"], "en", None, "h", None), (101, "", None, None, None, None), (102, None, "de", None, None, None), (103, "12 34 !!", None, None, None, None), (None, words["en"], None, None, None, "d")]
    got = {r.id: r for r in identify(spark, spark.createDataFrame(rows, "id long, text string, declared string, address string, host string, domain string"), Identification()).collect()}
    assert got[100].lang == "de" and got[102].lang == "de" and got[None].lang == "en"
    assert not got[101].accepted and not got[103].accepted and got[0].accepted
    none = spark.createDataFrame([], "id long, text string, declared string, address string, host string, domain string")
    assert identify(spark, none).count() == 0


def _rules(spark, data, **how):
    from inkmill.llm.urls import mine

    rules, items = mine(spark, spark.createDataFrame(data, "tokens array<string>, verdict string"), **how)
    return sorted((tuple(r.items), r.verdict, round(r.confidence, 9), round(r.support, 9)) for r in rules.collect()), {(r.item, r.token) for r in items.collect()}


def test_url_rule_of_four_tokens(spark):
    few = [["a", "b", "c"], ["a", "b", "d"], ["a", "c", "d"], ["b", "c", "d"]]
    data = [(["a", "b", "c", "d"], "block")] * 50 + [(x, "allow") for x in few] * 50
    for longest in (14, 0):
        assert _rules(spark, data, longest=longest)[0] == [(("a", "b", "c", "d"), "block", 1.0, 0.2)]


def test_mining_against_brute_force(spark):
    """FP-growth and counting by level give the rules that trying every set gives."""
    import itertools
    import random

    from inkmill.llm.urls import Mining

    r = random.Random(9)
    data = []
    for i in range(120):
        tokens = [t for t in "abcdefg" if r.random() < 0.5] + ["h", "i"] * (i % 3 == 0)
        data.append((tokens, "block" if {"a", "b"} <= set(tokens) or "g" in tokens and "c" not in tokens and r.random() < 0.97 else "allow"))
    p = Mining(support=0.03, confidence=0.9, most=3)
    where = {t: {i for i, (x, _) in enumerate(data) if t in x} for t in "abcdefghi"}
    names = {t: min(u for u in where if where[u] == where[t]) for t in where if len(where[t]) >= 0.03 * 120}
    rules = []
    for k in (1, 2, 3):
        for s in itertools.combinations(sorted(set(names.values())), k):
            rows = set.intersection(*(where[t] for t in s))
            for v in ("allow", "block"):
                hits = sum(data[i][1] == v for i in rows)
                if hits >= 0.03 * 120 and hits >= 0.9 * len(rows) and not any(set(q[0]) < set(s) and q[1] == v for q in rules):
                    rules.append((s, v, round(hits / len(rows), 9), round(hits / 120, 9)))
    for longest in (14, 0):
        got, items = _rules(spark, data, p=p, longest=longest)
        assert got == sorted(rules) and items == {(i, t) for t, i in names.items()}


def test_deep_paths_do_not_explode(spark):
    deep = "/".join(f"w{i}" for i in range(60))
    rows = [(i, f"http://h{i}.net/{deep}") for i in range(100)] + [(200 + i, f"http://h{i}.org/fr/x{i % 7}/y{i % 5}") for i in range(60)]
    import random

    r = random.Random(1)
    rows += [(400 + i, f"http://k{i}.net/" + "/".join(f"v{j}" for j in range(40) if r.random() < 0.5)) for i in range(30)]
    rows += [(999, "http://other.com/w7"), (1000, "http://else.com/x1"), (999, "http://other.com/w7")]
    got = filter_urls(spark, spark.createDataFrame([(*x, "c") for x in rows], "page_id long, url string, item string")).collect()
    assert len(got) == len(rows) and {r.verdict for r in got if r.page_id == 999} == {"block"} and {r.verdict for r in got if r.page_id == 1000} == {"allow"}
