"""Text functions on literals."""

import pytest
from pyspark.sql import functions as F

from inkmill.functions import rules
from inkmill.functions import text as tx


@pytest.fixture(scope="module")
def one(spark):
    def run(f, *values):
        df = spark.createDataFrame([(i, *((v,) if not isinstance(v, tuple) else v)) for i, v in enumerate(values)], "i int, " + ", ".join(f"x{k} string" for k in range(len(values[0]) if isinstance(values[0], tuple) else 1)))
        names = [c for c in df.columns if c != "i"]
        return [r[0] for r in df.orderBy("i").select(f(*names).alias("r")).collect()]

    return run


CASES = [
    (tx.ustrip, " 　a b\n", "a b"),
    (tx.clean_line, "  a \t b c ", "a b c"),
    (tx.clean_extracted_text, "a\\nb\r\nc\r\r\n\n\nd  e•f", "a\nb\nc\nd e\n•f"),
    (tx.clean_extracted_text, "end.Next U.S.A.", "end.\nNext U.\nS.\nA."),
    (tx.collapse_spaced_letters, "C h a p t e r 1 : R a c e s", "Chapter 1 : Races"),
    (tx.collapse_spaced_letters, "H i l l D w a r f", "HillDwarf"),
    (tx.collapse_spaced_letters, "", ""),
    (tx.clean_content_line, "D u n g e o n s & Dragons", "Dungeons & Dragons"),
    (tx.clean_content_line, "play D & D", "play D&D"),
    (lambda x: tx.clean_content_line(x, join_lower=False), "of the  D u n g e o n", "of the Dungeon"),
    (tx.clean_content_line, "of the", "ofthe"),
    (tx.fix_spaced_words, "a D u n g e o n s day", "aDungeons day"),
    (tx.fix_common_terms, "D  &  D and dun geons & dra gons", "D&D and Dungeons & Dragons"),
    (tx.fix_common_terms, "Dungeons&Dragons", "Dungeons & Dragons"),
    (tx.fix_common_spacing, "you r m ore Doyou the se what ever it'sa x it'sabig som e ofcharacter often", "your more Do you these whatever it'sa x it's a big some of character of ten"),
    (tx.fix_run_together, "gowith", "go with"),
    (tx.clean_paragraph, "abc", "abc"),
    (lambda x: tx.clean_paragraph(x, "none"), "you r day", "you r day"),
    (lambda x: tx.clean_paragraph(x, "basic"), "you r day", "you r day"),
    (tx.clean_content_text, "D u n g e o n s", "Dun geo n s"),
    (tx.clean_content_text, "andcreate  it", "and create it"),
    (tx.clean_content_text, "theory", "the ory"),
    (tx.normalize_title, "C l a s s e s", "Classes"),
    (lambda x: tx.normalize_title(x, literal=True), "C l a s s e s", "Cl As Se S"),
    (tx.normalize_title, "Races....17", "Races"),
    (tx.normalize_title, "D&D rules", "D&d Rules"),
    (tx.normalize_title, "", "Untitled Section"),
    (tx.normalize_title, None, "Untitled Section"),
    (tx.normalize_title, "hillDwarf - sub-title", "Hill Dwarf Sub Title"),
    (tx.clean_filename, "my_file-o'neil.pdf", "My File O'Neil"),
    (tx.title_of_stem, "a_big book2x", "A Big Book2X"),
    (tx.anchor, "1. Hill Dwarf's Été", "1-hill-dwarfs-été"),
    (tx.page_number, "Races 17", 17),
    (tx.page_number, "Races", None),
    (tx.escape_yaml, "a*b[c]", r"a\*b\[c\]"),
    (tx.simple_tokens, "It's a Été_1, no.", ["it", "s", "a", "été_1", "no"]),
    (tx.word_tokens, "It's é!", ["It", "s", "é"]),
    (tx.word_and_gap_tokens, "It's  a.", ["It's", "  ", "a", "."]),
    (tx.join_split_words, "H ill D warf\ncat", "H ill D warfcat"),
    (tx.join_split_words, "A cat sat. I went to X ray.", "A cat sat. I went to X ray."),
    (tx.join_split_capitals, "A cat sat. I went to X ray.", "A cat sat. I went to X ray."),
    (tx.join_split_words, "A B c D and I  saw", "AB c D and I saw"),
    (tx.join_split_capitals, "A B C D", "ABCD"),
    (tx.clean_text, "to find o f it a n d t h e ex-\nam.... 4", "to find of it and the exam •  4"),
    (lambda x: tx.clean_text(x, bounded=False), "to find", "tofind"),
    (tx.has_spaced_text, "C h a p t e r 1", True),
    (tx.has_spaced_text, "R a c e s", True),
    (tx.has_spaced_text, "H i l l D w a r f", True),
    (tx.has_spaced_text, "Chapter 1: Races", False),
    (tx.is_chapter_title, "Chapter 1 : Races", True),
    (tx.is_chapter_title, "Chapter 1: Races 17", False),
    (tx.is_chapter_title, "Races.....17", False),
    (tx.is_chapter_title, "classes", True),
    (tx.is_chapter_title, "Step by Step Characters", True),
    (tx.is_subchapter_title, "H i l l D w a r f", True),
    (tx.is_subchapter_title, "hill dwarf", False),
    (tx.subchapter_title, "H i l l D w a r f", "Hill Dwarf"),
    (tx.looks_like_toc_entry, "Races.....", True),
    (tx.looks_like_toc_entry, "Races 7", True),
    (tx.is_appendix_heading, "The Glossary", True),
    (tx.is_appendix_heading, "Races", False),
    (tx.is_heading, "## a", True),
    (tx.is_heading, "### a", False),
    (tx.is_fence, "  ```py", True),
    (tx.is_scanned, " x ", True),
    (tx.is_sufficient, "x" * 100, True),
    (tx.is_sufficient, "x" * 100 + rules.SUFFICIENCY_MARKERS[0], False),
]


@pytest.mark.parametrize("f,given,want", CASES, ids=range(len(CASES)))
def test_case(one, f, given, want):
    assert one(f, given) == [want]


def _joined(text, line_end, p):
    """The letter joining done step by step: words of a match one space apart, single letters together."""
    import itertools
    import re

    def words(m):
        groups = itertools.groupby(m[0].split(), key=lambda w: len(w) == 1)
        return " ".join(x for single, ws in groups for x in (["".join(ws)] if single else ws))

    text = re.sub(r"([A-Za-z])\s*\n\s*([A-Za-z])", line_end, text)
    while (new := re.sub(p, words, text)) != text:
        text = new
    return text


def test_letters_are_joined_like_step_by_step(spark, one):
    import random

    r = random.Random(11)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["".join(r.choice("ABCDabc  \n\t.") for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts += ["A cat sat. I went to X ray.", "H i l l D w a r f", "C H A P T E R I", "A b c D e f G", "T he R aces of A B C\nD E f\n g", " ".join("ABcD" * 40)]
    for f, line_end, p in ((tx.join_split_capitals, r"\1 \2", tx._SPLIT_WORDS), (tx.join_split_words, r"\1\2", tx._SPLIT_WORDS_APART)):
        assert one(f, *texts) == [_joined(t, line_end, p) for t in texts]


def test_long_lines(one):
    whole = "Sentence one is here. " * 150
    parts = one(lambda x: tx.split_long_line(tx.ustrip(x)), whole)[0]
    assert len(parts) == 2 and all(len(p) <= 2000 for p in parts) and " ".join(parts) == whole.strip()
    assert one(tx.split_long_line, "x" * 2001) == [["x" * 2001]] and one(tx.split_long_line, "ab") == [["ab"]]
    assert one(lambda x: tx.split_long_line(x, 10), "aaaa. bbbb. cccc dddd eeee. f") == [["aaaa.", "bbbb.", "cccc dddd eeee.", "f"]]


def test_long_spaced_line_is_fused_to_the_end(one):
    import random
    import re

    def literal(y):
        while m := re.search(r"\b([A-Za-z])\s+([A-Za-z])\s+([A-Za-z])", y):
            y = y.replace(m[0], re.sub(r"\s+", "", m[0]))
        return y

    letters = random.Random(5)
    lines = [" ".join(letters.choice("QXZWVK") if upper else letters.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n, upper in ((400, True), (1200, False))]
    got = one(tx.clean_content_text, *lines)
    want = [literal(line) for line in lines]
    assert got[0] == want[0] and got[1].replace(" ", "") == want[1].replace(" ", "")
    assert not any(re.search(r"\b[A-Za-z]\s+[A-Za-z]\s+[A-Za-z]", y) for y in want)
    split = rf"\b({'|'.join(rules.SPLITTABLE_WORDS)})([a-z])"
    assert got[1].count(" ") <= want[1].count(" ") + sum(bool(re.match(split, w)) for w in want[1].split())


@pytest.mark.parametrize("line,before,want", [("and so", "It ended.", True), ("Next", "It ended.", False), (", x", "It ended.", True), ("Next", "sent to the", True), ("(x)", "no stop", True), ("", "x", False), ("Next", "no stop", False)])
def test_continuation(one, line, before, want):
    assert one(lambda a, b: tx.is_continuation(a, b, ignore_case=False), (line, before)) == [want]


def test_run_together_forms_agree(one):
    texts = ["gowith theother dayofthe Xandy", "éthe thethe  a1the", None, "because"]
    assert one(tx.run_together_fixer(), *texts) == one(tx.fix_run_together, *texts)


def test_idempotent(one):
    texts = ["  a  b\n\n\nc•d ", "x.Y z", "é  ü　"]
    for f in (tx.clean_line, tx.collapse_space, tx.clean_extracted_text):
        once = one(f, *texts)
        assert one(f, *once) == once


def test_null_stays_null(one):
    for f in (tx.clean_line, tx.clean_extracted_text, tx.clean_content_text, tx.anchor, tx.fix_common_spacing):
        assert one(f, None) == [None]


def test_rule_tables_compile():
    import re

    tables = (rules.SPACING_RULES, rules.WORD_JOIN_RULES, rules.PHRASE_RULES, rules.SPLIT_WORD_RULES, rules.JOINED_RULES)
    assert [len(t) for t in tables] == [35, 15, 13, 28, 14]
    assert len(rules.SPLIT_EXCEPTIONS) == 53
    for t in tables:
        for p, by, conf in t:
            assert re.compile(p).groups >= by.count("\\") and 0 < conf < 1
    assert F is not None
