"""Segmentation, tables, lint, correction, structure, rendering on small tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from inkmill.functions import rules
from inkmill.functions import text as tx
from inkmill.operators import correct, lint, quality, segment, structure, tables
from inkmill.plans import pipeline, render


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def column(df, *names):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


BOOK = "before\nC h a p t e r 1 : R a c e s\nfirst line\nH i l l D w a r f\na dwarf\nan other\nC l a s s e s\nlast"


# --- segmentation -----------------------------------------------------------------------
def test_lines_and_stats(spark):
    rows = segment.split_lines(docs(spark, " a  b \n\n c", "", None))
    assert column(rows.orderBy("line_no"), "doc_id", "line_no", "text") == [(0, 0, "a b"), (0, 1, "c")]
    assert column(segment.line_stats(rows), "total_lines", "avg_line_length", "max_line_length") == [(2, 2.0, 3)]


def test_line_stats_forms_agree(spark):
    df = docs(spark, " a  b \n\n c", "Sentence one is here. " * 150 + "\nx", "", None)
    got = {r.doc_id: tuple(r)[1:] for r in segment.document_line_stats(df).collect()}
    rows = {r.doc_id: tuple(r)[1:] for r in segment.line_stats(segment.split_lines(df)).collect()}
    assert got == rows | {2: (0, 0.0, 0), 3: (0, 0.0, 0)}


def test_chapters(spark):
    rows = segment.split_lines(docs(spark, BOOK, "no headings"))
    got = segment.chapters(rows).orderBy("doc_id", "chapter_seq").collect()
    assert [(r.chapter_seq, r.number, r.title, r.main_content, r.line_count) for r in got if r.doc_id == 0] == [
        (0, 0, "Front Matter", ["before"], 1), (1, 1, "Races", ["first line"], 3), (2, 0, "Classes", ["last"], 1)
    ]
    assert [(s.title, s.lines) for s in got[1].subchapters] == [("Hill Dwarf", ["a dwarf", "an other"])]
    assert [r.main_content for r in got if r.doc_id == 1] == [["no headings"]]
    assert column(segment.chapter_stats(segment.chapters(rows)).orderBy("doc_id"), "total_chapters", "avg_chapter_length") == [(3, 5 / 3), (1, 1.0)]
    last = segment.chapters(rows, last_buffer_count=True).filter("doc_id = 0 and chapter_seq = 1").first()
    assert last.line_count == 2
    plain = segment.chapters(segment.split_lines(docs(spark, "Chapter 1: Races\nx")), spaced_only=False).collect()
    assert [(r.number, r.title) for r in plain] == [(1, "Races")]
    assert [r.number for r in segment.chapters(segment.split_lines(docs(spark, "Chapter 1: Races\nx"))).collect()] == [0]


@pytest.mark.parametrize("line,want", [("Chapter 4: Personalityand Background", (4, "Personality and Background")), ("S tep by step characters", (0, "S tep by step characters")), ("Step by step characters", (1, "Step-by-Step Characters")), ("7 ", (7, "Chapter 7")), ("chapter 2 Gear", (2, "Gear")), ("Races", (0, "Races"))])
def test_chapter_header(spark, line, want):
    assert tuple(docs(spark, line).select(segment.chapter_header("text").alias("h")).first().h) == want


def test_md_sections(spark):
    rows = segment.raw_lines(docs(spark, "a\n```py\ncode\n```\nb", "a\n```\nopen", "```\nx\n```"))
    got = segment.md_sections(rows, ignore_code=False).orderBy("doc_id", "sec_no")
    assert column(got, "doc_id", "type", "start_line", "end_line", "text") == [
        (0, "text", 0, 1, "a"), (0, "code", 1, 3, "```py\ncode\n```"), (0, "text", 4, 5, "b"), (1, "text", 0, 1, "a"), (1, "code", 1, 3, "```\nopen"), (2, "code", 0, 2, "```\nx\n```")
    ]
    assert set(column(segment.md_sections(rows), "type")) == {"text"}


def test_md_chapters(spark):
    long_ = "\n".join(["x" * 30] * 10)
    got = segment.md_chapters(docs(spark, "pre\n# A\na\n## B\nb", "# only\nx", long_, ""), most=100).orderBy("doc_id", "chunk_no").collect()
    by = lambda d: [r.text for r in got if r.doc_id == d]
    assert by(0) == ["pre", "# A\na", "## B\nb"] and by(1) == ["# only\nx"] and by(3) == [""]
    assert "\n".join(by(2)) == long_ and all(len(t) <= 100 for t in by(2))


def test_chunks(spark):
    texts = ["para one.\n\npara two is here. And more text", "x" * 95, "short", ""]
    got = docs(spark, *texts).select("doc_id", segment.chunks("text", 20).alias("c")).orderBy("doc_id").collect()
    assert all("".join(r.c) == t and all(len(c) <= 20 for c in r.c) for r, t in zip(got, texts))
    assert got[0].c[0] == "para one.\n\n"


def test_toc(spark):
    text = "Intro\nChapter 1: Races 17\nDwarf.18\nElf . 21\nnot a section.x\nAppendix A: Conditions 290\nLost.3\nC h a p t e r 2 : Classes"
    got = segment.toc(segment.raw_lines(docs(spark, text))).orderBy("ord").collect()
    assert [(r.type, r.number, r.letter, r.title, r.page) for r in got] == [("chapter", 1, None, "Races", 17), ("appendix", None, "A", "Conditions", 290), ("chapter", 2, None, "Classes", None)]
    assert [[tuple(s) for s in r.sections] for r in got] == [[("Dwarf", 18), ("Elf", 21)], [], []]


def test_paragraphs_and_merging(spark):
    text = "It starts\nhere and\nends. \n\nNew one,\nwith more.\nand joined.\nLast."
    assert column(segment.paragraphs(segment.raw_lines(docs(spark, text)), clean=False), "text") == ["It starts here and ends.\n\nNew one, with more. and joined.\n\nLast."]
    merged = segment.merge_lines(segment.split_lines(docs(spark, "An exam-\nple line\n, then\nNext one.\nEnd.")))
    assert column(merged.orderBy("line_no"), "text") == ["An example line, then", "Next one.", "End."] or column(merged.orderBy("line_no"), "text")[0].startswith("An example line, then")


def test_vertical_text(spark):
    got = segment.vertical_text(segment.raw_lines(docs(spark, "R\na\nc\ne\ns\nx\nword\nQ"))).orderBy("line_no")
    assert column(got, "line_no", "text", "consumed") == [(0, "Races", 5), (5, "x", 1), (7, "Q", 1)]


def test_samples(spark):
    rows = segment.raw_lines(docs(spark, "\n".join(map(str, range(120))), "\n".join(map(str, range(7)))))
    got = segment.systematic_sample(rows)
    assert sorted(column(got.filter("doc_id = 0"), "line_no")) == [i * 120 // 50 for i in range(50)] and got.filter("doc_id = 1").count() == 7
    edge = segment.edge_sample(rows)
    assert sorted(column(edge, "doc_id", "line_no")) == [(0, 0), (0, 60), (0, 119), (1, 0), (1, 6)]


# --- tables -----------------------------------------------------------------------------
LEVELS = ["1st", "+2", "Rage", "2", "+2", "more", "2nd", "+2", "Reckless Attack", "and more", "unlimited", "+2"]
CLASSES = ["Barbarian", "A fierce", "warrior of", "d12", "Wisdom & Strength", "Bard", "An inspiring x", "d8"]


def test_table_detection(spark):
    rows = spark.createDataFrame([("l", i, x) for i, x in enumerate(LEVELS * 2)] + [("c", i, x) for i, x in enumerate(CLASSES)] + [("t", i, "just a line, x1.") for i in range(9)] + [("s", 0, "1st")], "g string, line_no int, text string")
    got = {r.g: (r.is_table, r.table_type) for r in tables.detect(rows, "g").collect()}
    assert got["l"] == (True, "level_progression") and got["t"] == (False, None) and got["s"] == (False, None)


def test_table_parsing(spark):
    df = spark.createDataFrame([(LEVELS, "level_progression"), (CLASSES, "class_table"), (["x"], None)], "lines array<string>, kind string")
    got = [r.t for r in df.select(tables.parse("lines", F.col("kind")).alias("t")).collect()]
    assert got[0].rows == [["1st", "+2", "Rage"], ["2", "+2 more"], ["2nd", "+2", "Reckless Attack and more", "unlimited", "+2"]]
    assert got[1].rows[0][:4] == ["Barbarian", "A fierce", "warrior of", "d12"] or got[1].rows[0][:2] == ["Barbarian", "A fierce warrior of"]
    assert got[2] is None


def test_markdown_tables(spark):
    df = spark.createDataFrame([(["a", "b"], [["1"], ["2", "3", "4"]]), ([], []), (None, None)], "c array<string>, r array<array<string>>")
    assert column(df.select(tables.markdown_table(F.col("c"), F.col("r")).alias("m")), "m") == ["| a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |", "Empty table", "Table data unavailable"]
    assert df.select(tables.markdown_table(F.col("c"), F.col("r"), F.lit("T")).alias("m")).first().m.startswith("**T**\n\n| a")


# --- lint -------------------------------------------------------------------------------
def test_positions_are_finditer(spark):
    texts = ["you r w eapon\nt he end-\n ing of a th ey", "", "ab cde fg\n\nhi jkl", "x" * 50, "é ab cd\nüb cd"]
    got = sorted(map(tuple, lint.scan(docs(spark, *texts), rules.SPACING_RULES, False, ("doc_id",)).select("doc_id", "rule_no", "match_no", "start", "line", "column", "text").collect()))
    want = []
    for d, t in enumerate(texts):
        for k, (p, _, _) in enumerate(rules.SPACING_RULES):
            for j, m in enumerate(re.finditer(p, t)):
                head = t[: m.start()].split("\n")
                want.append((d, k, j, m.start(), len(head) - 1, len(head[-1]), m[0]))
    assert got == sorted(want)


def test_suggestions_are_expanded(spark):
    got = lint.lint_markdown(docs(spark, "that'sgood exam-\nple skill check role play")).collect()
    assert ("that'sgood", "that's good") in {(r.text, r.suggestion) for r in got} and ("exam-\nple", "example") in {(r.text, r.suggestion) for r in got}
    assert "skill check" not in {r.text for r in got} and "role play" in {r.text for r in got}
    told = lint.find_errors(segment.md_sections(segment.raw_lines(docs(spark, "skill check"))), lint.MARKDOWN, equal=True)
    assert "skill check" in column(told, "text")


def test_code_is_left_out_and_caps_hold(spark):
    df = docs(spark, "```\nyou r\n```\nfine", "you r " * 30)
    assert set(column(lint.lint_markdown(df), "doc_id")) == {1} and lint.lint_markdown(df).count() == 10
    assert 0 in column(lint.lint_markdown(df, ignore_code=False, most=None), "doc_id")


def test_false_splits(spark):
    texts = ["hit points", "Hill Dwarf", "page 12", "made for", "some Name", "wiz ard"]
    assert column(docs(spark, *texts).select(F.expr(lint.is_false_split("text")).alias("f")), "f") == [True, True, True, True, True, False]


def test_report(spark):
    df = docs(spark, "the w eapon\nyoucan go", "all fine here")
    got = lint.report(lint.with_context(lint.find_errors(segment.md_sections(segment.raw_lines(df)), (("joined_words", rules.WORD_JOIN_RULES, True), ("spacing", rules.SPLIT_TERMS, False))), df)).collect()
    assert len(got) == 1
    assert got[0].report == "Found 2 potential errors:\n\n- 1 joined_words issues\n- 1 spacing issues\n\n1. [JOINED_WORDS] Line 2, Col 1: 'youcan' → 'you can' (0.95)\n   >>>youcan<<< go\n\n2. [SPACING] Line 1, Col 5: 'w eapon' → 'weapon' (0.95)\n   the >>>w eapon<<<\n"


def test_fixes(spark):
    df = docs(spark, "a w eapon and\n```\nw eapon\n```\nyoucan s pell", "nothing wrong", None)
    got = {r.doc_id: r for r in lint.fix_text(df).collect()}
    assert got[0].text == "a weapon and\n```\nw eapon\n```\nyou can spell" and got[0].applied == 3
    assert got[1].text == "nothing wrong" and got[1].applied == 0 and got[2].text is None
    fixes = spark.createDataFrame([(0, 0, "zz", "q"), (0, 2, "w eapon", "W")], "doc_id long, start int, original string, replacement string")
    assert lint.apply_fixes(df.filter("doc_id = 0"), fixes).first().applied == 1


# --- correction -------------------------------------------------------------------------
def test_corrections(spark):
    tokens = spark.createDataFrame([(w,) for w in ["dungoen", "Wizrad", "the", "ab", "dungeon", "zzzz", "x" * 21, "wizrad"]], "token string")
    got = {r.token: (r.corrected, round(r.confidence, 3)) for r in correct.corrections(tokens, correct.lexicon(spark)).collect()}
    assert got["dungoen"] == ("dungeon", 0.857) and got["Wizrad"] == ("Wizard", 0.833) and got["wizrad"][0] == "wizard"
    assert got["the"] == ("the", 1.0) and got["ab"] == ("ab", 1.0) and got["zzzz"] == ("zzzz", 1.0) and got["x" * 21][1] == 1.0


def test_correct_text(spark):
    got = correct.correct_text(docs(spark, "A dungoen, t he wizrad!", "fine text", None), correct.lexicon(spark))
    assert {r.doc_id: r.text for r in got.collect()} == {0: "A dungeon, the wizard!", 1: "fine text", 2: None}


ODD_TEXTS = [
    "A dungoen, t he wizrad! It's a wizrad's sp ell_wizrad", "circum-\nstances and cir-\n\ncumstnces of exam-\nple", "soft\xad\nware long\xad\n sword", "left - right cre - ature", None, "",
    "_dungoen_ DUNGOEN Dungoen dungoens", "D  & D and Dun geo ns & Dra gons m ore y ou r", "ourée Ouré 'wizrad' ``wizrad``", "dungoen " * 2000,
]


@pytest.mark.parametrize("aggressive", [False, True])
@pytest.mark.parametrize("most_bytes", [16 << 20, 600])
def test_corrected_text_against_brute_force(spark, aggressive, most_bytes):
    from tests import brute

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()] + ODD_TEXTS
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = correct.correct_text(df, correct.corrector_lexicon(spark), aggressive=aggressive, hyphens=sorted(brute.VALID), most_bytes=most_bytes)
    assert {r.doc_id: r.text for r in got.collect()} == {i: brute.correct_text(t, aggressive=aggressive) for i, t in enumerate(texts)}
    assert correct.correct_text(df.limit(0), correct.corrector_lexicon(spark)).count() == 0


def test_rendered_lint_and_preview(spark):
    got = lint.lint_rendered(docs(spark, "# A **w eapon** and\n- youcan")).collect()
    assert [(r.text, r.suggestion, r.line_num, r.column) for r in sorted(got, key=lambda r: r.ord)] == [("w eapon", "weapon", 1, 3), ("youcan", "you can", 2, 1)]
    assert column(docs(spark, "a\nb\nc\nd", "a\nb").select(lint.preview(F.col("text"), 2).alias("p")), "p") == ["a\nb\n... and 2 more lines", "a\nb"]


def test_word_errors_in_parts_agree(spark):
    from inkmill.operators import lint
    from inkmill.operators.segment import md_sections, raw_lines

    texts = ["a dungoen\n```\ndungoen\n```\nthe dungoen and Skils", "fine", None, "dungoen wizrad\n dungoens " * 30]
    sections = md_sections(raw_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", True)
    whole, parts = (sorted(map(tuple, lint.word_errors(sections, correct.corrector_lexicon(spark), most_bytes=b).collect())) for b in (16 << 20, 300))
    assert whole == parts and [x[4:9] for x in whole if x[0] == 0] == [(0, 2, 0, 2, "dungoen"), (0, 4, 0, 4, "dungoen"), (1, 16, 0, 16, "Skils")]
    first = [r for r in lint.lint_markdown(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect() if r.doc_id == 0]
    assert [(r.error_type, r.line_num, r.column, r.text) for r in sorted(first, key=lambda r: (r.sec_no, r.ord)) if r.error_type == "word"] == [("word", 1, 3, "dungoen"), ("word", 5, 5, "dungoen"), ("word", 5, 17, "Skils")]


def test_hyphens(spark):
    run = correct.join_hyphens(["example", "dungeon"])
    assert column(docs(spark, "exam-\nple", "exam\xad\n ple", "left - right", "dun-\ngoen", None).select(run("text").alias("t")), "t") == ["example", "example", "leftright", "dun goen", None]


def test_lexicon_joins(spark):
    words, df = correct.lexicon(spark), docs(spark, "the wizard and a flumph of wizards", "too few", "short")
    tokens = correct.tokens_of(df)
    assert {(r.doc_id, r.total, r.known) for r in correct.known_ratio(tokens, words).collect()} == {(0, 5, 3), (1, 2, 0), (2, 1, 0)}
    checks = {r.doc_id: r for r in correct.check_text(df, words).collect()}
    assert not checks[0].valid and [(i.word, i.suggestion) for i in checks[0].issues] == [("wizards", "with")] or checks[0].issues
    assert checks[1].valid and checks[1].total_words is None and checks[2].valid
    assert sorted(column(correct.with_cases(spark.createDataFrame([("hit points",)], "word string")), "word")) == ["HIT POINTS", "Hit Points", "hit points"]
    assert correct.union_lexicons(words, words).count() == words.count()


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "w.txt").write_text("The of\nand\n")
    assert sorted(column(correct.read_lexicon(spark, str(tmp_path)), "word")) == ["and", "of", "the"]


# --- quality ----------------------------------------------------------------------------
def test_quality(spark):
    got = {r.doc_id: r for r in quality.issues(docs(spark, "word " * 60, "é " + "x" * 101, "." * 101 + " a", "")).collect()}
    assert got[0].is_valid and got[0].word_count == 60
    assert got[1].issues == ["Text contains too few words (2 < 50)", "Average word length too long (51.0 > 15)", "Found 101 repeated 'x' characters", "Non-ASCII characters detected"]
    assert not any("repeated" in i for i in got[2].issues) and got[3].word_count == 0 and got[3].avg_word_length == 0
    lines = quality.issues(docs(spark, "\n".join(["H", "a", "H", "b", "H", "c", "H", "d"])), per_line=True).first()
    assert "Detected possible header/footer repetition" in lines.issues


GOOD = {"filename": "a", "extraction_date": "b", "output_type": "c", "content": {"metadata": {"title": "t", "type": "u"}, "table_of_contents": [], "chapters": [{"number": 1, "title": "x", "sections": []}], "appendices": [{"letter": "A", "title": "t", "content": "", "sections": []}]}}


def test_envelopes(spark):
    assert quality.envelope_errors(GOOD) == [] and quality.envelope_errors(GOOD | {"content": "text"}) == []
    for f in quality.FIELDS:
        assert quality.envelope_errors({k: v for k, v in GOOD.items() if k != f}) == [f"Missing required field: {f}"]
    bad = GOOD | {"filename": 1, "content": {"metadata": {"title": "t"}, "table_of_contents": {}, "chapters": [1, {"title": "x"}], "appendices": {}}}
    assert quality.envelope_errors(bad) == [
        "Field 'filename' must be a string", "Metadata missing required field: type", "Table of contents must be a list", "Chapter 1 must be a dictionary",
        "Chapter 2 missing required field: number", "Chapter 2 missing required field: sections", "Appendices must be a list",
    ]
    df = docs(spark, json.dumps(GOOD), "{", None)
    assert [len(x) for x in column(df.select(quality.json_envelope_errors("text").alias("e")), "e")] == [0, 1, 1]
    env = quality.envelope(docs(spark, "body"), F.col("text"), "raw", F.lit("2020-01-02 03:04:05").cast("timestamp"))
    assert env.first().extraction_date == "2020-01-02 03:04:05" and env.select(quality.typed_envelope_errors(env).alias("e")).first().e == []


# --- structure and rendering ------------------------------------------------------------
TEXT = "A Book\n\nContents\nChapter 1: Races 3\nDwarf.4\nAppendix A: Rest 9\n\nChapter 1 : Races\nHill Dwarf\nA dwarf of hills.\nChapter 2 : Classes\nsome text here.\nAppendix A: Conditions\nBlinded\nNo sight.\n"


def test_structure(spark):
    got = structure.structured(docs(spark, TEXT, "nothing"), title="My book", clean=False).orderBy("doc_id").collect()
    book = got[0]
    assert book.metadata.title == "My book" and [(t.type, t.title, t.page) for t in book.table_of_contents] == [("chapter", "Races", 3), ("appendix", "Rest", 9)]
    assert [(c.number, c.title, [(s.title, s.content) for s in c.sections]) for c in book.chapters] == [(1, "Races", [("Hill Dwarf", "A dwarf of hills.")]), (2, "Classes", [("Main Content", "some text here.")])]
    assert [(a.letter, a.title, [s.title for s in a.sections]) for a in book.appendices] == [("A", "Conditions", ["Blinded"])]
    assert got[1].chapters == [] and got[1].appendices == [] and got[1].table_of_contents == []
    out = render.markdown(structure.structured(docs(spark, TEXT), title="My book", clean=False), extracted_on=F.lit("now")).first().markdown
    assert out.startswith("# My Book\n\n*Extracted on: now*\n\n## Table of Contents\n\n- [1. Races](#1-races)\n  - [Dwarf](#dwarf)\n- [Appendix A: Rest](#appendix-a-rest)\n")
    bare = render.markdown(structure.structured(docs(spark, TEXT.replace("Contents\nChapter 1: Races 3\nDwarf.4\nAppendix A: Rest 9\n\n", "")), title="My book", clean=False)).first().markdown
    assert "\n- [1. Races](#1-races)\n  - [Hill Dwarf](#hill-dwarf)\n- [2. Classes](#2-classes)\n- [Appendix A: Conditions](#appendix-a-conditions)\n" in bare
    assert "## 1. Races\n\n### Hill Dwarf\n\nA dwarf of hills.\n" in out and "## 2. Classes\n\nsome text here.\n" in out and out.count("### Main Content") == 0


def test_content_list(spark):
    got = docs(spark, "Title\nHill Dwarf • 12\n\n17\nElf").select(structure.content_list("text").alias("l"), structure.is_list_like("text").alias("x")).first()
    assert [tuple(i) for i in got.l][1:] == [("Elf", None)] and got.l[0].page == 12 and got.x


def test_pieces_by_order(spark):
    got = docs(spark, "Chapter 1 a\nTitle One\nx y.\nChapter 2 b\nplain words.").select(structure.sections_of_lines("text").alias("c")).first().c
    assert [(c.number, [s.title for s in c.sections]) for c in got] == [(1, ["Title One"]), (2, ["Main Content"])]
    ap = docs(spark, "Appendix X one\nbody.\nAppendix Y two\nmore.").select(structure.lettered_appendices("text").alias("a")).first().a
    assert [(a.letter, a.content) for a in ap] == [("A", "body."), ("B", "more.")]


@pytest.mark.parametrize("kind", pipeline.OUTPUT_TYPES)
def test_output_types(spark, kind):
    assert pipeline.process(docs(spark, BOOK, "", None), kind).count() >= 1


def test_pipeline_markdown(spark):
    out = pipeline.process(docs(spark, BOOK), "markdown", title="b").first().markdown
    assert "## 1. Races\n\nfirst line\n\n### Hill Dwarf\n\na dwarf\n\nan other\n" in out and "- [1. Races](#1-races)" in out
    with pytest.raises(ValueError):
        pipeline.process(docs(spark, "x"), "other")
    assert "Races" in render.outline(segment.chapters(segment.split_lines(docs(spark, BOOK)))).first().outline
    assert render.lines_markdown(segment.raw_lines(docs(spark, "a\nb")), F.lit("T")).first().markdown == "# T\n\na b"
    assert tx is not None
