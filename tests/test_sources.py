"""Readers, writers, backends, the landing stream."""

import json

from pyspark.sql import functions as F

from inkmill.sources import files, sinks
from inkmill.streaming import landing


def test_find_and_read(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.pdf").write_bytes(b"%PDF")
    (tmp_path / "y.pdf").write_bytes(b"x")
    (tmp_path / "z.PDF").write_bytes(b"")
    (tmp_path / "m.md").write_text("# é\nb")
    assert sorted(r.path.rsplit("/", 1)[-1] for r in files.find_files(spark, str(tmp_path)).collect()) == ["x.pdf", "y.pdf"]
    assert [r.path.rsplit("/", 1)[-1] for r in files.find_files(spark, str(tmp_path), content=False).collect()] == ["x.pdf", "y.pdf"]
    assert files.find_files(spark, str(tmp_path / "none")).count() == 0
    got = files.read_texts(spark, str(tmp_path), "*.md").select("text", files.relative_path(F.col("path"), str(tmp_path)).alias("r"), files.stem(F.col("path")).alias("s"), files.suffix(F.col("path")).alias("x")).first()
    assert tuple(got) == ("# é\nb", "m.md", "m", ".md")


def test_structured_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("title: T\nn: 3\nwhen: 2020-01-02\n")
    (tmp_path / "b.json").write_text(json.dumps({"title": "J", "n": 4}, indent=2))
    (tmp_path / "c.txt").write_text("x")
    (tmp_path / "d.json").write_text("{")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_structured(spark, str(tmp_path), "title string, n int").collect()}
    assert got["a.yaml"].value == ("T", 3) and got["b.json"].value == ("J", 4)
    assert got["c.txt"].error == "Unsupported file type: .txt" and got["d.json"].error == "File does not parse"


def test_extraction_cascade(spark):
    fails = lambda data, pages: 1 / 0
    first = lambda data, pages: [(0, "one page. Next")] if data == b"a" else [(0, "")]
    rest = lambda data, pages: [(1, "two"), (0, "one")] if data != b"c" else []
    df = spark.createDataFrame([("1", bytearray(b"a")), ("2", bytearray(b"b")), ("3", bytearray(b"c"))], "path string, content binary")
    got = {r.path: r.text for r in files.extract(df, (fails, first, rest)).collect()}
    assert got == {"1": "one page.\nNext", "2": "one\ntwo", "3": ""}
    assert files.extract(df, ("pypdf", "ocr")).filter("text <> ''").count() == 0
    pages = files.extract_pages(df, lambda d, p: [(i, str(i)) for i in (p or range(3)) if i < 3], [0, 2, 9])
    assert sorted({r.page_no for r in pages.collect()}) == [0, 2]
    assert files.select_pages(pages, 1).count() == 3 and files.select_pages(pages).count() == 6


def test_html_and_markdown(spark):
    df = spark.createDataFrame([("<p>a &amp; b<script>x</script></p><style>y</style>c",), (None,)], "h string")
    assert [r[0] for r in df.select(files.html_text("h")).collect()] == ["a & bc", None]
    md = spark.createDataFrame([("# T\n- *a* **b** [c](d) `e`\n> q",)], "m string")
    assert md.select(files.markdown_text("m").alias("t")).first().t == "T\na b c e\nq"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "2020", "raw", "é"), ("b.pdf", "2020", "lines", "y")], "filename string, extraction_date string, output_type string, content string")
    assert sinks.write_envelopes(df, f"{tmp_path}/e").count() == 2
    assert json.loads((tmp_path / "e/raw/a.json").read_text()) == {"filename": "a.txt", "extraction_date": "2020", "output_type": "raw", "content": "é"}
    assert sinks.write_envelopes(df, f"{tmp_path}/y", "yaml", debug=True).count() == 2
    assert (tmp_path / "y/debug/b_lines.yaml").read_text().startswith("content: y\n")
    assert sinks.write_envelopes(df, f"{tmp_path}/t", "txt").count() == 2 and (tmp_path / "t/raw/a.txt").read_text() == "é"
    sinks.write_json(df, f"{tmp_path}/j", "output_type")
    sinks.write_text(df, f"{tmp_path}/w", "content")
    assert spark.read.json(f"{tmp_path}/j").count() == 2 and spark.read.text(f"{tmp_path}/w").count() == 2


def test_landing_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("word " * 60)
    (tmp_path / "in/b.txt").write_text("few words")
    run = lambda: landing.write_checked(landing.read_landing(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert run()
    assert sorted(r.is_valid for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [False, True]
    (tmp_path / "in/c.txt").write_text("more")
    assert run() and spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_command_line(spark, tmp_path, capsys):
    from inkmill.plans.cli import parser, run

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.txt").write_text("C h a p t e r 1 : R a c e s\nfirst line")
    (tmp_path / "in/b.md").write_text("the w eapon")
    ask = lambda *a: run(spark, parser().parse_args([*map(str, a)]))
    for kind in ("raw", "lines", "lines_chapters", "processed", "validated"):
        assert ask("process", tmp_path / "in", tmp_path / "out", "--type", kind) == 1
    assert json.loads((tmp_path / "out/lines/sub/a.json").read_text())["content"] == ["C h a p t e r 1 : R a c e s", "first line"]
    assert ask("convert", tmp_path / "out/processed", tmp_path / "md") == 1 and "## 1. Races" in (tmp_path / "md/sub/a.md").read_text()
    assert ask("process", tmp_path / "in", tmp_path / "md2", "--type", "markdown", "--no-toc") == 1 and "Table of Contents" not in (tmp_path / "md2/sub/a.md").read_text()
    assert ask("process", tmp_path / "in", tmp_path / "out2", "--type", "processed", "--to-markdown") == 2 and "# " in (tmp_path / "out2/markdown/sub/a.md").read_text()
    assert ask("lint", tmp_path / "in", tmp_path / "adv", "--advanced", "--preview", "6") == 1 and "SPLIT_WORD" in (tmp_path / "adv/b.report.txt").read_text()
    assert "w eapon" in capsys.readouterr().out
    assert ask("lint", tmp_path / "in", tmp_path / "rep", "--fix") == 2
    assert "w eapon" in (tmp_path / "rep/b.report.txt").read_text() and (tmp_path / "rep/b.fixed.md").read_text() == "the weapon"


def test_grammar_backend(spark):
    from inkmill.operators import grammar

    make = lambda: lambda text: [(text.index("teh"), 3, "MORFOLOGIK_X", "typo", "the", "TYPOS"), (0, 1, "OTHER", "x", "", "STYLE")] if "teh" in text else []
    df = spark.createDataFrame([(1, "a\nin teh end"), (2, "teh"), (3, None)], "doc_id long, text string")
    got = grammar.check(df, make, disabled=["STYLE"]).collect()
    assert [(r.doc_id, r.start, r.line, r.column, r.text, r.suggestion, r.confidence, r.error_type) for r in got] == [(1, 5, 1, 3, "teh", "the", 0.9, "spelling")]


def test_chapter_checks(spark):
    from inkmill.operators import correct, segment

    text = "C h a p t e r 1 : R a c e s\n" + "\n".join(f"the wizzard casts and {i} spells" for i in range(80)) + "\nH i l l D w a r f\nthe wizzard of a dwarf\nplain"
    rows = segment.split_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    got = correct.check_chapters(segment.chapters(rows), correct.lexicon(spark)).collect()
    assert sum(r.part == "main" for r in got) == 50 and sum(r.part == "Hill Dwarf" for r in got) == 2 and any(not r.valid for r in got)
