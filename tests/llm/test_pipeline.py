"""The corpus pipeline stage by stage against brute force."""

import corpus_pipeline as cp
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    one = cp.language_id(spark, docs, SF)
    assert one.columns == columns and one.count() >= 0.97 * docs.count()
    two = cp.near_dedup(spark, one, SF)
    text = [(r.doc_id, r.text) for r in one.collect()]
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {d for d, _, _, kept in brute.near_duplicates(text, 5) if kept}
    three = cp.decontaminate(spark, two, SF)
    text = [(r.doc_id, r.text) for r in two.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {r[0] for r in brute.contamination(text, items) if not r[5]}
    four = cp.mix_sources(spark, three, SF)
    assert four.columns == columns and 0 < four.count()
    five = cp.token_files(spark, four, SF).collect()
    from inkmill.llm.queries import tokenizer_path

    assert sorted(map(tuple, five)) == sorted(brute.token_files([(r.doc_id, r.text) for r in four.collect()], tokenizer_path()))


def test_run_is_the_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_files"]
    got = cp.run(spark, SF)
    assert got.count() > 0 and got.columns[:3] == ["doc_id", "start", "n_tokens"]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break


def test_odd_rows_and_clashing_columns(spark):
    names = ["_gone", "row", "key", "times", "copy", "sig", "n", "part", "s_", "id", "rid", "declared"]
    data = [(1, "the house and the garden", "en", "a"), (1, "the house and the garden", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "the river and the town", "en", None), (4, "x" * 50_000, "en", "b")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(names))) for r in data], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
    assert cp.token_files(spark, docs, SF).count() == len(data)
