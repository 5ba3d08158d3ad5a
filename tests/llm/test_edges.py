"""Null values, empty tables, repeated rows and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import chat, cover_tree, decontaminate, html_text, jaccard_join, packing, pii, quality, secrets, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["id", "cluster", "bucket", "salt", "rank", "n", "sig", "set", "side", "u", "v", "score", "spans", "token", "print", "word", "known", "_row", "length", "start"]
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (1, "some words here for a text", "en", "s", 26), (1, "some words here for a text", "en", "s", 26), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id at all here", "en", None, 1),
    (None, None, None, None, None), (4, LONG, "en", "s", len(LONG)), (5, LONG, "en", "s", len(LONG)), (6, "   \n\t ", "xx", "", 6), (7, "x" * 200_000, "en", "s", 200_000), (8, "é ñ 日本 \x00", "fr", "s", 6),
]


@pytest.fixture(params=["rows", "empty", "clash"])
def docs(request, spark):
    df = spark.createDataFrame([] if request.param == "empty" else ROWS, DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if request.param == "clash" else df


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "some benchmark item of many words that nobody has copied"), (None, "another one without an id but words"), (2, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def model():
    import numpy as np

    return quality.train(np.zeros((0, 1)), np.zeros(0))


def test_pack(docs):
    out = packing.pack(docs).collect()
    assert len({(r["doc_id"], r["start"]) for r in out if r["doc_id"] == 4}) == len([r for r in out if r["doc_id"] == 4])
    assert len([r for r in out if r["start"] == 0]) == docs.count()


def test_pii(docs):
    assert pii.find_pii(docs).count() == docs.count()
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_quality(docs, model):
    assert quality.score(docs, model).count() == docs.count()
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_jaccard(docs):
    out = jaccard_join.jaccard_classes(docs).collect()
    assert len(out) == docs.count()
    assert all(r["component_id"] == (4 if r["doc_id"] == 5 else r["doc_id"]) for r in out)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.select("doc_id").collect()) == ([-1, -1, 1, 2, 3, 4, 6, 7, 8] if out else [])


def test_passages(docs):
    found = {r["doc_id"] for r in substring_dedup.repeated_passages(docs).collect()}
    assert found == ({4, 5} if docs.count() else set())


def test_secrets(docs):
    assert secrets.scan_secrets(docs).count() == docs.count()


def test_decontaminate(docs, items):
    assert decontaminate.contaminated(docs, items).count() == 0
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_no_items(spark):
    docs, none = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.clean(docs, none).count() == len(ROWS)


@pytest.mark.parametrize("clash", [False, True])
def test_other_tables(spark, clash):
    more = (lambda df: df.withColumns({c: F.lit("x") for c in [*CLASHING, "cell", "links", "host", "template", "part", "chunk", "a", "b", "x", "y"]})) if clash else (lambda df: df)
    pages = more(spark.createDataFrame([(1, "http://a/b", "<p>x"), (None, None, None), (2, "::", ""), (1, "http://a/b", "<p>x")], "page_id long, url string, html string"))
    assert html_text.extract_text(pages).count() == 4 and html_text.extract_text(pages.limit(0)).count() == 0
    vectors = more(spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, None, None)], "vec_id long, embedding array<float>, label int"))
    out = cover_tree.cosine_links(vectors).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in out) == [(-1, 0), (1, 1), (1, 1), (2, 0)] and cover_tree.cosine_links(vectors.limit(0)).count() == 0
    turns = more(spark.createDataFrame([(1, 0, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string"))
    assert chat.render(turns, chat.maximal_conversations(turns)).count() == 1 and chat.maximal_conversations(turns.limit(0)).count() == 0


def test_stages(spark, docs, items, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.count()
