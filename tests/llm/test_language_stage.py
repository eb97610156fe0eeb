import corpus_pipeline
from cohortscore.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_no_label_at_all(spark):
    rows = [(1, "some words in it", None, "a", 1), (2, None, None, "a", 1), (3, "123", None, "a", 1), (4, "mehr Wörter", None, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert langid.fit(docs) is None
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["lang"]) for r in got.collect()) == [(1, None), (4, None)]


def test_a_learned_label_und_is_no_rejection(spark):
    rows = [(i, f"some words in text {i}", "und", "a", 1) for i in range(20)] + [(20, "123", "und", "a", 1)]
    got = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r["doc_id"] for r in got.collect()} == set(range(20))
