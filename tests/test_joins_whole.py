from cohortscore.operators import joins


def test_pool_of_all_missing_phenotypes(spark):
    samples = spark.createDataFrame([(1, 0), (2, 1)], "sample_id long, target int")
    cohort = spark.createDataFrame([(3, None), (7, 1), (8, None), (14, 0)], "person_id long, target int")
    assert {r[0] for r in joins.eval_pool(spark, samples=samples, cohort=cohort).collect()} == {1, 3, 8}


def test_survey_groups_whole_texts(spark):
    rows = [(1, "the first words, then a", "en", "s", 9), (2, "the first words, then b", "en", "s", 9), (3, "the first words, then b", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = joins.survey_diagnostic(spark, documents=docs).collect()
    assert [(r["answer"][-1], r["n_people"]) for r in got] == [("b", 2), ("a", 1)]
