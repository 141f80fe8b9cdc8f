"""The pipeline: its stages' decisions against plain rules, and whole runs."""

import corpus_pipeline
from pulsecheck.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        after = after.persist()
        assert 0.5 * before < after.count() <= before
        assert after.join(docs, "doc_id", "left_anti").count() == 0
        if name == "secret_scans":
            assert after.count() == before and after.where("text RLIKE '[0-9a-f]{32}'").count() == 0
            assert after.where("n_chars <> char_length(text)").count() == 0
        docs, before = after, after.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == before


def test_run_and_odd_documents(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", None, None, None), (3, "plain words here", "en", "s", 16), (3, "plain words here", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (odd, odd.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
