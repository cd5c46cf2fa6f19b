import __spark_entry__
from millrace.plans import catalogue, oracles


def test_entry_runs(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["source", "reason", "n"] and out.count() > 0


def test_every_query_has_sql_or_is_known_to_have_none():
    without = {"blake2b_split", "bpe_fertility"}
    assert set(catalogue.queries()) - set(oracles.sql()) == without
    assert set(oracles.sql()) <= set(catalogue.queries())
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_stream_keeps_each_text_once(spark):
    got = [r[0] for r in catalogue.streaming_dedup(spark, "/root/testdata/sf0.001").collect()]
    batch = catalogue.doc_dedup(spark, "/root/testdata/sf0.001").where("first_document").count()
    assert len(got) == len(set(got)) == batch


def test_stream_cleans_each_text_once(spark):
    """The cleaning stands once in the plan; a filter that were pushed below it would repeat it for each rule."""
    from millrace.streaming import seen

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = seen.deduplicated(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") == 1 and plan.count("regexp_extract_all") == 1
