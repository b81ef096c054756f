"""What searches shuffle: neither postings nor whole texts."""

import pytest
from pyspark.sql import functions as F
from verimill.functions import extension
from verimill.operators import retrieval
from verimill.plans import registry

SF = "/root/testdata/sf0.001"


def shuffled(spark, run):
    """Bytes that run() writes to shuffles, and spills."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty(60_000)
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() + found.apply(i).diskBytesSpilled() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


@pytest.mark.parametrize("name", ["k2_rerank_scores", "i47_metrics_graded", "i22_hybrid_search", "i23_embedded_search", "i27_retrieval_log", "i24_rerank", "i50_evidence"])
def test_searches_shuffle_less_than_the_texts(spark, name):
    texts = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert shuffled(spark, lambda: registry.QUERIES[name](spark, SF).collect()) < texts


def test_only_texts_of_results_are_shuffled(spark, monkeypatch):
    """Few of many texts are in the results; a result without a text has no row, a null text a null score."""
    texts = spark.range(4000).select(F.col("id").alias("document_id"), F.when(F.col("id") != 7, F.concat(F.lit("fox "), F.expr("repeat(sha2(string(id), 512), 20)"))).alias("text"))
    pairs = spark.createDataFrame([(1, 5), (2, 5), (2, 7), (1, 9999)], "query_id long, document_id long")
    queries = spark.createDataFrame([(1, "fox sea"), (2, "sea")], "query_id long, query_text string")
    scored = lambda: sorted(map(tuple, extension.rerank_scores(pairs, texts, queries, extension.term_overlap).collect()))
    want = [(1, 5, 0.5), (2, 5, 0.0), (2, 7, None)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the results' size weren't known
    try:
        got = []
        assert shuffled(spark, lambda: got.extend(scored())) < 50_000 and got == want
        monkeypatch.setattr(retrieval, "TERM_ROWS", 0)
        assert scored() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
