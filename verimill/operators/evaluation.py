"""Ranking metrics over a run (query_id, document_id, rank) and gold (query_id, document_id, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(run: DataFrame, gold: DataFrame, k: int = 5, graded: bool = False) -> DataFrame:
    """(query_id, ndcg, recall, precision, mrr, answerable, relevant_found, relevant_total, retrieved) for each query that has gold.

    Binary gain unless graded. mrr looks at the whole run, the others at its first k rows.
    """
    g = gold.select("query_id", "document_id", (F.col("grade") if graded else F.lit(1.0)).cast("double").alias("gain"))
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "document_id")
    ideal = g.withColumn("r", F.row_number().over(best)).groupBy("query_id").agg(F.sum(F.when(F.col("r") <= k, F.col("gain") / F.log2(F.col("r") + 1.0))).alias("idcg"), F.count("*").alias("relevant_total"))
    hits = run.join(g, ["query_id", "document_id"]).groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, F.col("gain") / F.log2(F.col("rank") + 1.0))).alias("dcg"), F.count_if(F.col("rank") <= k).alias("found"), F.min("rank").alias("first"))
    sizes = run.groupBy("query_id").agg(F.count("*").alias("retrieved"), F.count_if(F.col("rank") <= k).alias("top"))
    rows = ideal.join(hits, "query_id", "left").join(sizes, "query_id", "left").fillna(0, ["dcg", "found", "retrieved", "top"])
    return rows.select(
        "query_id",
        F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 9).alias("ndcg"),
        F.round(F.col("found") / F.col("relevant_total"), 9).alias("recall"),
        F.round(F.when(F.col("top") > 0, F.col("found") / F.col("top")).otherwise(0.0), 9).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("mrr"),
        (F.col("found") > 0).alias("answerable"),
        F.col("found").alias("relevant_found"),
        "relevant_total",
        F.col("retrieved").alias("retrieved"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6)
    return metrics.agg(F.count("*").alias("total_queries"), mean("ndcg").alias("mean_ndcg"), mean("recall").alias("mean_recall"), mean("precision").alias("mean_precision"), mean("mrr").alias("mean_mrr"), mean(F.col("answerable").cast("double")).alias("answerability"))
