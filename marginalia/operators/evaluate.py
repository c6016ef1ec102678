"""Retrieval evaluation: gold ranks, rank metrics, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_ranks(hits: DataFrame, gold: DataFrame, siblings: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank): the gold's rank once its siblings are dropped, null beyond ``k``.

    ``hits``: (query_id, doc_id, rank); ``gold``, ``siblings``: (query_id, doc_id).
    """
    left = hits.join(siblings, ["query_id", "doc_id"], "left_anti")
    own = left.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)
    return gold.join(own, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("place").alias("rank"))


def rank_metrics(rank: str = "rank") -> list[Column]:
    r = F.col(rank)
    part = lambda c: F.round(F.sum(F.coalesce(c, F.lit(0.0))) / F.count(F.lit(1)), 6)
    return [
        part(F.when(r <= 1, 1.0)).alias("r1"),
        part(F.when(r <= 5, 1.0)).alias("r5"),
        part(1.0 / r).alias("mrr"),
        part(F.when(r <= 10, 1.0 / F.log2(r + 1.0))).alias("ndcg10"),
        F.count(F.lit(1)).alias("n"),
    ]


def by_grouping_sets(ranks: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Metrics for each grouping set in one pass; columns outside a set are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return ranks.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*rank_metrics())


def percentiles(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    """(point, value) by linear interpolation, exact."""
    values = F.percentile(F.col(column), F.array(*[F.lit(p / 100) for p in points]))
    zipped = F.arrays_zip(F.array(*[F.lit(float(p)) for p in points]).alias("point"), F.col("v").alias("value"))
    return df.agg(values.alias("v")).select(F.explode(zipped).alias("x")).select("x.point", F.round("x.value", 6).alias("value"))
