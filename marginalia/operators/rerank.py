"""Two retrievers, a judge, means and pairwise order; the judge is injected."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of reranking.
WIDTH, PACKET, FINAL = 32, 8, 5


def packets(cards: DataFrame, size: int = PACKET) -> DataFrame:
    """``cards`` (query_id, rank, ...) with the packet each goes to the judge in."""
    return cards.withColumn("packet", F.floor((F.col("rank") - 1) / size).cast("int"))


def judge(cards: DataFrame, decide: Callable[[pd.DataFrame], pd.Series], workers: int = 5) -> DataFrame:
    """(query_id, doc_id, rank, score): answers of ``decide``, one call a packet.

    At most ``workers`` calls run at a time. Scores outside 0..1, or fewer than
    cards, are errors.
    """

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in groups:
            for _, own in pdf.groupby(["query_id", "packet"], sort=True):
                scores = pd.Series(decide(own)).astype(float)
                if len(scores) != len(own) or not scores.between(0, 1).all():
                    raise ValueError("the judge must give each card a score from 0 to 1")
                yield pd.DataFrame({"query_id": own["query_id"], "doc_id": own["doc_id"], "rank": own["rank"], "score": scores.to_numpy()})

    schema = f"query_id {dict(cards.dtypes)['query_id']}, doc_id {dict(cards.dtypes)['doc_id']}, rank int, score double"
    return packets(cards).repartition(workers, "query_id", "packet").mapInPandas(run, schema)


def merge_top(left: DataFrame, right: DataFrame, keep: int = FINAL) -> DataFrame:
    """Mean score of both sides; ties by either side's rank, then the id.

    Each side: (query_id, doc_id, rank, score).
    """
    a = left.select("query_id", "doc_id", F.col("rank").alias("ra"), F.col("score").alias("sa"))
    b = right.select("query_id", "doc_id", F.col("rank").alias("rb"), F.col("score").alias("sb"))
    n = F.col("sa").isNotNull().cast("int") + F.col("sb").isNotNull().cast("int")
    both = a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", F.round((F.coalesce("sa", F.lit(0.0)) + F.coalesce("sb", F.lit(0.0))) / n, 6))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("ra").asc_nulls_last(), F.col("rb").asc_nulls_last(), "doc_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).select("query_id", "doc_id", "score", "rank")


def ordered_pairs(final: DataFrame) -> DataFrame:
    """(query_id, i, j, a, b): both orders of all pairs of the kept few."""
    a, b = final.alias("a"), final.alias("b")
    return a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") != F.col("b.rank"))).select(
        F.col("a.query_id").alias("query_id"), F.col("a.rank").alias("i"), F.col("b.rank").alias("j"), F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")
    )


def pairwise_order(answers: DataFrame) -> DataFrame:
    """(query_id, doc_id, preference, rank) from (query_id, i, j, a, b, p).

    A pair's preference is (forward + 1 - reverse) / 2; sums order the few, ties
    keep their position.
    """
    back = answers.select("query_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("p").alias("r"))
    both = answers.join(back, ["query_id", "i", "j"])
    total = both.groupBy("query_id", "i", F.col("a").alias("doc_id")).agg(F.round(F.sum((F.col("p") + 1 - F.col("r")) / 2), 6).alias("preference"))
    w = Window.partitionBy("query_id").orderBy(F.col("preference").desc(), "i")
    return total.withColumn("rank", F.row_number().over(w)).select("query_id", "doc_id", "preference", "rank")


def sampled_df(docs: DataFrame, sample: int = 4000) -> DataFrame:
    """(term, df) over the first ``sample`` documents by id, title and 400 characters each."""
    head = docs.orderBy("doc_id").limit(sample)
    words = F.regexp_extract_all(F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 400)), F.lit(r"([a-z0-9\x{ac00}-\x{d7a3}]{2,})"), F.lit(1))
    return head.select("doc_id", F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
