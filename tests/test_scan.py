"""Scores made where the documents lie against scores of exchanged postings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import index, rank, recall, scan, store

WORDS = "tea bread river stone garden copper paper winter 手続 メモ 메모리 gardens mountain".split()


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 7)))) for i in range(120)] + [(120, None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = [(q, " ".join(rng.sample(WORDS, 3)) + " absent" * (q == 3)) for q in range(8)]
    return docs, store.build(docs), spark.createDataFrame(queries, "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("bound", [200_000, 5])
def test_best_equals_exchanged_scores(spark, world, monkeypatch, bound):
    docs, own, queries = world
    terms = rank.query_terms(queries)
    want = rank.bm25(terms, own.post, own.lengths, own.stats, dfs=own.dfs).cache()
    monkeypatch.setattr(rank, "BROADCAST_TERMS", bound)
    monkeypatch.setattr(scan, "MOST_DOCS", 16)
    asked = rank.asked_bm25(terms, own.dfs, own.stats)
    assert (len(asked) > 1) == (bound == 5)
    avgdl = own.stats.first()["avgdl"]
    assert rows(rank.bm25_best(asked, own.rows, avgdl, 7)) == rows(rank.top_k(want, 7))
    by_value = rank.bm25_best(asked, own.rows.withColumn("value", -F.col("doc_id").cast("double")), avgdl, 4).select("query_id", "doc_id", "rank", F.lit(0.0).alias("score"))
    assert rows(by_value) == rows(rank.top_k(want.withColumn("score", F.lit(0.0)), 4))
    lift = F.sqrt(F.col("doc_id") % 3 + 1.0).alias("boost")  # no products that end in a half
    lifted = want.join(docs.select("doc_id", lift), "doc_id").select("query_id", "doc_id", F.round(F.col("score") * F.col("boost"), 6).alias("score"))
    assert rows(rank.bm25_best(asked, scan.only_asked(own.rows, asked).withColumn("boost", lift), avgdl, 5)) == rows(rank.top_k(lifted, 5))
    wide = queries.select("query_id", F.lit("related").alias("tier"), F.lit("mountain stone 手続").alias("text"))
    added = rank.expansion_terms(wide, terms)
    full = rank.covering(terms, own.post)
    both = rank.expanded(want, rank.bm25(added, own.post, own.lengths, own.stats, script_bonus=False, dfs=own.dfs), full)
    assert rows(rank.bm25_best(rank.asked_bm25(terms, own.dfs, own.stats, added), own.rows, avgdl, 7)) == rows(rank.top_k(both, 7))
    assert sorted(map(tuple, rank.covering_best(terms, own.rows).collect())) == sorted(map(tuple, full.collect()))


def test_cosine_related_and_recall(spark, world, monkeypatch):
    docs, own, queries = world
    monkeypatch.setattr(store, "FREQUENT", 3)
    counts = index.postings(queries.withColumnRenamed("query_id", "doc_id")).withColumnRenamed("doc_id", "query_id")
    want = rank.tfidf_cosine(counts, own.post, own.stats)
    assert rows(rank.cosine_best(counts, own.rows, own.stats, own.dfs, own.norms, 6)) == rows(rank.top_k(want, 6))
    linked = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(7, 9)], "src long, dst long")
    asking = F.col("doc_id") % 7 == 0
    got = rank.related_best(own.rows, own.stats, own.dfs, linked, asking=asking)
    assert rows(got) == rows(rank.related(own.post, own.lengths, own.stats, linked, asking=asking, dfs=own.dfs))
    all_ = recall.select(docs, own, queries, spark.createDataFrame([], "query_id long, doc_id long"), 9)
    gone = all_.where("rank < 4").select("query_id", "doc_id")
    assert rows(recall.select(docs, own, queries, gone, 3).withColumn("rank", F.col("rank") + 3)) == rows(all_.where("rank between 4 and 6"))


def test_no_posting_is_exchanged(world):
    _, own, queries = world
    asked = rank.asked_bm25(rank.query_terms(queries), own.dfs, own.stats)
    plan = scan.best(own.rows.withColumn("size", F.col("doclen").cast("double")), asked, lambda tf, size: tf, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" not in index.term_rows(world[0])._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "").split("MapInArrow")[0]


def test_counts_equal_the_column_tokens(spark):
    texts = ["Azafrán FÜTTERN Straße straße", "豚骨スープ 豚 메모리 x", "ＡＰＩ ｶﾀｶﾅ Tiếng Việt", "gardens GARDENS garden_2 Йогурт café 𠮷野家", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    post = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    assert sorted(map(tuple, index.postings(docs, unique=True).collect())) == sorted(map(tuple, post.collect()))
    lengths = {r.doc_id: r.doclen for r in index.doc_lengths(post).collect()}
    assert {r.doc_id: r.doclen for r in index.term_rows(docs).collect()} == {i: lengths.get(i, 0) for i in range(len(texts))}
    twice = docs.unionByName(docs)
    assert sorted(map(tuple, index.postings(twice).collect())) == sorted((i, t, 2 * n) for i, t, n in post.collect())
    assert index.unique_ids(docs) and not index.unique_ids(twice)


def test_plain_sums_are_scored_many_queries_at_a_time(spark, world, monkeypatch):
    _, own, _ = world
    none = spark.createDataFrame([], "src long, dst long")
    want = rows(rank.related(own.post, own.lengths, own.stats, none, dfs=own.dfs))
    calls = []
    one = scan.Kept.offer

    def offer(self, q, *rest):
        calls.append(len(q))
        return one(self, q, *rest)

    monkeypatch.setattr(scan.Kept, "offer", offer)
    blocks = []
    monkeypatch.setattr(scan, "_each", lambda df, asked, task, schema: blocks.append((asked, task)) or df.sparkSession.createDataFrame([], schema))
    rank.related_best(own.rows, own.stats, own.dfs, none).count()
    (asked, task) = blocks[0]
    monkeypatch.undo()
    monkeypatch.setattr(scan.Kept, "offer", offer)
    batches = scan._long(own.rows.withColumn("size", F.col("doclen").cast("double")).drop("doclen")).toArrow().to_batches()
    assert sum(b.num_rows for b in task(iter(batches), asked[0])) and len(calls) <= len(batches) and max(calls) > 50
    assert rows(rank.related_best(own.rows, own.stats, own.dfs, none)) == want
