"""Ranked retrieval: weighted query terms joined to postings, fusion and cuts.

Queries come as a table, so one plan ranks any number of them. A query is
(query_id, text); its terms are distinct. Sums are rounded to six places before
ranking and ties end at doc_id, so results don't depend on the order of sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import settle
from . import scan

# Fixed values of the ranking.
K1, B = 1.5, 0.75
CANDIDATES, FUSE_DEPTH, RRF_K = 32, 100, 5
SCRIPT_BONUS, W_DYN, W_ZONE, STRENGTH_CAP = 0.5, 0.3, 0.2, 5.0
SEM_WEIGHT, SEM_WEIGHT_CJK = 0.4, 1.0
EXPANSION_WEIGHTS = {"synonyms": 0.75, "keywords": 0.75, "related": 0.4, "note_line": 0.4}
#: Queries' terms are broadcast up to so many rows; beyond, the join shuffles.
BROADCAST_TERMS = 200_000
PLACES = 6


def query_terms(queries: DataFrame, exact: bool = True) -> DataFrame:
    """(query_id, term, weight 1.0), distinct."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text"), exact))).alias("term")).withColumn("weight", F.lit(1.0))


def expansion_terms(expansions: DataFrame, literal: DataFrame, exact: bool = True) -> DataFrame:
    """(query_id, term, weight): highest tier of each term the query lacks.

    ``expansions``: (query_id, tier, text).
    """
    weight = F.create_map(*[x for k, v in EXPANSION_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])[F.col("tier")]
    terms = expansions.select("query_id", weight.alias("weight"), F.explode(T.tokens(F.col("text"), exact)).alias("term"))
    best = terms.where("weight is not null").groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    return best.join(literal.select("query_id", "term"), ["query_id", "term"], "left_anti")


def _small(df: DataFrame, bound: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted below ``bound`` rows; for written tables, else it runs twice."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def bm25(terms: DataFrame, post: DataFrame, lengths: DataFrame, stats: DataFrame, script_bonus: bool = True, dfs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term.

    Only postings of asked terms pass the first join. Their document frequencies
    come from ``dfs`` or are counted on these postings alone; they are written,
    with the queries' terms, before the postings are scored. Queries of several
    scripts multiply a document's score by 1 + 0.5 for each further script that
    it matches.
    """
    terms = settle(terms, "query-terms")
    asked = _small(terms.select("term").distinct())
    df = dfs.join(asked, "term") if dfs is not None else post.join(asked, "term").groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = F.col("n_docs"), F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    idf = F.col("weight") * F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = settle(terms.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", idf.alias("idf"), avgdl.alias("avgdl")), "query-weights")
    scored = post.join(_small(weighted), "term").join(lengths, "doc_id")
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("doclen") / F.col("avgdl")))
    aggs = [F.sum(part).alias("score")]
    if script_bonus:
        aggs.append(F.count_distinct(F.when(T.script(F.col("term")) != "", T.script(F.col("term")))).alias("scripts"))
    out = scored.groupBy("query_id", "doc_id").agg(*aggs)
    if script_bonus:
        asked_scripts = terms.groupBy("query_id").agg(F.count_distinct(F.when(T.script(F.col("term")) != "", T.script(F.col("term")))).alias("asked"))
        out = out.join(_small(asked_scripts), "query_id").withColumn("score", F.col("score") * F.when(F.col("asked") > 1, 1 + SCRIPT_BONUS * F.greatest(F.lit(0), F.col("scripts") - 1)).otherwise(1.0))
    return out.select("query_id", "doc_id", F.round("score", PLACES).alias("score"))


def _bm25_side(avgdl: float):
    return lambda tf, doclen: tf * (K1 + 1) / (tf + K1 * (1 - B + B * doclen / avgdl))


def _cosine_side(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) / norm


def idf_weights(terms: DataFrame, dfs: DataFrame, stats: DataFrame) -> DataFrame:
    """``terms`` (query_id, term, weight) with weights times the BM25 idf; 0 for what no document holds."""
    asked = settle(terms, "query-terms")
    df = settle(dfs.join(_small(asked.select("term").distinct()), "term").crossJoin(F.broadcast(stats.select("n_docs"))), "query-frequencies")
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(_small(df), "term", "left").select("query_id", "term", F.coalesce(F.col("weight") * idf, F.lit(0.0)).alias("weight"))


def is_unit(term: Column) -> Column:
    """An original unit of a query: stems and characters of a longer Han or kana run are none."""
    return ~term.endswith(T.STEM_MARK) & T.counts_in_length(term)


def script_number(term: Column) -> Column:
    own = T.script(term)
    return F.when(own == "hangul", 1).when(own == "cjk", 2).when(own == "latin", 3).otherwise(0)


def asked_bm25(terms: DataFrame, dfs: DataFrame, stats: DataFrame, added: DataFrame | None = None, scripts: bool = True) -> list[scan.Asked]:
    """Blocks of queries for :func:`bm25_best`; ``added``: expansion terms (query_id, term, weight) that full matches don't take."""
    term = F.col("term")
    weights = idf_weights(terms, dfs, stats).select("query_id", "term", "weight", F.lit(0.0).alias("added"), is_unit(term).alias("unit"), (script_number(term) if scripts else F.lit(0)).alias("script"))
    if added is not None:
        more = idf_weights(added, dfs, stats).select("query_id", "term", F.lit(0.0).alias("weight"), F.col("weight").alias("added"), F.lit(False).alias("unit"), F.lit(0).alias("script"))
        weights = weights.unionByName(more)
    return scan.asked_blocks(settle(weights, "query-weights"), BROADCAST_TERMS)


def bm25_best(asked: list[scan.Asked], rows: DataFrame, avgdl: float | None, k: int, script_bonus: bool = True, by: list | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the first ``k`` of what :func:`bm25` gives, scored where the documents lie.

    ``rows``: (doc_id, doclen, terms, tfs) of a stored index, ids that fit a long. A column
    ``boost`` multiplies a document's scores, ``value`` takes their place. ``avgdl`` is the
    mean of doclen.
    """
    sized = rows.withColumn("size", F.col("doclen").cast("double")).drop("doclen")
    return top_k(scan.best(sized, asked, _bm25_side(avgdl or 1.0), k, SCRIPT_BONUS if script_bonus else 0.0), k, by)


def cosine_best(counts: DataFrame, rows: DataFrame, stats: DataFrame, dfs: DataFrame, norms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the first ``k`` of what :func:`tfidf_cosine` gives, scored where the documents lie."""
    counts = settle(counts, "query-counts")
    df = dfs.join(_small(counts.select("term").distinct()), "term").crossJoin(F.broadcast(stats.select("n_docs")))
    idf = df.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    own = settle(counts.join(idf, "term").select("query_id", "term", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("qw")), "query-weights")
    qnorm = own.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    weights = own.join(_small(qnorm), "query_id").select("query_id", "term", (F.col("qw") / F.col("qnorm") * F.col("idf")).alias("weight"))
    asked = scan.asked_blocks(settle(weights, "query-weights"), BROADCAST_TERMS)
    near = scan.only_asked(rows.select("doc_id", "terms", "tfs"), asked).where(F.size("terms") > 0)
    sized = near.join(norms.select("doc_id", F.col("norm").alias("size")), "doc_id")
    return top_k(scan.best(sized, asked, _cosine_side, k).where("score > 0"), k)


def covering_best(terms: DataFrame, rows: DataFrame) -> DataFrame:
    """What :func:`covering` gives, found where the documents lie."""
    units = settle(terms.where(is_unit(F.col("term"))).select("query_id", "term").distinct().withColumn("unit", F.lit(True)), "query-units")
    return scan.full_matches(rows, scan.asked_blocks(units, BROADCAST_TERMS))


def without(best: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of ``best`` that are not in ``excluded`` (query_id, doc_id)."""
    return top_k(best.drop("rank").join(excluded.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"), k)


def most_a_query(excluded: DataFrame) -> int:
    """The greatest number of rows that a query has in ``excluded``: so many more of its best are looked at."""
    return excluded.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def tfidf_cosine(counts: DataFrame, post: DataFrame, stats: DataFrame, dfs: DataFrame | None = None, norms: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) by (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) vectors.

    ``counts``: (query_id, term, tf); unlike BM25, repeated query terms count.
    ``dfs`` and ``norms`` (doc_id, norm) are those of a stored index, or made here.
    """
    df = dfs if dfs is not None else post.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = (1 + F.log("tf")) * F.col("idf")
    if norms is None:
        norms = post.join(idf, "term").groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    counts = settle(counts, "query-counts")
    asked = counts.withColumnRenamed("tf", "q").join(idf.join(_small(counts.select("term").distinct()), "term"), "term").withColumn("qw", (1 + F.log("q")) * F.col("idf"))
    asked = settle(asked.select("query_id", "term", "idf", "qw"), "query-weights")
    qnorm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    weighted = asked.join(qnorm, "query_id").select("query_id", "term", "idf", (F.col("qw") / F.col("qnorm")).alias("qw"))
    small = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    sums = post.join(F.broadcast(weighted) if small else weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * w).alias("dot"))
    return sums.join(norms, "doc_id").select("query_id", "doc_id", F.round(F.col("dot") / F.col("norm"), PLACES).alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: int, by: list | None = None) -> DataFrame:
    """The best ``k`` of each query with rank 1..k."""
    w = Window.partitionBy("query_id").orderBy(*(by or [F.col("score").desc(), F.col("doc_id")]))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shared_ranks(scores: DataFrame) -> DataFrame:
    """Competition ranks: equal scores share the first's rank."""
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc())))


def rrf(rankings: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, doc_id, score) rankings with weights."""
    votes = None
    for ranking, weight in rankings:
        own = shared_ranks(ranking).select("query_id", "doc_id", (F.lit(weight) / (k + F.col("rank"))).alias("vote"))
        votes = own if votes is None else votes.unionByName(own)
    return votes.groupBy("query_id", "doc_id").agg(F.round(F.sum("vote"), PLACES).alias("score"))


def covering(terms: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents with every original unit of the query.

    Stems and characters of a longer Han or kana run are not units.
    """
    units = terms.where(~F.col("term").endswith(T.STEM_MARK) & T.counts_in_length(F.col("term"))).select("query_id", "term").distinct()
    wanted = units.groupBy("query_id").agg(F.count("*").alias("units"))
    have = post.join(_small(units), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("have"))
    return have.join(_small(wanted), "query_id").where("have = units").select("query_id", "doc_id")


def expanded(literal: DataFrame, added: DataFrame, full: DataFrame) -> DataFrame:
    """Literal scores plus expansion scores, which full matches don't take."""
    extra = added.join(full, ["query_id", "doc_id"], "left_anti")
    return literal.unionByName(extra).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), PLACES).alias("score"))


def _boost() -> Column:
    return 1 + W_DYN * F.coalesce("eff", F.lit(1.0)) / STRENGTH_CAP + W_ZONE * F.coalesce("priority", F.lit(0.0))


def boosted(scores: DataFrame, strength: DataFrame, zones: DataFrame, priority: DataFrame) -> DataFrame:
    """Scores times 1 + 0.3 * strength / 5 + 0.2 * zone priority.

    ``strength``: (doc_id, eff); ``zones``: (doc_id, zone); ``priority``: (zone, priority).
    """
    joined = scores.join(strength, "doc_id", "left").join(zones, "doc_id", "left").join(priority, "zone", "left")
    return joined.select("query_id", "doc_id", F.round(F.col("score") * _boost(), PLACES).alias("score"))


def boosts(zones: DataFrame, strength: DataFrame, priority: DataFrame) -> DataFrame:
    """(doc_id, boost) of every document of ``zones``, to be joined to its row before it is scored."""
    return zones.join(strength, "doc_id", "left").join(priority, "zone", "left").select("doc_id", _boost().alias("boost"))


def cut_then_filter(scores: DataFrame, visible: DataFrame, limit: int, candidates: int = CANDIDATES) -> DataFrame:
    """The best ``candidates`` first, visibility afterwards: fewer than ``limit`` may remain.

    The rank filter is a window, which no optimizer rule moves the semi-join
    below.
    """
    cut = top_k(scores, candidates).drop("rank")
    return top_k(cut.join(visible.select("doc_id"), "doc_id", "left_semi"), limit)


def hybrid(lexical: DataFrame, semantic: DataFrame, full: DataFrame, weight: float = SEM_WEIGHT) -> DataFrame:
    """Fused score and lexical rank; documents that cover the query come first.

    (query_id, doc_id, score, pinned, lexical_rank), cut to FUSE_DEPTH a leg.
    """
    legs = [top_k(x, FUSE_DEPTH).drop("rank") for x in (lexical, semantic)]
    fused = rrf([(legs[0], 1.0), (legs[1], weight)])
    order = shared_ranks(legs[0]).select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    pins = full.withColumn("pinned", F.lit(True))
    worst = legs[0].groupBy("query_id").agg((F.count("*") + 1).alias("worst"))
    out = fused.join(order, ["query_id", "doc_id"], "left").join(pins, ["query_id", "doc_id"], "left").join(worst, "query_id", "left")
    return out.select("query_id", "doc_id", "score", F.coalesce(F.col("pinned") & F.col("lexical_rank").isNotNull(), F.lit(False)).alias("pinned"), F.coalesce("lexical_rank", "worst", F.lit(1)).alias("lexical_rank"))


def union_channels(channels: DataFrame, width: int = 32) -> DataFrame:
    """(query_id, doc_id, position): first occurrence over channels of ranked rows.

    ``channels``: (query_id, channel, rank, doc_id).
    """
    first = channels.where(F.col("rank") <= width).groupBy("query_id", "doc_id").agg(F.min(F.struct("channel", "rank")).alias("at"))
    return first.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("position"))


def related(post: DataFrame, lengths: DataFrame, stats: DataFrame, linked: DataFrame, limit: int = 5, terms: int = 12, asking=None, dfs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): neighbours of every document by its top terms.

    ``linked``: (src, dst) pairs that are links already; ``asking``: a condition
    on doc_id that the asking documents meet, all without one.
    """
    w = Window.partitionBy("doc_id").orderBy(F.col("tf").desc(), F.col("term"))
    own = post.where(~F.col("term").endswith(T.STEM_MARK))
    top = (own if asking is None else own.where(asking)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= terms)
    asked = top.select(F.col("doc_id").alias("query_id"), "term", F.lit(1.0).alias("weight"))
    scores = bm25(asked, post, lengths, stats, script_bonus=False, dfs=dfs).where("query_id <> doc_id")
    free = scores.join(linked.select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id")), ["query_id", "doc_id"], "left_anti")
    return top_k(free, limit)


def related_best(rows: DataFrame, stats: DataFrame, dfs: DataFrame, linked: DataFrame, limit: int = 5, terms: int = 12, asking=None) -> DataFrame:
    """What :func:`related` gives, scored where the documents lie; ``rows`` are a stored index's."""
    own = (rows if asking is None else rows.where(asking)).select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc_id", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    w = Window.partitionBy("doc_id").orderBy(F.col("tf").desc(), F.col("term"))
    top = own.where(~F.col("term").endswith(T.STEM_MARK)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= terms)
    asked = asked_bm25(top.select(F.col("doc_id").alias("query_id"), "term", F.lit(1.0).alias("weight")), dfs, stats, scripts=False)
    links = linked.select(F.col("src").alias("query_id"), F.col("dst").alias("doc_id")).distinct()
    best = bm25_best(asked, rows, stats.first()["avgdl"], limit + 1 + most_a_query(links), script_bonus=False)
    return without(best.where("query_id <> doc_id"), links, limit)
