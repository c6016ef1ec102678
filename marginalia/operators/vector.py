"""Vector scalars and searches over array<float> columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import top_k
from .scan import PLACES, Kept


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once a row: within a lambda it would be made anew for each number."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return _once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))


def signs(v: Column) -> Column:
    """1-bit quantisation: 1 where positive, else -1."""
    return F.transform(v, lambda x: F.when(x > 0, 1).otherwise(-1).cast("tinyint"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def int8_rows(v: Column) -> Column:
    """(scale, values): scale = greatest magnitude / 127."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x).cast("double")))
    scale = F.when(top > 0, top / 127).otherwise(1.0)
    return _once(scale, lambda s: F.struct(s.alias("scale"), F.transform(v, lambda x: F.rint(x.cast("double") / s).cast("int")).alias("values")))


def dequantised(row: Column) -> Column:
    """The vector of (scale, values)."""
    return _once(row["scale"], lambda s: F.transform(row["values"], lambda x: x * s))


#: Numbers of one block of scores (queries x rows) in a task.
SCORES_AT_ONCE = 1 << 20


def _task_best(batches: Iterator[pa.RecordBatch], asked: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score): each query's ``k`` best documents among a task's rows, by their best row."""
    kept = Kept(len(ids), k)
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = np.asarray(batch.column(0))
        order = np.argsort(doc, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(doc[order]) != 0))
        rows = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(doc), -1)[order]
        docs = doc[order][starts]
        step = max(1, SCORES_AT_ONCE // len(doc))
        for q in range(0, len(ids), step):
            scores = asked[q : q + step] @ rows.T
            if len(starts) < len(doc):
                scores = np.maximum.reduceat(scores, starts, axis=1)
            kept.offer(np.arange(q, q + len(scores)), scores, docs, lambda x: np.round(x, PLACES))
    if len(ids):
        yield kept.batch(ids)


def search(vectors: DataFrame, queries: DataFrame, k: int, bound: int = 10_000) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best documents of each normalised query by their best row.

    ``vectors``: (doc_id, row: array of one length), several rows a document;
    ``queries``: (query_id, embedding). Each task keeps a query's ``k`` best
    documents of its own rows, so tasks x queries x k rows are exchanged and no row
    is: a document among the best overall is among the best where its best row is.
    Queries are counted and go ``bound`` at a time. Rows without doc_id or vector
    are no candidates.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), l2_normalize(F.col("embedding")).alias("q")).where("query_id is not null and size(q) > 0")
    blocks = max(1, -(-asked.count() // bound))
    rows = vectors.where("doc_id is not null and size(row) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("row").cast("array<double>").alias("row"))
    out = None
    for b in range(blocks):
        # At most about ``bound`` queries, a block at a time.
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not part and blocks > 1:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["q"] for r in part], np.float64).reshape(len(part), -1), np.array([r["query_id"] for r in part], np.int64)))
        best = rows.mapInArrow(lambda batches, shared=shared: _task_best(batches, *shared.value, k), "query_id long, doc_id long, score double")
        out = best if out is None else out.unionByName(best)
    best = out.groupBy("query_id", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(best, k)


def sign_search(vectors: DataFrame, queries: DataFrame, k: int, bound: int = 10_000) -> DataFrame:
    """Top ``k`` documents by the normalised query times the signs; best chunk a document.

    ``vectors``: (doc_id, embedding), several rows a document; ``queries``:
    (query_id, embedding), a stated set; see :func:`search`.
    """
    return search(vectors.select("doc_id", signs(F.col("embedding")).alias("row")), queries, k, bound)


def int8_search(vectors: DataFrame, queries: DataFrame, k: int, bound: int = 10_000) -> DataFrame:
    """Top ``k`` documents by the normalised query times the dequantised rows; ``vectors``: (doc_id, scale, values)."""
    return search(vectors.select("doc_id", dequantised(F.struct("scale", "values")).alias("row")), queries, k, bound)
