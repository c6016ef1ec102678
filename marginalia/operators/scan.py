"""Ranking without exchanging postings: a task scores its own documents against a block of queries.

A document is one row of terms and counts, so all that a score needs lies in a task once
the queries' weights are there. These are collected and broadcast, ``rank.BROADCAST_TERMS``
rows at a time; each block reads the rows once. A task keeps a query's best ``k`` of its
own documents: one among the best of all is among the best where it lies. What is
exchanged is tasks x queries x k rows, whatever the documents share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of one block of weights (terms x documents) in a task; scores (queries x documents) that are made at once, in a processor's cache.
NUMBERS_AT_ONCE, SCORES_AT_ONCE = 1 << 22, 1 << 16
MOST_DOCS = 1024
PLACES = 6


@dataclass
class Asked:
    """A block of queries: query i has the entries ``starts[i]`` to ``starts[i + 1]``.

    An entry is a term (its place in ``vocab``) with its weight for the literal score, its
    weight for the added one, whether a full match needs it, and its script (0: none).
    """

    ids: np.ndarray
    vocab: pa.Array
    starts: np.ndarray
    at: np.ndarray
    weight: np.ndarray
    added: np.ndarray
    unit: np.ndarray
    script: np.ndarray


def asked_blocks(weights: DataFrame, bound: int) -> list[Asked]:
    """The queries of ``weights`` (query_id, term, weight and, where there are any, added, unit, script), about ``bound`` rows a block."""
    given = set(weights.columns)
    extra = [F.col(c).cast(t).alias(c) if c in given else F.lit(d).cast(t).alias(c) for c, t, d in (("weight", "double", 0.0), ("added", "double", 0.0), ("unit", "boolean", False), ("script", "int", 0))]
    rows = weights.select(F.col("query_id").cast("long").alias("query_id"), "term", *extra)
    blocks = max(1, -(-rows.count() // bound))
    out = []
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if not part.num_rows:
            continue
        query = part["query_id"].to_numpy()
        order = np.argsort(query, kind="stable")
        ids, starts = np.unique(query[order], return_index=True)
        terms = part["term"].combine_chunks() if isinstance(part["term"], pa.ChunkedArray) else part["term"]
        vocab = pc.unique(terms)
        numbers = lambda c, part=part, order=order: part[c].to_numpy()[order]
        out.append(Asked(ids, vocab, np.append(starts, len(query)), pc.index_in(terms, value_set=vocab).to_numpy(zero_copy_only=False)[order], numbers("weight"), numbers("added"), numbers("unit"), numbers("script")))
    return out


def _entries(batch: pa.RecordBatch, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in ``vocab``, count) of a batch's asked terms."""
    terms, tfs = batch.column("terms"), batch.column("tfs")
    at = pc.fill_null(pc.index_in(terms.flatten(), value_set=vocab.cast(terms.type.value_type)), -1).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(at >= 0)
    row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))
    return row[own], at[own], tfs.flatten().to_numpy(zero_copy_only=False)[own]


def _blocks(batches: Iterator[pa.RecordBatch], asked: Asked, side: Callable) -> Iterator[tuple]:
    """(batch's part, places of the terms in the weights or -1, terms x documents of weights) for some documents at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        row, at, tf = _entries(batch, asked.vocab)
        size = batch.column("size").to_numpy(zero_copy_only=False)
        weight = side(tf.astype(np.float64), size[row])
        start = 0
        while start < batch.num_rows:
            i, j = np.searchsorted(row, (start, start + MOST_DOCS))
            # As many documents as the terms that they hold leave room for, not those that are asked.
            step = max(16, min(MOST_DOCS, NUMBERS_AT_ONCE // max(1, len(np.unique(at[i:j])))))
            part = batch.slice(start, step)
            j = np.searchsorted(row, start + step)
            used, place = np.unique(at[i:j], return_inverse=True)
            held = np.zeros((len(used), part.num_rows))
            held[place, row[i:j] - start] = weight[i:j]
            where = np.full(len(asked.vocab), -1)
            where[used] = np.arange(len(used))
            yield part, where, held
            start += step


def _full(asked: Asked, q: int, where: np.ndarray, held: np.ndarray) -> np.ndarray | None:
    """Which documents hold every unit of a query; None where the query has no unit or no document could."""
    own = slice(asked.starts[q], asked.starts[q + 1])
    need = where[asked.at[own][asked.unit[own]]]
    return (held[need] > 0).all(axis=0) if len(need) and need.min() >= 0 else None


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10**PLACES + 0.5) / 10**PLACES


def _scores(asked: Asked, q: int, where: np.ndarray, held: np.ndarray, bonus: float) -> np.ndarray | None:
    """A query's rounded scores, NaN where a document shares no term; None where none does."""
    own = slice(asked.starts[q], asked.starts[q + 1])
    place = where[asked.at[own]]
    live = np.flatnonzero(place >= 0)
    if not len(live):
        return None
    values = held[place[live]]
    raw = asked.weight[own][live] @ values
    matched = raw > 0
    scripts = asked.script[own]
    kinds = np.unique(scripts[scripts > 0])
    if bonus and len(kinds) > 1:
        seen = sum((values[scripts[live] == kind] > 0).any(axis=0).astype(int) for kind in kinds)
        raw = raw * (1 + bonus * np.maximum(0, seen - 1))
    score = _rounded(raw)
    extra = asked.added[own][live]
    if extra.any():
        more = extra @ values
        full = _full(asked, q, where, held)
        if full is not None:
            more[full] = 0
        matched |= more > 0
        score = _rounded(score + _rounded(more))
    return np.where(matched, score, np.nan)


class Kept:
    """A task's ``k`` best documents of each of ``queries`` queries by (score desc, doc_id), -inf where there are fewer."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.doc = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray, rounded: Callable, above: float = -np.inf) -> None:
        """Scores (queries ``q`` x documents) above a number; only those that reach a query's least are rounded and sorted."""
        least = self.score[q, -1]
        new = np.flatnonzero(np.isneginf(least))
        bound = least - 2 * 10.0**-PLACES
        if len(new) and score.shape[1] > self.k:
            bound[new] = np.partition(score[new], -self.k, axis=1)[:, -self.k] - 2 * 10.0**-PLACES
        i, j = np.nonzero(score >= np.maximum(bound, np.nextafter(above, np.inf))[:, None])
        if not len(i):
            return
        found = rounded(score[i, j])
        better = (found > least[i]) | ((found == least[i]) & (doc[j] < self.doc[q, -1][i]))
        if better.any():
            self._add(q[i[better]], found[better], doc[j[better]])

    def _add(self, q: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        own = np.unique(q)
        q, score, doc = np.append(np.repeat(own, self.k), q), np.append(self.score[own], score), np.append(self.doc[own], doc)
        # A document may come again: its better row counts.
        order = np.lexsort((-score, doc, q))
        again = (np.diff(q[order], prepend=-1) == 0) & (np.diff(doc[order], prepend=-1) == 0) & (score[order] > -np.inf)
        order = order[~again]
        order = order[np.lexsort((doc[order], -score[order], q[order]))]
        first = np.searchsorted(q[order], own)
        best = order[first[:, None] + np.arange(self.k)]
        self.score[own], self.doc[own] = score[best], doc[best]

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        """(query_id, doc_id, score)."""
        i, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(self.doc[i, j]), pa.array(self.score[i, j])], names=["query_id", "doc_id", "score"])


def _task_sums(batches: Iterator[pa.RecordBatch], asked: Asked, side: Callable, k: int) -> Iterator[pa.RecordBatch]:
    """What :func:`_task_best` gives for queries that are sums of weights not below zero, many queries at a time.

    Queries go by how many of their terms some document at hand holds, so the t-th terms of
    those that have one are added by rows.
    """
    kept = Kept(len(asked.ids), k)
    query = np.repeat(np.arange(len(asked.ids)), np.diff(asked.starts))
    for part, where, held in _blocks(batches, asked, side):
        doc = part.column("doc_id").to_numpy(zero_copy_only=False)
        place = where[asked.at]
        live = np.flatnonzero(place >= 0)
        many = np.bincount(query[live], minlength=len(asked.ids))
        queries = np.argsort(-many, kind="stable")[: np.count_nonzero(many)]
        begin = np.searchsorted(query[live], queries)
        step = max(1, SCORES_AT_ONCE // len(doc))
        buffer = np.empty((step, len(doc)))
        for low in range(0, len(queries), step):
            q = queries[low : low + step]
            score = np.zeros((len(q), len(doc)))
            for t in range(many[q[0]]):
                n = np.searchsorted(-many[q], -t)
                entry = live[begin[low : low + n] + t]
                more = np.take(held, place[entry], axis=0, out=buffer[:n], mode="clip")
                more *= asked.weight[entry][:, None]
                score[:n] += more
            kept.offer(q, score, doc, _rounded, 0.0)
    yield kept.batch(asked.ids)


def _task_best(batches: Iterator[pa.RecordBatch], asked: Asked, side: Callable, k: int, bonus: float) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id, score): each query's ``k`` best of a task's documents by (score desc, doc_id).

    A ``boost`` column multiplies a document's scores; a ``value`` column takes their place.
    """
    queries = len(asked.ids)
    least = np.full(queries, -np.inf)
    held_q, held_s, held_d = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    for part, where, held in _blocks(batches, asked, side):
        doc = part.column("doc_id").to_numpy(zero_copy_only=False)
        names = part.schema.names
        boost = part.column("boost").to_numpy(zero_copy_only=False) if "boost" in names else None
        value = part.column("value").to_numpy(zero_copy_only=False) if "value" in names else None
        found = [(held_q, held_s, held_d)]
        for q in range(queries):
            score = _scores(asked, q, where, held, bonus)
            if score is None:
                continue
            if boost is not None:
                score = _rounded(score * boost)
            if value is not None:
                score = np.where(np.isnan(score), np.nan, value)
            own = np.flatnonzero(score >= least[q])
            if len(own) > k:
                kth = np.partition(score[own], len(own) - k)[len(own) - k]
                own = own[score[own] >= kth]
                if len(own) > k:
                    own = own[np.lexsort((doc[own], -score[own]))[:k]]
            if len(own):
                found.append((np.full(len(own), q), score[own], doc[own]))
        if len(found) > 1:
            held_q, held_s, held_d = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((held_d, -held_s, held_q))
            held_q, held_s, held_d = held_q[order], held_s[order], held_d[order]
            first = np.searchsorted(held_q, np.arange(queries))
            kept = np.arange(len(held_q)) - first[held_q] < k
            last = first + k - 1
            whole = np.flatnonzero((last < len(held_q)) & (np.append(held_q, -1)[np.minimum(last, len(held_q))] == np.arange(queries)))
            least[whole] = held_s[last[whole]]
            held_q, held_s, held_d = held_q[kept], held_s[kept], held_d[kept]
    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[held_q]), pa.array(held_d), pa.array(held_s)], names=["query_id", "doc_id", "score"])


def _task_full(batches: Iterator[pa.RecordBatch], asked: Asked) -> Iterator[pa.RecordBatch]:
    """(query_id, doc_id) of every document with all units of a query."""
    for part, where, held in _blocks(batches, asked, lambda tf, size: tf):
        doc = part.column("doc_id").to_numpy(zero_copy_only=False)
        hits = [(asked.ids[q], doc[full]) for q in range(len(asked.ids)) if (full := _full(asked, q, where, held)) is not None and full.any()]
        if hits:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in hits], [len(d) for _, d in hits])), pa.array(np.concatenate([d for _, d in hits]))], names=["query_id", "doc_id"])


def _task_asked(batches: Iterator[pa.RecordBatch], vocab: pa.Array) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, at, tf = _entries(batch, vocab)
        ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
        lists = {"terms": pa.ListArray.from_arrays(ends, vocab.take(pa.array(at)).cast(pa.string())), "tfs": pa.ListArray.from_arrays(ends, pa.array(tf))}
        yield pa.RecordBatch.from_arrays([lists.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)


def _long(rows: DataFrame) -> DataFrame:
    """``rows`` with a long doc_id, for numpy."""
    return rows.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))


def _each(rows: DataFrame, blocks: list[Asked], task: Callable, schema: str) -> DataFrame:
    out = None
    for asked in blocks:
        shared = rows.sparkSession.sparkContext.broadcast(asked)
        one = rows.mapInArrow(lambda batches, shared=shared: task(batches, shared.value), schema)
        out = one if out is None else out.unionByName(one)
    return rows.sparkSession.createDataFrame([], schema) if out is None else out


def best(rows: DataFrame, blocks: list[Asked], side: Callable, k: int, bonus: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score) with every query's ``k`` best documents and some more.

    ``rows``: (doc_id, size, terms, tfs and, where wanted, boost or value); ``side`` makes a
    weight of a count and its document's size.
    """
    plain = not bonus and not {"boost", "value"} & set(rows.columns) and all((b.weight >= 0).all() and not b.added.any() for b in blocks)
    task = (lambda batches, asked: _task_sums(batches, asked, side, k)) if plain else (lambda batches, asked: _task_best(batches, asked, side, k, bonus))
    return _each(_long(rows), blocks, task, "query_id long, doc_id long, score double")


def full_matches(rows: DataFrame, blocks: list[Asked]) -> DataFrame:
    """(query_id, doc_id) of the documents that hold every unit of a query."""
    sized = rows.select("doc_id", F.lit(0.0).alias("size"), "terms", "tfs")
    return _each(_long(sized), blocks, _task_full, "query_id long, doc_id long")


def only_asked(rows: DataFrame, blocks: list[Asked]) -> DataFrame:
    """``rows`` with the terms that some query has: little is left to exchange."""
    vocab = pc.unique(pa.concat_arrays([b.vocab for b in blocks])) if blocks else pa.array([], pa.string())
    shared = rows.sparkSession.sparkContext.broadcast(vocab)
    return rows.mapInArrow(lambda batches: _task_asked(batches, shared.value), rows.schema)
