"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text teach; a document without a label,
or labelled as not toxic, is unlabelled. The class prior (the share of toxic
documents) is a parameter, or taken from the labels' share.

1. Executors count, over all documents and over the confirmed ones, in how many each
   hashed gram of 4 to 7 bytes of a word (with its ends) occurs. The ratio of both
   counts, corrected for the toxic documents among all by the prior, says how much a
   gram speaks for toxicity.
2. A document becomes ``DIMS`` numbers: how its grams spread over the ratios. A
   confirmed document's own occurrence is taken out of the counts for training.
3. Linear classifiers in numpy minimise the non-negative risk
   ``prior R+(p) + max(0, R-(u) - prior R-(p))``: where the second part falls below
   zero, its gradient is reversed. Several strengths of regularisation are tried on
   folds and the one of the least risk is fitted on all; no negative label is used.
4. Every document is scored on executors from its numbers. Labels, language, source
   and doc_id are no inputs.

The classifier is fitted on a bounded sample: about ``CONFIRMED`` confirmed and
``UNLABELLED`` unlabelled documents, chosen by hashes; the counts, the prior and the
scores cover all rows and whole texts.

Defined cases: null text is empty; an empty text has a score like any other; labels
outside 0 and 1 or of unknown documents are ignored, repeated labels of a document
count by majority (a tie is toxic); rows without doc_id are never held out and never
confirmed; rows that share a doc_id share its label; without a confirmed document, or
with nothing but, every score is the prior (0 without labels); an empty table gives
an empty table; other columns are not read. A word of more than ``BYTES_AT_ONCE``
bytes is cut there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, drop_table, settle, write_table

#: Documents held out of learning: those whose crc32(doc_id) leaves 0 by this.
HELD_OUT = 5
CONFIRMED, UNLABELLED = 5000, 20_000
BITS, SIZES = 18, (4, 5, 6, 7)
BUCKETS, BLOCK = 1 << BITS, 1 << 14
BYTES_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 1 << 13
#: Documents that the ratio of a gram is drawn to even by.
EVEN = 2.0
EDGES = np.array([-1, -0.5, -0.25, 0, 0.25, 0.5, 0.75, 1, 1.25, 1.5, 1.75, 2, 2.5], np.float32)
#: Bins whose counts themselves, not only shares, are numbers of a document.
COUNTED = 4
BINS = len(EDGES) + 1
DIMS = BINS + (BINS - COUNTED) + 3
STRENGTHS, FOLDS, STEPS, RATE = (1e-3, 1e-2, 1e-1), 4, 400, 0.02


def _letters() -> np.ndarray:
    """Lower-cased letters and bytes of other scripts; anything else ends a word."""
    out = np.full(256, 32, np.uint8)
    out[97:123] = out[65:91] = np.arange(97, 123)
    out[128:] = np.arange(128, 256)
    return out


_LETTER = _letters()


def _pieces(raw: bytes) -> list[np.ndarray]:
    """A text's letters, with a blank at both ends, in pieces that end at blanks."""
    a = np.empty(len(raw) + 2, np.uint8)
    a[0] = a[-1] = 32
    a[1:-1] = _LETTER[np.frombuffer(raw, np.uint8)]
    out, at = [], 0
    while len(a) - at > BYTES_AT_ONCE:
        blank = np.flatnonzero(a[at + 1 : at + BYTES_AT_ONCE] == 32)
        end = at + 1 + int(blank[-1]) if len(blank) else at + BYTES_AT_ONCE - 1
        out.append(a[at : end + 1])
        at = end
    return [*out, a[at:]]


def _grouped(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[np.ndarray], bool]]:
    """(rows, pieces, whole): some rows with all their text, or one with a piece of it."""
    rows, held, size = [], [], 0
    for row, raw in enumerate(texts):
        own = _pieces(raw or b"")
        if len(own) > 1:
            yield from (([row], [p], False) for p in own)
            continue
        if size + len(own[0]) > BYTES_AT_ONCE or len(rows) == ROWS_AT_ONCE:
            yield rows, held, True
            rows, held, size = [], [], 0
        rows.append(row)
        held += own
        size += len(own[0])
    if rows:
        yield rows, held, True


def grams_by_size(pieces: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(piece, bucket) of every gram of each size, in order: bytes of one word, a blank before and after it included."""
    a = np.concatenate(pieces)
    of = np.repeat(np.arange(len(pieces), dtype=np.uint32), [len(p) for p in pieces])
    blank = a == 32
    h, inner = a.astype(np.uint32), np.zeros(len(a), bool)
    out = []
    for n in range(2, max(SIZES) + 1):
        m = len(a) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ a[n - 1 :]
        inner = inner[:m] | blank[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        if n in SIZES:
            own = np.flatnonzero(~inner)
            g = h[own]
            g = (g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            out.append((of[own], g >> np.uint32(32 - BITS)))
    return out


def grams(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, bucket) of every gram of all sizes."""
    none = np.zeros(0, np.uint32)
    made = [(none, none), *grams_by_size(pieces)]
    return np.concatenate([w for w, _ in made]), np.concatenate([b for _, b in made])


def _document_counts(texts: list[bytes | None], flags: np.ndarray, all_: np.ndarray, confirmed: np.ndarray) -> None:
    """Add each document once to the counts of its grams.

    ``stamp`` holds, for each bucket, the number of the last gram that fell in it:
    a gram is its document's first of a bucket if no gram of the document did before
    (its stamp is older than the document) and it is the one whose number stayed. So
    no document is sorted.
    """
    stamp, number, since, last = np.full(BUCKETS, -1, np.int64), 0, 0, -1
    for rows, pieces, _ in _grouped(texts):
        sizes = [(bucket, np.searchsorted(which, np.arange(len(rows) + 1)).tolist()) for which, bucket in grams_by_size(pieces)]
        for k, row in enumerate(rows):
            if row != last:  # else another piece of the same document
                last, since = row, number
            for bucket, at in sizes:
                own = bucket[at[k] : at[k + 1]]
                own = own[stamp[own] < since]
                mine = np.arange(number, number + len(own))
                stamp[own] = mine
                own = own[stamp[own] == mine]
                number += len(mine)
                all_[own] += 1
                if flags[row]:
                    confirmed[own] += 1


def ratios(confirmed: np.ndarray, all_: np.ndarray, n_confirmed: int, n_all: int, prior: float) -> np.ndarray:
    """Log ratio of a gram's confirmed documents to those expected of clean ones."""
    clean = np.maximum(0, all_ - prior * n_all / n_confirmed * confirmed) / (1 - prior)
    return np.log((confirmed + EVEN) / (clean * (n_confirmed / n_all) + EVEN)).astype(np.float32)


def numbers(texts: list[bytes | None], tables: list[np.ndarray], which_table: np.ndarray) -> np.ndarray:
    """The numbers of each text, by the ratios of its table."""
    bins = [np.searchsorted(EDGES, t).astype(np.int32) for t in tables]
    good = [np.maximum(t, 0) for t in tables]
    square_of = [t * t for t in good]
    spread, top, square = np.zeros((len(texts), BINS)), np.zeros(len(texts)), np.zeros(len(texts))
    for rows, pieces, _ in _grouped(texts):
        rows = np.array(rows)
        for which, bucket in grams_by_size(pieces):
            for k in np.unique(which_table[rows]).tolist():
                own = slice(None) if len(tables) == 1 else which_table[rows][which] == k
                w, b = which[own].astype(np.int32), bucket[own]
                if not len(w):
                    continue
                spread[rows] += np.bincount(w * np.int32(BINS) + bins[k][b], minlength=len(rows) * BINS).reshape(-1, BINS)
                starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))  # grams come in the order of their documents
                at = rows[w[starts]]
                square[at] += np.add.reduceat(square_of[k][b], starts, dtype=np.float64)
                top[at] = np.maximum(top[at], np.maximum.reduceat(good[k][b], starts))
    n = spread.sum(1)
    shares, counts = np.sqrt(spread / (n + 20)[:, None]), np.log1p(spread[:, COUNTED:]) / 5
    return np.column_stack((shares, counts, top, square / (n + 20) * 5, np.log1p(n) / 10)).astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def non_negative(p: np.ndarray, u: np.ndarray, prior: float, strength: float, steps: int = STEPS) -> np.ndarray:
    """Weights (bias last) that minimise the non-negative risk of logistic losses, by Adam steps."""
    w = np.append(np.zeros(p.shape[1]), np.log(prior / (1 - prior)))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if clean >= 0:
            gp, gu = np.full(len(p), -prior / len(p)), sigmoid(zu) / len(u)  # of prior R+(p) - prior R-(p): the losses' slopes differ by 1
        else:
            gp, gu = prior * sigmoid(zp) / len(p), -sigmoid(zu) / len(u)
        g = np.append(gp @ p + gu @ u + strength * w[:-1], gp.sum() + gu.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> float:
    """Non-negative estimate of the share of wrong decisions."""
    missed, called = (p @ w[:-1] + w[-1] < 0).mean(), (u @ w[:-1] + w[-1] >= 0).mean()
    return prior * missed + max(0.0, called - prior * (1 - missed))


@dataclass
class Model:
    """Ratios of the grams, the scale of the numbers, and the classifier's weights."""

    ratios: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])


def train(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) from the numbers of confirmed and unlabelled documents."""
    mean, scale = u.mean(0), u.std(0) + 1e-3
    p, u = ((x - mean) / scale for x in (p.astype(np.float64), u.astype(np.float64)))
    strength = STRENGTHS[len(STRENGTHS) // 2]
    if min(len(p), len(u)) >= 2 * FOLDS:
        fold_p, fold_u = np.arange(len(p)) % FOLDS, np.arange(len(u)) % FOLDS
        made = {s: [non_negative(p[fold_p != k], u[fold_u != k], prior, s, STEPS // 2) for k in range(FOLDS)] for s in STRENGTHS}
        off = {s: np.mean([risk(w, p[fold_p == k], u[fold_u == k], prior) for k, w in enumerate(made[s])]) for s in STRENGTHS}
        strength = min(STRENGTHS, key=lambda s: (off[s], -s))  # of equals the strongest
    return mean, scale, non_negative(p, u, prior, strength)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _below(share: float) -> int:
    """The bound on signed 64-bit hashes that this share of them is below."""
    return 2**63 - 1 if share >= 1 else int(share * 2**64) - 2**63


@dataclass
class Fitted:
    """A model, and the written numbers of all documents that it was fitted with."""

    model: Model | float
    numbers: DataFrame


def _confirmed(labels: DataFrame) -> tuple[list[int], float]:
    """Ids of confirmed toxic documents, about ``CONFIRMED`` at most, and the share of toxic ones among the labelled."""
    votes = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    votes = votes.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("toxic") >= 0.5).alias("toxic"))
    n, toxic = votes.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0))).first()
    chosen = votes.where("toxic").where(F.xxhash64(F.lit(13), "id") <= _below(CONFIRMED / max(1, toxic))).select("id")
    return sorted(r["id"] for r in chosen.collect()), toxic / n if n else 0.0


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Documents of each gram (confirmed, all), and confirmed and all documents."""
    spark = rows.sparkSession
    fields = [("block", pa.int32()), ("confirmed", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())]

    def count(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, n = [np.zeros(BUCKETS, np.int64) for _ in range(2)], [0, 0]
        for batch in given:
            flags = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            _document_counts(batch.column(0).to_pylist(), flags, *tables)
            n = [n[0] + len(flags), n[1] + int(flags.sum())]
        out = [(b, k, n[k] if b == 0 else 0, t[b * BLOCK : (b + 1) * BLOCK]) for k, t in enumerate(tables) for b in range(BUCKETS // BLOCK)]
        out = [(b, k, m, t.astype("<i8" if t.max() >> 31 else "<i4").tobytes()) for b, k, m, t in out if m or t.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f[1]) for i, f in enumerate(fields)], schema=pa.schema(fields))

    def add(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in given:
            for b, k, m, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault((b, k), [0, np.zeros(BLOCK, np.int64)])
                own[0] += m
                own[1] += np.frombuffer(raw, "<i8" if len(raw) == 8 * BLOCK else "<i4")
        out = [(b, k, m, t.tobytes()) for (b, k), (m, t) in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f[1]) for i, f in enumerate(fields)], schema=pa.schema(fields))

    schema = "block int, confirmed long, n long, counts binary"
    path = write_table(rows.select("text", "confirmed").mapInArrow(count, schema), "gram-counts")
    tables, n = [np.zeros(BUCKETS, np.int64) for _ in range(2)], [0, 0]
    with batches_of(spark, 64):  # a row is a block of counts
        # Blocks are added up as they stream; two tables of fixed size come back.
        for r in spark.read.schema(schema).parquet(path).repartition(BUCKETS // BLOCK, "block").mapInArrow(add, schema).collect():
            raw, k = r["counts"], r["confirmed"]
            tables[k][r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(raw, np.int64)
            n[k] += r["n"]
    drop_table(spark, path)
    return tables[1], tables[0], n[1], n[0]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _numbers(rows: DataFrame, tables: list[np.ndarray]) -> DataFrame:
    """(doc_id, confirmed, training, scoring, h, x): the numbers of each row, and once more
    for training, without itself in the counts, of each confirmed one."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)  # two tables of fixed size

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            doc, text, flag, h = (batch.column(i) for i in range(4))
            own = np.asarray(flag.to_numpy(zero_copy_only=False), bool)
            at = np.append(np.arange(len(own)), np.flatnonzero(own))
            again = np.arange(len(at)) >= len(own)
            texts = text.to_pylist()
            x = numbers([texts[i] for i in at.tolist()], shared.value, again.astype(np.int64))
            take = pa.array(at)
            columns = [doc.take(take), flag.take(take), pa.array(again | ~own[at]), pa.array(~again), h.take(take), pa.array([v.tobytes() for v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "confirmed", "training", "scoring", "h", "x"])

    made = rows.withColumn("h", F.xxhash64(F.lit(17), "doc_id", "text")).mapInArrow(run, "doc_id long, confirmed boolean, training boolean, scoring boolean, h long, x binary")
    return settle(made, "toxicity-numbers")


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Fitted:
    """Learn from the confirmed documents that are not held out, and from all documents as unlabelled ones."""
    spark = docs.sparkSession
    ids, share = _confirmed(labels)
    prior = share if prior is None else prior
    chosen = spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64())})).withColumn("confirmed", F.lit(True))
    rows = _rows(docs)
    rows = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["id"], "left").select("doc_id", "text", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    confirmed, all_, n_confirmed, n_all = _counts(rows) if ids and 0 < prior < 1 else (None, None, 0, 0)
    if not n_confirmed:
        return Fitted(float(prior), rows.select("doc_id"))
    # A confirmed document's own grams are one fewer in both counts.
    tables = [ratios(confirmed, all_, n_confirmed, n_all, prior), ratios(np.maximum(confirmed - 1, 0), np.maximum(all_ - 1, 0), max(1, n_confirmed - 1), n_all, prior)]
    made = _numbers(rows, tables)
    seen = made.where("training").where(F.col("confirmed") | (F.col("h") <= _below(UNLABELLED / n_all)))
    # About CONFIRMED + UNLABELLED rows of DIMS numbers.
    got = seen.select("confirmed", (F.col("h") <= _below(UNLABELLED / n_all)).alias("drawn"), "h", "x").toPandas().sort_values(["h", "x"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, DIMS)
    mean, scale, weights = train(x[got["confirmed"].to_numpy(bool)], x[got["drawn"].to_numpy(bool)], prior)
    return Fitted(Model(tables[0], mean, scale, weights), made)


def _judged(score: Column) -> list[Column]:
    return ["doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")]


def _scored(rows: DataFrame, model: Model, column: str, table: list[np.ndarray] | None) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((model, table))  # of fixed size

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            model, table = shared.value
            own = batch.column(1).to_pylist()
            x = numbers(own, table, np.zeros(len(own), np.int64)) if table else np.frombuffer(b"".join(own), np.float32).reshape(-1, DIMS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x), pa.float64())], names=["doc_id", "score"])

    return rows.select("doc_id", column).mapInArrow(run, "doc_id long, score double")


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of any documents."""
    rows = _rows(docs)
    if isinstance(model, float):
        return rows.select(*_judged(F.lit(model)))
    return _scored(rows, model, "text", [model.ratios]).select(*_judged(F.col("score")))


def score_fitted(fitted: Fitted) -> DataFrame:
    """:func:`score` of the documents that the model was fitted with, from their written numbers."""
    if isinstance(fitted.model, float):
        return fitted.numbers.select(*_judged(F.lit(fitted.model)))
    return _scored(fitted.numbers.where("scoring"), fitted.model, "x", None).select(*_judged(F.col("score")))
