"""Quality classifier by co-training on two views of a document.

* text view: hashed byte trigrams of the whole text, and how often words recur
  a few words later;
* page view: source, language, stored size (how far the text compresses) and
  layout counts (lines, characters, shares of capitals, digits and symbols), none
  of which look at what the text says.

Both views start from the same labelled rows. In each round both score every
unlabelled row on the executors, and each labels those it is surest of, in the
proportions of the labels, for the other one. Scores are calibrated on held-out
labelled rows, which also weigh the two views in the combined score; the weights
are drawn towards equal ones and neither falls below ``LEAST_WEIGHT``, so both
views count. All documents are scored on executors.

The driver fits on bounded sets: ``LABELLED`` labelled rows, chosen by a hash of
doc_id, and at most ``TAUGHT`` rows a view and round, the surest of all; everything
else covers every row and whole texts.

Defined cases: null text is empty; null source or language is its own value;
labels outside 0 and 1 or of unknown documents are ignored, repeated labels of a
document count by majority (a tie is 1); without both classes among the labels
every document gets the prior (1.0 without labels) and is kept; rows without
doc_id teach nothing, and of rows that share one only that of the least text
hash teaches; all are scored row by row; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LABELLED, HELD_OUT = 5000, 0.25
#: Rounds of exchange, and the rows that each view labels for the other in one: a share of all, and at most so many.
ROUNDS, SHARE, TAUGHT = 2, 0.025, 400
#: How strongly the views' weights are drawn to equal ones, and the least weight.
PULL, LEAST_WEIGHT = 0.02, 0.15
#: Rows are rejected below this probability of being good.
THRESHOLD = 0.5
TRIGRAMS, SLOTS = 1 << 11, 64
LAGS = (1, 2, 3, 4, 6, 8)
DIMS = TRIGRAMS + len(LAGS)
LAYOUT = 11
L2 = 1e-5
#: Characters and words of ordinary text that the shares of a short text are mixed with.
SOFT_CHARS, SOFT_WORDS = 100, 20


def text_view(text: str | None) -> np.ndarray:
    """Square roots of hashed byte-trigram shares, then word recurrence at each lag."""
    raw = (text or "").encode("utf-8", "replace")
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(TRIGRAMS)
    for s in range(0, len(a) - 2, 1 << 20):
        b = a[s : s + (1 << 20) + 2]
        h = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(21), minlength=TRIGRAMS)
    words = np.fromiter(map(hash, raw.split()), np.int64)
    again = [(words[k:] == words[:-k]).sum() / (len(words) + SOFT_WORDS) for k in LAGS]
    return np.concatenate((np.sqrt(out / (out.sum() + SOFT_CHARS)), again)).astype(np.float32)


def _slot(value, salt: int) -> int:
    return LAYOUT + zlib.crc32(f"{salt}:{value}".encode()) % (SLOTS - LAYOUT)


def page_view(text: str | None, source, lang) -> np.ndarray:
    """Layout counts, and hashed indicators of the source and language."""
    out = np.zeros(SLOTS, np.float32)
    a = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = len(a) + SOFT_CHARS
    c = np.bincount(a, minlength=256)
    letters, capitals = c[97:123].sum() + c[65:91].sum() + c[128:].sum(), c[65:91].sum()
    lines = c[10] + 1
    raw = a.tobytes()
    stored = (len(zlib.compress(raw, 1)) + SOFT_CHARS / 2) / n
    plain = letters + c[48:58].sum() + c[9:14].sum() + c[32] + c[44] + c[46]
    out[:LAYOUT] = (
        1.0, np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 5, capitals / (letters + SOFT_CHARS), c[48:58].sum() / n,
        (len(a) - plain) / n, c[32] / n, (c[33] + c[63]) / n,
        2 * stored, np.log(stored),
    )
    out[_slot(source, 1)] += 0.3
    out[_slot(lang, 2)] += 0.3
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float | np.ndarray, steps: int = 300, prior: np.ndarray | float = 0.0, least: np.ndarray | None = None) -> np.ndarray:
    """Weights (bias last) of a class-balanced logistic regression, by Nesterov steps.

    They are drawn to ``prior`` and kept at or above ``least``.
    """
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(x.dtype)
    rate = 1 / (0.25 * float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + np.max(l2))
    w = ahead = np.zeros(x.shape[1] + 1, x.dtype)
    for i in range(steps):
        off = weight * (sigmoid(_score(x, ahead)) - y).astype(x.dtype)
        grad = np.append(x.T @ off, off.sum()) + l2 * (ahead - prior)
        new = ahead - rate * grad
        if least is not None:
            new = np.maximum(new, least)
        ahead = new + (i / (i + 3)) * (new - w)
        w = new
    return w


def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class Model:
    """Weights of both views, their calibrations (slope, offset), and the
    weights of the calibrated views in the combination (text, page, offset)."""

    text: np.ndarray
    page: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]]
    mix: tuple[float, float, float]

    def views(self, text, source, lang) -> tuple[float, float]:
        """Calibrated log-odds of the text and page views."""
        made = zip((text_view(text), page_view(text, source, lang)), (self.text, self.page), self.calibration, strict=True)
        return tuple(float(np.clip(_score(x, w) * c[0] + c[1], -6, 6)) for x, w, c in made)

    def score(self, text, source, lang) -> tuple[float, float, float]:
        a, b = self.views(text, source, lang)
        return float(sigmoid(a)), float(sigmoid(b)), float(sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2]))


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A slope and offset that turn scores into log-odds (targets smoothed as Platt does)."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b, size = 1.0, 0.0, max(1e-6, float(np.abs(score).mean()))
    s = score / size
    for _ in range(100):  # Newton
        p = sigmoid(a * s + b)
        g = np.array([((p - target) * s).sum(), (p - target).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * s * s).sum() + 1e-3, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0) / size), float(b)


def combination(odds: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of the two views' log-odds, and the offset."""
    made = logistic(odds, y.astype(float), np.array([PULL, PULL, 1e-3]), 2000, np.array([0.5, 0.5, 0.0]), np.array([LEAST_WEIGHT, LEAST_WEIGHT, -np.inf]))
    return tuple(float(x) for x in made)


def calibrated(weights: list[np.ndarray], held: list[np.ndarray], held_y: np.ndarray) -> Model:
    """The model of two views' weights, calibrated and combined on held-out rows."""
    calibration = tuple(_platt(_score(x, w), held_y) for x, w in zip(held, weights, strict=True))
    odds = np.stack([np.clip(_score(x, w) * c[0] + c[1], -6, 6) for x, w, c in zip(held, weights, calibration, strict=True)], 1)
    return Model(weights[0], weights[1], calibration, combination(odds, held_y))


def _column(docs: DataFrame, name: str):
    return F.col(name) if name in docs.columns else F.lit(None).cast("string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select("doc_id", "text", _column(docs, "source").alias("source"), _column(docs, "lang").alias("lang"))


def features(docs: DataFrame, chosen: DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(id, text view, page view) on the driver, one row an id; ``chosen``: some thousand ids."""
    own = _rows(docs).join(F.broadcast(chosen.select("id")), F.col("doc_id") == F.col("id"))
    own = own.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "source", "lang")).alias("r")).select("id", "r.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(zip(pdf["text"], pdf["source"], pdf["lang"], strict=True))
            yield pd.DataFrame({"id": pdf["id"], "t": [text_view(t).astype(np.float16).tobytes() for t, _, _ in rows], "p": [page_view(*x).tobytes() for x in rows]})

    made = settle(own.mapInPandas(run, "id long, t binary, p binary"), "features")
    # As many rows as were chosen, of fixed size; they come one file at a time.
    return ((r["id"], np.frombuffer(r["t"], np.float16), np.frombuffer(r["p"], np.float32)) for r in made.toLocalIterator())


def view_scores(docs: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    """(id, text, page): both views' scores of every id, uncalibrated."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # two vectors of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [float(_score(text_view(t), shared.value[0])) for t in pdf["text"]]
            page = [float(_score(page_view(*x), shared.value[1])) for x in zip(pdf["text"], pdf["source"], pdf["lang"], strict=True)]
            yield pd.DataFrame({"id": pdf["doc_id"], "h": pdf["h"], "text": text, "page": page})

    made = _rows(docs).withColumn("h", F.xxhash64("text")).mapInPandas(run, "id long, h long, text double, page double")
    return made.groupBy("id").agg(F.min(F.struct("h", "text", "page")).alias("r")).select("id", "r.text", "r.page")


def surest(free: DataFrame, view: str, good: float, taught: int) -> list[tuple[int, float]]:
    """(id, label) of the rows that a view is surest of, in the proportions of the labels."""
    order = [_rank(F.col("id")), "id"]
    low = free.where(F.col(view) < 0).orderBy(F.col(view), *order).limit(round(taught * (1 - good)))
    high = free.where(F.col(view) > 0).orderBy(F.col(view).desc(), *order).limit(round(taught * good))
    return [(r["id"], 0.0) for r in low.collect()] + [(r["id"], 1.0) for r in high.collect()]


def _rank(col):
    return F.xxhash64(F.lit(11), col)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, share: float = SHARE, taught: int = TAUGHT) -> Model | float:
    """The model, or the prior where the labels hold fewer than two classes."""
    spark = docs.sparkSession
    votes = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").alias("q"))
    known = _rows(docs).select(F.col("doc_id").alias("id")).distinct().join(votes, "id").select("id", (F.col("q") >= 0.5).cast("int").alias("y"))
    # A sample of fixed size, whatever the table: the smallest hashes.
    sample = [(r["id"], r["y"]) for r in known.orderBy(_rank(F.col("id")), "id").limit(labelled).collect()]
    held = [x for i, x in enumerate(sample) if i % round(1 / HELD_OUT) == 0]
    seen = [x for i, x in enumerate(sample) if i % round(1 / HELD_OUT)]
    if any(len({y for _, y in part}) < 2 for part in (held, seen)):
        return float(np.mean([y for _, y in sample])) if sample else 1.0

    # Rows are held out, labelled, taught; both views have room for all that will be taught.
    n = len(sample)
    views = [np.zeros((n + rounds * taught, width), np.float32) for width in (DIMS, SLOTS)]
    ys = [np.array([y for _, y in held + seen] + [0] * (rounds * taught), np.float32) for _ in views]
    upto = [n, n]

    def fill(to: list[dict[int, int]]) -> None:
        """Put the features of ids in their rows of each view as they come."""
        ids = pa.table({"id": pa.array(sorted(to[0].keys() | to[1].keys()), pa.int64())})
        for i, *own in features(docs, spark.createDataFrame(ids)):
            for k in (0, 1):
                if i in to[k]:
                    views[k][to[k][i]] = own[k]

    def fitted() -> list[np.ndarray]:
        return [logistic(views[k][len(held) : upto[k]], ys[k][len(held) : upto[k]], L2) for k in (0, 1)]

    fill([{i: at for at, (i, _) in enumerate(held + seen)}] * 2)
    good, gone, weights = float(ys[0][len(held) : n].mean()), set(), fitted()
    for _ in range(rounds):
        scores = settle(view_scores(docs, weights).join(votes, "id", "left_anti"), "view-scores")
        free = scores.where(~F.col("id").isin(sorted(gone))) if gone else scores  # at most 2 * TAUGHT a round
        most = min(taught, int(np.ceil(free.count() * share)))
        picked = [surest(free, view, good, most) for view in ("text", "page")]
        if not any(picked):
            break
        to: list[dict[int, int]] = [{}, {}]
        for k, own in enumerate(picked):  # what one view is sure of teaches the other
            for i, y in own:
                to[1 - k][i], ys[1 - k][upto[1 - k]] = upto[1 - k], y
                upto[1 - k] += 1
        gone |= to[0].keys() | to[1].keys()
        fill(to)
        weights = fitted()
    return calibrated(weights, [v[: len(held)] for v in views], ys[0][: len(held)])


def score(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_text, p_page, p_good, keep) for every row."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # two weight vectors of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            own = zip(pdf["text"], pdf["source"], pdf["lang"], strict=True)
            made = [(model, model, model) if isinstance(model, float) else model.score(*x) for x in own]
            out = pd.DataFrame(made, columns=["p_text", "p_page", "p_good"], dtype="float64")
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            out["keep"] = out["p_good"] >= threshold if not isinstance(model, float) else True
            yield out.astype({"keep": bool})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _column(docs, "source").alias("source"), _column(docs, "lang").alias("lang"))
    return rows.mapInPandas(run, "doc_id long, p_text double, p_page double, p_good double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the combined classifier rejects."""
    model = fit(docs, labels)
    if isinstance(model, float):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = {c: docs.columns.index(c) if c in docs.columns else None for c in ("text", "source", "lang")}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(i).to_pylist() if i is not None else [None] * batch.num_rows for i in at.values()]
            yield batch.filter(pa.array([shared.value.score(*x)[2] >= threshold for x in zip(*cols, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
