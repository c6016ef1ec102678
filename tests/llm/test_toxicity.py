"""Toxicity: grams and numbers against plain Python, the risk's steps, held-out labels."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import toxicity as tox

DOCS = "doc_id long, text string, score double, label int"


def words(text):
    raw = (text or "").encode()
    kept = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in raw)
    return kept.decode("latin-1").split()


def plain_grams(text):
    """Every gram of 4 to 7 bytes of each word with a blank at both ends, hashed one by one."""
    out = []
    for w in words(text):
        w = [32, *w.encode("latin-1"), 32]
        for n in tox.SIZES:
            for i in range(len(w) - n + 1):
                h = w[i]
                for x in w[i + 1 : i + n]:
                    h = ((h * 0x01000193) & 0xFFFFFFFF) ^ x
                h = ((h ^ (h >> 15)) * (0x85EBCA6B + 2 * n)) & 0xFFFFFFFF
                out.append(h >> (32 - tox.BITS))
    return out


def texts():
    rng = random.Random(5)
    syllables = ["ba", "re", "ti", "é", "ß", "秘", "on", " ", " ", " ", "\n", "1", ".", "X"]
    return [None, "", " ", "a", "ab cd", "ÄÖ", *("".join(rng.choices(syllables, k=rng.randint(1, 80))) for _ in range(60)), "word " * 400, "x" * 900]


@pytest.mark.parametrize("bytes_at_once,rows_at_once", [(1 << 20, 1 << 13), (150, 3)])
def test_counts_and_numbers_equal_plain_python(monkeypatch, bytes_at_once, rows_at_once):
    monkeypatch.setattr(tox, "BYTES_AT_ONCE", bytes_at_once)
    monkeypatch.setattr(tox, "ROWS_AT_ONCE", rows_at_once)
    own = texts()[: -1 if bytes_at_once == 150 else None]  # the last is one word longer than a piece
    flags = np.arange(len(own)) % 3 == 0
    all_, confirmed = np.zeros(tox.BUCKETS, np.int64), np.zeros(tox.BUCKETS, np.int64)
    tox._document_counts([None if t is None else t.encode() for t in own], flags, all_, confirmed)
    want, want_confirmed = Counter(), Counter()
    for t, f in zip(own, flags, strict=True):
        want.update(set(plain_grams(t)))
        want_confirmed.update(set(plain_grams(t)) if f else ())
    assert {i: int(all_[i]) for i in np.flatnonzero(all_)} == want
    assert {i: int(confirmed[i]) for i in np.flatnonzero(confirmed)} == want_confirmed
    table = tox.ratios(confirmed, all_, int(flags.sum()), len(own), 0.2)
    got = tox.numbers([None if t is None else t.encode() for t in own], [np.zeros_like(table), table], np.ones(len(own), np.int64))
    for row, t in zip(got, own, strict=True):
        r = [table[g] for g in plain_grams(t)]
        spread = np.bincount(np.searchsorted(tox.EDGES, np.array(r, np.float32)), minlength=tox.BINS)
        positive = [max(0.0, float(x)) for x in r]
        want = [*np.sqrt(spread / (len(r) + 20)), *(np.log1p(spread[tox.COUNTED :]) / 5), max(positive, default=0), sum(x * x for x in positive) / (len(r) + 20) * 5, math.log1p(len(r)) / 10]
        assert np.allclose(row, want, atol=1e-4)
    g = int(np.argmax(confirmed))
    clean = max(0.0, all_[g] - 0.2 * len(own) / flags.sum() * confirmed[g]) / 0.8
    assert math.isclose(table[g], math.log((confirmed[g] + tox.EVEN) / (clean * flags.sum() / len(own) + tox.EVEN)), rel_tol=1e-5)


def test_risk_falls_and_stays_non_negative():
    rng = np.random.default_rng(2)
    prior, p = 0.3, rng.normal(1.5, 1, (150, 4))
    toxic = rng.random(3000) < prior
    u = np.where(toxic[:, None], rng.normal(1.5, 1, (3000, 4)), rng.normal(-0.5, 1, (3000, 4)))
    w = tox.non_negative(p, u, prior, 1e-2)
    called = u @ w[:-1] + w[-1] >= 0
    assert (called == toxic).mean() > 0.93
    assert 0 <= tox.risk(w, p, u, prior) < 0.1
    # Where few confirmed documents could be told apart by chance, the unlabelled part of the risk would fall far below zero.
    wide_p, wide_u = rng.normal(0, 1, (20, 60)), rng.normal(0, 1, (400, 60))
    w = tox.non_negative(wide_p, wide_u, prior, 1e-3)
    clean = np.logaddexp(0, wide_u @ w[:-1] + w[-1]).mean() - prior * np.logaddexp(0, wide_p @ w[:-1] + w[-1]).mean()
    assert clean > -0.2


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


@pytest.fixture(scope="module")
def fitted(spark):
    return tox.fit(table(spark, "documents"), table(spark, "labels"))


def test_held_out_labels_and_planted_documents(spark, fitted):
    out = tox.score_fitted(fitted)
    rows = out.collect()
    assert len(rows) == table(spark, "documents").count() and out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, "labels").collect()}
    own = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = ([s for s, y in own if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.8
    # New documents score as they would in the corpus; a word of the confirmed ones is caught in clean text.
    again = {r["doc_id"]: r["score"] for r in tox.score(table(spark, "documents"), fitted.model).collect()}
    assert all(math.isclose(again[r["doc_id"]], r["score"], abs_tol=1e-6) for r in rows)
    plain = "The reer thon ering thatnd eron, and in the hener ation. " * 3
    new = spark.createDataFrame([(1, plain, 0.0, 0), (2, plain + "This idiot and moron is pathetic scum, worthless trash.", 0.0, 0)], DOCS)
    made = {r["doc_id"]: r["predicted"] for r in tox.score(new, fitted.model).collect()}
    assert made == {1: 0, 2: 1}


def test_held_out_labels_teach_nothing(spark, fitted):
    labels = table(spark, "labels")
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = tox.fit(table(spark, "documents"), other)
    assert np.array_equal(again.model.ratios, fitted.model.ratios) and np.allclose(again.model.weights, fitted.model.weights)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(i, t, 1.0, 0) for i, t in enumerate(texts())] + [(None, "no id", 1.0, 0), (3, "twice", 1.0, 0), (3, "twice", 1.0, 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = tox.score_fitted(tox.fit(docs, none)).collect()
    assert len(out) == docs.count() and {r["score"] for r in out} == {0.0}
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (3, 1, 1), (7, 1, 1), (2, 1, 0), (8, 1, 5), (None, 1, 1), (4000, 1, 1), (6, 0, 0), (9, 1, None)], "doc_id long, quality int, toxic int")
    out = tox.score_fitted(tox.fit(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    only = spark.createDataFrame([(1, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in tox.score_fitted(tox.fit(docs, only)).collect()} == {1.0}
    assert tox.score_fitted(tox.fit(spark.createDataFrame([], DOCS), labels)).count() == 0
    assert tox.score_fitted(tox.fit(docs, labels, prior=0.3)).count() == docs.count()
