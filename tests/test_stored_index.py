"""The stored index after refreshes against a rebuild, and the vault's searches through it."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.api import Vault
from marginalia.operators import store

WORDS = "tea bread river stone garden copper paper winter".split()


def tables(idx):
    return {
        "post": sorted((r.doc_id, r.term, r.tf) for r in idx.post.collect()), "lengths": sorted((r.doc_id, r.doclen) for r in idx.lengths.collect()),
        "dfs": sorted((r.term, r.df) for r in idx.dfs.collect()), "stats": [tuple(r) for r in idx.stats.collect()],
    }


def test_refreshes_equal_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(store, "MOST_DELTAS", 2)
    rng = random.Random(1)
    text = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))
    frame = lambda rows: spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")
    docs = {i: text() for i in range(12)}
    idx = store.build(frame(docs))
    for n in range(3):
        changed = {i: text() for i in rng.sample(range(16), 3)} | {rng.randrange(16): None, 99: None}
        docs = {i: t for i, t in (docs | changed).items() if t is not None}
        idx = store.refresh(idx, frame(changed))
        assert idx.deltas == (0 if n == 1 else 1)
        assert tables(idx) == tables(store.build(frame(docs)))


def test_ids_are_checked(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string")
    for bad in (twice, twice.limit(1).withColumn("doc_id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError, match="doc_id"):
            store.build(bad)
        with pytest.raises(ValueError, match="doc_id"):
            store.refresh(store.build(twice.limit(0)), bad)


def test_the_vault_searches_its_stored_index(spark, monkeypatch):
    builds = []
    build = store.build
    monkeypatch.setattr(store, "build", lambda *a: builds.append(1) or build(*a))
    v = Vault.empty(spark).remember("Tea", "green tea in winter", "2024-01-01").remember("Stone", "copper and stone", "2024-01-02")
    now = "2024-06-01 00:00:00"
    assert [h.key for h in v.search("winter tea", now).collect()] == ["tea"]
    later = v.remember("River", "a winter river", "2024-01-03").remember("Tea", "black tea", "2024-01-04", expected=1)
    assert [h.key for h in later.search("winter", now).collect()] == ["river"] and [h.key for h in later.search("tea", now).collect()] == ["tea"]
    assert [h.key for h in v.search("winter", now).collect()] == ["tea"]
    gone, _ = later.forget("stone", now)
    assert gone.search("copper", now).collect() == [] and [h.key for h in gone.search("copper", now, include_archive=True).collect()] == ["stone"]
    assert len(builds) == 1
