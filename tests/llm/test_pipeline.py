"""The pipeline's stages against plain Python, on a small table with planted cases."""

from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__
from tests.llm.test_decontamination_cotraining import normal, words
from tests.llm.test_packing_dedup_simhash import DOCS, brute_lines, edited


def planted(tmp_path, spark):
    rng = random.Random(9)
    clean = [words(rng, 120) + "." for _ in range(300)]
    passages = [words(rng, 20) for _ in range(6)]
    line = "a line that is found in very many documents of the table"
    texts = {"clean": clean, "junk": [" ".join(w.upper() + "!!" for w in words(rng, 60).split()) for _ in range(60)]}
    texts["near"] = [edited(rng, clean[i], 2) for i in range(20)]
    texts["copy"] = clean[20:30]
    texts["leak"] = [f"{words(rng, 60)} {passages[i % 6]} {words(rng, 60)}." for i in range(12)]
    texts["lined"] = [f"{words(rng, 80)}.\n{line}" for _ in range(10)]
    rows, kind, labels = [], {}, []
    for k, own in texts.items():
        for t in own:
            i = len(rows)
            rows.append((i, t, "en", f"src{i % 3}", len(t)))
            kind[i] = k
            if i % 2 == 0:
                labels.append((i, int(k != "junk"), 0))
    d = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, kind, passages


def test_stages(tmp_path, spark):
    d, rows, kind, passages = planted(tmp_path, spark)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    schema, at = docs.schema, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        if name != "packing":
            assert docs.schema == schema
        docs.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        at[name] = docs.collect()
    ids = {name: {r.doc_id for r in got} for name, got in at.items()}
    good = {i for i, k in kind.items() if k != "junk"}
    assert len(good - ids["quality_cotraining"]) <= 2 and len(ids["quality_cotraining"] - good) <= 3
    kept = [(r.doc_id, r.text) for r in at["quality_cotraining"]]
    assert sorted((r.doc_id, r.text) for r in at["line_dedup"]) == [(i, t) for i, _, _, t in sorted(brute_lines(kept))]
    copies = {i for i, k in kind.items() if k in ("near", "copy")}
    assert ids["simhash_near_dedup"] == ids["line_dedup"] - copies
    leaks = {r.doc_id for r in at["simhash_near_dedup"] if any(normal(p) in normal(r.text) for p in passages)}
    assert ids["decontamination"] == ids["simhash_near_dedup"] - leaks and leaks
    assert ids["packing"] == ids["decontamination"]
    again = corpus_pipeline.run(spark, d)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again.collect())) == sorted(map(key, at["packing"]))


def test_empty_tables(tmp_path, spark):
    d = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_entry_registers_all():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
