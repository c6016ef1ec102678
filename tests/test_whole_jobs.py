"""Jobs that are whole whatever their size."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import segment
from marginalia.functions import text as T
from marginalia.operators import bundle, dynamics_store, pairs, sidecar, vector


@pytest.mark.parametrize(("most", "want"), [(None, (True, 66)), (64, (False, 65))])
def test_a_bundle_without_a_budget_is_whole(spark, most, want):
    listed = "\n".join(f"MUST READ: {i}.md" for i in range(1, 65))
    rows = [("0.md", listed), *((f"{i}.md", "MUST READ: 70.md" if i == 64 else "") for i in range(1, 65)), ("70.md", "")]
    starts = spark.createDataFrame([(0, "0.md")], "bundle long, path string")
    made = bundle.bundle(spark.createDataFrame(rows, "path string, text string"), starts, most, None).summary.first()
    assert (made["complete"], made["files"]) == want


def test_scripts_are_counted_to_four(spark):
    texts = [("при вет", "ru"), ("при", None), ("п-р-и-в", "ru"), ("при 한국", None), ("при 한국어요", "ko"), ("привет 한국어요", None), ("", None), (None, None), ("x" * 100_000 + "γειά", "el"), ("あいう\n漢え", "ja")]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string").select("i", T.script_language(F.col("t")).alias("l"))
    assert {r["i"]: r["l"] for r in got.collect()} == {i: want for i, (_, want) in enumerate(texts)}


def test_sums_where_the_keys_lie_equal_exchanged_ones(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(40)], "id long, embedding array<double>")
    model = sidecar.model_rows(rows, 5)
    tokens = [(i, [rng.randrange(50) for _ in range(rng.randrange(0, 30))]) for i in range(700)] + [(700, None)]
    tokens = spark.createDataFrame(tokens, "doc_id long, ids array<long>").coalesce(1)
    plain = lambda df: {r.doc_id: [round(x, 9) for x in r.embedding] for r in df.collect()}
    want = plain(sidecar.sums(tokens, model, 5, "doc_id"))
    near = sidecar.sums(tokens, model, 5, "doc_id", unique=True)
    assert plain(near) == want and "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sidecar, "BROADCAST_ROWS", 3)
    assert plain(sidecar.sums(tokens, model, 5, "doc_id", unique=True)) == want


def test_states_are_judged_in_one_read(spark, tmp_path):
    spark.createDataFrame([("f", '{"key": "a"}')] * 3, "file string, line string").write.parquet(f"{tmp_path}/lines")
    out = dynamics_store.judged(spark.read.parquet(f"{tmp_path}/lines"))
    assert out.count() == 3 and out._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1


def test_token_sets_are_made_without_an_exchange(spark):
    docs = spark.createDataFrame([(1, "b a b gardens"), (2, ""), (3, None)], "doc_id long, text string")
    sets = pairs.token_sets(docs)
    assert [tuple(r) for r in sets.collect()] == [(1, ["a", "b", "gardens", "garde~"])]
    assert "MapInArrow" in sets._jdf.queryExecution().executedPlan().toString()


def test_a_long_batch_is_segmented_in_pieces(spark):
    vocab = segment.Vocabulary(["<unk>", "▁a", "b"], [-9.0, -1.0, -2.0], 0)
    assert segment.TEXTS_AT_ONCE < 600
    texts = spark.createDataFrame([(i, "ab " * (i % 7)) for i in range(600)], "i int, text string").coalesce(1)
    got = {r.i: list(r.ids) for r in texts.select("i", segment.segments(spark, F.col("text"), vocab).alias("ids")).collect()}
    assert got == {i: [1, 2] * (i % 7) for i in range(600)}


def test_scores_are_sifted_before_they_are_rounded(monkeypatch):
    rng = np.random.default_rng(4)
    docs, rows = rng.permutation(np.repeat(np.arange(300), 2)), rng.normal(size=(600, 4)).round(1)
    rows[::3] = rows[0]
    asked = rng.normal(size=(40, 4)).round(1)
    parts = [(docs[i : i + 150], rows[i : i + 150]) for i in range(0, 600, 150)]
    batches = [pa.RecordBatch.from_arrays([pa.array(d), pa.array(list(r))], names=["doc_id", "row"]) for d, r in parts]
    looked, one = [], np.round
    monkeypatch.setattr(np, "round", lambda x, *a, **k: looked.append(np.size(x)) or one(x, *a, **k))
    got = pa.Table.from_batches(vector._task_best(iter(batches), asked, np.arange(40), 5)).to_pylist()
    assert sum(looked) < 40 * 300
    monkeypatch.undo()
    best = [[(-max(np.round(asked[q] @ r, 6) for r in rows[docs == d]), d) for d in range(300)] for q in range(40)]
    assert [(r["query_id"], -r["score"], r["doc_id"]) for r in got] == [(q, s, d) for q in range(40) for s, d in sorted(best[q])[:5]]


def test_a_scale_is_made_once_a_row(spark):
    long = spark.range(1).select(F.transform(F.sequence(F.lit(-9_999), F.lit(10_000)), lambda x: x.cast("double")).alias("v"))
    row = vector.int8_rows(F.col("v"))
    rows = long.select("v", row["scale"].alias("scale"), row["values"].alias("values"))
    back = rows.select(F.size(vector.l2_normalize(F.col("v"))), vector.dequantised(F.struct("scale", "values")).alias("d"))
    began = time.time()
    got = back.first()
    # 20,000 numbers: a scale for each of them would be 400 million steps a use.
    assert time.time() - began < 5 and got[0] == 20_000 and got["d"][-1] == pytest.approx(10_000) and got["d"][9_999] == 0
