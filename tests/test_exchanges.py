"""The exchange review: restarts repeat nothing and lose nothing."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginalia.streaming import exchanges as X


def put(folder: Path, name: str, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(("seq", "user", "assistant"), r, strict=True))) for r in rows))


def test_a_restart_repeats_and_loses_nothing(spark, tmp_path):
    given, out, checkpoint = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    given.mkdir()
    put(given, "1.json", [(1, "remember tea", "yes"), (2, None, "hm")])
    calls, broken = [], []

    def review(rows):
        calls.append(sorted(r.seq for r in rows.collect()))
        if broken:
            raise ValueError("reviewer is down")
        return rows.select("seq", F.concat_ws("|", "user", "assistant").alias("line"))

    def start(on_written=lambda batch: None):
        stream = spark.readStream.schema(X.EXCHANGE).option("maxFilesPerTrigger", 1).json(f"file://{given}")
        return X.review_stream(stream, review, out, checkpoint, on_written)

    def lines():
        return sorted((r.seq, r.line, r.batch) for r in X.proposals(spark, out, "seq bigint, line string").collect())

    query = start()
    X.flush(query)
    query.stop()
    assert lines() == [(1, "remember tea|yes", 0), (2, "|hm", 0)] and calls == [[1, 2]]

    def crash(batch):
        raise RuntimeError("the driver died after the write")

    put(given, "2.json", [(3, "a", "b")])
    query = start(crash)
    with pytest.raises(Exception, match="driver died"):
        X.flush(query)
    query.stop()
    assert lines()[2:] == [(3, "a|b", 1)]
    query = start()  # the checkpoint gives batch 1 again
    X.flush(query)
    query.stop()
    assert calls == [[1, 2], [3]] and len(lines()) == 3
    put(given, "3.json", [(4, "c", "d")])
    broken.append(True)
    query = start()
    with pytest.raises(Exception, match="reviewer is down"):
        X.flush(query)
    query.stop()
    assert len(lines()) == 3
    broken.clear()
    query = start()
    X.flush(query)
    query.stop()
    assert lines()[3:] == [(4, "c|d", 2)] and calls[-2:] == [[4], [4]]
    assert X.proposals(spark, f"file://{tmp_path}/none", "seq bigint, line string").count() == 0
