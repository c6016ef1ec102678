"""Startup bundles and the stored dynamics."""

from __future__ import annotations

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginalia.operators import bundle as B
from marginalia.operators import dynamics_store as D


def documents(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


TEXTS = {
    "a/main.md": "﻿# Top\nMUST READ: sub/one.md\n  - must read:  `../b/two.md` \n```\nMUST READ: fenced.md\n~~~\n```\nnot MUST READ: x.md\nMust Read: \"./sub/../sub/one.md\"\n",
    "a/sub/one.md": "~~~ py\nMUST READ: no.md\n~~\n~~~\nMUST READ: ../main.md\r\nMUST READ: ../../c/list.json",
    "b/two.md": "", "c/list.json": '{"must_read": ["../b/two.md", "three.md"], "other": 1}', "c/three.md": None, "d/alone.md": "text\n\nmore",
    "e/bad.md": "MUST READ: ''\nMUST READ: ../../up.md\nMUST READ: /etc/x\nMUST READ: .hidden/x.md\nMUST READ: C:x", "e/bad.json": "{", "e/shape.json": '{"must_read": "x"}', "e/mixed.json": '{"must_read": ["x", 1]}',
    "e/list.json": "[1]", "e/none.json": '{"a": 1}', "e/gone.md": "MUST READ: nowhere.md",
}


def test_references_are_parsed(spark):
    got = sorted((r.path, r.reference, r.target, r.problem) for r in B.references(documents(spark, TEXTS)).collect() if not r.path.startswith("e/"))
    assert got == [
        ("a/main.md", "../b/two.md", "b/two.md", None), ("a/main.md", "./sub/../sub/one.md", "a/sub/one.md", None), ("a/main.md", "sub/one.md", "a/sub/one.md", None),
        ("a/sub/one.md", "../../c/list.json", "c/list.json", None), ("a/sub/one.md", "../main.md", "a/main.md", None), ("c/list.json", "../b/two.md", "b/two.md", None), ("c/list.json", "three.md", "c/three.md", None),
    ]
    wrong = sorted((r.path, str(r.reference), r.problem) for r in B.references(documents(spark, TEXTS)).collect() if r.problem)
    out = "outside the root or hidden"
    assert wrong == [
        ("e/bad.json", "None", "invalid JSON"), ("e/bad.md", "", "empty reference"), ("e/bad.md", "../../up.md", out), ("e/bad.md", ".hidden/x.md", out), ("e/bad.md", "/etc/x", out), ("e/bad.md", "C:x", out),
        ("e/mixed.json", "None", "must_read holds no paths"), ("e/shape.json", "None", "must_read is no list"),
    ]


def test_bundles_and_their_verification(spark):
    docs = documents(spark, TEXTS)
    starts = spark.createDataFrame([(1, "a/main.md"), (2, "d/alone.md"), (2, "b/two.md"), (3, "e/gone.md"), (4, "e/bad.json"), (5, "../x.md"), (6, "e/none.json")], "bundle int, path string")
    made = B.bundle(docs, starts)
    summary = {r.bundle: (r.complete, r.files) for r in made.summary.collect()}
    assert summary == {1: (True, 5), 2: (True, 2), 3: (False, 1), 4: (False, 1), 5: (False, 0), 6: (True, 1)}
    files = sorted((r.depth, r.path, r.bytes, r.lines) for r in made.files.where("bundle = 1").collect())
    assert [f[:2] for f in files] == [(0, "a/main.md"), (1, "a/sub/one.md"), (1, "b/two.md"), (2, "c/list.json"), (3, "c/three.md")]
    assert all(n == len((TEXTS[p] or "").encode()) and k == len((TEXTS[p] or "").splitlines()) for _, p, n, k in files)
    given = B.context(made, docs).cache()
    text = "".join(r.text for r in sorted(given.where("path = 'd/alone.md'").collect(), key=lambda r: r.start_byte))
    assert text == TEXTS["d/alone.md"]
    edited = documents(spark, TEXTS | {"d/alone.md": "text\n\nmore.", "c/three.md": "x"})
    cases = given.withColumn("text", F.when((F.col("bundle") == 1) & (F.col("path") == "a/main.md"), F.upper("text")).otherwise(F.col("text"))).where("bundle <> 2")
    assert {r.bundle: r.problem for r in B.verify(given, docs, starts).collect()} == {1: None, 2: None, 3: "sources are incomplete", 4: "sources are incomplete", 5: "sources are incomplete", 6: None}
    assert {r.bundle: r.problem for r in B.verify(given, edited, starts.where("bundle < 3")).collect() if r.bundle < 3} == {1: "missing file", 2: "the file has changed"}
    foreign = cases.unionByName(given.where("bundle = 1 and path = 'a/sub/one.md'").withColumn("bundle", F.lit(6)))
    assert {r.bundle: r.problem for r in B.verify(foreign, docs, starts.where("bundle in (1, 2, 6)")).collect()} == {1: "a block has changed", 2: "missing file", 6: "foreign file"}
    tight = B.bundle(docs, starts.where("bundle = 1"), most_files=3)
    assert [(r.complete,) for r in tight.summary.collect()] == [(False,)] and "over the file budget" in [r.problem for r in tight.problems.collect()]


# -- stored dynamics -----------------------------------------------------------------------


def states(df):
    return sorted((r.key, r.strength, r.stability, r.access_count, str(r.last_access)) for r in df.collect())


def accesses(spark, rows):
    return spark.createDataFrame(rows, "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))


def test_recording_in_parts_equals_one_fold(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:30:00"), ("b", "2024-01-02 00:00:00.123456"), ("a", "2024-01-01 11:30:00"), ("a", "2024-01-03 00:00:00"), ("c", "2024-01-04 00:00:00"), (None, "2024-01-04 00:00:00")]
    parts, whole = D.Store(spark, f"file://{tmp_path}/parts"), D.Store(spark, f"file://{tmp_path}/whole")
    assert parts.load().version == 0 and parts.record(accesses(spark, [])) == 0
    for i, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        assert parts.record(accesses(spark, part)) == i + 1
    whole.record(accesses(spark, rows))
    assert states(parts.load().state) == states(whole.load().state)
    assert [(k, s, n) for k, s, _, n, _ in states(whole.load().state)] == [("a", 2.0, 4), ("b", 1.25, 1), ("c", 1.25, 1)]
    assert states(whole.load().state)[1][4] == "2024-01-02 00:00:00.123456"


def test_damaged_files_are_set_aside(spark, tmp_path):
    store = D.Store(spark, f"file://{tmp_path}/s")
    store.record(accesses(spark, [("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:00:00")]))
    good = {"key": "c", "strength": 2.0, "stability": 9.0, "access_count": 3, "last_access": None}
    lines = [
        json.dumps(good), "", "{cut", "[1]", json.dumps(good | {"key": ""}), json.dumps(good | {"key": "d", "strength": "x"}), json.dumps(good | {"key": "e", "stability": 1e9}),
        json.dumps(good | {"key": "f", "access_count": -1}), json.dumps(good | {"key": "g", "last_access": "soon"}), json.dumps(good | {"last_access": "2024-02-01T00:00:00Z", "extra": 1}), '{"key": "h", "strength": NaN}', "퟿\x00",
    ]
    damaged = Path(tmp_path, "s", "version-00000001", "part-damaged.json")
    damaged.write_text("\n".join(lines), encoding="utf-8")
    now = store.load()
    assert [r[0] for r in states(now.state)] == ["a", "b", "c"] and {r.file for r in now.quarantine.collect()} == {"part-damaged.json"}
    assert sorted(r.reason for r in now.quarantine.collect()) == ["access_count", "last_access", "no key", "not an object", "not an object", "not an object", "not an object", "repeated", "stability", "strength"]
    before = states(now.state)
    assert store.set_aside().count() == 10
    assert store.load().version == 2 and states(store.load().state) == before and store.load().quarantine.count() == 0
    assert not damaged.exists() and Path(tmp_path, "s", "quarantine", "00000001", "part-damaged.json").exists()


def test_writers_that_read_the_same_version(spark, tmp_path):
    store = D.Store(spark, f"file://{tmp_path}/s")
    store.record(accesses(spark, [("a", "2024-01-01 10:00:00")]))
    read = store.load()
    assert store.commit(read.state, read.version) == 2
    with pytest.raises(D.Conflict):
        store.commit(read.state, read.version)
    done = []
    logs = [accesses(spark, [("a", f"2024-01-0{i} 10:00:00")]) for i in (2, 3, 4)]
    threads = [threading.Thread(target=lambda log=log: done.append(D.Store(spark, f"file://{tmp_path}/s").record(log, 20))) for log in logs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [3, 4, 5] and [r[:4] for r in states(store.load().state)] == [("a", 2.0, 35.4375, 4)]
    assert not list(Path(tmp_path, "s").glob("writing-*"))
