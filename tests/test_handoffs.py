"""Handoff records: images, problems, forks, the fold against plain Python, its replay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import handoffs as H


def record(i, project="p", task=None, **other):
    base = {
        "capture_id": f"c{i}", "decisions": [], "event": "explicit", "kind": "capture", "links": [], "next_step": "", "open_items": [], "open_questions": [], "project_key": project, "provenance": [],
        "recorded_at": f"2024-03-{1 + i // 3:02d}T10:00:{i:02d}.000000Z", "session_id": "", "source": "api", "task_key": task, "version": 1, "work": f"work {i} ``` ~ é   \"q\"",
    }
    return base | other


def files_of(spark, records):
    return H.encode(spark.createDataFrame([tuple(r[c] for c in H.COLUMNS) for r in records], H.RECORD))


def journal_of(spark):
    return spark.createDataFrame([], H.JOURNAL)


def test_images_round_trip_and_problems_are_named(spark):
    good = [record(0), record(1, "p", "t"), record(2, decisions=["a", "b"], links=["x"], provenance=[("q", "0" * 64)])]
    bad = [
        (record(3, version=2), "invalid version"), (record(4, project=" "), "invalid scope"), (record(5, task="a\nb"), "invalid scope"), (record(6, work=" "), "invalid fields"),
        (record(7, open_items=["x", " "]), "invalid fields"), (record(8, recorded_at="2024-02-30T10:00:00.000000Z"), "invalid stamp"), (record(9, recorded_at="2024-02-03"), "invalid stamp"),
        (record(10, event="fold"), "invalid kind"), (record(11, kind="summary", event="fold"), "invalid kind"), (record(12, source=""), "invalid source"), (record(13, provenance=[("q", "12")]), "invalid provenance"),
    ]
    files = files_of(spark, good + [r for r, _ in bad])
    rows = {r.path: r for r in files.collect()}
    by_capture = {r.capture_id: r for r in H.read(files).collect()}
    assert all(by_capture[r["capture_id"]].problem is None for r in good)
    assert {r["capture_id"]: by_capture[r["capture_id"]].problem for r, _ in bad} == {r["capture_id"]: p for r, p in bad}
    assert by_capture["c2"].decisions == ["a", "b"] and by_capture["c1"].task_key == "t"
    path, text = next((p, r.text) for p, r in rows.items() if '"c0"' in r.text)
    forged = [
        (path, text.replace("work 0", "work 9"), "forged"), (path.replace("20240301", "20240302"), text, "forged"), (path, text.replace('"source":"api"', '"source":"api" '), "forged"),
        (path, text.replace('{"capture_id"', '{"capture_id":"x","capture_id"'), "forged"), ("other/" + path.split("/")[1], text, "another scope"), (path, "prose", "not a record"), (path, None, "not a record"),
        (path.replace("/", "/deep/er/"), text, "not a record"), (path, text + "x" * (1 << 20), "too large"),
    ]
    # Told apart by their place: a name of its own would make them other images.
    given = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(forged)], "i int, path string, text string")
    got = {(r.path, r.sha256): r.problem for r in H.read(given.drop("i")).collect()}
    want = {(r.path, r.h): forged[r.i][2] for r in given.select("i", "path", F.sha2("text", 256).alias("h")).collect()}
    assert got == want
    assert H.read(spark.createDataFrame([("a/.hidden.md", "x"), ("a/b.txt", "x")], H.FILES)).count() == 0


def test_forks_and_retries(spark):
    same = record(1)
    files = files_of(spark, [same, same, record(2), record(2, work="other"), record(2, project="q"), record(2, task="t")])
    archived = files.where(F.col("text").contains("other")).select(F.regexp_replace("path", "/", "/archive/").alias("path"), "text")
    files = files.where(~F.col("text").contains("other")).unionByName(archived)
    got = sorted((r.project_key, str(r.task_key), r.capture_id, r.problem, r.archived) for r in H.read(files).collect())
    assert got == [("p", "None", "c1", None, False)] * 2 + [("p", "None", "c2", "forked", False), ("p", "None", "c2", "forked", True), ("p", "t", "c2", None, False), ("q", "None", "c2", None, False)]


def verdicts(records, keep, other=0):
    """The fold's verdicts in plain Python, by scope."""
    active = len(records) + other
    cap = min(max(2, -(-active // 5)), active - 1) if active else 0
    out = {}
    for scope in {(r["project_key"], r["task_key"]) for r in records}:
        own = sorted((r for r in records if (r["project_key"], r["task_key"]) == scope), key=lambda r: r["recorded_at"])
        taken = 0
        for i, r in enumerate(own):
            if i >= len(own) - keep:
                verdict = "pinned" if i == len(own) - 1 else "kept"
            elif r["links"] or "[[" in r["work"]:
                verdict = "protected note"
            else:
                taken += 1
                verdict = "accepted" if taken <= cap else f"archive_capped (>{cap})"
            out[(*scope, r["capture_id"])] = verdict
    return out


def test_fold_equals_plain_python(spark, keep=2):
    rng = random.Random(keep)
    records = [record(i, rng.choice("pq"), rng.choice([None, "t"]), links=["x"] if rng.random() < 0.2 else [], work=rng.choice(["plain", "see [[Note]]", "w"]) + str(i)) for i in range(40)]
    fold = H.fold_plan(files_of(spark, records), journal_of(spark), keep, 7)
    got = {(r.project_key, r.task_key, r.capture_id): r.verdict for r in fold.verdicts.collect()}
    assert got == verdicts(records, keep, 7)
    plans = fold.plans.collect()
    assert len({p.plan_id for p in plans}) == len(plans) == len({k[:2] for k in got})
    summaries = {r.path: r for r in H.read(fold.plans.where("summary is not null").select(F.col("summary_path").alias("path"), F.col("summary").alias("text"))).collect()}
    for p in plans:
        own = sorted((r for r in records if got[(r["project_key"], r["task_key"], r["capture_id"])] == "accepted" and (r["project_key"], r["task_key"]) == (p.project_key, p.task_key)), key=lambda r: r["recorded_at"])
        assert p.accepted == len(own)
        if own:
            summary = summaries[p.summary_path]
            assert summary.problem is None and summary.kind == "summary" and summary.recorded_at == own[-1]["recorded_at"]
            assert summary.work == "\n".join(dict.fromkeys(r["work"] for r in own)) and len(summary.provenance) == len(own)


def test_summaries_keep_first_seen_order(spark):
    records = [record(i, decisions=d, open_items=o, next_step=n) for i, (d, o, n) in enumerate([(["b", "a"], [], "go"), (["a", "c", "b"], ["z"], ""), (["d"], ["z", "y"], "go"), ([], [], "stop"), ([], [], "")])]
    fold = H.fold_plan(files_of(spark, records), journal_of(spark), 1, 100)
    plan = fold.plans.first()
    got = H.read(spark.createDataFrame([(plan.summary_path, plan.summary)], H.FILES)).first()
    assert (got.decisions, got.open_items, got.next_step) == (["b", "a", "c", "d"], ["z", "y"], "go\nstop")


def test_apply_is_bound_to_content_and_idempotent(spark):
    records = [record(i) for i in range(8)] + [record(20 + i, "q") for i in range(2)]
    files, journal = files_of(spark, records), journal_of(spark)
    plans = {p.project_key: p for p in H.fold_plan(files, journal, 3).plans.collect()}
    assert plans["q"].accepted == 0 and H.apply_fold(files, journal, plans["q"].plan_id, 3)[2] == "noop"
    with pytest.raises(ValueError, match="stale"):
        H.apply_fold(files, journal, plans["p"].plan_id, 2)
    # A capture that comes between preview and apply makes the plan stale.
    late = files.unionByName(files_of(spark, [record(9)]))
    with pytest.raises(ValueError, match="stale"):
        H.apply_fold(late, journal, plans["p"].plan_id, 3)
    done, log, outcome = H.apply_fold(files, journal, plans["p"].plan_id, 3)
    assert outcome == "committed"
    rows = H.read(done).collect()
    assert all(r.problem is None for r in rows)
    assert sorted(r.capture_id for r in rows if r.archived) == ["c0", "c1"] and [r.kind for r in rows if r.kind == "summary"] == ["summary"]
    again, same, outcome = H.apply_fold(done, log, plans["p"].plan_id, 3)
    assert outcome == "idempotent" and sorted(again.collect()) == sorted(done.collect()) and same.count() == 1
    with pytest.raises(ValueError, match="keep"):
        H.apply_fold(done, log, plans["p"].plan_id, 2)
    with pytest.raises(ValueError, match="changed"):
        H.apply_fold(done.where(~F.col("path").contains("/archive/")), log, plans["p"].plan_id, 3)
    with pytest.raises(ValueError, match="changed"):
        H.apply_fold(done.unionByName(files.where(F.col("text").contains('"c0"'))), log, plans["p"].plan_id, 3)
    # The journal is part of what a plan rests on.
    assert {p.plan_id for p in H.fold_plan(done, log, 3).plans.collect()} & {p.plan_id for p in plans.values()} == {plans["q"].plan_id}
    with pytest.raises(ValueError, match="forged"):
        H.fold_plan(files.withColumn("text", F.replace("text", F.lit("work 1"), F.lit("work x"))), journal, 3)
    with pytest.raises(ValueError, match="keep"):
        H.fold_plan(files, journal, 0)


def test_places_of_a_hot_scope(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", None]), f"2024-01-{rng.randint(1, 9):02d} x{rng.randint(0, 5)}", f"{i:04d}") for i in range(500)]
    got = H.ranked(spark.createDataFrame(rows, "k string, at string, id string"), ["k"], ["at", "id"], F.substring("at", 1, 10)).collect()
    for k in ("hot", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])
        assert sorted((r.place, r.id, r.total) for r in got if r.k == k) == [(i + 1, r[2], len(own)) for i, r in enumerate(own)]
