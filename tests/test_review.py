"""Review answers and their journal, cut at every step."""

from __future__ import annotations

import itertools
import json

import pytest

from marginalia.operators import review as R

NOTES = [(f"n{i}", [f"s{i}", "shared"], i, f"body {i}") for i in range(10)]


def notes_of(spark, rows=NOTES):
    return spark.createDataFrame(rows, R.NOTE)


def answers_of(spark, rows):
    return spark.createDataFrame(rows, "seq int, question_id string, choice string, survivor string, merged_body string")


def rows(df):
    return sorted((r.path, tuple(r.sources), r.version, r.body) for r in df.collect())


def test_answers_become_changes_or_problems(spark):
    notes = notes_of(spark, [*NOTES, ("_archive/n7", [], 1, "old")])
    pairs = spark.createDataFrame([(f"n{2 * i}", f"n{2 * i + 1}") for i in range(5)] + [("n0", "n0"), ("n0", "n9")], "first string, second string")
    asked = {(r.first, r.second): r.question_id for r in R.ask(pairs, notes).collect()}
    q = lambda a, b: asked[(f"n{a}", f"n{b}")]
    given = [
        (1, q(0, 1), "keep-first", "first", None), (2, q(2, 3), "merge", "second", " both \n"), (3, q(4, 5), "keep-both", "first", ""), (4, q(6, 7), "drop-second", "first", None), (5, q(8, 9), "merge", "first", "  "),
        (6, q(8, 9), "keep-both", "first", "text"), (7, q(8, 9), "guess", "first", None), (8, "nothing", "merge", "first", "x"), (9, q(0, 0), "keep-both", "first", None), (10, q(0, 9), "keep-first", "first", None), (11, q(8, 9), None, "first", None),
    ]
    questions = R.ask(pairs, notes)
    changes, refused = R.judge(questions, answers_of(spark, given), notes)
    body = "a merge, and nothing else, has a body"
    assert {r.seq: r.problem for r in refused.collect()} == {
        4: "the archive has one already", 5: body, 6: body, 7: "unknown choice or survivor", 8: "no such question", 9: "one note twice", 10: "touched by an earlier answer", 11: "unknown choice or survivor",
    }
    after = {r.path: (r.target, json.loads(r.after)) for r in changes.collect()}
    assert set(after) == {"n0", "n1", "n2", "n3", "n4", "n5"}
    assert after["n1"] == ("_archive/n1", {"path": "_archive/n1", "sources": ["s1", "shared"], "version": 1, "body": "body 1"})
    assert after["n3"] == ("n3", {"path": "n3", "sources": ["s3", "shared", "s2"], "version": 4, "body": "both\n"}) and after["n2"][0] == "_archive/n2"
    assert [after[n][0] for n in ("n0", "n4", "n5")] == ["n0", "n4", "n5"]
    edited = notes_of(spark, [(p, s, v, b + "!") if p == "n1" else (p, s, v, b) for p, s, v, b in NOTES])
    assert [r.problem for r in R.judge(questions, answers_of(spark, given[:1]), edited)[1].collect()] == ["stale: ask again"]


class Cut(Exception):
    pass


def test_a_commit_cut_at_any_step_has_one_outcome(spark, tmp_path):
    pairs = spark.createDataFrame([("n0", "n1"), ("n2", "n3")], "first string, second string")
    questions = R.ask(pairs, notes_of(spark))
    given = [(i, r.question_id, "merge", "first", "merged") for i, r in enumerate(questions.collect())]
    changes = R.judge(questions, answers_of(spark, given), notes_of(spark))[0].cache()
    whole = R.Journal(spark, f"file://{tmp_path}/whole")
    whole.start(notes_of(spark))
    tx = whole.commit(changes)
    want = rows(whole.notes())
    assert whole.states() == {tx: "committed"} and {p for p, *_ in want} == {"n0", "_archive/n1", "n2", "_archive/n3", *(f"n{i}" for i in range(4, 10))}
    for step, again in itertools.product(["before prepared", "prepared", "applied", "committed"], ["recover", "commit"]):

        def cut(at, step=step):
            if at == step:
                raise Cut

        path = f"file://{tmp_path}/{step.replace(' ', '-')}-{again}"
        R.Journal(spark, path).start(notes_of(spark))
        with pytest.raises(Cut):
            R.Journal(spark, path, cut).commit(changes)
        journal = R.Journal(spark, path)
        if again == "commit":
            assert journal.commit(changes) == tx
        elif journal.recover() == {}:
            assert step == "before prepared" and rows(journal.notes()) == rows(notes_of(spark))
            continue
        assert rows(journal.notes()) == want and journal.states() == {tx: "committed"} and journal.current()[0] == 1
    assert whole.commit(changes) == tx and whole.current()[0] == 1
    # Undo is checked against the images after, and gives back those before.
    whole.undo(tx)
    assert rows(whole.notes()) == rows(notes_of(spark)) and whole.current()[0] == 2
    with pytest.raises(R.Stale):  # other changes, made from notes that are gone
        whole.commit(changes.withColumn("before", changes["after"]))
    with pytest.raises(KeyError):
        whole.undo("0" * 32)
