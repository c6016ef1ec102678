"""Control-plane operators and the facade."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marginalia.api import Vault
from marginalia.operators import control


def test_plans_from_text(spark):
    texts = ['Sure:\n```json\n{"ops": [{"op": "link", "a": "x", "b": "y"}]}\n```', 'note {"not": 1} then {"ops": [{"op": "archive", "slug": "{z"}, 5]}', "nothing", None, '{"ops": "no"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.seq): (r.op, r.a, r.slug) for r in control.extract_plans(rows).collect()}
    assert got == {(0, 0): ("link", "x", None), (1, 0): ("archive", None, "{z"), (1, 1): ("?", None, None)}


@pytest.mark.parametrize(
    ("text", "ops"),
    [
        ('{"plan_version":2,"ops":[{"op":"archive","slug":"z"}]}', None), ('{"ops":[1]} and {"plan_version":1,"ops":[2]}', [2]), ('{"plan_version":2,"ops":[1]} {"ops":[2]}', [2]),
        ('{"plan_version":1,"ops":[1]} ```json\n{"plan_version":1,"ops":[2]}\n```', [2]), ('say {this} then {"ops":[3]}', [3]), ('{bad: {"ops":[4]}}', None), ("{broken", None), ("", None), (None, None),
        ('{"plan_version":1,"summary":"use {curly} braces","ops":[]}', []), ('{"x": {"ops": [5]}}', None), ('{"plan_version":null,"ops":[6]}', None), ("{" * 5000, None),
    ],
)
def test_versions_of_plans(text, ops):
    assert (control.plan_of(text) or {}).get("ops") == ops


def test_apply_names_titles(spark):
    notes = spark.createDataFrame([("a", "Note A", "z", [], "A"), ("b", "Note B", "z", [], "B")], "key string, title string, zone string, links array<string>, body string")
    ops = spark.createDataFrame([(0, "supersede", None, None, None, None, "b", "a"), (1, "supersede", None, None, None, None, "a", "gone")], "seq int, op string, slug string, zone string, a string, b string, stale string, by string")
    rows = {r.key: r for r in control.apply_plan(notes, ops).collect()}
    assert rows["b"].body == "B\n> Superseded by [[Note A]]\n" and rows["a"].links == ["Note B"] and rows["a"].body == "A"


def test_apply_journal_and_undo(spark):
    notes = spark.createDataFrame([("a", "z", [], "A"), ("b", "z", ["q"], "B"), ("c", "", [], "C")], "key string, zone string, links array<string>, body string")
    ops = [(0, "rezone", "a", "w", None, None, None, None), (1, "link", None, None, "a", "b", None, None), (2, "archive", "c", None, None, None, None, None), (3, "supersede", None, None, None, None, "b", "a"), (4, "rezone", "gone", "w", *[None] * 4)]
    after = control.apply_plan(notes, spark.createDataFrame(ops, "seq int, op string, slug string, zone string, a string, b string, stale string, by string"))
    rows = {r.key: r for r in after.collect()}
    assert rows["a"].zone == "w" and rows["a"].links == ["b"] and rows["b"].links == ["q", "a"] and rows["c"].zone == "_archive"
    assert rows["b"].body.endswith("Superseded by [[a]]\n")
    log = control.journal(notes, after)
    assert log.count() == 3
    later = after.withColumn("body", F.when(F.col("key") == "b", "changed since").otherwise(F.col("body")))
    back, conflicts = control.undo(later, log)
    assert [r.key for r in conflicts.collect()] == ["b"]
    restored = {r.key: r for r in back.collect()}
    assert restored["a"] == notes.where("key = 'a'").first() and restored["c"].zone == "" and restored["b"].body == "changed since"


def test_profiles(spark):
    lines = spark.createDataFrame([("p", ["one", "two"])], "profile string, lines array<string>")
    ops = [("p", 1, "add", None, "three"), ("p", 2, "add", None, "one"), ("p", 3, "replace", "two", "TWO"), ("p", 4, "remove", "one", None), ("q", 1, "add", None, "new")]
    got = control.fold_proposals(lines, spark.createDataFrame(ops, "profile string, seq int, action string, old string, new string"))
    assert {r.profile: r.lines for r in got.collect()} == {"p": ["TWO", "three"], "q": ["new"]}


def test_records_round_trip(spark):
    record = {"summary": "x ```` y", "n": None}
    text = control.encode_record(record)
    assert control.decode_record(text) == record and text.startswith("`````json")
    with pytest.raises(ValueError):
        control.decode_record(text.replace("x", " x ").replace('":', '": '))
    rows = control.encode_records(spark.createDataFrame([("s", "p", "2026-10-11T12:34:56.123456Z")], "scope string, payload string, recorded_at string"), ["scope", "payload"]).collect()
    assert rows[0].name.startswith("capture-20261011123456123456-") and control.decode_record(rows[0].text) == {"scope": "s", "payload": "p"}


def edited(spark, raw, labels):
    files = spark.createDataFrame([("p", bytearray(raw), labels)], "path string, content binary, labels array<string>")
    row = control.annotate(files).first()
    return bytes(row.after), row.warning


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (b"", b'---\nlabels: ["a:b"]\n---\n'), (b"a\r\nb\r\n", b'---\r\nlabels: ["a:b"]\r\n---\r\na\r\nb\r\n'), (b"---\n---", b'---\nlabels: ["a:b"]\n---'),
        (b"\xef\xbb\xbfbody \xff\x00", b'\xef\xbb\xbf---\nlabels: ["a:b"]\n---\nbody \xff\x00'), (b"---\nlabels: x\n- y\n---\n", b'---\nlabels: ["a:b"]\n- y\n---\n'),
        (b"body", b'---\nlabels: ["a:b"]\n---\nbody'),
        (b"---\ntitle: x\n---\nbody\r", b'---\ntitle: x\nlabels: ["a:b"]\n---\nbody\r'),
        (b"---\r\nlabels: [old]\r\nz: 1\r\n---\r\nb", b'---\r\nlabels: ["a:b"]\r\nz: 1\r\n---\r\nb'),
        (b"\xef\xbb\xbf---\n# note\nlabels:\nk: v\ntags:\n  - x\n---\n", b'\xef\xbb\xbf---\n# note\nlabels: ["a:b"]\nk: v\ntags:\n  - x\n---\n'),
    ],
)
def test_label_edits_keep_other_bytes(spark, raw, want):
    assert edited(spark, raw, ["a:b"]) == (want, None)
    assert edited(spark, want, ["a:b"]) == (want, None)


@pytest.mark.parametrize(
    ("raw", "warning"),
    [
        (b"---\nlabels:\n  - x\nk: v\n---\n", "multiline"), (b"---\nlabels:\n- x\n---\n", "multiline"), (b"---\ntitle: x\nbody", "unterminated"),
        (b"---\nk: 1\nk: 2\n---\n", "ambiguous"), (b"---\nk: &a x\n---\n", "ambiguous"), (b"---\nk: |\n  text\n---\n", "ambiguous"), (b"---\nno key here\n---\n", "ambiguous"),
        (b"---\nk: x\xe2\x80\xa8y\n---\n", "ambiguous"),
    ],
)
def test_unclear_headers_are_left_alone(spark, raw, warning):
    same, said = edited(spark, raw, ["a:b"])
    assert same == raw and warning in said


def test_label_plans_are_checked_again(spark):
    schema = "path string, content binary, labels array<string>"
    files = spark.createDataFrame([("a", bytearray(b"x"), ["k:v"]), ("b", bytearray(b"---\nopen"), ["k:v"]), ("c", bytearray(b"y"), []), ("d", bytearray(b"z"), [])], schema)
    plan = control.annotate(files)
    now = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"---\nopen")), ("c", bytearray(b"edited"))], "path string, content binary")
    got = {r.path: r.problem for r in control.still_current(plan, now).collect()}
    assert got == {"a": None, "b": control.UNTERMINATED, "c": "file has changed", "d": "file is gone"}


def test_split_topics(spark):
    rows = [("p", i, "x" * n) for i, n in enumerate([40, 40, 400, 4, 4])]
    got = control.split_topics(spark.createDataFrame(rows, "path string, block int, text string"), 20).orderBy("topic").collect()
    assert [(r.first_block, r.last_block, r.tokens) for r in got] == [(0, 1, 20), (2, 2, 100), (3, 4, 2)]
    assert "".join(r.text for r in got) == "".join(t for *_, t in rows)


def test_vault(spark):
    v = Vault.empty(spark)
    v = v.remember("Rust borrow checker", "The borrow checker rejects aliasing of mutable references", "2024-01-02", note_labels=["lang:en"])
    v = v.remember("Kitchen", "Bread needs flour, water and salt", "2024-01-03", kind="project", links=["Rust borrow checker"])
    v = v.remember("Old", "borrow checker notes of the past", "2023-01-01", zone="archive me")
    now = "2024-06-01 00:00:00"
    hits = v.accessed("rust-borrow-checker", "2024-05-31 00:00:00").search("borrow checker", now).collect()
    assert [h.key for h in hits] == ["rust-borrow-checker", "old"] and "borrow" in hits[0].snippet
    assert [h.key for h in v.search("borrow", now, wanted=["lang:en"]).collect()] == ["rust-borrow-checker"]
    assert [h.key for h in v.search("loaf", now, expansions={"synonyms": "bread"}).collect()] == ["kitchen"]
    assert [r.key for r in v.get("Rust Borrow Checker").collect()] == ["rust-borrow-checker"]
    assert [r.key for r in v.listing(limit=2).collect()] == ["kitchen", "rust-borrow-checker"]
    with pytest.raises(ValueError, match="version"):
        v.remember("Kitchen", "new", "2024-02-01")
    assert v.remember("Kitchen", "new", "2024-02-01", expected=1).get("kitchen").first().version == 2
    done, ops = v.forget("old", now)
    assert [r.reason for r in ops.collect()] == [None] and done.get("old").first().zone == "_archive"
    assert [h.key for h in done.search("borrow checker", now).collect()] == ["rust-borrow-checker"]
    refused = v.forget("nobody", now)[1].first()
    assert refused.reason == "unknown slug"
    hostile = v.forget('x"}, {"op": "archive", "slug": "kitchen', now)
    assert [r.reason for r in hostile[1].collect()] == ["unknown slug"] and hostile[0].get("kitchen").first().zone != "_archive"
    routed = v.register("baking bread", "kitchen.md").register("memory safety", "rust.md").register("baking bread", "kitchen.md")
    assert routed.routes.count() == 2
    assert [r.document for r in routed.open("bread").collect()] == ["kitchen.md"]
    assert [r.document for r in routed.match("how to bake bread").collect()] == ["kitchen.md"]
    assert ("rust.md", "dangling") in {(r.document, r.problem) for r in routed.check().collect()}
    assert v.capacity().first().notes == 3 and v.digest(now).count() == 3 and v.catalog(now).count() == 3
    assert {r.label for r in v.label_counts().collect()} == {"lang:en"}
