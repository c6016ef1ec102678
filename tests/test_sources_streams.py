"""Sources on real files, and streams against their batch forms."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marginalia.operators import dynamics
from marginalia.sources import notes
from marginalia.streaming import access

NOTE = '---\ntitle: "My: Note"\ntype: person\ntags: [a, "b c"]\nlabels: ["lang:en", "x:Y"]\nconfidence: 0.9\nexpires_at: 2024-01-01\nnested:\n  k: [1, 2.5, "q"]\n  list:\n    - one\n    - two\n---\n\n# Head\nfirst [[Link One|x]] line\n'


@pytest.fixture
def vault(tmp_path):
    for rel, text in {"a.md": NOTE, "z/a.MD": "older", "sub/b.md": "plain body", ".hidden/c.md": "no", "sub/t.txt": "no"}.items():
        path = tmp_path / "vault" / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    import os

    os.utime(tmp_path / "vault/z/a.MD", (1, 1))
    return str(tmp_path / "vault")


def test_scan_and_entries(spark, vault, tmp_path):
    files = notes.scan(spark, vault)
    assert {(r.key, r.zone) for r in files.collect()} == {("a", ""), ("z/a", "z"), ("b", "sub")}
    rows = {r.key: r for r in notes.entries(files).collect()}
    a = rows["a"]
    assert (a.title, a.type, a.tags, a.labels, a.confidence, a.expires_at) == ("My: Note", "person", ["a", "b c"], ["lang:en", "x:Y"], 0.9, "2024-01-01")
    assert a.links == ["Link One"] and a.summary == "first [[Link One|x]] line" and a.polarity == "positive"
    assert rows["b"].title == "b" and rows["b"].type == "topic" and rows["b"].body == "plain body" and rows["b"].confidence == 0.5
    out = str(tmp_path / "index")
    notes.write_notes(notes.entries(files), out)
    assert notes.read_notes(spark, out).count() == 3 and notes.read_notes(spark, out, version=2) is None
    with pytest.raises(Exception, match="exist"):
        notes.write_notes(notes.entries(files), out)
    assert "title: \"My: Note\"" in notes.export_markdown(notes.entries(files)).where("rel = 'a.md'").first().content


def test_whole_header():
    got = notes.parse_header(NOTE.split("---\n")[1])
    assert got["nested"] == {"k": [1, 2.5, "q"], "list": ["one", "two"]} and got["tags"] == ["a", "b c"]
    assert notes.parse_header("a: 01\nb: 1e3\nc: -2\nbad line\nd: 'it''s'\ne: true\nf:\n- x: 1\n  y: 2\n- x: 3") == {
        "a": "01", "b": "1e3", "c": -2, "bad line": {}, "d": "it''s", "e": True, "f": [{"x": 1, "y": 2}, {"x": 3}]
    }


def test_scalars_of_headers():
    assert notes.parse_header('a:b\nc: "C:\\new"\nd: "q \\" \\\\ z"\ne:\nf: []\ng: k: v\nh:\n  i: 1') == {"a": "b", "c": "C:\\new", "d": 'q " \\ z', "e": {}, "f": [], "g": "k: v", "h": {"i": 1}}
    assert notes.scalar('["D:\\dir\\", "x"]') == ["D:\\dir\\", "x"] and notes.scalar('["a, b", c]') == ["a, b", "c"]


def test_imports(spark):
    rows = [("d/A.txt", bytearray(b"x ``` y")), ("d/a.json", bytearray(b'{"k": 1}')), ("d/b.json", bytearray(b"{bad")), ("d/c.md", bytearray(b"# t")), ("d/x.png", bytearray(b"1"))]
    got = {r.path: r for r in notes.import_candidates(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["d/A.txt"].problem == got["d/a.json"].problem == "duplicate target" and got["d/b.json"].problem == "invalid JSON"
    assert got["d/c.md"].body == "# t" and got["d/A.txt"].body.startswith("````\n") and "d/x.png" not in got


def run(stream, name, mode):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_access_stream_equals_batch(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=37 * i * (k + 1))) for k in range(4) for i in range(30)]
    log = spark.createDataFrame(rows, "key long, ts timestamp").orderBy("ts")
    for i, part in enumerate((log.where("ts < '2024-01-01 12:00:00'"), log.where("ts >= '2024-01-01 12:00:00'"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/log/part{i}")
    source = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    run(access.fold_stream(source), "folded", "update")
    last = spark.table("folded").groupBy("key").agg(F.max_by(F.struct("strength", "stability", "access_count", "last_access"), "access_count").alias("s"))
    got = {r.key: (r.s.strength, r.s.stability, r.s.access_count, r.s.last_access) for r in last.collect()}
    want = {r.key: (r.strength, pytest.approx(r.stability, abs=1e-5), r.access_count, r.last_access) for r in dynamics.fold_accesses(log).collect()}
    assert got == want


def test_stamps_and_captures(spark, tmp_path):
    rows = [("s", f"c{i}", s, datetime(2024, 1, 1, 0, 0, i)) for i, s in enumerate([5, 5, 4, 9])] + [("s", "c0", 5, datetime(2024, 1, 1, 0, 0, 9))]
    records = spark.createDataFrame(rows, "scope string, capture_id string, stamp long, recorded_at timestamp")
    records.coalesce(1).write.parquet(f"{tmp_path}/records")
    source = spark.readStream.schema(records.schema).parquet(f"{tmp_path}/records")
    run(access.capture_stream(source), "captured", "append")
    assert sorted(r.capture_id for r in spark.table("captured").collect()) == ["c0", "c1", "c2", "c3"]
    run(access.stamp_stream(source.where("recorded_at < '2024-01-01 00:00:05'")), "stamped", "append")
    assert sorted(r.stamp for r in spark.table("stamped").collect()) == [4, 5, 6, 9]
