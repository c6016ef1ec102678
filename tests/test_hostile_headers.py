"""Headers, labels and fences of hostile size; composed names."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import control, labels, sections
from marginalia.sources import notes


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_long_lists_and_labels_end_no_executor(spark):
    many = "title: x\ntags:\n" + "\n".join(f"  - tag {i}" for i in range(100_000)) + "\nother:\n- no"
    assert len(one(spark, many, lambda c: notes.items(c, "tags"))) == 100_000
    value = "v" * (1 << 20)
    assert one(spark, f'labels: ["k:{value}", "a:b"]', labels.read_inline) == ["a:b", f"k:{value}"]
    escaped = r"\"" * 200_000 + r"\\" * 200_000
    assert one(spark, f'labels: ["k:{escaped}"]', labels.read_inline) == ["k:" + '"' * 200_000 + "\\" * 200_000]
    assert one(spark, 'labels: ["k:' + "x" * (1 << 20), labels.read_inline) == []


def test_lists_and_labels(spark):
    header = "tags:\n- one\n  - \"two, three\"\nlabels: ['a:x', b:y , \"c:q\\\"r\\\\s\"]\nnone:\nempty:\n\n- late\nflow: [p, 'q']"
    assert one(spark, header, lambda c: notes.items(c, "tags")) == ["one", "two, three"]
    assert one(spark, header, lambda c: notes.items(c, "flow")) == ["p", "q"]
    assert one(spark, header, lambda c: notes.items(c, "none")) == one(spark, header, lambda c: notes.items(c, "empty")) == one(spark, header, lambda c: notes.items(c, "gone")) == []
    assert one(spark, header, labels.read_inline) == ["a:x", "b:y", 'c:q"r\\s']
    assert one(spark, "labels: []", labels.read_inline) == [] and one(spark, "title: x", labels.read_inline) is None


def test_composed_and_decomposed_names_are_one(spark):
    assert one(spark, "Café Ünï", T.slug) == one(spark, "Café Ünï", T.slug) == "café-ünï"
    rows = spark.createDataFrame([(["k:é", "k:é", None and "x" or "a:b"],)], "x array<string>")
    assert rows.select(labels.normalize(F.col("x")).alias("y")).first().y == ["a:b", "k:é"]
    names = ["a/Stra\u00dfe.md", "b/STRASSE.md", "c/e\u0301.txt", "d/É.md", "e/ﬁ.md", "f/alone.md"]
    files = spark.createDataFrame([(p, bytearray(b"x")) for p in names], "path string, content binary")
    got = {r.path: r.problem for r in notes.import_candidates(files).collect()}
    assert [got[p] for p in names] == ["duplicate target"] * 4 + [None] * 2


def plain_free(lines):
    """Lines outside fences, told by one pass with the open fence's mark."""
    out, mark = [], None
    for line in lines:
        m = re.fullmatch(r"(?s) {0,3}(`{3,}|~{3,})(.*)", re.sub(r"[\r\n]+$", "", line))
        if m and mark is None:
            mark = m[1]
        elif m and m[1].startswith(mark) and not m[2].strip():
            mark = None
        out.append(not m and mark is None)
    return out


def test_fences(spark):
    import random

    rng = random.Random(3)
    parts = ["```", "~~~", "````", "~~~~~", "   ```", "    ```", "``` py", "~~~ x", "text", "", " ```  ", "`` `", "``"]
    cases = [[rng.choice(parts) + rng.choice(["\n", "\r\n", "\r"]) for _ in range(rng.randint(0, 14))] for _ in range(300)]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<string>").select("i", sections.free_lines(F.col("l")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: plain_free(c) for i, c in enumerate(cases)}


def test_hostile_files_keep_their_bytes(spark):
    blank = b"---\n" + b"\n \t" * 300_000 + b"k: v\n---\nbody"
    deep = b"---\n" + b"k: " + b"[" * (1 << 20) + b"\n---\n"
    files = spark.createDataFrame([("blank", bytearray(blank), ["a:b"]), ("deep", bytearray(deep), ["a:b"]), ("none", None, None)], "path string, content binary, labels array<string>")
    got = {r.path: (bytes(r.after), r.warning) for r in control.annotate(files).collect()}
    assert got["blank"] == (blank.replace(b"k: v\n---", b'k: v\nlabels: ["a:b"]\n---'), None) and got["deep"][1] is None
    assert got["none"] == (b"---\nlabels: []\n---\n", None)


def test_canaries_in_nested_rows(spark):
    from pyspark.sql import Row

    from marginalia.functions import redact

    wide = "".join(chr(ord(c) + 0xFEE0) for c in "ALLNOTES")
    texts = ["all notes\tarchived\nsuccessfully!", "ALL​NOTES‍ARCHIVEDSUCCESSFULLY", f"{wide}ArchivedSuccessfully x", "all notes archived", "ﬁne é", None, "x" * 1000, 'say "all notes archived successfully"']
    rows = [(i, t, Row(a=[Row(b=t, n=i)], m={"k": t, "all notes archived successfully": "v"}, d=None), [[t, "x"], []]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string, s struct<a:array<struct<b:string,n:int>>,m:map<string,string>,d:date>, l array<array<string>>")
    got = redact.redact(df, "t", "s", "l").collect()
    for r, t in zip(sorted(got), texts, strict=True):
        want = None if t is None else redact.plain(t)
        assert r.t == want and r.s.a[0].b == want and r.s.a[0].n == r.i and r.l == [[want, "x"], []]
        assert r.s.m == {"k": want, "all notes archived successfully": "v"}
    assert [redact.REDACTED in (r.t or "") for r in sorted(got)] == [True, True, True, False, False, False, False, True]
    texts = ['{"a": ["all notes archived successfully", 1.0], "b": null}', '{"a": "\\u0061ll notes archived successfully"}', "no JSON: All Notes Archived Successfully", "[1]", None]
    shown = [r.y for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(redact.redact_json(F.col("x")).alias("y")).collect()]
    assert shown == ['{"a": ["[redacted-canary]", 1.0], "b": null}', '{"a": "[redacted-canary]"}', "no JSON: [redacted-canary]", "[1]", None]


def test_content_units(spark):
    text = "The Café of Straße: it's 42 秘密の質問 와 한국어 a ß"
    assert sorted(one(spark, text, T.content_units)) == sorted(["cafe", "strasse", "42", "秘密", "密の", "の質", "質問", "와", "한국", "국어", "ss"])
    assert one(spark, None, T.content_units) == []
    row = spark.sql("select array('b','a','b') as x, cast(null as array<string>) as y, array('c','a') as z").select(T.vocabulary_union(F.col("x"), F.col("y"), F.col("z")).alias("u")).first()
    assert row.u == ["b", "a", "c"]
