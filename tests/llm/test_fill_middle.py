"""Fill-in-the-middle against plain Python over code points."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import fill_middle

SCHEMA = "doc_id long, text string, n string, output int"
UNIT = {"char": r"(?s).", "word": r"(?s)[ \t\n\x0b\x0c\r]+(?=[^ \t\n\x0b\x0c\r])|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*|[ \t\n\x0b\x0c\r]+", "line": r"(?s)[^\n]*\n|[^\n]+"}


def plain_python(doc_id, text, unit="char"):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    alphabet = ["a", "é", "秘", "😀", "́", "<", ">", "<P", "S>", " ", "\n", "\t", "\r\n", "　", "\x00"]
    return ["", None, "x", "\n", " ", "<S>in it", "é" * 9, "<P", "S><", "<", *("".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(300)), "漢字" * 40_000]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equals_plain_python(spark, unit, monkeypatch):
    rows = [(i, t, "x", i) for i, t in enumerate(texts())] + [(None, "no id é", "x", 0), (7, "twice", "x", 0), (7, "twice", "x", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = fill_middle.transform(docs, unit)
    out = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"], r["back"]) for r in out)
    want = sorted((str(i), *plain_python(i, t, unit), t or "") for i, t, *_ in rows)
    assert got == want
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("window", [1, 2, 3, 7, 64])
def test_windows_carry_on(window, monkeypatch):
    monkeypatch.setattr(fill_middle, "WINDOW", window)
    own = [(t or "").encode() for t in texts()[:120]]
    offsets = np.cumsum([0, *map(len, own)])
    raw = np.frombuffer(b"".join(own), np.uint8)
    h = np.arange(len(own)) * 2654435761 % (1 << 32)
    n, low, middle, a, b = fill_middle.cuts(raw, offsets, h, h[::-1].copy())
    for i, t in enumerate(own):
        text = t.decode()
        assert n[i] == len(text)
        assert raw[offsets[i] : a[i]].tobytes().decode() == text[: low[i]]
        assert raw[a[i] : b[i]].tobytes().decode() == text[low[i] : low[i] + middle[i]]


def test_empty_table_and_bytes_that_are_no_utf8(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert fill_middle.transform(docs).count() == 0
    odd = spark.sql("select id as doc_id, cast(unhex('80FF61C3') as string) as text from range(40)")
    out = fill_middle.transform(odd)
    out = out.select("n", F.regexp_replace(F.hex(F.col("output").cast("binary")), "3C5[03]3E|3C4D3E", "").alias("h")).collect()
    assert {r["n"] for r in out} == {4}
    assert all(sorted(r["h"][i : i + 2] for i in range(0, 8, 2)) == ["61", "80", "C3", "FF"] for r in out)
    with pytest.raises(ValueError, match="unit"):
        fill_middle.transform(docs, "page")
