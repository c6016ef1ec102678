"""Segmentation against a plain Viterbi; the sidecar against a rebuild."""

from __future__ import annotations

import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import segment
from marginalia.operators import sidecar, vector

ALPHABET = "abcdé秘😀▁"


def plain(words, pieces, scores, unknown):
    """Each word's best cut, one substring at a time."""
    known = {p: (i, float(np.float32(s))) for i, (p, s) in enumerate(zip(pieces, scores, strict=True))}
    free = min(float(np.float32(s)) for s in scores) - 10
    out = []
    for word in words:
        best = [(0.0, 0, unknown)]
        for j in range(1, len(word) + 1):
            now = (best[j - 1][0] + free, j - 1, unknown)
            for i in range(max(0, j - 24), j):
                if word[i:j] in known and best[i][0] + known[word[i:j]][1] > now[0]:
                    now = best[i][0] + known[word[i:j]][1], i, known[word[i:j]][0]
            best.append(now)
        ids, j = [], len(word)
        while j:
            _, i, p = best[j]
            if not (p == unknown and ids and ids[-1] == unknown):
                ids.append(p)
            j = i
        out.append(ids[::-1])
    return out


@pytest.fixture(scope="module")
def pieces():
    rng = random.Random(1)
    own = ["<unk>", *sorted({"".join(rng.choices(ALPHABET, k=rng.randint(1, 5))) for _ in range(200)} | {"a" * 24, "b" * 25, MARKED})]
    return own, [-20.0, *(-rng.choice([1, 2, 3, rng.random() * 9]) for _ in own[1:])]


MARKED = segment.MARK + "ab"


def test_segments_equal_a_plain_viterbi(pieces):
    rng = random.Random(2)
    words = ["".join(rng.choices(ALPHABET + "xyz", k=rng.randint(0, 30))) for _ in range(1500)] + ["x" * 3000, "a" * 60, "b" * 60, "秘x😀" * 40]
    vocab = segment.Vocabulary(*pieces, 0)
    assert [x.tolist() for x in vocab.segment(words)] == plain(words, *pieces, 0)
    assert vocab.segment([]) == []


def test_texts_are_composed_and_parted(spark, pieces, monkeypatch):
    monkeypatch.setattr(segment, "CHARS_AT_ONCE", 40)
    vocab = segment.Vocabulary(*pieces, 0)
    texts = [None, "", " \n ", "ab, (cd)ab", "éa ﬁ Ａb", "a　b\tc", "<unk>", "a_b-c"]
    want = []
    for t in texts:
        spaced = re.sub(r"([!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~])", r" \1 ", unicodedata.normalize("NFKC", t or ""))
        want.append([i for own in plain([segment.MARK + w for w in spaced.split()], *pieces, 0) for i in own])
    got = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2).select("id", segment.segments(spark, F.col("t"), vocab).alias("ids")).collect()
    assert [r["ids"] for r in sorted(got)] == want


def test_vocabulary_files_are_checked(tmp_path, pieces):
    def file(model):
        path = tmp_path / "v.json"
        path.write_text(json.dumps({"model": model}), encoding="utf-8")
        return str(path)

    good = {"type": "Unigram", "unk_id": 0, "vocab": [list(r) for r in zip(*pieces, strict=True)]}
    vocab = segment.load_vocabulary(file(good))
    assert [x.tolist() for x in vocab.segment(["abc"])] == plain(["abc"], *pieces, 0)
    for bad in (
        good | {"type": "BPE"}, good | {"unk_id": None}, good | {"unk_id": 10_000}, good | {"vocab": []}, good | {"vocab": [["a", "1"]]}, good | {"vocab": [["a", True]]},
        good | {"vocab": [["a"]]}, good | {"vocab": [["a", 1.0], ["a", 2.0]]}, good | {"vocab": [["a", float("inf")]]},
    ):
        with pytest.raises(ValueError):
            segment.load_vocabulary(file(bad))
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(ValueError):
        segment.load_vocabulary(str(tmp_path / "list.json"))


def test_vocabulary_tables(spark, monkeypatch):
    rows = spark.createDataFrame([("ab", -1.0), ("a", -2.0), ("b", -1.0)], "piece string, score double")
    vocab = segment.vocabulary(rows)
    assert [x.tolist() for x in vocab.segment(["ab", "ba", "aab", "zz"])] == [[1], [2, 3], [3, 1], [0]]
    monkeypatch.setattr(segment, "MOST_PIECES", 2)
    with pytest.raises(ValueError, match="pieces"):
        segment.vocabulary(rows)


# -- vectors ---------------------------------------------------------------------


@pytest.mark.parametrize("batch", [3, 1000])
def test_search_keeps_the_best_documents(spark, batch, monkeypatch):
    monkeypatch.setattr(vector, "SCORES_AT_ONCE", 20)
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 40)), rng.integers(-3, 4, 6).astype(float).tolist()) for _ in range(200)]
    rows += [(None, [1.0] * 6), (7, None), (8, [])]
    asked = [(q, rng.normal(size=6).tolist()) for q in range(9)] + [(50, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = vector.sign_search(vectors, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 5, bound=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for q, v in asked:
        unit = np.array(v) / (np.linalg.norm(v) or 1)
        best = {}
        for doc, row in rows:
            if doc is not None and row:
                best[doc] = max(best.get(doc, -9.0), round(float(np.where(np.array(row) > 0, 1, -1) @ unit), 6))
        want += [(q, doc, f"{score + 0:.5f}", i + 1) for i, (doc, score) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
    assert sorted((r["query_id"], r["doc_id"], f"{r['score'] + 0:.5f}", r["rank"]) for r in got) == sorted(want)


META = sidecar.Meta("words", "1", 4, 30)


def rows_of(df):
    return sorted((r["doc_id"], r["chunk"], round(r["scale"], 9), tuple(r["values"])) for r in df.collect())


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def model(spark, dim=4):
    rng = np.random.default_rng(4)
    return sidecar.model_rows(spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(25)], "id long, embedding array<double>"), dim)


def test_sidecar_equals_a_rebuild(spark, tmp_path):
    pieces = lambda t: sidecar.word_ids(t, 30)  # noqa: E731  (ids 25 to 29 are not in the model)
    make = lambda name, meta=META: sidecar.Sidecar(spark, f"{tmp_path}/{name}", meta, model(spark), pieces)
    first = [(1, "One", "apples and pears\n\nplums in the garden of the house\n\nmore"), (2, "Two", "short"), (3, None, "untitled text"), (4, "Four", None), (None, "No id", "text"), (2, "Two", "short")]
    side = make("live")
    n = side.sync(documents(spark, first))
    assert n == sidecar.chunk_rows(documents(spark, first), META).select("hash").distinct().count()
    assert side.sync(documents(spark, first)) == 0
    # An edit of one paragraph, a copy, an insertion and a deletion.
    second = [(1, "One", "apples and pears\n\nplums in the garden of the city\n\nmore"), (5, "Two", "short"), (6, "Six", "words " * 40), (3, None, "untitled text")]
    docs = documents(spark, second)
    old = sidecar.chunk_rows(documents(spark, first), META)
    fresh = sidecar.chunk_rows(docs, META).join(old, "hash", "left_anti").select("hash").distinct().count()
    assert side.sync(docs) == fresh > 0
    whole = make("new")
    whole.sync(docs)
    assert rows_of(side.vectors(docs)) == rows_of(whole.vectors(docs))
    side.compact(docs)
    assert rows_of(side.vectors(docs)) == rows_of(whole.vectors(docs)) and side.stored().count() == whole.stored().count()
    asked = spark.createDataFrame([(0, "plums in the garden"), (1, "short")], "query_id long, text string")
    for exact in (True, False):
        assert side.search(docs, asked, 3, exact).collect() == whole.search(docs, asked, 3, exact).collect()
    # Another revision has vectors of its own; unfinished or foreign files are left out.
    assert make("live", sidecar.Meta("words", "2", 4, 30)).stored().count() == 0
    spark.range(3).write.parquet(f"{side.folder}/generation-000009-foreign")
    (tmp_path / "live" / META.key / "generation-000010-cut").mkdir()
    assert rows_of(side.vectors(docs)) == rows_of(whole.vectors(docs))


def test_sums_are_of_dequantised_rows(spark):
    rng = np.random.default_rng(5)
    table = {i: rng.normal(size=3) for i in range(6)}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], "id long, embedding array<double>")
    tokens = [("a", [0, 1, 1, 5]), ("b", []), ("c", [9]), ("d", [2] * 50)]
    got = {r["hash"]: r["embedding"] for r in sidecar.sums(spark.createDataFrame(tokens, "hash string, ids array<long>"), sidecar.model_rows(rows, 3), 3).collect()}
    for key, ids in tokens:
        want = np.zeros(3)
        for i in ids:
            if i in table:
                scale = np.abs(table[i]).max() / 127
                want += np.rint(table[i] / scale) * scale
        assert np.allclose(got[key], want)
    with pytest.raises(Exception, match="repeated"):
        sidecar.model_rows(rows.union(rows), 3).collect()
    with pytest.raises(Exception, match="numbers"):
        sidecar.model_rows(rows, 4).collect()
