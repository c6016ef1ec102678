"""Alignment of two tokenizers against plain Python, token by token."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marginalia.llm import token_alignment as ta
from marginalia.llm.queries import ALIGNED

PATHS = tuple(map(public_tokenizers.path, ALIGNED))
SCHEMA = "doc_id long, text string, pair string, n_a int"


class Plain:
    """Whole texts, no parts: every token's bytes, every link of every group."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in shown]
        self.byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}

    def piece(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
        b = [(i, self.piece(i)) for i in self.b.encode(text)]
        if any(b"".join(x for _, x in own) != (" " + text).encode() for own in (a, b)):
            return []
        ends = [set(np.cumsum([len(x) for _, x in own]).tolist()) for own in (a, b)]
        both, out, at = ends[0] & ends[1], [], [0, 0]
        place, now = [0, 0], [[], []]
        for stop in sorted(both):
            for k, own in enumerate((a, b)):
                while at[k] < stop:
                    i, raw = own[place[k]]
                    now[k].append(i)
                    at[k] += len(raw)
                    place[k] += 1
            out.append((now[0], now[1]))
            now = [[], []]
        return out

    def rows(self, texts):
        made = [self.groups(t) for t in texts]
        linked = [[(x, y) for g in groups for x in g[0] for y in g[1]] for groups in made]
        count = Counter(p for own in linked for p in set(own))
        best = defaultdict(int)
        for (x, _), n in count.items():
            best[x] = max(best[x], n)
        for groups, own in zip(made, linked, strict=True):
            shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
            yield (
                sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(own),
                sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), shown,
            )


def texts():
    rng = random.Random(7)
    alphabet = ["a", "the", " ", " ", "  ", "é", "é", "秘密", "😀", "\n", "\r\n", "\t", ";\r", "　", "\xa0", "'s", "<s>", "<|endoftext|>", "▁", "\x00", "\x1c", "123", "ing", "​", "。"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(400)]
    fixed = [None, "", " ", "  ", "   ", "a ", "a  ", " a", "\n", " \n", "a \n", "a \n b", "\n\n  a", "a▁b", "ﬁ", "word " * 200, "<unk> </s>", "x" * 5000, "漢字仮名" * 800]
    return fixed + made


@pytest.fixture(scope="module")
def plain():
    return Plain()


def test_equals_plain_python(spark, plain):
    own = texts()
    own += own[20:60]  # repeated rows count as documents of their own
    rows = [(i if i % 50 else None, t, "x", 3) for i, t in enumerate(own)]
    out = ta.align(spark.createDataFrame(rows, SCHEMA).repartition(5), *PATHS).collect()
    got = sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"))) for r in out)
    want = sorted((str(i), *r) for (i, *_), r in zip(rows, plain.rows(own), strict=True))
    assert got == want


def test_pair_counts_and_small_bounds(spark, plain, monkeypatch):
    for name, value in {"KNOWN_PARTS": 20, "BYTES_AT_ONCE": 300, "PAIRS_AT_ONCE": 50, "HELD": 60, "WIDE_GROUP": 2}.items():
        monkeypatch.setattr(ta, name, value)
    parts = ta.Parts(ta.Tokenizers(*PATHS))
    own = texts()[:200]
    count, expected = Counter(), Counter()
    for _, batch in ta.batches([None if t is None else t.encode() for t in own], parts):
        for doc, pair, _ in ta.weighted(batch, parts):
            count.update(p for _, p in {(d, p) for d, p in zip(doc.tolist(), pair.tolist(), strict=True)})
    for t in own:
        expected.update({(x << 32) | y for g in plain.groups(t) for x in g[0] for y in g[1]})
    assert count == expected
    monkeypatch.undo()
    table = ta.pair_counts(spark.createDataFrame([(t,) for t in own], "text string").repartition(3), *PATHS)
    assert {((r["a"] << 32) | r["b"]): r["n"] for r in table.collect()} == expected


def test_wide_groups_link_by_distinct_ids():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 250)
    zeros = [np.zeros(len(x), np.int64) for x in (a, b)]
    _, pair, times = ta.links(a, b, *zeros)
    got = {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(n) for p, n in zip(pair, times, strict=True)}
    assert got == Counter((int(x), int(y)) for x in a for y in b)


def test_runs_that_cross_batches_and_empty_tables(spark):
    rows = [(k // 7, 1) for k in range(700)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        out = ta.sorted_counts(spark.createDataFrame(rows, "pair long, n long").repartition(3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["pair"], r["n"]) for r in out) == [(k, 7) for k in range(100)]
    assert ta.align(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0
    odd = spark.sql("select 1L as doc_id, cast(unhex('61FF') as string) as text union all select 2L, 'fine'")
    assert sorted((r["doc_id"], r["n_a"], r["groups"] == "") for r in ta.align(odd, *PATHS).collect()) == [(1, 0, True), (2, 1, False)]


def test_shards_outside_a_mounted_folder(spark, monkeypatch):
    keys = spark.range(0, 1000).select((F.col("id") * 3).alias("pair"), (F.col("id") + 1).alias("n"))
    shards = ta.write_shards(keys, 1)
    sought = np.array([0, 1, 3, 300, 2997, 2998, 5000])
    assert shards.find(sought).tolist() == [1, 0, 2, 101, 1000, 0, 0]
    monkeypatch.setattr(ta.fs, "LocalFileSystem", type("Other", (), {}))
    shards._open = None
    assert shards.find(sought).tolist() == [1, 0, 2, 101, 1000, 0, 0]
    assert shards.best.tolist() == [1000]
