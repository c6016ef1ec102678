"""Packing, line dedup and SimHash against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from marginalia.llm import line_dedup, packing, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "a", "Ünï ÇØDÉ 中文 \x1c x", "it's 12 o'clock <|endoftext|> ﬁ", "word " * 9000, "same text here", "same text here"]


# -- packing -------------------------------------------------------------------


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    rng, plain = random.Random(5), Tokenizer.from_file(TOKENIZER)
    letters = list("aBéßÿµª²½'’ \t\n\x00\x0b\x1c\x85\xa0　<|>中Σςİé̀-_.,!?0５Ⅷ😀st're'll") + ["<|endoftext|>", "'s", "ﬁ", "ΑΣ "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["a" * n + "!" * n for n in range(20, 28)] + ["!", "!\x00", "!\x00\x00", "'s's 'Re'VE''s x'll'", "'", "x'"]
    made = packing.WordIds(TOKENIZER).encode(texts)
    for text, ids in zip(texts, made, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_each_part_is_learned_once():
    words = packing.WordIds(TOKENIZER)
    text = " ".join("abcdefghijklmnopqrstuvwxyz"[:n] + "!?" for n in range(1, 27))
    words.encode([text])
    known = words.table.n
    words.encode([text, "x " + text])
    assert known == 27 and words.table.n == 28


def test_ids_with_a_small_table(monkeypatch):
    """What the table forgets is learned again."""
    monkeypatch.setattr(packing, "KNOWN_PARTS", 64)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 30) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    small = packing.WordIds(TOKENIZER)
    for i in range(0, 200, 10):
        for text, ids in zip(texts[i : i + 10], small.encode(texts[i : i + 10]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENIZER)
    texts = ODD + [f"some words {i} " * (i % 300) for i in range(300)]
    rows = packing.pack(documents(spark, texts), TOKENIZER).collect()
    want = {}
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[i, k] = (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096
    assert len(at) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_solve_uses_up_every_count():
    rng = np.random.default_rng(3)
    for n in (1, 5, 400):
        lengths = np.sort(rng.choice(np.arange(1, 4097), n, replace=False))
        counts = rng.integers(1, 50, n)
        plan, least = packing.solve(lengths, counts)
        assert least <= sum(n for _, n in plan)
        used = np.zeros(n, np.int64)
        for own, times in plan:
            assert sum(a * lengths[i] for i, a in own.items()) <= 4096
            for i, a in own.items():
                used[i] += a * times
        assert (used == counts).all()


def test_solve_reaches_known_optima_and_its_bound():
    # Perfect fillings exist: 1948 + 2148, and 1000 + 1500 + 1596; best fit alone needs more.
    plan, least = packing.solve(np.array([1000, 1500, 1596, 1948, 2148]), np.full(5, 30_000))
    assert least == sum(n for _, n in plan) == 60_000
    # Only three of these fit, whatever their volume: the prices must find the bound.
    lengths = np.arange(1100, 1500, 2)
    plan, least = packing.solve(lengths, np.full(len(lengths), 90))
    assert least > lengths.sum() * 90 / 4096 * 1.04 and sum(n for _, n in plan) <= 1.01 * least


def test_pack_over_many_partitions(spark):
    texts = [("a few words " * (i % 7)).strip() for i in range(900)]
    rows = packing.pack(documents(spark, texts).repartition(37), TOKENIZER).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert len(rows) == 900 and max(at.values()) <= 4096
    assert len(at) == -(-sum(r.length for r in rows) // 4096)


def test_pack_empty_nulls_and_clashing_columns(spark):
    assert packing.pack(documents(spark, []), TOKENIZER).count() == 0
    odd = spark.createDataFrame([(None, "x", 1, "s", 7), (None, "x", 1, "s", 7), (3, None, 2, None, 8)], "doc_id long, text string, length int, sequence_id string, salt int")
    rows = packing.pack(odd, TOKENIZER).collect()
    assert len(rows) == 3 and sorted(r.length for r in rows) == [1, 2, 2]


# -- line dedup ------------------------------------------------------------------


def brute_lines(docs, least=20, copies=3):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < copies or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    pool = [f"A common line number {i} of the corpus" for i in range(8)] + ["short", "", "  ÄÖ a common line with umlauts é ", "\tA COMMON line number 1 of the corpus\r"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "\n\n"), (None, pool[0]), (5, docs[5][1]), (6, pool[1] + "\nother")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.line_dedup(frame).collect()), key=str)
    assert got == brute_lines(docs)


def test_line_dedup_long_text_and_hot_line(spark):
    line = "the very same line in every document"
    docs = [(i, "\n".join([line] * 50 + [f"own line of document {i} here"])) for i in range(40)] + [(99, "\n".join([line] * 20_000))]
    rows = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[99].n_dropped == 0 and rows[99].n_lines == 20_000
    assert all(rows[i].kept == f"own line of document {i} here" and rows[i].n_dropped == 50 for i in range(40))


def test_dedup_documents_keeps_columns(spark):
    texts = ["a line that is in all of them\nx" for _ in range(4)] + [None, ""]
    docs = documents(spark, texts)
    docs = docs.selectExpr("*", "1 as kept", "2 as gone", "3 as id", "4 as row", "array(1) as h1")
    out = line_dedup.dedup_documents(docs)
    assert out.schema == docs.schema
    rows = {r.doc_id: r for r in out.collect()}
    assert [rows[i].text for i in range(6)] == ["x", "x", "x", texts[3], None, ""]
    assert rows[0].n_chars == 1 and rows[3].n_chars == len(texts[3]) and rows[4].n_chars is None
    assert line_dedup.dedup_documents(docs.limit(0)).count() == 0
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


# -- simhash -----------------------------------------------------------------------


def brute_print(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 150))) for _ in range(60)]
    texts = ODD + base + [edited(rng, b, 1) for b in base if b for _ in range(3)]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame([*zip(ids, texts, strict=True), (None, "x y z")], "doc_id long, text string")
    rows = simhash.classes(docs).collect()
    prints = {i: brute_print(t, 4) for i, t in zip(ids, texts, strict=True)}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {r.doc_id: r.w0 % 2**64 for r in rows if r.doc_id is not None} == prints
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == {i: find(i) for i in ids}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


@pytest.mark.parametrize("tile", [4, 64])
def test_small_tiles_lose_no_link(tile):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flip = lambda: np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False)))
    fps = np.unique(np.array([c ^ flip() for c in centres for _ in range(12)], np.uint64))
    high, low = np.bitwise_count(fps >> np.uint64(32)), np.bitwise_count(fps & np.uint64(0xFFFFFFFF))
    of = (high.astype(int) * 33 + low).tolist()
    sizes = {c: of.count(c) for c in set(of)}
    plan = {c: row for c, *row in simhash.plan_tiles(sizes, simhash.CONTRACT, tile)}
    tiles = np.array([plan[c][0] + int(f) % plan[c][1] for c, f in zip(of, fps, strict=True)])
    assert max(np.bincount(tiles)) <= 4 * tile
    none, whole = np.zeros(len(fps), np.int64), simhash.Forest(len(fps))
    order = simhash._order(fps[:, None], none, none, simhash.CONTRACT)
    ranges = {int(tiles[k]): plan[c][2:] for k, c in enumerate(of)}
    for i, (low, high) in ranges.items():
        assert all(ranges[j][0] <= i <= ranges[j][1] for j in range(low, high + 1) if j in ranges)
        for j in range(i, high + 1):
            left, right = order[tiles[order] == i], order[tiles[order] == j]
            root = simhash.link_tiles(fps[:, None], none, left, left if i == j else right, simhash.CONTRACT).root
            whole.link(np.arange(len(fps)), root)
    want = simhash.Forest(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 4)
        want.link(np.full(len(near), i), near)
    assert (whole.root == want.root).all()


def test_near_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(30)]
    near = [edited(rng, b, 2) for b in base]
    docs = documents(spark, base + near + base[:5] + [None]).selectExpr("*", "doc_id as node", "n_chars as w0", "lang as component")
    out = simhash.keep_representatives(docs)
    assert out.schema == docs.schema
    assert sorted(r.doc_id for r in out.collect()) == [*range(30), 65]
    assert simhash.keep_representatives(docs.limit(0)).count() == 0
    twice = docs.limit(3).unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    assert sorted(str(r.doc_id) for r in simhash.keep_representatives(twice).collect()) == ["0", "1", "2", "None"]


def test_two_texts_under_one_id(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    one, two, three = text(), text(), text()
    rows = [(3, one), (5, one + " x"), (5, two), (7, two + " y"), (9, three), (9, three), (11, text())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [sorted((r.doc_id, r.text) for r in simhash.keep_representatives(docs.repartition(n)).collect()) for n in (1, 3)]
    # 5 joins both classes to 3, whose text is the one that stays.
    assert kept[0] == kept[1] == sorted([(3, one), (9, three), rows[-1]])
    alone = docs.where("doc_id = 5")
    assert len({tuple(r) for n in (1, 2) for r in simhash.keep_representatives(alone.repartition(n)).collect()}) == 1


@pytest.mark.parametrize("rows", [4096, 3])
def test_near_links_are_the_exact_similarity(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, gone = [], set()
    # Shingles, those of them kept at a change of the end; 0.8, 0.782, 0.7.
    for n, kept in [(90, 80), (90, 79), (85, 70)] * 20:
        own = [word() for _ in range(n + 4)]
        texts += [" ".join(own), " ".join(own[: kept + 4] + [word() for _ in range(n - kept)])]
        if kept / (2 * n - kept) >= 0.8:
            gone.add(len(texts) - 1)
    for _ in range(40):  # 4 against 5 shingles
        own = [word() for _ in range(9)]
        texts += [" ".join(own), " ".join(own[:8])]
        gone.add(len(texts) - 1)
    # A group in which only some links hold: neighbours share 0.8, others less.
    own = [word() for _ in range(94 + 10 * 11)]
    texts += [" ".join(own[10 * i : 10 * i + 94]) for i in range(12)]
    gone |= set(range(len(texts) - 11, len(texts)))
    docs = documents(spark, texts)
    assert {r.doc_id for r in simhash.keep_representatives(docs).collect()} == set(range(len(texts))) - gone


def test_a_shorter_member_of_a_fingerprint_links(spark):
    # Without shingles of its own, each text has its set of one; sums tell sets of equal count apart.
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base[: 40 - i]) for i in range(6)] + [" ".join(base)] * 3
    gone = {r.doc_id for r in simhash.classes(documents(spark, texts), simhash.NEAR).collect() if r.component_id != r.doc_id}
    assert gone == set(range(1, 9))


def test_near_classes_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {i: set(simhash.shingle_hashes(t or "", 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.component_id for r in simhash.classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), simhash.NEAR).collect()}
    linked = [i for i in ids if find(i) != i]
    caught = sum(got[i] == find(i) for i in linked) / len(linked)
    print(f"near classes: {len(linked)} linked by all pairs, {caught:.3f} caught")
    assert caught >= 0.99 and all(got[i] == i for i in ids if find(i) == i and all(find(j) != i for j in linked))


def test_one_large_group(spark):
    rng = random.Random(6)
    text = " ".join(f"w{i}" for i in range(400))
    docs = documents(spark, [edited(rng, text, i % 2) for i in range(1500)])
    assert {r.component_id for r in simhash.classes(docs).collect()} == {0}


def test_queries_agree(spark):
    from marginalia.llm import queries

    d = "/root/testdata/sf0.001"
    rows = queries.op3_line_dedup(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_lines(sorted(texts.items()))}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want
