"""Decontamination and co-training against plain Python."""

from __future__ import annotations

import random

import numpy as np

from pyspark.sql import functions as F

from marginalia.llm import cotraining, decontamination
from marginalia.llm.decontamination import PassageIndex, banded, codes, normal

SYLLABLES = "the of and to in is that for with as on by it at er an re ti en or".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mangled(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("qxz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("qxz"))
    return "".join(out)


def least(item, text):
    """Least edits of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_finds_what_the_edit_budget_allows():
    rng = random.Random(1)
    items = [(i, normal(words(rng, rng.randint(8, 40)))) for i in range(25)]
    index = PassageIndex(items)
    for trial in range(60):
        i, text = rng.choice(items)
        place = words(rng, 30), words(rng, 30)
        shown = mangled(rng, text, rng.randint(0, int(len(text) * 0.08)))
        found = {h.item: h for h in index.found(f"{place[0]} {shown} {place[1]}")}
        assert i in found, (trial, i)
        hit = found[i]
        got = normal(f"{place[0]} {shown} {place[1]}")[hit.start : hit.start + hit.length]
        assert distance(text, got) == hit.edits == least(text, normal(f"{place[0]} {shown} {place[1]}"))


def test_leaves_clean_texts_alone_and_equals_brute_force():
    rng = random.Random(2)
    items = [(i, normal(words(rng, 14))) for i in range(12)]
    index = PassageIndex(items)
    for _ in range(25):
        text = normal(words(rng, 60))
        want = {i for (i, t), k in zip(items, index.budget.tolist(), strict=True) if least(t, text) <= k}
        assert {h.item for h in index.found(text)} == want


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(30):
        item = words(rng, 6)
        part = mangled(rng, item, rng.randint(0, 3))
        edits, end = banded(codes(item), codes("zz" + part + "zz"), -8, 12)
        assert edits <= distance(item, part)
        assert end <= len(part) + 4


def test_odd_texts_and_items(spark):
    rng = random.Random(4)
    passage = words(rng, 30)
    bench = spark.createDataFrame([(1, passage, 0), (2, None, 0), (3, "", 0), (None, passage, 0), (5, "ab", 0), (6, words(rng, 2), 0)], "item_id long, text string, start int")
    long = words(rng, 3000)
    docs = spark.createDataFrame(
        [(1, None, 1), (2, "", 1), (3, passage.upper().replace(" ", " \n"), 1), (None, f"x {passage} y", 1), (5, " AB ", 1), (6, long + " " + passage + " " + long, 1), (6, long, 1), (8, "中文 " * 40, 1)],
        "doc_id long, text string, edits int",
    )
    rows = decontamination.leaks(docs, bench).collect()
    got = sorted((str(r.doc_id), str(r.item_id)) for r in rows if r.item_id != 6)
    assert got == sorted([("3", "1"), ("3", "None"), ("None", "1"), ("None", "None"), ("5", "5"), ("6", "1"), ("6", "None")])
    in_blocks = decontamination.leaks(docs, bench, block_chars=50).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, rows))
    kept = decontamination.drop_contaminated(docs, bench.where("item_id is null or item_id <> 6"))
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "6", "8"]
    assert decontamination.leaks(docs.limit(0), bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(docs, bench.limit(0)).count() == 8


def test_short_items_match_as_whole_words():
    index = PassageIndex([(1, "Ab"), (2, "to be"), (3, "ab"), (4, "xyz"), (5, "a longer passage of words")])
    found = lambda t: sorted((h.item, h.start, h.length) for h in index.found(t))
    assert found("cab abc to bee") == []
    assert found("the AB and\nto  be ab") == [(1, 4, 2), (1, 17, 2), (2, 11, 5), (3, 4, 2), (3, 17, 2)]
    assert found("xyz") == [(4, 0, 3)] and found("") == [] and found(None) == []
    assert found("it has a longer passage of words xyz") == [(4, 33, 3), (5, 7, 25)]


def test_short_items_beside_punctuation_and_in_scripts_without_blanks():
    index = PassageIndex([(1, "secret7"), (2, "秘密の質問"), (3, "ああ"), (4, "c++"), (5, "é"), (6, "رمز")])
    found = lambda t: sorted((h.item, h.start) for h in index.found(t))
    assert found("the secret7. end, (secret7) secret77 xsecret7 secret7") == [(1, 4), (1, 19), (1, 46)]
    assert found("これは秘密の質問です") == [(2, 3)] and found("abc秘密の質問7") == [(2, 3)]
    assert found("あああ") == [(3, 0), (3, 1)]
    assert found("in c++, not c++x or xc++") == [(4, 3), (4, 12)]
    assert found("é né é") == [(5, 0), (5, 5)] and found("(رمز) رمزي") == [(6, 1)]


def test_short_items_equal_brute_force():
    rng = random.Random(9)
    items = ["".join(rng.choices("ab .秘", k=rng.randint(1, 4))) for _ in range(40)]
    index = PassageIndex(list(enumerate(items)))
    for _ in range(200):
        t = normal("".join(rng.choices("ab .秘c", k=rng.randint(0, 60))))
        joined = lambda i: 0 < i < len(t) and t[i - 1] in "abc" and t[i] in "abc"  # noqa: B023, E731
        want = [(k, i) for k, own in enumerate(map(normal, items)) if own for i in range(len(t)) if t.startswith(own, i) and not joined(i) and not joined(i + len(own))]
        assert sorted((h.item, h.start) for h in index.found(t)) == sorted(want)


def test_repeats_of_a_passage_take_linear_time():
    import time

    rng = random.Random(6)
    passage = normal(words(rng, 14))
    index, took = PassageIndex([(1, passage), (2, "so7")]), []
    for n in (4000, 8000, 16000):
        text, at = (passage + " qqzz so7 ") * n, time.process_time()
        hits = index.found(text)
        took.append(time.process_time() - at)
        assert sum(h.item == 1 for h in hits) == n and sum(h.item == 2 for h in hits) == n
    assert took[2] < 8 * took[0] + 0.5


def test_chunks_of_a_long_text(monkeypatch):
    rng = random.Random(5)
    passage = normal(words(rng, 25))
    index = PassageIndex([(7, passage)])
    monkeypatch.setattr(decontamination, "CHUNK", 500)
    for at in range(0, 1200, 37):
        text = normal(words(rng, 300))[:at].strip() + " " + passage + " " + normal(words(rng, 200))
        assert [h.item for h in index.found(text)] == [7]


# -- co-training ------------------------------------------------------------------


def table(spark, n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, good = words(rng, rng.randint(20, 120)) + ".", rng.random() < 0.8
        if not good:
            text = rng.choice([" ".join(w.upper() + "!!" for w in text.split()), " ".join(w + "%%%" for w in text.split()), " ".join(text.split()[:1] * 60)])
        rows.append((i, text, "en", f"src{i % 4}", len(text), 1))
        if i % 2:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(spark):
    docs, labels, rows = table(spark, 1200, 1)
    scored = {r.doc_id: r for r in cotraining.score(docs, cotraining.fit(docs, labels)).collect()}
    unseen = [r for r in rows if r[0] % 2 == 0]
    good = lambda r: r[1].endswith(".") and not r[1].isupper() and len(set(r[1].split())) > 2
    assert np.mean([scored[r[0]].keep == good(r) for r in unseen]) > 0.97
    assert np.mean([scored[r[0]].keep for r in unseen if good(r)]) > 0.98
    kept = cotraining.keep_good(docs, labels)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, r in scored.items() if r.keep}
    again = {r.doc_id: r for r in cotraining.score(docs, cotraining.fit(docs, labels)).collect()}
    assert again == scored


def test_exchange_equals_plain_python(spark):
    docs, labels, rows = table(spark, 500, 3)
    rank = {r.i: r.h for r in spark.range(500).select(F.col("id").alias("i"), F.xxhash64(F.lit(11), "id").alias("h")).collect()}
    known = sorted(((rank[r.doc_id], r.doc_id, r.quality) for r in labels.collect()))[:100]
    held, seen = known[::4], [x for i, x in enumerate(known) if i % 4]
    named = {r.doc_id for r in labels.collect()}
    made = {r[0]: (cotraining.text_view(r[1]).astype(np.float16).astype(np.float32), cotraining.page_view(r[1], r[3], r[2])) for r in rows}
    full = {r[0]: (cotraining.text_view(r[1]), made[r[0]][1]) for r in rows}
    sets = [[(made[i][k], y) for _, i, y in seen] for k in (0, 1)]
    fitted = lambda: [cotraining.logistic(np.stack([x for x, _ in s]), np.array([y for _, y in s], np.float32), cotraining.L2) for s in sets]
    weights, gone, good = fitted(), set(), np.mean([y for _, _, y in seen])
    for _ in range(2):
        free = [i for i in full if i not in named and i not in gone]
        picked = []
        for k in (0, 1):
            score = {i: float(full[i][k] @ weights[k][:-1] + weights[k][-1]) for i in free}
            order = lambda i: (rank[i], i)
            low = sorted((i for i in free if score[i] < 0), key=lambda i: (score[i], order(i)))[: round(20 * (1 - good))]
            high = sorted((i for i in free if score[i] > 0), key=lambda i: (-score[i], order(i)))[: round(20 * good)]
            picked.append([(i, 0.0) for i in low] + [(i, 1.0) for i in high])
        for k in (0, 1):
            sets[1 - k] += [(made[i][1 - k], y) for i, y in picked[k]]
            gone |= {i for i, _ in picked[k]}
        weights = fitted()
    assert len(sets[0]) > len(seen) + 20 and len(sets[1]) > len(seen) + 20
    want = cotraining.calibrated(weights, [np.stack([made[i][k] for _, i, _ in held]) for k in (0, 1)], np.array([y for _, _, y in held]))
    got = cotraining.fit(docs, labels, labelled=100, rounds=2, share=1.0, taught=20)
    assert np.allclose(got.text, want.text, atol=1e-4) and np.allclose(got.page, want.page, atol=1e-4)
    assert np.allclose(got.mix, want.mix, atol=1e-3) and min(got.mix[:2]) >= cotraining.LEAST_WEIGHT - 1e-9
    scored = {r.doc_id: r.p_good for r in cotraining.score(docs, got).collect()}
    for i, _, text, source, lang in [(r[0], 0, r[1], r[3], r[2]) for r in rows[:50]]:
        assert abs(scored[i] - want.score(text, source, lang)[2]) < 1e-3


def test_one_row_an_id_teaches(spark):
    docs, labels, _ = table(spark, 200, 4)
    again = docs.unionByName(docs.where("doc_id < 20").crossJoin(spark.range(30)).drop("id"))
    got = cotraining.features(again, spark.createDataFrame([(i,) for i in range(20)], "id long"))
    assert sorted(i for i, _, _ in got) == list(range(20))
    assert isinstance(cotraining.fit(again, labels), cotraining.Model)


def test_odd_rows_and_labels(spark):
    docs, labels, _ = table(spark, 300, 2)
    odd = spark.createDataFrame([(9001, None, None, None, None, 1), (None, "x", None, "s", 1, 1), (9003, "", "en", None, 0, 1), (9003, "", "en", None, 0, 1), (9004, "word " * 50_000, "en", "s", 1, 1)], docs.schema)
    extra = spark.createDataFrame([(None, 1, 0), (1, 7, 0), (1, None, 0), (424242, 0, 0)], labels.schema)
    every = docs.unionByName(odd)
    rows = cotraining.score(every, cotraining.fit(every, labels.unionByName(extra))).collect()
    assert len(rows) == 305 and all(0 <= r.p_good <= 1 for r in rows)
    assert cotraining.keep_good(docs.limit(0), labels).count() == 0
    none = cotraining.score(docs, cotraining.fit(docs, labels.limit(0))).collect()
    assert all(r.keep and r.p_good == 1.0 for r in none)
    ones = cotraining.fit(docs, labels.where("quality = 1"))
    assert ones == 1.0 and cotraining.keep_good(docs, labels.where("quality = 1")).count() == 300
