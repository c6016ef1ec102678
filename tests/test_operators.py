"""Operators on hand-computed rows and against plain Python."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import dynamics, evaluate, gate, index, labels, pairs, rank, recall, records, rerank, routing, sections, store, vector


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def post(spark):
    return frame(spark, [(1, "cat", 2), (1, "dog", 1), (2, "cat", 1)], "doc_id long, term string, tf long")


def test_bm25_by_formula(spark, post):
    lengths = frame(spark, [(1, 3), (2, 1)], "doc_id long, doclen long")
    stats = frame(spark, [(2, 4, 2.0)], "n_docs long, total_len long, avgdl double")
    terms = frame(spark, [(0, "cat", 1.0)], "query_id long, term string, weight double")
    got = {r.doc_id: r.score for r in rank.bm25(terms, post, lengths, stats).collect()}
    idf = math.log(1 + 0.5 / 2.5)
    want = {1: idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)), 2: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 / 2))}
    assert got == {k: round(v, 6) for k, v in want.items()}


def test_script_bonus(spark):
    docs = frame(spark, [(1, "moving checklist"), (2, "moving 手続"), (3, "other")], "doc_id long, text string")
    own = index.postings(docs, exact=True)
    lengths = index.doc_lengths(own)
    terms = rank.query_terms(frame(spark, [(0, "moving 手続")], "query_id long, text string"), True)
    both = {r.doc_id: r.score for r in rank.bm25(terms, own, lengths, index.corpus_stats(docs, lengths)).collect()}
    plain = {r.doc_id: r.score for r in rank.bm25(terms, own, lengths, index.corpus_stats(docs, lengths), False).collect()}
    assert both[1] == plain[1] and abs(both[2] - 1.5 * plain[2]) < 1e-5


def test_filter_stays_above_the_cut(spark):
    scores = frame(spark, [(0, i, 100.0 - i) for i in range(50)], "query_id long, doc_id long, score double")
    visible = frame(spark, [(i,) for i in range(30, 50)], "doc_id long")
    got = rank.cut_then_filter(scores, visible, 8)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [30, 31]


def test_fusion_and_ranks(spark):
    a = frame(spark, [(0, 1, 3.0), (0, 2, 3.0), (0, 3, 1.0)], "query_id long, doc_id long, score double")
    assert [r["rank"] for r in rank.shared_ranks(a).orderBy("doc_id").collect()] == [1, 1, 3]
    b = frame(spark, [(0, 3, 9.0)], "query_id long, doc_id long, score double")
    got = {r.doc_id: r.score for r in rank.rrf([(a, 1.0), (b, 0.4)]).collect()}
    assert got == {1: round(1 / 6, 6), 2: round(1 / 6, 6), 3: round(1 / 8 + 0.4 / 6, 6)}


def test_access_fold_equals_steps(spark):
    rng, rows, want = random.Random(7), [], {}
    for key in range(60):
        at, strength, stability, last = datetime(2024, 1, 1), 1.0, 7.0, None
        for _ in range(rng.randint(1, 40)):
            at += timedelta(minutes=rng.choice([1, 30, 59, 60, 61, 6000]))
            rows.append((key, at))
            if last is None or at - last >= timedelta(hours=1):
                stability = min(365.0, stability * 1.5)
            strength, last = min(5.0, strength + 0.25), at
        want[key] = (strength, pytest.approx(stability, abs=1e-5), last)
    got = dynamics.fold_accesses(frame(spark, rows, "key long, ts timestamp")).collect()
    assert {r.key: (r.strength, r.stability, r.last_access) for r in got} == want


def test_decay_and_stale(spark):
    now = F.lit("2024-06-01").cast("timestamp")
    rows = [("a", 1.0, 7.0, datetime(2024, 5, 25), "work", None), ("b", 1.0, 7.0, datetime(2024, 1, 1), "work", None), ("c", 1.0, 7.0, datetime(2024, 1, 1), "identity", None),
            ("d", 1.0, 7.0, datetime(2024, 1, 1), "_archive/x", None), ("e", 1.0, 7.0, None, "work", None), ("f", 1.0, 7.0, datetime(2024, 1, 1), "w", "2024-05-31"), ("g", 1.0, 7.0, datetime(2024, 1, 1), "w", "bad")]
    notes = frame(spark, rows, "key string, strength double, stability double, last_access timestamp, zone string, expires_at string")
    eff = {r.key: r.e for r in notes.select("key", dynamics.effective(F.col("strength"), F.col("stability"), F.col("last_access"), now).alias("e")).collect()}
    assert eff["a"] == round(math.exp(-1), 6) and eff["b"] == 0.05 and eff["e"] == 1.0
    assert sorted(r.key for r in dynamics.stale(notes, now).collect()) == ["b", "g"]


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, sorted(rng.sample([f"t{j}" for j in range(25)], rng.randint(1, 15)))) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 230)]
    sets = frame(spark, rows, "doc_id long, terms array<string>")
    heads = {}
    for i, t in rows:
        heads.setdefault(tuple(t), i)
    want = set()
    own = sorted((i, set(t)) for t, i in heads.items())
    for x, (a, s) in enumerate(own):
        for b, t in own[x + 1 :]:
            if len(s & t) >= 3 and len(s & t) / len(s | t) >= 0.55:
                want.add((a, b, len(s & t)))
    assert {(r.a, r.b, r.common) for r in pairs.similar_pairs(sets).collect()} == want
    sizes = {r.doc_id: (r.class_id, r.class_size) for r in pairs.classes(sets).collect()}
    assert sizes[215] == (0, 31)


def test_similar_pairs_exchange_no_candidates(spark, monkeypatch):
    """Candidates stay in their tasks, over several blocks of one length, with rare terms and terms that share a hash."""
    monkeypatch.setattr(pairs, "FREQUENT", 9)
    monkeypatch.setattr(pairs, "BLOCK_TERMS", 150)
    monkeypatch.setattr(pairs, "NUMBERS_AT_ONCE", 1 << 10)
    monkeypatch.setattr(pairs, "_rare_key", lambda t: F.when(t.isin("t3", "t4", "t31"), F.lit(-7).cast("long")).otherwise(F.xxhash64(t).bitwiseOR(F.lit(-(1 << 63)))))
    rng = random.Random(12)
    rows = [(f"d{i}", sorted(rng.sample([f"t{j}" for j in range(40)], rng.choice((3, 8, 8, 20))))) for i in range(160)]
    rows += [(f"e{i}", sorted({*rows[i][1], f"u{i}"})) for i in range(60)]
    heads = {}
    for i, t in sorted(rows):
        heads.setdefault(tuple(t), i)
    own = sorted((i, set(t)) for t, i in heads.items())
    want = {(a, b, len(s & t), round(len(s & t) / len(s | t), 6)) for x, (a, s) in enumerate(own) for b, t in own[x + 1 :] if len(s & t) >= 3 and len(s & t) / len(s | t) >= 0.55}
    got = pairs.similar_pairs(frame(spark, rows, "doc_id string, terms array<string>"))
    assert len(want) > 30 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_prefixes_shorten_with_the_length_of_the_other_set():
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(400), rng.randint(20, 60))) for _ in range(150)]
    sets += [sorted(set(s[: int(len(s) * rng.uniform(0.5, 1))] + rng.sample(range(400), 3))) for s in sets]
    sets.sort(key=len)
    table = pa.table({"doc_id": list(range(len(sets))), "n": pa.array([len(s) for s in sets], pa.int32()), "keys": pa.array(sets, pa.list_(pa.int32()))})
    jaccard = lambda i, j: len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j]))
    got, want = set(), {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(i, j) >= 0.55}
    for low in range(0, len(sets), 60):
        block = pairs._block(table.slice(low, 60), 0.55)
        assert pairs._against(block, 50, 0.55).entries.size < block.entries.size
        for batch in table.slice(low).sort_by([("n", "descending")]).to_batches(max_chunksize=40):
            got |= {(r["x"], r["y"]) for out in pairs._near(iter([batch]), block, 0.55, 3) for r in out.to_pylist()}
    assert want and {(max(p), min(p)) for p in got} == want


def test_similar_pairs_of_nothing(spark):
    kind = "doc_id long, terms array<string>"
    assert pairs.similar_pairs(frame(spark, [], kind)).count() == 0
    few = [(1, []), (2, None), (3, ["a"]), (4, ["a", "b", "c"]), (5, ["a", "b", "c", "d"]), (6, [])]
    assert [tuple(r) for r in pairs.similar_pairs(frame(spark, few, kind)).collect()] == [(4, 5, 3, 0.75)]


def test_partners_exchange_no_candidates(spark):
    """Both cuts, by hand; the pairs that they rank come from no join."""
    base = [f"t{j}" for j in range(12)]
    rows = [(i, sorted([*base, *(f"u{i}_{j}" for j in range(i))])) for i in range(6)]
    found = pairs.similar_pairs(frame(spark, rows, "doc_id long, terms array<string>"))
    got = pairs.partners(found, prefilter=3, keep=2)
    share = lambda a, b: round(12 / (12 + a + b), 6)
    want = set()
    for a in range(6):
        near = [b for b in range(6) if b != a and share(a, b) >= 0.55][:3]  # all have 12 in common: by id
        best = sorted(near, key=lambda b: (-share(a, b), b))[:2]
        want |= {(a, b, share(a, b), r + 1) for r, b in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_set_keys_are_short_and_one_terms(spark, monkeypatch):
    """Four bytes a key, sorted, no wide row sorted for a join; terms that share the short hash keep keys of their own."""
    monkeypatch.setattr(pairs, "FREQUENT", 2)
    monkeypatch.setattr(pairs, "BLOCK_TERMS", 90)
    # t0 to t9 have hashes that differ below the upper half only.
    monkeypatch.setattr(pairs, "_rare_key", lambda t: F.when(F.length(t) == 2, F.lit(-(1 << 63)) + F.ascii(F.substring(t, 2, 1))).otherwise(F.xxhash64(t).bitwiseOR(F.lit(-(1 << 63)))))
    rng = random.Random(5)
    rows = [(i, sorted(rng.sample([f"t{j}" for j in range(24)], rng.randint(4, 14)))) for i in range(60)]
    sets = frame(spark, rows, "doc_id long, terms array<string>")
    keyed = pairs.term_keys(sets)
    assert keyed.schema["keys"].dataType.simpleString() == "array<int>"
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    own = {r.doc_id: r["keys"] for r in keyed.collect()}
    names = dict(rows)
    assert all(k == sorted(set(k)) and len(k) == len(names[i]) for i, k in own.items())
    assert all(len(set(own[a]) & set(own[b])) == len(set(names[a]) & set(names[b])) for a in own for b in own)
    seen, want = {}, set()
    for i, terms in rows:
        seen.setdefault(tuple(terms), i)
    for a, b in ((a, b) for a in seen.values() for b in seen.values() if a < b):
        x, y = set(names[a]), set(names[b])
        if len(x & y) >= 3 and len(x & y) / len(x | y) >= 0.55 - 1e-12:
            want.add((a, b, len(x & y)))
    assert want and {(r.a, r.b, r.common) for r in pairs.similar_pairs(sets).collect()} == want


def test_labels(spark):
    rows = [([" Lang: En ", "a:B", "a:A", "a:B"],), (["bad"],), ([],), (None,)]
    got = [r.y for r in frame(spark, rows, "x array<string>").select(labels.normalize(F.col("x")).alias("y")).collect()]
    assert got == [["a:A", "a:B", "lang:En"], None, [], None]
    ok = [r.y for r in frame(spark, rows, "x array<string>").select(labels.has_all(F.col("x"), F.array(F.lit("a:A"))).alias("y")).collect()]
    assert ok == [True, False, False, False]


def test_zones(spark):
    rows = ["", " Inbox ", "Projects", "Deep Work", "a/../b", "_archive", "a/_Archive", "x/y", ".git/x", "a|b", "end."]
    got = [r.y for r in frame(spark, [(r,) for r in rows], "x string").select(index.normal_zone(F.col("x")).alias("y")).collect()]
    assert got == ["", "", "projects", "Deep Work", None, None, None, "x/y", None, None, None]


def test_refresh_and_aliases(spark):
    scan = frame(spark, [("a", "a.md", 1, 1), ("b", "b.md", 2, 1), ("c", "c.md", 1, 1)], "key string, rel string, mtime int, size int")
    old = frame(spark, [("a", "a.md", 1, 1), ("b", "b.md", 1, 1), ("d", "d.md", 1, 1)], "key string, rel string, mtime int, size int")
    assert {r.key: r.action for r in index.refresh_plan(scan, old).collect()} == {"a": "keep", "b": "update", "c": "insert", "d": "delete"}
    notes = frame(spark, [("k1", "My Note", 1), ("k2", "my note", 2), ("plain", "Plain", 1)], "key string, title string, mtime int")
    names = frame(spark, [("k1",), ("Plain",), ("MY NOTE",), ("none",)], "name string")
    assert {r.name: r.key for r in index.resolve(names, notes).collect()} == {"k1": "k1", "Plain": "plain", "MY NOTE": "k2", "none": None}


def test_routing(spark):
    routes = frame(spark, [(0, "checking the login page", "a/x.md"), (1, "check invoices", "a/y.md"), (2, "check", "b.md"), (3, "deploy site", "c/z.md")], "seq int, trigger string, document string")
    tasks = frame(spark, [(1, "Check the weather"), (2, "fix sign in"), (3, "CHECK"), (4, "invoice sent"), (5, "webpage")], "task_id int, task string")
    got = {}
    for r in routing.match(routes, tasks).collect():
        got.setdefault(r.task_id, set()).add(r.seq)
    assert got[2] == {0} and got[4] == {1} and 2 in got[3] and got[5] >= {3}
    known = frame(spark, [("a/x.md",), ("q.md",)], "document string")
    problems = {(r.document, r.problem) for r in routing.integrity(routes, known).collect()}
    assert ("q.md", "orphan") in problems and ("b.md", "dangling") in problems
    top = {r.topic: (r.routes, r.documents) for r in routing.topics(routes).collect()}
    assert top == {"dir:a": (2, 2), "file:b.md": (1, 1), "dir:c": (1, 1)}
    assert routing.view(routes).first().mode in ("flat", "grouped")
    more = routing.register(routes, frame(spark, [(0, "check", "b.md"), (1, "new", "n.md")], "seq int, trigger string, document string"))
    assert more.count() == 5


def test_gate(spark):
    notes = frame(spark, [(f"n{i}", "z", "topic", "positive", []) for i in range(10)] + [("neg", "z", "topic", "negative", []), ("arch", "_archive", "topic", "positive", []), ("filed", "z", "topic", "positive", ["x"])],
                  "key string, zone string, type string, polarity string, links array<string>")
    none = [None] * 7
    ops = [(0, "archive", "neg", *none[:5]), (1, "archive", "arch", *none[:5]), (2, "archive", "filed", *none[:5])]
    ops += [(10 + i, "archive", f"n{i}", *none[:5]) for i in range(6)]
    ops += [(30, "rezone", "n1", " New Zone ", *none[:4]), (31, "link", None, None, "n1", "n1", None, None), (32, "melt", "n1", *none[:5]), (33, "supersede", *none[:4], "n1", "gone")]
    plan = frame(spark, ops, "seq int, op string, slug string, zone string, a string, b string, stale string, by string")
    eff = frame(spark, [(f"n{i}", float(10 - i)) for i in range(10)], "key string, eff double")
    got = {r.seq: r.reason for r in gate.validate(plan, notes, eff).collect()}
    assert (got[0], got[1], got[2]) == ("protected note", "already archived", "protected note")
    assert [i for i in range(6) if got[10 + i] is None] == [3, 4, 5]  # ceil(0.2 * 12) = 3 weakest
    assert got[30] is None and got[31] == "self-link" and got[32] == "unknown op" and got[33] == "unknown slug"
    made = gate.dense_links(frame(spark, [("n1", "w"), ("n2", "w")], "key string, zone string"), notes.withColumn("zone", F.when(F.col("key") == "n5", "w").otherwise(F.col("zone"))), frame(spark, [], "a string, b string"))
    assert {(r.a, r.b) for r in made.collect()} == {("n1", "n2"), ("n1", "n5"), ("n2", "n5")}


def test_retire(spark):
    rows = [(f"k{i}", 10, datetime(2024, 1, 1 + i), 0, 0.0, "z", "preference", "positive", []) for i in range(6)]
    notes = frame(spark, rows, "key string, size long, last_access timestamp, access_count long, mtime double, zone string, type string, polarity string, links array<string>")
    assert [r.key for r in gate.retire(notes, 4, 10**9, 10).orderBy("place").collect()] == ["k0", "k1"]
    assert [r.key for r in gate.retire(notes, 100, 35, 10).orderBy("place").collect()] == ["k0", "k1", "k2"]
    assert gate.retire(notes, 100, 10**9, 10).count() == 0


def test_records(spark):
    rows = frame(spark, [("s", 1, 5), ("s", 2, 5), ("s", 3, 4), ("s", 4, 9), ("t", 1, 1)], "scope string, n int, stamp long")
    got = [(r.scope, r.n, r.bumped) for r in records.bump_stamps(rows, ["scope"], "n", "stamp").orderBy("scope", "n").collect()]
    assert got == [("s", 1, 5), ("s", 2, 6), ("s", 3, 7), ("s", 4, 9), ("t", 1, 1)]
    text = "# Decisions\n- use it\n1. again\n```\n# Links\n- hidden\n```\n## Notes\nskipped\n### Next Step ##\nplain"
    talk = frame(spark, [(1, 0, "user", text), (1, 1, "system", "# Decisions\nno"), (1, 2, "assistant", "# open items\n* none")], "conv_id long, turn long, role string, text string")
    got = {r.family: r["items"] for r in records.transcript_sections(talk).collect()}
    assert got == {"decisions": ["use it", "again"], "next_step": ["plain"], "open_items": ["none"]}
    lines = records.line_offsets(frame(spark, [(1, "é\nab\n\nc")], "doc_id long, text string")).orderBy("line").collect()
    assert [(r.start, r.length) for r in lines] == [(0, 3), (3, 3), (6, 1), (7, 1)]


MARKDOWN = "---\ntitle: x\n---\nintro\n# One #\ntext\n```\n# not a heading\n```\n## Two\nmore\nThree\n-----\nlast\n# One\nagain"


def test_sections_and_coverage(spark):
    docs = frame(spark, [("p", MARKDOWN), ("q", ""), ("r", "no heading")], "path string, text string")
    got = sections.sections(docs, "path").where("path = 'p'").orderBy("section").collect()
    assert [(r.heading, r.level, r.ancestry) for r in got] == [("Preamble", 0, []), ("One", 1, []), ("Two", 2, ["One"]), ("Three", 2, ["One"]), ("One", 1, [])]
    assert len({r.anchor for r in got}) == 5 and "".join(r.text for r in got) == MARKDOWN.split("---\n", 2)[2]
    odd = frame(spark, [(1, "a\n---\n---\nb\n===\n\n==="), (2, "# A\n### B\n## C\n#### D\n# A ##\n"), (3, "\n \n#\n####### no\n    # code"), (4, "\ufeff---\nk: v\n---\n\n# T\nx"), (4, "---\nno end"), (None, None)], "doc_id int, text string")
    rows = sections.sections(odd).orderBy("doc_id", "first_line").collect()
    found = lambda i: [(r.heading, r.level, r.ancestry) for r in rows if r.doc_id == i]
    assert found(1) == [("a", 2, []), ("b", 1, [])]
    assert found(2) == [("A", 1, []), ("B", 3, ["A"]), ("C", 2, ["A"]), ("D", 4, ["A", "C"]), ("A", 1, [])]
    assert found(3) == [("", 1, [])] and [r.section for r in rows if r.doc_id == 2] == [0, 1, 2, 3, 4]
    assert sorted(found(4)) == [("Preamble", 0, []), ("T", 1, [])]
    asked = frame(spark, [(0, "again"), (1, "nothing here")], "query_id int, text string")
    best = sections.search(sections.sections(docs, "path"), asked, id_col="path").collect()
    assert [(r.query_id, r.path, r.heading, r.rank) for r in best if r.query_id == 0] == [(0, "p", "One", 1)]
    anchor = got[2].anchor
    shown = sections.read(sections.sections(docs, "path"), frame(spark, [("p", anchor)], "path string, anchor string"), "path").orderBy("section").collect()
    assert [r.heading for r in shown] == ["Preamble", "Two"]
    plain = frame(spark, [("p", MARKDOWN.split("---\n", 2)[2]), ("q", ""), ("r", "no heading")], "path string, text string")
    blocks = sections.blocks(plain)
    assert {r.path: r.ok for r in sections.verify_blocks(blocks, plain).collect()} == {"p": True, "q": True, "r": True}
    broken = blocks.withColumn("text", F.concat("text", F.lit("!")))
    assert not any(r.ok for r in sections.verify_blocks(broken, plain).where("path <> 'q'").collect())
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {(r.document, r.depth) for r in sections.closure(edges, frame(spark, [("a",)], "document string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_rerank(spark):
    schema = "query_id long, doc_id long, rank int, score double"
    merged = rerank.merge_top(frame(spark, [(0, 1, 1, 0.9), (0, 2, 2, 0.5)], schema), frame(spark, [(0, 2, 1, 0.7), (0, 3, 2, 0.9)], schema))
    assert [(r.doc_id, r.score) for r in merged.orderBy("rank").collect()] == [(1, 0.9), (3, 0.9), (2, 0.6)]
    answers = rerank.ordered_pairs(merged).withColumn("p", F.when(F.col("a") == 2, 1.0).when(F.col("b") == 2, 0.0).otherwise(0.5))
    assert [(r.doc_id, r.preference) for r in rerank.pairwise_order(answers).orderBy("rank").collect()] == [(2, 2.0), (1, 0.5), (3, 0.5)]
    cards = frame(spark, [(0, i, i) for i in range(1, 20)], "query_id long, doc_id long, rank int")
    judged = rerank.judge(cards, lambda own: own["doc_id"] / 100).collect()
    assert {r.doc_id: r.score for r in judged} == {i: i / 100 for i in range(1, 20)}


def test_metrics(spark):
    ranks = frame(spark, [("a", 1), ("a", 3), ("a", None), ("b", 10)], "kind string, rank int")
    got = ranks.groupBy().agg(*evaluate.rank_metrics()).first()
    assert (got.r1, got.r5, got.n) == (0.25, 0.5, 4) and got.mrr == round((1 + 1 / 3 + 0.1) / 4, 6)
    assert got.ndcg10 == round((1 + 1 / 2 + 1 / math.log2(11)) / 4, 6)
    hits = frame(spark, [(0, 5, 1), (0, 6, 2), (0, 7, 3)], "query_id long, doc_id long, rank int")
    gold = frame(spark, [(0, 7)], "query_id long, doc_id long")
    assert evaluate.gold_ranks(hits, gold, frame(spark, [(0, 5)], "query_id long, doc_id long")).first()["rank"] == 2


def test_vectors(spark):
    v = frame(spark, [(1, [3.0, 4.0]), (1, [-1.0, 1.0]), (2, [0.0, 0.0])], "doc_id long, embedding array<float>")
    q = frame(spark, [(9, [3.0, 4.0])], "query_id long, embedding array<float>")
    assert {r.doc_id: r.score for r in vector.sign_search(v, q, 5).collect()} == {1: 1.4, 2: -1.4}
    scaled = v.where("doc_id = 1").select(vector.int8_rows(F.col("embedding")).alias("r")).first().r
    assert scaled["values"] == [95, 127]


def test_recall(spark):
    nudges = [(0, "a.md", "Uses port 80"), (1, "zz.md", "x"), (2, "a.md", "again"), (3, "b.md", "You must stop"), (4, "b.md", "token: abcdefgh1"), (5, "b.md", "Fine fact"), (6, "c.md", "late")]
    offered = frame(spark, [("a.md",), ("b.md",), ("c.md",)], "path string")
    got = {r.seq: r.reason for r in recall.admit(frame(spark, nudges, "seq int, path string, hint string"), offered, frame(spark, [], "path string")).collect()}
    assert got == {0: None, 1: "unoffered-or-protected", 2: "already-surfaced-or-duplicate", 3: "addresses-agent", 4: "secret-like", 5: None, 6: "cap"}
    hits = frame(spark, [("x " * 300 + "café beta " + "y " * 200, ["cafe", "beta"])], "text string, terms array<string>")
    assert "café beta" in recall.snippets(hits).first().snippet
    assert recall.snippet_of("  no term  ", ["zz"]) == "no term"
    far = "alpha " + "- " * 200 + "beta\ngamma" + " -" * 200
    assert "beta gamma" in recall.snippet_of(far, ["alpha", "beta", "gamma"]) and recall.snippet_of(far, ["alpha"]).startswith("alpha")
    assert "verlangen" in recall.snippet_of("x " * 200 + "verlangen " + "y " * 200, ["verla~"]) and "verla" not in recall.snippet_of("x " * 200 + "verla", ["verla~"])
    assert "ＡＰＩ" in recall.snippet_of("一 " * 200 + "ＡＰＩ ende", ["api"]) and "cafe\u0301" in recall.snippet_of("z " * 200 + "cafe\u0301 x", ["cafe"])


def test_operators_fold_by_default(spark):
    rows = [(1, "ﬁnal ＡＰＩ Ⅷ ① cafés ΟΔΟΣ"), (2, "final API viii 1 cafés οδοσ"), (3, "plain words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = lambda df, key: {k: {r.term for r in df.collect() if r[key] == k} for k in (1, 2)}
    post = terms(index.postings(docs), "doc_id")
    assert post[1] == post[2] and {"final", "api", "viii", "1", "cafes", "οδοσ"} == post[1]
    asked = terms(rank.query_terms(docs.withColumnRenamed("doc_id", "query_id")), "query_id")
    assert asked[1] == asked[2] == post[1]
    sets = {r.doc_id: r.terms for r in pairs.token_sets(docs).collect()}
    assert sets[1] == sets[2]
    assert {(r.doc_id, r.class_id) for r in pairs.exact_duplicates(docs).collect()} == {(1, 1), (2, 1)}


def test_index_refresh_equals_rebuild(spark, tmp_path):
    rows = {i: f"alpha beta{i % 3} gamma " * (i % 4) for i in range(30)}
    before = frame(spark, list(rows.items()), "doc_id int, text string")
    old = store.build(before)
    seen = before.select("doc_id", F.sha2("text", 256).alias("digest"))
    rows |= {3: "beta1 delta", 40: "new words alpha", 41: ""}
    del rows[5], rows[7]
    after = frame(spark, list(rows.items()), "doc_id int, text string")
    moved = store.changes(after, seen)
    assert sorted(r.doc_id for r in moved.collect()) == [3, 5, 7, 40, 41]
    got, want = store.refresh(old, moved), store.build(after)
    for name in ("post", "lengths", "dfs", "stats", "norms"):
        both = [sorted(map(str, getattr(x, name).collect())) for x in (got, want)]
        assert both[0] == both[1], name
    store.save(got, f"{tmp_path}/index")
    again = store.load(spark, f"{tmp_path}/index")
    assert sorted(map(str, again.post.collect())) == sorted(map(str, want.post.collect()))
    assert store.load(spark, f"{tmp_path}/index", 2) is None
    with pytest.raises(Exception, match="exist"):
        store.save(got, f"{tmp_path}/index")
    terms = rank.query_terms(frame(spark, [(0, "alpha delta")], "query_id int, text string"))
    scores = [sorted((r.doc_id, r.score) for r in rank.bm25(terms, x.post, x.lengths, x.stats, dfs=dfs).collect()) for x, dfs in ((got, got.dfs), (want, None))]
    assert scores[0] == scores[1] and scores[0]
