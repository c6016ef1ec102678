"""WARC derivatives, URL trust and quotation linking against plain Python."""

from __future__ import annotations

import codecs
import gzip
import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import pytest
import zstandard
from pyspark.sql import functions as F

from marginalia.llm import quote_links, url_trust, warc

PAGE = """<!DOCTYPE html><html lang="fr"><head><title>A &amp; b</title><style>p{x}</style><script>var t="</p>";</script></head>
<body><!-- hidden --><p>One<br>two</p><div>caf&eacute; <b>bold</b></div><a href="http://x.org/a?b=1&amp;c">link</a> <a href='/rel'>r</a></body></html>"""


def test_derivatives_refer_to_their_response():
    source = warc.response("http://a.com/x", PAGE)
    meta, text = warc.derive(source)
    for kind, headers, block in (meta, text):
        assert headers["WARC-Type"] == kind and headers["WARC-Refers-To"] == source[1]["WARC-Record-ID"]
        assert headers["WARC-Refers-To-Target-URI"] == headers["WARC-Target-URI"] == "http://a.com/x"
        assert headers["X-Source-WARC-Payload-Digest"] == warc.sha1_digest(PAGE.encode())
        assert headers["X-Source-WARC-Block-Digest"] == source[1]["WARC-Block-Digest"]
        assert headers["WARC-Block-Digest"] == warc.sha1_digest(block) and headers["Content-Length"] == str(len(block))
    assert text[2].decode() == "A & b\nOne\ntwo\ncafé bold\nlink r"
    lines = meta[2].decode().split("\r\n")
    assert lines[:2] == ["title: A & b", "lang: fr"] and "outlink: http://x.org/a?b=1&c" in lines and "outlink: /rel" in lines
    assert warc.derive(source) == (meta, text) and meta[1]["WARC-Record-ID"] != text[1]["WARC-Record-ID"]


def test_round_trip_of_records():
    records = [r for u, h in (("http://a.com/é", PAGE), (None, None), ("x", "\r\n\r\n" * 3), ("y", "z" * 300_000)) for r in (warc.response(u, h), *warc.derive(warc.response(u, h)))]
    data = warc.serialize(records)
    assert list(warc.parse(data)) == records
    assert list(warc.parse(gzip.decompress(data))) == records
    assert list(warc.parse(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse(b"nonsense\r\n\r\n"))


def test_pages_and_files(spark):
    rows = [(1, "http://a.com/", PAGE, "t"), (1, "http://a.com/", PAGE, "t"), (2, None, None, None), (None, "http://b.org", "", "t"), (3, "u", "<p>" + "x " * 200_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type string")
    out = warc.build_derivatives(pages).collect()
    assert len(out) == 10 and {r.type for r in out} == {"metadata", "conversion"}
    for r in out:
        assert r.block_digest == warc.sha1_digest(bytes(r.block)) and r.headers["WARC-Refers-To"] == r.refers_to
    assert {bytes(r.block) for r in out if r.page_id == 2 and r.type == "conversion"} == {b""}
    assert len({r.record_id for r in out}) == 8  # repeated pages repeat their records
    assert warc.build_derivatives(pages.limit(0)).count() == 0
    files = spark.createDataFrame([("f", bytearray(warc.serialize([warc.response("u", PAGE), warc.derive(warc.response("u", PAGE))[0]])))], "path string, content binary")
    made = warc.derive_files(files).orderBy("place").collect()
    assert [r.place for r in made] == [0, 1]
    assert list(warc.parse(b"".join(bytes(r.warc) for r in made))) == list(warc.derive(warc.response("u", PAGE)))


class Reader(HTMLParser):
    """Plain text by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.out, self.hidden, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc.HIDDEN
        self.out.append("\n" if tag in warc.BREAKS else " " if tag in warc.HIDDEN else "")
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        self.out.append("\n" if tag in warc.BREAKS else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)

    def handle_comment(self, data):
        self.out.append(" ")

    handle_decl = handle_comment


def test_pages_read_as_by_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    assert len(rows) >= 50
    for html in [PAGE, *(r.html for r in rows)]:
        plain = Reader()
        plain.feed(html)
        plain.close()
        text = "\n".join(x for x in (" ".join(y.split()) for y in "".join(plain.out).split("\n")) if x)
        page = warc.read_page(html)
        assert page.text == text and page.links == [" ".join(x.split()) for x in plain.links]


def test_charsets_and_codings():
    def text(head, body):
        block = ("HTTP/1.1 200 OK\r\n" + head + "\r\n").encode() + body
        meta, made = warc.derive(("response", {"WARC-Record-ID": "<urn:x>"}, block))
        return made[2].decode(), meta[2].decode()

    kind = "Content-Type: text/html; charset="
    page = "<p>café ßß</p>"
    assert text(f"{kind}iso-8859-1\r\n", page.encode("latin-1"))[0] == "café ßß"
    assert text(f"{kind}\"Shift_JIS\"\r\n", "<p>日本</p>".encode("shift_jis"))[0] == "日本"
    assert text("", b"<meta http-equiv=x content='text/html; charset=windows-1251'>" + "да".encode("cp1251"))[0] == "да"
    assert text(f"{kind}utf-8\r\n", codecs.BOM_UTF16_LE + page.encode("utf-16-le"))[0] == "café ßß"
    for label in ("nonsense", "hex", "punycode", "\x00"):
        assert text(f"{kind}{label}\r\n", page.encode())[0] == "café ßß"
    raw, plain = zlib.compressobj(9, zlib.DEFLATED, -15), page.encode()
    for coding, body in (("gzip", gzip.compress(plain)), ("x-gzip", gzip.compress(plain)), ("deflate", zlib.compress(plain)), ("deflate", raw.compress(plain) + raw.flush()), ("zstd", zstandard.compress(plain)), ("identity", plain)):
        assert text(f"Content-Encoding: {coding}\r\n", body)[0] == "café ßß", coding
    assert text("Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n", b"".join(b"%x;e=1\r\n%s\r\n" % (len(x), x) for x in (gzip.compress(plain)[:10], gzip.compress(plain)[10:])) + b"0\r\n\r\n")[0] == "café ßß"
    made, meta = text("Content-Encoding: br\r\n", b"\x0b\x02")
    assert made == "" and "unreadContentEncoding: br" in meta
    assert text("Content-Encoding: gzip\r\n", gzip.compress(plain * 1000)[:-30])[0].startswith("café")
    assert warc.plain_text("a&#" + "9" * 5000 + ";b &#65;") == "a\ufffdb A"


def test_hostile_markup_and_large_files_take_linear_time():
    began = time.time()
    for bad in ("<title>", "<a ", "<!--", "<script ", "<script>", "</script", "<a href=\"", "<html lang", "&#", " ", "\n ", "<", "</title", "<meta "):
        page = bad * (5_000_000 // len(bad))
        warc.derive(warc.response("u", page))
    assert time.time() - began < 60
    one = warc.response("u", "<p>" + "word " * 2000)
    plain = gzip.decompress(warc.serialize([one])) * 10_000  # 100 MB
    assert len(plain) > 100_000_000
    began = time.time()
    assert sum(1 for _ in warc.parse(plain)) == 10_000
    assert sum(1 for _ in warc.parse(warc.serialize([one]) * 10_000)) == 10_000
    assert time.time() - began < 20


# -- urls ----------------------------------------------------------------------------


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(h + p, v) for v, h, p in url_trust.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def brute_ranks(seeds, links, damping=url_trust.DAMPING):
    out = {}
    for (s, _), n in links.items():
        out[s] = out.get(s, 0) + n
    hosts = set(seeds) | {h for pair in links for h in pair}
    rank = dict.fromkeys(hosts, 0.0)
    for _ in range(150):
        new = {h: (1 - damping) * seeds.get(h, 0) for h in hosts}
        for (s, d), n in links.items():
            new[d] += damping * rank[s] * n / out[s]
        rank = new
    return rank


URLS = [None, "", "no scheme", "http://", "://", "HTTP://A.Com?x", "http://a.com", "https://Www.Example.com/en/x?y#z", "http://m.example.com/en/1", "http://example.com/en", "http://net/es/", "http://xnet/es/",
        "http://q.net/fr/a://b", "http://q.net/de/", "http://É.net/es/#", "ftp://user@a.com:80/p;x", "http://a.com#f/?", "http://a.com//en/", "http://b.org/x"]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in url_trust.judge(pages).collect()}
    for i, u in enumerate(URLS):
        host, path = brute_parts(u)
        rule, verdict = brute_rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        if rule:
            assert rows[i].verdict == verdict


def test_propagation_equals_iteration(spark):
    rng = random.Random(1)
    hosts = ["a.com", "b.com", "c.org", "d.org", "e.org", "f.net", "g.net"]
    rows = []
    for i in range(80):
        h = rng.choice(hosts)
        path = rng.choice(["/es/", "/fr/", "/x"])
        html = None if i % 9 == 0 else "".join(f'<a href="http://{rng.choice(hosts).upper()}/p{j}">' for j in range(rng.randint(0, 3)))
        rows.append((i, f"http://{h}{path}{i}", html, "x"))
    rows += [rows[3], (None, "http://c.org/", None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    share, links, count = {}, {}, {}
    for _, u, html, _ in rows:
        h, p = brute_parts(u)
        v = brute_rule(h, p)[1]
        count[h] = count.get(h, 0) + 1
        for kind in ("allow", "block"):
            share[h, kind] = share.get((h, kind), 0) + (v == kind)
        for d in {x.lower() for x in re.findall(r"http://([^/]+)", html or "")} - {h}:
            links[h, d] = links.get((h, d), 0) + 1
    trust = brute_ranks({h: share[h, "allow"] / n for h, n in count.items()}, links)
    distrust = brute_ranks({h: share[h, "block"] / n for h, n in count.items()}, {(d, s): n for (s, d), n in links.items()})
    got = url_trust.judge(pages, tolerance=1e-4).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.trust - trust[r.host]) <= 1e-4 and abs(r.distrust - distrust[r.host]) <= 1e-4
        rule, verdict = brute_rule(r.host, r.path)
        margin = distrust[r.host] - trust[r.host] - url_trust.THRESHOLD * (1 - url_trust.DAMPING)
        if rule is None and abs(margin) > 2e-4:
            assert r.verdict == ("block" if margin > 0 else "allow")
    assert url_trust.judge(pages.limit(0)).count() == 0


def test_small_shares_of_a_hub_add_up(spark):
    n = 1_000_000  # each gets 1.3e-7 of the hub's trust; all of them link to one host
    mid = F.concat(F.lit("m"), F.col("id"))
    links = spark.range(n).select(F.lit("hub").alias("src"), mid.alias("dst"), F.lit(1).alias("n")).unionByName(spark.range(n).select(mid.alias("src"), F.lit("end").alias("dst"), F.lit(1).alias("n")))
    seeds = spark.createDataFrame([("hub", 1.0)], "host string, seed double")
    ranks = url_trust.propagate(seeds, links)
    assert ranks.count() == n + 2
    end = ranks.where("host = 'end'").first()["rank"]
    assert abs(end - 0.15 * 0.85**2) < 1e-6


# -- quotes --------------------------------------------------------------------------


def brute_chat(rows):
    level = lambda x: (re.match(quote_links.MARKS, x) or [""])[0].count(">")
    norm = lambda x: re.sub(r"\s+", " ", re.sub(quote_links.MARKS, "", x)).strip().lower()
    lines = {}  # the passages of each message
    for c, t, _, text in rows:
        own, open_ = lines.setdefault((c, t), []), None
        for x in re.split("\r?\n", text or ""):
            if not norm(x):
                open_ = None
            elif open_ is not None and open_[0] == level(x):
                open_[1].append(norm(x))
            else:
                open_ = (level(x), [norm(x)])
                own.append(open_)

    def units(lv, keys):
        yield 0, " ".join(keys)
        yield from ((1, pair) for pair in zip(keys, keys[1:]))
        yield from ((2, k) for k in keys if lv == 0 or len(keys) == 1)

    turns = {}
    for c, t in lines:
        turns.setdefault(c, set()).add(t)
    out = {}
    for c, own in turns.items():
        writers = {}
        for t in sorted(own):
            for lv, keys in lines[c, t]:
                for unit in units(lv, keys) if lv == 0 else ():
                    writers.setdefault(unit, t)
        for t in sorted(own):
            votes = {}
            for lv, keys in {(lv, tuple(keys)) for lv, keys in lines[c, t] if lv > 0}:
                found = {}
                for unit in set(units(lv, keys)):
                    if writers.get(unit, t) < t:
                        found[unit[0], writers[unit]] = found.get((unit[0], writers[unit]), 0) + 1
                for (kind, w), n in found.items():
                    if kind == min(found)[0]:
                        votes[lv, w] = votes.get((lv, w), 0) + (len(keys), min(n + 1, len(keys)), 1)[kind]
            best = max(votes.items(), key=lambda x: (-x[0][0], x[1], x[0][1]), default=None)
            before = max((x for x in own if x < t), default=None)
            parent = best[0][1] if best else before
            thread, depth = (t, 0) if parent is None else (out[c, parent][1], out[c, parent][2] + 1)
            out[c, t] = (parent, thread, depth, sum(votes.values()))
    return out


@pytest.mark.parametrize("block", [3, 1024])
def test_threads_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(quote_links, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for c in range(12):
        said = []
        for t in sorted(rng.sample(range(-5, 60), rng.randint(1, 25))):
            own = [f"Line {c} {rng.randrange(12)}  of TEXT" for _ in range(rng.randint(0, 5))]
            quoted = []
            for _ in range(rng.choice([0, 0, 1, 2])):
                if said:  # a stretch of an earlier message
                    kept, at = rng.choice(said), rng.randrange(3)
                    quoted += ["> " * rng.randint(1, 3) + x.upper() for x in kept[at : at + rng.randint(1, 4)]] + [""] * rng.randint(0, 1)
            rows.append((c, t, "user", "\n".join(quoted + own)))
            said += [own] if own else []
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.linked_lines) for r in quote_links.format_chat(frame).collect()}
    assert got == brute_chat(rows)


def test_odd_messages(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "u", "Say this\nand that"), (1, 2, "a", "On Monday u wrote:\n> say   THIS\nYes"), (1, 3, "u", "> > say this\n> Yes\nfine"), (1, 3, "x", "repeated"), (2, 0, None, None),
            (None, 1, "u", "> q\nown"), (3, None, "u", "text"), (4, 0, "u", "> unknown words"), (5, 0, "u", "x " * 100_000 + "\n" + "> y\n" * 5000)]
    frame = spark.createDataFrame(rows, schema)
    got = {(r.conv_id, r.turn, r.role): r for r in quote_links.format_chat(frame).collect()}
    assert len(got) == len(rows)
    assert got[1, 2, "a"].text == "Yes" and got[1, 2, "a"].reply_to == 0 and got[1, 2, "a"].linked_lines == 1
    assert got[1, 3, "u"].text == "fine" and got[1, 3, "u"].reply_to == 2 and got[1, 3, "u"].depth == 2
    assert got[1, 3, "x"].reply_to == 2 and got[2, 0, None].text == "" and got[2, 0, None].reply_to is None
    assert got[None, 1, "u"].text == "own" and got[3, None, "u"].reply_to is None
    assert got[4, 0, "u"].text == "" and got[4, 0, "u"].quoted_lines == 1 and got[4, 0, "u"].linked_lines == 0
    assert got[5, 0, "u"].quoted_lines == 5000
    assert quote_links.format_chat(frame.limit(0)).count() == 0


def test_passages_outdo_common_lines(spark):
    rows = [(1, 0, "u", "Thanks\nsee below"), (1, 1, "u", "A long paragraph\nthat goes on\nThanks"), (1, 2, "u", "other words"),
            (1, 3, "u", "> a long  paragraph that\n> goes on thanks\nnoted"), (1, 4, "u", "> that goes on\n> Thanks\nagreed"), (1, 5, "u", "> thanks\nyes")]
    got = {r.turn: (r.reply_to, r.linked_lines) for r in quote_links.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[3] == (1, 2)  # wrapped anew, yet the passage of turn 1
    assert got[4] == (1, 2)  # two lines of it
    assert got[5] == (0, 1)  # a line alone is its first writer's


def test_hot_quoted_line_and_hot_conversation(spark):
    # A third of all messages in one conversation, and a line that all quote.
    n = 6000
    text = F.when(F.col("id") < 1, F.lit("The very common line")).otherwise(F.concat(F.lit("> the very common line\nanswer "), "id"))
    hot = spark.range(n).select(F.when(F.col("id") < n // 3, F.lit(0)).otherwise(F.col("id")).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), text.alias("text"))
    rows = quote_links.format_chat(hot).collect()
    assert len(rows) == n
    assert all((r.reply_to, r.depth, r.linked_lines) == (0, 1, 1) for r in rows if r.conv_id == 0 and r.turn > 0)
    assert all(r.reply_to is None and r.linked_lines == 0 and r.quoted_lines == 1 for r in rows if r.conv_id > 0)


def test_one_long_conversation(spark):
    frame = spark.range(5000).selectExpr("1L as conv_id", "id * 3 as turn", "'u' as role", "concat('message ', id) as text")
    rows = quote_links.format_chat(frame).collect()
    assert {(r.turn, r.depth, r.thread) for r in rows} == {(3 * i, i, 0) for i in range(5000)}


def test_digest_is_of_the_payload():
    assert warc.sha1_digest(b"") == "sha1:" + __import__("base64").b32encode(hashlib.sha1(b"").digest()).decode()


def test_hostile_quote_marks(spark):
    """A megabyte of marks, deep marks apart by blanks, and blanks without a mark end no executor."""
    texts = [">" * (1 << 20) + " deep", "> " * 300_000 + "deep", " \t" * 500_000, "> plain\nanswer"]
    messages = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = messages.select("turn", quote_links.split_lines(F.col("text")).alias("l")).select("turn", F.col("l")[0]["level"].alias("level")).collect()
    assert {r.turn: r.level for r in got} == {0: 1 << 20, 1: 300_000, 2: 0, 3: 1}
    out = {r.turn: r.text for r in quote_links.format_chat(messages).select("turn", "text").collect()}
    assert out[3] == "answer" and out[0] == "" and len(out) == 4


def test_links_after_long_runs_of_blanks_take_linear_time(spark):

    html = spark.range(1).select(F.repeat(F.lit("<a href="), F.lit(1)).alias("a"))
    took = []
    for n in (1 << 18, 1 << 19, 1 << 20):
        own = html.select(F.concat("a", F.repeat(F.lit(" "), F.lit(n)), F.lit("x>"), F.lit("<a href  =  \"  http://b.org/x\">"), F.repeat(F.lit("href"), F.lit(n // 4))).alias("h"))
        at = time.perf_counter()
        assert own.select(F.regexp_extract_all("h", F.lit(url_trust.LINK), F.lit(1)).alias("l")).first().l == ["b.org"]
        took.append(time.perf_counter() - at)
    assert took[2] < 2
    for text, want in {"href=http://a/": "a", "HREF = 'HTTP://A.b:1/x'": "A.b:1", "href=\"  ftp://q?": "q", "href= x://y": "y", "href='/local'": None}.items():
        assert (spark.range(1).select(F.regexp_extract_all(F.lit(text), F.lit(url_trust.LINK), F.lit(1)).alias("l")).first().l or [None])[0] == want
