"""Control plane with table contracts: plans from text, applies, journals, edits."""

from __future__ import annotations

import base64
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# -- plans from model text -------------------------------------------------------


PLAN_VERSION = 1
_DECODER = json.JSONDecoder()
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def json_objects(text: str) -> list[dict]:
    """JSON objects that start outside of any brace or quote, decoded where they stand."""
    out, depth, until = [], 0, 0
    for mark in _MARKS.finditer(text):
        if mark.start() < until or mark[0][0] == '"':
            continue
        if mark[0] == "}":
            depth = max(0, depth - 1)
            continue
        if not depth:
            try:
                got, until = _DECODER.raw_decode(text, mark.start())
                out.append(got)
                continue
            except (ValueError, RecursionError):
                pass
        depth += 1
    return out


def plan_of(text: str | None) -> dict | None:
    """The plan in a model's answer: an object with a list ``ops``.

    One of version 1 comes first, fenced ones before others, then one without
    any version; a plan of another version is none.
    """
    fenced = [o for part in re.findall(r"```(?:json)?\s(.*?)```", text or "", re.S) for o in json_objects(part)]
    plans = [o for o in [*fenced, *json_objects(text or "")] if isinstance(o.get("ops"), list)]
    ours = [o for o in plans if o.get("plan_version") == PLAN_VERSION]
    return next(iter(ours + [o for o in plans if "plan_version" not in o]), None)


OPS = "array<struct<op:string,slug:string,zone:string,a:string,b:string,stale:string,by:string,reason:string>>"


def extract_plans(answers: DataFrame, text_col: str = "text") -> DataFrame:
    """``answers`` exploded to one row an operation, with its ``seq``."""
    names = ("op", "slug", "zone", "a", "b", "stale", "by", "reason")

    def run(texts: pd.Series) -> pd.Series:
        def rows(t):
            ops = (plan_of(t) or {"ops": []})["ops"]
            return [{n: o[n] if isinstance(o.get(n), str) else None for n in names} if isinstance(o, dict) else dict.fromkeys(names) | {"op": "?"} for o in ops]

        return texts.map(rows)

    keep = [c for c in answers.columns if c != text_col]
    return answers.select(*keep, F.posexplode(F.pandas_udf(run, OPS)(F.col(text_col))).alias("seq", "o")).select(*keep, "seq", "o.*")


# -- applying plans -----------------------------------------------------------------


def apply_plan(notes: DataFrame, accepted: DataFrame) -> DataFrame:
    """``notes`` (key, zone, links, body, perhaps title) after accepted operations.

    The last rezone or archive of a note wins; links, by title, are added on
    both sides; a superseded note gets one line that names its successor's
    title, and the successor a link to it. Operations on unknown notes change
    nothing.
    """
    title = F.coalesce("title", "key") if "title" in notes.columns else F.col("key")
    named = notes.select(F.col("key").alias("other"), title.alias("t"))
    moves = accepted.where(F.col("op").isin("rezone", "archive")).groupBy(F.col("slug").alias("key")).agg(F.max_by(F.when(F.col("op") == "archive", "_archive").otherwise(F.col("zone")), "seq").alias("to"))
    link = lambda key, other: F.struct(F.col(key).alias("key"), F.col(other).alias("other"))
    sides = F.when(F.col("op") == "link", F.array(link("a", "b"), link("b", "a"))).when(F.col("op") == "supersede", F.array(link("by", "stale")))
    pairs = accepted.select(F.explode(sides).alias("p")).select("p.*").join(named, "other")
    added = pairs.groupBy("key").agg(F.array_sort(F.collect_set("t")).alias("more"))
    # A successor that isn't there supersedes nothing.
    stale = accepted.where("op = 'supersede'").select(F.col("stale").alias("key"), F.col("by").alias("other"), "seq").join(named, "other")
    rows = notes.join(moves, "key", "left").join(added, "key", "left").join(stale.groupBy("key").agg(F.max_by("t", "seq").alias("next")), "key", "left")
    line = F.concat(F.lit("\n> Superseded by [["), F.col("next"), F.lit("]]\n"))
    body = F.when(F.col("next").isNotNull() & ~F.contains("body", line), F.concat("body", line)).otherwise(F.col("body"))
    links = F.when(F.col("more").isNotNull(), F.array_union("links", "more")).otherwise(F.col("links"))
    changed = {"zone": F.coalesce("to", "zone"), "links": links, "body": body}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in notes.columns])


def journal(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """(key, before, after, digest_before, digest_after) of the rows that a change touches."""
    image = lambda df: df.select(F.col(key).alias("k"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("j"))
    b, a = image(before).alias("b"), image(after).alias("a")
    both = b.join(a, F.col("b.k") == F.col("a.k"), "full_outer").where(~F.col("b.j").eqNullSafe(F.col("a.j")))
    return both.select(F.coalesce("b.k", "a.k").alias(key), F.col("b.j").alias("before"), F.col("a.j").alias("after"), F.sha2("b.j", 256).alias("digest_before"), F.sha2("a.j", 256).alias("digest_after"))


def undo(current: DataFrame, log: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(restored, conflicts): rows back to their before images where they are still the after ones.

    A row that changed since is a conflict and stays as it is.
    """
    names = sorted(current.columns)
    now = current.withColumn("digest", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256))
    marks = log.select(F.col(key).alias("k"), "before", "digest_after")
    joined = now.join(marks, now[key] == marks["k"], "full_outer")
    logged = F.col("k").isNotNull()
    clean = logged & F.col("digest").eqNullSafe(F.col("digest_after"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in current.select(*names).schema)
    back = joined.where(clean & F.col("before").isNotNull()).select(F.from_json("before", ddl).alias("r")).select("r.*").select(*current.columns)
    rest = joined.where(~clean & F.col("digest").isNotNull()).select(*current.columns)
    return rest.unionByName(back), joined.where(logged & ~clean).select(F.col("k").alias(key))


def upsert_versioned(notes: DataFrame, writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, refused): writes whose ``expected`` version is the stored one replace a row.

    ``notes``: (key, version, ...); ``writes``: the same with ``expected`` (null
    creates). The first write of a key wins; others are refused.
    """
    first = writes.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("version")))
    joined = first.join(notes.select(F.col("key").alias("k"), F.col("version").alias("stored")), F.col("key") == F.col("k"), "left")
    good = (F.col("n") == 1) & F.col("expected").eqNullSafe(F.col("stored"))
    taken = joined.where(good).withColumn("version", F.coalesce("stored", F.lit(0)) + 1).select(*notes.columns)
    kept = notes.join(taken.select("key"), "key", "left_anti").select(*notes.columns)
    return kept.unionByName(taken), joined.where(~good).select("key")


# -- profiles -----------------------------------------------------------------------


def fold_proposals(lines: DataFrame, proposals: DataFrame) -> DataFrame:
    """(profile, lines) after add, replace and remove proposals in order; repeats change nothing.

    ``lines``: (profile, lines); ``proposals``: (profile, seq, action, old, new).
    """
    known = proposals.groupBy("profile").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "old", "new"))).alias("ops"))

    def step(now, p):
        add = F.when(F.array_contains(now, p["new"]), now).otherwise(F.concat(now, F.array(p["new"])))
        swap = F.array_distinct(F.transform(now, lambda x: F.when(x == p["old"], p["new"]).otherwise(x)))
        return F.when((p["action"] == "add") & p["new"].isNotNull(), add).when((p["action"] == "replace") & p["new"].isNotNull(), swap).when(p["action"] == "remove", F.filter(now, lambda x: x != p["old"])).otherwise(now)

    empty = F.array().cast("array<string>")
    both = lines.join(known, "profile", "full_outer")
    return both.select("profile", F.aggregate(F.coalesce("ops", F.array().cast(known.schema["ops"].dataType)), F.coalesce("lines", empty), step).alias("lines"))


# -- handoff records -------------------------------------------------------------------


def record_name(kind: str, stamp: str, payload: str) -> str:
    """File name that binds kind, stamp and content: a base32 prefix of its SHA-256."""
    digest = base64.b32encode(hashlib.sha256(payload.encode()).digest()).decode().rstrip("=").lower()
    return f"{kind}-{re.sub(r'[^0-9]', '', stamp)}-{digest[:26]}.md"


def encode_record(record: dict) -> str:
    """Canonical JSON in a fence longer than any backtick run in it."""
    body = json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    mark = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", body)), default=0))
    return f"{mark}json\n{body}\n{mark}\n"


def decode_record(text: str) -> dict:
    """The record of :func:`encode_record`; anything else is an error."""
    got = re.fullmatch(r"(`{3,})json\n(.*)\n\1\n", text, re.S)
    record = json.loads(got[2]) if got else None
    if not isinstance(record, dict) or encode_record(record) != text:
        raise ValueError("not a canonical record")
    return record


def encode_records(records: DataFrame, columns: list[str], kind: str = "capture", stamp: str = "recorded_at") -> DataFrame:
    """``records`` with the file ``name`` and ``text`` of each."""

    def run(rows: pd.Series, stamps: pd.Series) -> pd.DataFrame:
        texts = [encode_record(json.loads(r)) for r in rows]
        return pd.DataFrame({"name": [record_name(kind, s or "", t) for s, t in zip(stamps, texts, strict=True)], "text": texts})

    image = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return records.withColumn("file", F.pandas_udf(run, "name string, text string")(image, F.col(stamp).cast("string"))).select(*records.columns, "file.name", "file.text")


# -- label edits and splits ----------------------------------------------------------------


#: Fixed patterns of headers, on bytes read as Latin-1: a key at the start of a line; values that YAML
#: reads as anchors, aliases, tags or merges; characters that other readers take for line ends.
HEADER_KEY = r"^([A-Za-z_][A-Za-z0-9_-]*)[ \t]*:"
AMBIGUOUS = r"(?m)^[ \t]*+(?:<<:|[^#:\r\n]+:[ \t]*+(?:\r?\n[ \t]*+)?[&*!])"
ODD_BREAK = r"[\x0b\x0c\x1c-\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]"
#: Why a header is left alone.
UNTERMINATED, AMBIGUOUS_HEADER, MULTILINE = "unterminated-header", "ambiguous-header", "multiline-labels"
_BLANKS = " \t\r\n\x0b\x0c"


def _line_kind(line):
    """(kind, key, value) of a header line: empty (blank or a comment), key, item, deeper, stray."""
    bare = F.btrim(line, F.lit(_BLANKS))
    key = F.regexp_extract(line, HEADER_KEY, 1)
    kind = (
        F.when((bare == "") | bare.startswith("#"), "empty").when(key != "", "key")
        .when(line.startswith("-"), "item").when(line.rlike(r"^[ \t]"), "deeper").otherwise("stray")
    )
    value = F.btrim(F.substr(line, F.locate(":", line) + 1), F.lit(_BLANKS))
    return F.struct(kind.alias("kind"), key.alias("key"), F.when(kind == "key", value).otherwise("").alias("value"))


def annotate(files: DataFrame) -> DataFrame:
    """(path, before, after, warning) plan of label edits from (path, content, labels).

    ``before`` is the digest that the file must still have when it is written. The
    header's lines become a table of their kinds, and counts over it say whether the
    ``labels`` field can be set: a header that isn't closed, repeats a key, has lines
    of no kind, or holds what readers of YAML disagree on is left alone, as is a
    ``labels`` value over several lines. All other bytes stay (they are read as
    Latin-1, a character each); line ends follow the file; a file without a header
    gets one. Null content is an empty file, null labels are none.
    """
    text = F.decode(F.coalesce(F.col("content"), F.lit(b"")), "ISO-8859-1")
    quoted = F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    field = F.decode(F.encode(F.concat(F.lit("labels: ["), F.array_join(quoted, ", "), F.lit("]")), "UTF-8"), "ISO-8859-1")
    mark = "\xef\xbb\xbf"
    rows = files.select("path", "content", text.alias("text"), field.alias("field")).withColumn("bom", F.when(F.col("text").startswith(mark), mark).otherwise(""))
    rest = F.substr("text", F.char_length("bom") + 1)
    rows = rows.withColumn("lines", F.filter(F.split(rest, "(?<=\n)", -1), lambda x: x != ""))
    rules = F.transform("lines", lambda x: F.rtrim(x, F.lit(_BLANKS)) == "---")
    # Place (from 1) of the rule that closes the header, 0 without one.
    later = F.array_position(F.slice(rules, 2, F.greatest(F.size("lines"), F.lit(1))), True)
    rows = rows.withColumns({"headed": F.coalesce(F.get(rules, F.lit(0)), F.lit(False)), "close": F.coalesce(F.when(later > 0, later + 1), F.lit(0)).cast("int")})
    header = F.when(F.col("close") > 0, F.slice("lines", 2, F.col("close") - 2)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("header", header).withColumn("kinds", F.transform("header", _line_kind))
    of = lambda kind: F.filter("kinds", lambda k: k["kind"] == kind)
    keys = F.transform(of("key"), lambda k: k["key"])
    counts = {
        "repeated": F.size(keys) - F.size(F.array_distinct(keys)), "stray": F.size(of("stray")),
        "scalars": F.size(F.filter(of("key"), lambda k: k["value"].rlike("^[|>]"))),
        "at": F.array_position(F.transform("kinds", lambda k: (k["kind"] == "key") & (k["key"] == "labels")), True).cast("int"),
    }
    rows = rows.withColumns(counts).withColumn("joined", F.array_join("header", ""))
    below = F.get(F.filter(F.slice("kinds", F.greatest("at", F.lit(1)) + 1, F.greatest(F.size("kinds"), F.lit(1))), lambda k: k["kind"] != "empty"), F.lit(0))["kind"]
    value = F.get("kinds", F.greatest(F.col("at") - 1, F.lit(0)))["value"]
    open_value = (value == "") | value.startswith("#")
    many = (F.col("at") > 0) & F.coalesce((below == "deeper") | (open_value & (below == "item")), F.lit(False))
    unclear = (F.col("repeated") + F.col("stray") + F.col("scalars") > 0) | F.col("joined").rlike(AMBIGUOUS) | F.col("joined").rlike(ODD_BREAK)
    warning = F.when(~F.col("headed"), None).when(F.col("close") == 0, UNTERMINATED).when(unclear, AMBIGUOUS_HEADER).when(many, MULTILINE)
    ends = lambda x: F.regexp_count(F.col("text"), F.lit(x))
    eol = F.when(F.when(F.col("headed"), F.get("lines", F.lit(0)).endswith("\r\n")).otherwise(ends("\r\n") * 2 > ends("\n")), "\r\n").otherwise("\n")
    rows = rows.withColumns({"warning": warning, "eol": eol})
    own = F.concat("field", "eol")
    put = F.when(F.col("at") > 0, F.col("at")).otherwise(F.col("close") - 1)  # lines before the field
    gone = F.when(F.col("at") > 0, 1).otherwise(0)
    inside = F.concat(F.array_join(F.slice("lines", 1, put), ""), own, F.array_join(F.slice("lines", put + gone + 1, F.greatest(F.size("lines"), F.lit(1))), ""))
    rule = F.concat(F.lit("---"), "eol")
    made = F.when(F.col("headed"), F.when(F.col("close") > 0, inside)).otherwise(F.concat(rule, own, rule, F.substr("text", F.char_length("bom") + 1)))
    after = F.when(F.col("warning").isNotNull(), F.col("text")).otherwise(F.concat("bom", made))
    return rows.select("path", F.sha2("content", 256).alias("before"), F.encode(after, "ISO-8859-1").alias("after"), "warning")


def still_current(plan: DataFrame, files: DataFrame) -> DataFrame:
    """(path, after, problem): edits of :func:`annotate` against the files as they are now.

    Only an edit without a problem may be written.
    """
    now = files.select(F.col("path").alias("p"), F.sha2("content", 256).alias("digest"))
    problem = F.when(F.col("p").isNull(), "file is gone").when(F.col("digest") != F.col("before"), "file has changed").otherwise(F.col("warning"))
    return plan.join(now, F.col("path") == F.col("p"), "left").select("path", "after", problem.alias("problem"))


def split_topics(blocks: DataFrame, most_tokens: int) -> DataFrame:
    """(path, topic, first_block, last_block, tokens, text): a note cut into topic documents.

    Blocks stay whole and in order; a topic closes before it would pass
    ``most_tokens``. Joined again, the topics are the note.
    """
    size = T.token_estimate(F.col("text"))
    rows = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", size.alias("n"), "text"))).alias("b"))
    start = F.array().cast("array<struct<first:int,last:int,tokens:bigint,text:string>>")

    def add(done, b):
        last = F.element_at(done, -1)
        own = F.struct(b["block"].cast("int").alias("first"), b["block"].cast("int").alias("last"), b["n"].alias("tokens"), b["text"].alias("text"))
        grown = F.struct(last["first"].alias("first"), b["block"].cast("int").alias("last"), (last["tokens"] + b["n"]).alias("tokens"), F.concat(last["text"], b["text"]).alias("text"))
        fits = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["tokens"], F.lit(0)) + b["n"] <= most_tokens)
        return F.when(fits, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(own)))

    def safe(done, b):
        return F.when(F.size(done) == 0, F.array(F.struct(b["block"].cast("int").alias("first"), b["block"].cast("int").alias("last"), b["n"].alias("tokens"), b["text"].alias("text")))).otherwise(add(done, b))

    topics = rows.select("path", F.posexplode(F.aggregate("b", start, safe)).alias("topic", "t"))
    return topics.select("path", "topic", F.col("t.first").alias("first_block"), F.col("t.last").alias("last_block"), F.col("t.tokens").alias("tokens"), F.col("t.text").alias("text"))


# -- onboarding -------------------------------------------------------------------------------


def onboarding_topics(notes: DataFrame) -> DataFrame:
    """(topic, keys): notes by their smallest topic label, smallest tag, first path part, or type."""
    labelled = F.array_min(F.filter("labels", lambda x: x.startswith("topic:")))
    topic = F.coalesce(F.substring(labelled, 7, 1000), F.array_min("tags"), F.when(F.contains("rel", F.lit("/")), F.split_part("rel", F.lit("/"), F.lit(1))), F.col("type"))
    return notes.groupBy(topic.alias("topic")).agg(F.array_sort(F.collect_list("key")).alias("keys"))
