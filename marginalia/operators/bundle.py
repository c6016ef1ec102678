"""Startup bundles: what a set of documents requires, in full, with receipts that can be checked.

References are parsed from the texts: lines ``MUST READ: path`` outside code fences, and
the ``must_read`` list of a JSON document; a path is relative to its document's folder.
:func:`bundle` takes in everything that the first documents reach, a step of the closure
at a time, and gives each file's digest, bytes and lines, each block's span and digest,
and its place. :func:`verify` reads the sources anew and names what no longer holds.

Bundles are many at once: ``starts`` has a bundle a row, so the closure is one join a
step for all of them, with what each has seen taken out. A step's rows are (bundle,
document) pairs that are new.

Defined cases: a missing document, a path outside the root or in a hidden folder, an
empty reference, malformed JSON and a bundle over its budgets are rows of ``problem``,
and such a bundle is not complete; null text is an empty document; cycles end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import settle
from . import sections

#: Documents and bytes of a bundle at most, and the form of a declaration.
MOST_FILES, MOST_BYTES = 64, 1 << 20
DECLARATION = r"(?i)^ {0,3}(?:-\s*)?MUST READ:[ \t]*(.*)$"
ROUNDS = 1000


def resolved(folder: Column, reference: Column) -> Column:
    """A reference's path from the root; null where it leaves the root, is absolute or hidden."""
    whole = F.when(folder == "", reference).otherwise(F.concat(folder, F.lit("/"), reference))
    parts = F.filter(F.split(F.replace(whole, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    # A fold with the parts so far: .. takes the last one off, and below the root there is none.
    start = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
    path = F.aggregate(parts, start, lambda a, p: F.when(p == "..", up(a)).otherwise(F.concat(a, F.array(p))))
    hidden = F.exists(path, lambda p: p.startswith("."))
    absolute = reference.startswith("/") | reference.rlike("^[A-Za-z]:")
    return F.when(~absolute & ~hidden & (F.size(path) > 0), F.array_join(path, "/"))


def references(docs: DataFrame) -> DataFrame:
    """(path, reference, target, problem): every declared reference of ``docs`` (path, text)."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^﻿", "")
    rows = docs.select("path", folder.alias("folder"), text.alias("text"), F.lower("path").endswith(".json").alias("json"))
    lines = F.filter(F.split("text", sections.LINE_ENDS, -1), lambda x: x != "")
    prose = rows.where("not json").select("path", "folder", lines.alias("lines"))
    zipped = F.arrays_zip(F.col("lines").alias("line"), sections.free_lines(F.col("lines")).alias("free"))
    bare = lambda x: F.regexp_replace(x, r"[\r\n]+$", "")
    declared = F.filter(zipped, lambda x: x["free"] & bare(x["line"]).rlike(DECLARATION))
    named = F.transform(declared, lambda x: F.btrim(F.btrim(F.regexp_extract(bare(x["line"]), DECLARATION, 1)), F.lit("`\"'")))
    prose = prose.select("path", "folder", F.explode(named).alias("reference"), F.lit(None).cast("string").alias("problem"))
    parsed = F.try_parse_json("text")
    shape = F.coalesce(F.schema_of_variant(parsed), F.lit("none"))
    held = F.try_variant_get(parsed, "$.must_read", "variant")
    kind = F.schema_of_variant(held)
    problem = F.when(shape == "none", "invalid JSON").when(~shape.startswith("OBJECT") | held.isNull(), None).when(~kind.startswith("ARRAY"), "must_read is no list").when(~kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), "must_read holds no paths")
    files = rows.where("json").select("path", "folder", problem.alias("problem"), F.when(problem.isNull(), F.try_variant_get(held, "$", "array<string>")).alias("list"))
    listed = files.select("path", "folder", F.explode_outer("list").alias("reference"), "problem").where("reference is not null or problem is not null")
    both = prose.select("path", "folder", "reference", "problem").unionByName(listed)
    target = resolved(F.col("folder"), F.col("reference"))
    wrong = F.coalesce("problem", F.when(F.btrim("reference") == "", "empty reference").when(target.isNull(), "outside the root or hidden"))
    return both.select("path", "reference", F.when(wrong.isNull(), target).alias("target"), wrong.alias("problem"))


@dataclass
class Bundle:
    """``files`` (bundle, path, depth, sha256, bytes, lines), ``problems`` (bundle, path, problem), ``summary`` (bundle, complete, files, bytes, receipt)."""

    files: DataFrame
    problems: DataFrame
    summary: DataFrame


def bundle(docs: DataFrame, starts: DataFrame, most_files: int | None = MOST_FILES, most_bytes: int | None = MOST_BYTES) -> Bundle:
    """The bundles of ``starts`` (bundle, path) over ``docs`` (path, text).

    ``docs`` hold a path once. A bundle over ``most_files`` stops growing there and is
    incomplete: the budget is a part of what a bundle is. None is no budget: all that is
    reached is in.
    """
    found = settle(references(docs), "references")
    edges = found.where("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()
    asked = starts.select("bundle", resolved(F.lit(""), F.col("path")).alias("path"), F.col("path").alias("named")).distinct()
    seen = settle(asked.where("path is not null").select("bundle", "path", F.lit(0).alias("depth")).distinct(), "bundle")
    front = seen
    for depth in range(1, ROUNDS):
        if most_files is not None:
            small = seen.groupBy("bundle").agg(F.count("*").alias("n")).where(F.col("n") <= most_files).select("bundle")
            front = front.join(small, "bundle", "left_semi")
        step = front.join(edges, front["path"] == edges["src"]).select("bundle", F.col("dst").alias("path")).distinct()
        front = settle(step.join(seen, ["bundle", "path"], "left_anti").withColumn("depth", F.lit(depth)), "bundle")
        if not front.limit(1).count():
            break
        seen = settle(seen.unionByName(front), "bundle")
    else:
        raise RuntimeError(f"references are deeper than {ROUNDS}")
    text = F.coalesce("text", F.lit(""))
    lines = F.size(F.filter(F.split(text, sections.LINE_ENDS, -1), lambda x: x != "")).cast("long")
    known = docs.select("path", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), lines.alias("lines"))
    files = settle(seen.join(known, "path", "left"), "bundle-files")
    have = files.where("sha256 is not null").select("bundle", "path", "depth", "sha256", "bytes", "lines")
    totals = have.groupBy("bundle").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    over = F.when(F.col("files") > F.lit(most_files), "over the file budget").when(F.col("bytes") > F.lit(most_bytes), "over the byte budget")
    problems = (
        files.where("sha256 is null").select("bundle", "path", F.lit("missing").alias("problem"))
        .unionByName(asked.where("path is null").select("bundle", F.col("named").alias("path"), F.lit("outside the root or hidden").alias("problem")))
        .unionByName(have.select("bundle", "path").join(found.where("problem is not null").select("path", "problem").distinct(), "path").select("bundle", "path", "problem"))
        .unionByName(totals.select("bundle", F.lit(None).cast("string").alias("path"), over.alias("problem")).where("problem is not null"))
    )
    problems = settle(problems, "bundle-problems")
    # A bundle's files (within a budget: these, and the step that passed it) are one row; the receipt binds all of them in order.
    images = F.array_sort(F.collect_list(F.struct("depth", "path", "sha256", "bytes")))
    receipt = have.groupBy("bundle").agg(F.sha2(F.to_json(images), 256).alias("receipt"))
    wrong = problems.select("bundle").distinct().withColumn("wrong", F.lit(True))
    all_ = starts.select("bundle").distinct().join(totals, "bundle", "left").join(receipt, "bundle", "left").join(wrong, "bundle", "left")
    summary = all_.select("bundle", F.col("wrong").isNull().alias("complete"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "receipt")
    return Bundle(have, problems, summary)


def context(made: Bundle, docs: DataFrame) -> DataFrame:
    """(bundle, path, depth, block, start_byte, end_byte, sha256, text): the blocks of complete bundles, whole."""
    whole = made.files.join(made.summary.where("complete"), "bundle", "left_semi").select("bundle", "path", "depth")
    parts = sections.blocks(docs.join(whole.select("path").distinct(), "path", "left_semi").select("path", "text"))
    return whole.join(parts, "path").select("bundle", "path", "depth", "block", "start_byte", "end_byte", "sha256", "text")


def verify(given: DataFrame, docs: DataFrame, starts: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(bundle, ok, problem) of a context as :func:`context` gives it, against sources read anew.

    Files must be those that the starts reach now, no more and no fewer; blocks must
    follow each other, hold their digests, and together be the file.
    """
    now = bundle(docs, starts, most_files, most_bytes)
    want = now.files.select("bundle", "path", F.col("sha256").alias("whole"), F.col("depth").alias("at"))
    size = F.max("end_byte").alias("end")
    start, sound = F.sum(F.col("end_byte") - F.col("start_byte")).alias("covered"), F.min((F.sha2("text", 256) == F.col("sha256")) & (F.octet_length("text") == F.col("end_byte") - F.col("start_byte"))).alias("sound")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_byte", "block", "text"))), lambda x: x["text"]), "")
    # A file is at most a bundle's byte budget.
    got = given.groupBy("bundle", "path", "depth").agg(size, start, sound, F.count("*").alias("n"), F.countDistinct("block").alias("blocks"), F.sha2(text, 256).alias("digest"))
    both = want.join(got, ["bundle", "path"], "full_outer")
    empty = F.sha2(F.lit(""), 256)
    problem = (
        F.when(F.col("whole").isNull(), "foreign file").when(F.col("digest").isNull() & (F.col("whole") != empty), "missing file")
        .when(F.col("digest").isNull(), None).when((F.col("n") != F.col("blocks")) | (F.col("covered") != F.col("end")), "blocks don't cover the file")
        .when(~F.col("sound"), "a block has changed").when(F.col("digest") != F.col("whole"), "the file has changed").when(F.col("depth") != F.col("at"), "another order")
    )
    first = both.withColumn("problem", problem).where("problem is not null").groupBy("bundle").agg(F.min(F.struct("path", "problem")).alias("p"))
    out = now.summary.join(first, "bundle", "full_outer")
    shown = F.coalesce(F.when(~F.col("complete"), "sources are incomplete"), F.col("p.problem"))
    return out.select("bundle", shown.isNull().alias("ok"), shown.alias("problem"))
