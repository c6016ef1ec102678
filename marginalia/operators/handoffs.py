"""Handoff records: canonical images, the checked reading of scopes, and the retention fold.

A record is a row of typed columns. Its image is a canonical JSON text in a fence, its
path a scope folder that binds the exact scope and a name that binds kind, stamp and
every byte of the image. :func:`read` takes images as they lie in folders and gives
each record with what is wrong with it: a forged image is one that its own record
would not make, a fork is a capture id that two different records claim.

:func:`fold_plan` proposes, for all scopes at once, to archive what is older than the
newest ``keep`` captures, lets the archive gate decide, and writes one summary a
scope. A plan's id is a digest of all that it rests on, so :func:`apply_fold` can tell
a plan that still holds from a stale one, and a repeated one from a new one.

Ranks within a scope are counts of earlier days and a window over one day, so a scope
with a third of all records is not one task's. Digests are of days first, for the same
reason.

Defined cases: null text is no record; a path of another form is no record; equal
records under one capture id (retries) are no fork; empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.tables import settle
from .gate import ARCHIVE_FRACTION, ARCHIVE_MIN

#: Columns of a record in the order of its image.
RECORD = (
    "capture_id string, decisions array<string>, event string, kind string, links array<string>, next_step string, open_items array<string>, open_questions array<string>, "
    "project_key string, provenance array<struct<path:string,sha256:string>>, recorded_at string, session_id string, source string, task_key string, version int, work string"
)
COLUMNS = [x.split(" ")[0] for x in RECORD.split(", ")]
LISTS, LINES = ("decisions", "open_items", "open_questions", "links"), ("work", "next_step")
SCOPE = ["project_key", "task_key"]
#: Bytes of a record at most, the form of stamps, the events of captures.
MOST_BYTES = 1 << 20
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z$"
CAPTURE_EVENTS = ("explicit", "pre-compress", "session-end")
CONTROL = r"[\x00-\x1f\x7f-\x9f]"
FILES = "path string, text string"
JOURNAL = "project_key string, task_key string, plan_id string, keep int, state string, moved array<struct<source:string,target:string,sha256:string>>"


def scope_folder(project: Column, task: Column) -> Column:
    """A readable start of both keys and a digest of the exact scope."""
    short = lambda c, other: F.coalesce(F.nullif(F.btrim(F.substring(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9_-]", "")), 1, 6), F.lit("-_")), F.lit("")), F.lit(other))
    exact = F.sha2(F.to_json(F.struct(project.alias("p"), task.alias("t")), {"ignoreNullFields": "false"}), 256)
    return F.concat(short(project, "proj"), F.when(task.isNotNull(), F.concat(F.lit("--"), short(task, "task"))).otherwise(""), F.lit("--"), exact)


def image(record: Column) -> Column:
    """The canonical text of a record: JSON of its columns in a fence that it can't close."""
    return T.fence(F.to_json(record, {"ignoreNullFields": "false"}), "json")


def encode(records: DataFrame) -> DataFrame:
    """(path, text) of records (``RECORD``)."""
    text = image(F.struct(*COLUMNS))
    name = F.concat(F.regexp_replace("recorded_at", r"[-:.]", ""), F.lit("--"), "kind", F.lit("--"), F.sha2("text", 256), F.lit(".md"))
    return records.withColumn("text", text).select(F.concat(scope_folder(F.col("project_key"), F.col("task_key")), F.lit("/"), name).alias("path"), "text")


def invalid(r: Column) -> Column:
    """What is wrong with a record's values, or null."""
    key = lambda c: F.coalesce(F.btrim(c) != "", F.lit(False)) & ~c.rlike(CONTROL)
    filled = lambda c: F.coalesce(~F.exists(c, lambda x: F.coalesce(F.btrim(x), F.lit("")) == ""), F.lit(False))
    dated = r["recorded_at"].rlike(STAMP) & F.try_to_timestamp(F.substring(r["recorded_at"], 1, 26), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).isNotNull()
    kind = F.when(r["kind"] == "capture", r["event"].isin(*CAPTURE_EVENTS) & key(r["capture_id"])).when(r["kind"] == "summary", (r["event"] == "fold") & r["capture_id"].isNull())
    hashed = ~F.exists(r["provenance"], lambda x: ~F.coalesce(key(x["path"]) & x["sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False)))
    good = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~good(r["version"] == 1), "version")
        .when(~good(key(r["project_key"]) & (r["task_key"].isNull() | key(r["task_key"]))), "scope")
        .when(~good((F.btrim(r["work"]) != "") & r["next_step"].isNotNull()), "fields")
        .when(~good(filled(r["decisions"]) & filled(r["open_items"]) & filled(r["open_questions"]) & filled(r["links"])), "fields")
        .when(~good(dated), "stamp").when(~good(kind), "kind")
        .when(~good(key(r["source"]) & ((r["session_id"] == "") | key(r["session_id"]))), "source")
        .when(~good(hashed), "provenance")
    )


def read(files: DataFrame) -> DataFrame:
    """Every image of ``files`` (path, text) as (path, archived, sha256, problem, record columns).

    ``problem`` is null for a record that holds; else ``too large``, ``not a record``,
    ``invalid`` and what, ``forged`` (the record's own image or name is another),
    ``another scope`` (it lies in another scope's folder) or ``forked``.
    """
    folder, name = F.regexp_extract("path", "^([^/]+)/", 1), F.regexp_extract("path", "([^/]+)$", 1)
    own = files.where(F.col("path").endswith(".md") & ~name.startswith("."))
    body = F.regexp_extract("text", "(?s)^`{3,}json\n(.*)\n`{3,}\n$", 1)
    placed = F.col("path").rlike("^[^/]+/(archive/)?[^/]+$")
    rows = own.select(
        "path", "text", folder.alias("folder"), name.alias("name"), F.contains("path", F.lit("/archive/")).alias("archived"), F.sha2("text", 256).alias("sha256"), placed.alias("placed"),
        F.from_json(F.when(F.octet_length("text") <= MOST_BYTES, body), RECORD, {"mode": "PERMISSIVE"}).alias("r"),
    )
    # Written once: each use of a field would otherwise parse the text again, and forks join the rows with themselves.
    rows, r = settle(rows, "handoff-images"), F.col("r")
    rows = rows.withColumn("wrong", invalid(r)).withColumn("again", F.to_json(r, {"ignoreNullFields": "false"}))
    rows = rows.withColumn("again", T.fence(F.col("again"), "json"))
    bad = F.coalesce(r["kind"], r["work"], r["project_key"]).isNull()
    stamp = F.regexp_replace(r["recorded_at"], r"[-:.]", "")
    named = F.col("name") == F.concat(stamp, F.lit("--"), r["kind"], F.lit("--"), "sha256", F.lit(".md"))
    problem = (
        F.when(F.octet_length("text") > MOST_BYTES, "too large").when(~F.col("placed") | bad, "not a record")
        .when(F.col("wrong").isNotNull(), F.concat(F.lit("invalid "), "wrong"))
        .when((F.col("again") != F.col("text")) | ~F.coalesce(named, F.lit(False)), "forged")
        .when(scope_folder(r["project_key"], r["task_key"]) != F.col("folder"), "another scope")
    )
    judged = rows.withColumn("problem", problem).select("path", "archived", "sha256", "problem", *[r[c].alias(c) for c in COLUMNS])
    # Counted first, so a capture id with many retries is one row a task and digest.
    held = judged.where("problem is null and capture_id is not null").groupBy(*SCOPE, "capture_id").agg((F.min("sha256") != F.max("sha256")).alias("forked"))
    same = lambda c: F.col(f"j.{c}").eqNullSafe(F.col(f"h.{c}"))
    out = judged.alias("j").join(held.where("forked").alias("h"), same("project_key") & same("task_key") & (F.col("j.capture_id") == F.col("h.capture_id")), "left")
    problem = F.when(F.col("j.problem").isNull() & F.col("forked"), "forked").otherwise(F.col("j.problem")).alias("problem")
    return out.select("j.path", "j.archived", "j.sha256", problem, *[F.col(f"j.{c}") for c in COLUMNS])


def ranked(rows: DataFrame, keys: list[str], order: list[str], day: Column) -> DataFrame:
    """``rows`` with ``place`` (from 1) in their order within ``keys`` and the ``total``; ``day`` grows with the order.

    Days are counted, summed up over the days of a key, and only rows of one day share a window.
    """
    own = rows.withColumn("_day", day)
    days = own.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(by_key).alias("total"))
    own = own.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_day").eqNullSafe(F.col("_d"))]
    both = own.join(days, on)
    return both.select(*rows.columns, (F.col("_before") + F.col("_row")).alias("place"), "total")


def judge_fold(records: DataFrame, keep: int, cap: Column, order: tuple[str, str] = ("recorded_at", "sha256"), scope: list[str] | None = None) -> DataFrame:
    """Active captures with ``verdict``: pinned, kept, accepted, or why the gate refuses.

    ``records``: (scope, order, protected) of active captures. Those older than the
    newest ``keep`` are proposed from the oldest on; protected ones are refused, and
    of the others all beyond ``cap``, a column of one number a scope.
    """
    if keep < 1:
        raise ValueError("keep is a positive number")
    scope, (stamp, tie) = scope or SCOPE, order
    day = F.substring(F.col(stamp).cast("string"), 1, 10)
    rows = ranked(records, scope, [stamp, tie], day).withColumn("old", F.col("place") <= F.col("total") - keep)
    out = rows.withColumn("open", F.col("old") & ~F.col("protected"))
    open_ = ranked(out.where("open").drop("place", "total"), scope, [stamp, tie], F.substring(F.col(stamp).cast("string"), 1, 10)).withColumnRenamed("place", "n").drop("total")
    capped = F.concat(F.lit("archive_capped (>"), cap.cast("string"), F.lit(")"))
    decided = open_.withColumn("verdict", F.when(F.col("n") <= cap, "accepted").otherwise(capped)).drop("n")
    rest = out.where("not open").withColumn("verdict", F.when(F.col("old"), "protected note").when(F.col("place") == F.col("total"), "pinned").otherwise("kept"))
    return rest.select(*records.columns, "verdict").unionByName(decided.select(*records.columns, "verdict"))


def _cap(active: Column) -> Column:
    raw = F.when(active > 0, F.greatest(F.lit(ARCHIVE_MIN), F.ceil(ARCHIVE_FRACTION * active))).otherwise(0)
    return F.least(raw, F.greatest(F.lit(0), active - 1)).cast("long")


def _summaries(accepted: DataFrame) -> DataFrame:
    """One record a scope: distinct values in order of first appearance, dated by the newest source."""
    at = F.struct("recorded_at", "sha256")
    one = lambda name: F.array(F.when(F.btrim(name) != "", F.col(name)))
    values = F.array(*(F.struct(F.lit(n).alias("field"), F.filter(one(n) if n in LINES else F.col(n), lambda x: x.isNotNull()).alias("v")) for n in (*LINES, *LISTS)))
    rows = accepted.select(*SCOPE, at.alias("at"), F.explode(values).alias("f")).select(*SCOPE, "at", "f.field", F.posexplode("f.v").alias("i", "value"))
    first = rows.groupBy(*SCOPE, "field", "value").agg(F.min(F.struct("at", "i")).alias("first"))
    named = accepted.groupBy(*SCOPE).agg(F.sum(F.octet_length("path") + 64).alias("bytes"))
    sized = first.groupBy(*SCOPE).agg(F.sum(F.octet_length("value")).alias("bytes")).unionByName(named).groupBy(*SCOPE).agg(F.sum("bytes").alias("bytes"))
    # A summary over the bound is an error before its values or sources meet in one row.
    fits = F.when(F.col("bytes") > MOST_BYTES, F.raise_error(F.lit("the summary is over the bound: fold fewer records"))).otherwise(F.lit(True))
    same = F.col("a.project_key").eqNullSafe(F.col("b.project_key")) & F.col("a.task_key").eqNullSafe(F.col("b.task_key"))
    checked = lambda df: df.alias("a").join(sized.alias("b"), same).where(fits).select("a.*")
    first, accepted = checked(first), checked(accepted)
    in_order = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == n, F.struct("first", "value")))), lambda x: x["value"])
    folded = first.groupBy(*SCOPE).agg(*(in_order(n).alias(n) for n in (*LINES, *LISTS)))
    sources = accepted.groupBy(*SCOPE).agg(F.max("recorded_at").alias("recorded_at"), F.transform(F.array_sort(F.collect_list(F.struct("recorded_at", "sha256", "path"))), lambda x: F.struct(x["path"].alias("path"), x["sha256"].alias("sha256"))).alias("provenance"))
    both = folded.alias("a").join(sources.alias("b"), same).select("a.*", "recorded_at", "provenance")
    fixed = {"capture_id": F.lit(None).cast("string"), "event": F.lit("fold"), "kind": F.lit("summary"), "session_id": F.lit(""), "source": F.lit("retention"), "version": F.lit(1)}
    return both.withColumns({n: F.array_join(n, "\n") for n in LINES}).withColumns(fixed).select(*COLUMNS)


@dataclass
class Fold:
    """``verdicts``: active captures with what becomes of each; ``plans``: (scope, plan_id, accepted, summary path and text)."""

    verdicts: DataFrame
    plans: DataFrame
    keep: int


def fold_plan(files: DataFrame, journal: DataFrame, keep: int = 3, other_notes: int = 0) -> Fold:
    """What a fold of all scopes of ``files`` would do; nothing is written.

    ``other_notes``: active notes outside the records, which the archive cap counts
    too. A record with a problem anywhere is an error: a fold rests on whole scopes.
    """
    rows = settle(read(files), "handoff-records")
    broken = rows.where("problem is not null").select("path", "problem").orderBy("path").first()
    if broken:
        raise ValueError(f"{broken['path']}: {broken['problem']}")
    active = rows.where("not archived")
    cap = F.lit(active.select(_cap(F.count("*") + F.lit(other_notes)).alias("c")).first()["c"])
    links = F.array_union("links", T.wikilinks(image(F.struct(*COLUMNS))))
    captures = active.where("kind = 'capture'").withColumn("protected", F.size(links) > 0)
    verdicts = settle(judge_fold(captures, keep, cap), "fold-verdicts")
    accepted = verdicts.where("verdict = 'accepted'")
    summary = encode(_summaries(accepted)).select(F.col("path").alias("summary_path"), F.col("text").alias("summary"), F.substring_index("path", "/", 1).alias("folder"))
    folder = scope_folder(F.col("project_key"), F.col("task_key")).alias("folder")
    day = F.substring("recorded_at", 1, 10)
    days = accepted.groupBy(*SCOPE, day.alias("day")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "recorded_at", "sha256", "path"))), "\n"), 256).alias("digest"))
    images = days.groupBy(*SCOPE).agg(F.sum("n").alias("accepted"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "digest"))), lambda x: F.concat_ws(" ", x["day"], x["digest"])), "\n"), 256).alias("images"))
    pinned = verdicts.where("verdict = 'pinned'").select(*SCOPE, F.col("sha256").alias("pinned"))
    done = journal.groupBy(*SCOPE).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "plan_id", "state"))), "\n"), 256).alias("state"))
    keyed = lambda df: df.withColumn("folder", folder).drop(*SCOPE)
    plans = pinned.withColumn("folder", folder).join(keyed(images), "folder", "left").join(summary, "folder", "left").join(keyed(done), "folder", "left")
    # What the plan rests on: scope, keep, the pinned record, all accepted images, the summary's bytes, earlier folds.
    binding = F.to_json(F.struct(F.col("project_key"), F.col("task_key"), F.lit(keep).alias("keep"), F.col("pinned"), F.col("images"), F.sha2("summary", 256).alias("summary"), F.col("state")), {"ignoreNullFields": "false"})
    plans = plans.select(*SCOPE, F.sha2(binding, 256).alias("plan_id"), F.coalesce("accepted", F.lit(0)).alias("accepted"), "summary_path", "summary")
    return Fold(verdicts, settle(plans, "fold-plans"), keep)


def apply_fold(files: DataFrame, journal: DataFrame, plan_id: str, keep: int = 3, other_notes: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """(files, journal, outcome) after the fold of one plan id: committed, idempotent or noop.

    A plan that nothing on hand gives is stale: an error. One that the journal holds as
    committed is given again only while its images are as it left them.
    """
    prior = journal.where(F.col("plan_id") == plan_id)
    if prior.count():
        wrong = prior.where((F.col("keep") != keep) | (F.col("state") != "committed")).count()
        moved = prior.select(F.explode("moved").alias("m")).select("m.*")
        now = files.select("path", F.sha2("text", 256).alias("digest"))
        kept = moved.join(now, moved["target"] == now["path"], "left").where(~F.col("digest").eqNullSafe(F.col("sha256"))).count()
        back = moved.join(now, moved["source"] == now["path"], "left_semi").count()
        if wrong or kept or back:
            raise ValueError("the committed fold's images have changed, or it was asked for with another keep")
        return files, journal, "idempotent"
    plan = fold_plan(files, journal, keep, other_notes)
    own = settle(plan.plans.where(F.col("plan_id") == plan_id), "fold-plan")
    if not own.count():
        raise ValueError("the plan is stale: preview again")
    if not own.where("accepted > 0").count():
        return files, journal, "noop"
    scope = scope_folder(F.col("project_key"), F.col("task_key"))
    mine = plan.verdicts.where("verdict = 'accepted'").withColumn("folder", scope).join(own.select(scope.alias("folder")), "folder", "left_semi")
    target = F.regexp_replace("path", "^([^/]+)/", "$1/archive/")
    moved = mine.select(F.col("path").alias("source"), target.alias("target"), "sha256")
    summary = own.select(F.col("summary_path").alias("path"), F.col("summary").alias("text"))
    stay = files.join(moved.select(F.col("source").alias("path"), "target"), "path", "left").select(F.coalesce("target", "path").alias("path"), "text")
    added = summary.select(F.lit(None).cast("string").alias("source"), F.col("path").alias("target"), F.sha2("text", 256).alias("sha256"))
    # One plan's moves are one journal row.
    images = moved.unionByName(added).agg(F.array_sort(F.collect_list(F.struct("source", "target", "sha256"))).alias("moved"))
    row = own.crossJoin(F.broadcast(images)).select(*SCOPE, "plan_id", F.lit(keep).alias("keep"), F.lit("committed").alias("state"), "moved")
    return settle(stay.unionByName(summary), "handoff-files"), settle(journal.unionByName(row), "fold-journal"), "committed"
