"""Review answers and the journal that commits them.

A question binds two notes by their digests. :func:`judge` turns a table of answers into
changes of notes, or says why an answer is refused; nothing is changed by it.

:class:`Journal` commits changes in steps that each appear whole: the prepared changes
with their images, the next version of the notes, the mark of the outcome. A version's
number can be taken once, and it holds its notes under the transaction that made it, so
after a cut at any step :meth:`Journal.recover` knows how far the commit came and
finishes it; the same commit asked for again finds itself and goes on. Undo is a commit of the images before, checked against those after.

Defined cases: a question about one note, unknown choices and questions, a merge
without a body and a body without a merge are refused; so is an answer whose notes are
not as they were asked about, or are touched by an earlier answer (by ``seq``) of the
same table; null answers are unknown choices; empty tables change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import Folder, settle

#: The answers, and which note each retires.
CHOICES = ("keep-both", "keep-first", "keep-second", "current-first", "current-second", "drop-first", "drop-second", "merge")
RETIRES_SECOND, RETIRES_FIRST = ("keep-first", "current-first", "drop-second"), ("keep-second", "current-second", "drop-first")
NOTE = "path string, sources array<string>, version bigint, body string"
ARCHIVE = "_archive/"
CHANGES = "question_id string, path string, target string, before string, after string"


def image(columns: list[str] | None = None) -> Column:
    """A note as JSON, the same for equal notes."""
    return F.to_json(F.struct(*(columns or [x.split(" ")[0] for x in NOTE.split(", ")])), {"ignoreNullFields": "false"})


def question_id(first: Column, first_digest: Column, second: Column, second_digest: Column) -> Column:
    return F.sha2(F.concat_ws("\0", first, first_digest, second, second_digest), 256)


def ask(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """(question_id, first, second, first_digest, second_digest) of pairs (first, second) of notes."""
    known = notes.select("path", F.sha2(image(), 256).alias("digest"))
    one, two = (known.select(F.col("path").alias(n), F.col("digest").alias(f"{n}_digest")) for n in ("first", "second"))
    rows = pairs.select("first", "second").join(one, "first").join(two, "second")
    return rows.select(question_id(F.col("first"), F.col("first_digest"), F.col("second"), F.col("second_digest")).alias("question_id"), "first", "second", "first_digest", "second_digest")


def judge(questions: DataFrame, answers: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, refused): what answers (seq, question_id, choice, survivor, merged_body) change, or (seq, question_id, problem).

    The retired note moves to the archive, byte for byte; the survivor of a merge
    takes the merged body, both notes' sources and the next version.
    """
    now = notes.select("path", "sources", "version", "body", image().alias("image"))
    side = lambda n: now.select(F.col("path").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("sources", "version", "image")])
    rows = answers.join(questions, "question_id", "left").join(side("first"), "first", "left").join(side("second"), "second", "left")
    body, merges = F.btrim(F.coalesce("merged_body", F.lit("")), F.lit(" \t\r\n\x0b\x0c")), F.col("choice") == "merge"
    bound = question_id(F.col("first"), F.col("first_digest"), F.col("second"), F.col("second_digest"))
    fresh = lambda n: F.sha2(F.col(f"{n}_image"), 256).eqNullSafe(F.col(f"{n}_digest"))
    problem = (
        F.when(~F.coalesce(F.col("choice").isin(*CHOICES), F.lit(False)) | ~F.coalesce(F.col("survivor").isin("first", "second"), F.lit(False)), "unknown choice or survivor")
        .when(F.col("first").isNull() | (bound != F.col("question_id")), "no such question").when(F.col("first") == F.col("second"), "one note twice")
        .when(merges != (body != ""), "a merge, and nothing else, has a body").when(~fresh("first") | ~fresh("second"), "stale: ask again")
    )
    loser = F.when(F.col("choice").isin(*RETIRES_SECOND) | merges & (F.col("survivor") == "first"), "second").when(F.col("choice").isin(*RETIRES_FIRST) | merges, "first")
    rows = settle(rows.withColumns({"problem": problem, "loser": loser, "body": body}), "answers")
    # A note is in few questions: its answers in order of seq, the first sound one takes it.
    touched = rows.where("problem is null").select("seq", "question_id", F.explode(F.array("first", "second")).alias("note"))
    later = touched.withColumn("n", F.row_number().over(Window.partitionBy("note").orderBy("seq", "question_id"))).where("n > 1").select("seq", "question_id", F.lit("touched by an earlier answer").alias("again")).distinct()
    rows = rows.join(later, ["seq", "question_id"], "left").withColumn("problem", F.coalesce("problem", "again"))
    taken = notes.select(F.col("path").alias("at"))
    target = lambda n: F.when(F.col("loser") == n, F.concat(F.lit(ARCHIVE), F.col(n))).otherwise(F.col(n))
    gone = F.when(F.col("loser") == "first", target("first")).when(F.col("loser") == "second", target("second"))
    rows = rows.withColumn("gone", gone).join(taken, F.col("gone") == F.col("at"), "left").withColumn("problem", F.coalesce("problem", F.when(F.col("at").isNotNull(), "the archive has one already")))
    rows = settle(rows, "judged")
    good = rows.where("problem is null")

    def change(n: str, other: str) -> Column:
        kept = merges & (F.col("loser") == other)
        merged = F.struct(F.col(n).alias("path"), F.array_union(F.coalesce(f"{n}_sources", F.array().cast("array<string>")), F.coalesce(f"{other}_sources", F.array().cast("array<string>"))).alias("sources"), (F.coalesce(f"{n}_version", F.lit(0)) + 1).alias("version"), F.concat("body", F.lit("\n")).alias("body"))
        moved = F.from_json(f"{n}_image", NOTE)
        moved = F.struct(target(n).alias("path"), moved["sources"].alias("sources"), moved["version"].alias("version"), moved["body"].alias("body"))
        after = F.to_json(F.when(kept, merged).otherwise(moved), {"ignoreNullFields": "false"})
        return F.struct(F.col(n).alias("path"), target(n).alias("target"), F.col(f"{n}_image").alias("before"), after.alias("after"))

    changes = good.select("question_id", F.explode(F.array(change("first", "second"), change("second", "first"))).alias("c")).select("question_id", "c.*")
    return changes, rows.where("problem is not null").select("seq", "question_id", "problem")


def changed(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """``notes`` after ``changes`` (path, after), which name each path once."""
    new = changes.select(F.from_json("after", NOTE).alias("n")).select("n.*")
    return notes.join(changes.select("path"), "path", "left_anti").select(*new.columns).unionByName(new)


class Stale(RuntimeError):
    """The notes are no longer as the changes were made from."""


class Journal:
    """Versions of notes and the transactions that made them, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, on_step: Callable[[str], None] = lambda step: None):
        self.spark, self.on_step = spark, on_step
        self.versions, self.log = Folder(spark, f"{path}/notes"), Folder(spark, f"{path}/journal")

    def start(self, notes: DataFrame) -> None:
        self.versions.publish(notes, f"{0:08d}", "start")

    def current(self) -> tuple[int, str]:
        """The latest version's number and transaction."""
        name = self.versions.names()[-1]
        return int(name), self.versions.inside(name)[0]

    def notes(self) -> DataFrame:
        number, tx = self.current()
        return self.versions.read(f"{number:08d}/{tx}")

    def states(self) -> dict[str, str]:
        """Every transaction with prepared, committed or stale."""
        out: dict[str, str] = {}
        for name in self.log.names():
            tx, state = name.rsplit(".", 1)
            if state != "prepared" or tx not in out:
                out[tx] = state
        return out

    def _stale(self, changes: DataFrame) -> bool:
        """Whether a changed note is not as it was, or a target is taken by another."""
        now = self.notes().select("path", image().alias("image"))
        kept = changes.select("path", "before").join(now, "path", "left").where(~F.col("before").eqNullSafe(F.col("image"))).limit(1).count()
        moves = changes.where("target <> path").select(F.col("target").alias("path"))
        return bool(kept or moves.join(now, "path", "left_semi").limit(1).count())

    def commit(self, changes: DataFrame) -> str:
        """Journal and apply ``changes``; the transaction. Asked for again, it finishes what it began and changes nothing twice."""
        changes = settle(changes.select(*[x.split(" ")[0] for x in CHANGES.split(", ")]), "changes")
        # A digest of all images; sums of hashes need no order and no single task.
        parts = changes.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), "question_id", "path", "before", "after").cast("decimal(38,0)")) for seed in (1, 2, 3))).first()
        tx = self.spark.range(1).select(F.sha2(F.lit(":".join(map(str, parts))), 256)).first()[0][:32]
        if self.states().get(tx) == "committed":
            return tx
        if tx not in self.states():
            if self._stale(changes):
                raise Stale("the notes have changed since the changes were made")
            self.on_step("before prepared")
            try:
                self.log.publish(changes, f"{tx}.prepared")
            except FileExistsError:
                pass  # another try of the same commit
        self.on_step("prepared")
        return self._finish(tx)

    def _finish(self, tx: str) -> str:
        """From a prepared transaction on: its version, if it has none, then its mark."""
        while not any(tx in self.versions.inside(n) for n in self.versions.names()):
            changes, (number, _) = self.log.read(f"{tx}.prepared"), self.current()
            if self._stale(changes):
                self.log.publish(self.spark.range(1), f"{tx}.stale")
                raise Stale(f"{tx}: another commit came first")
            try:
                self.versions.publish(changed(self.notes(), changes), f"{number + 1:08d}", tx)
            except FileExistsError:
                continue  # another commit took the number: from its notes
        self.on_step("applied")
        try:
            self.log.publish(self.spark.range(1), f"{tx}.committed")
        except FileExistsError:
            pass
        self.on_step("committed")
        return tx

    def recover(self) -> dict[str, str]:
        """Finish every transaction that was cut; all transactions and their states."""
        for tx, state in self.states().items():
            if state == "prepared":
                try:
                    self._finish(tx)
                except Stale:
                    pass
        return self.states()

    def undo(self, tx: str) -> str:
        """Commit the images before a committed transaction, if those after it still stand."""
        if self.states().get(tx) != "committed":
            raise KeyError(f"{tx} is not committed")
        log = self.log.read(f"{tx}.prepared")
        back = log.select(F.concat(F.lit("undo:"), F.col("question_id")).alias("question_id"), F.col("target").alias("path"), F.col("path").alias("target"), F.col("after").alias("before"), F.col("before").alias("after"))
        return self.commit(back)
