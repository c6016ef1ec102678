"""The stored usage dynamics: versions of one table, read permissively and written by compare and swap.

A version is a folder of JSON lines. Reading takes every line by itself: one that is no
JSON, or holds values that no state has, goes to a quarantine table with its file, its
text and the reason, and the rest loads. :meth:`Store.set_aside` moves the files that
hold such lines out of the version, after their sound lines were written to a new one.

A write names the version it was made from. The new version is written beside the
others under a name of its own and renamed into place, which the file system does once:
of two writers that read the same version one finds the next already there and starts
over from it.

Defined cases: no version is an empty state; a null or blank key is no state; of rows
that share a key the one of the latest access counts (then the larger numbers), and
the others are quarantined as repeated; empty lines are skipped; an empty log changes
nothing.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import settle
from . import dynamics

STATE = "key string, strength double, stability double, access_count bigint, last_access timestamp"
COLUMNS = [x.split(" ")[0] for x in STATE.split(", ")]
QUARANTINE = "file string, line string, reason string"
_TYPES = {"key": "string", "strength": "double", "stability": "double", "access_count": "long", "last_access": "timestamp"}


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def judged(lines: DataFrame) -> DataFrame:
    """(file, line, state columns, reason) of lines (file, line); a null reason is a state that holds."""
    rows = lines.where(F.btrim("line") != "").select("file", "line", F.try_parse_json("line").alias("v"))
    got = {n: F.try_variant_get("v", f"$.{n}", t) for n, t in _TYPES.items() if n != "last_access"}
    stamp = F.try_variant_get("v", "$.last_access", "string")
    got["last_access"] = F.try_to_timestamp(stamp)
    rows = rows.select("file", "line", F.schema_of_variant("v").alias("kind"), stamp.alias("stamp"), *[c.alias(n) for n, c in got.items()])
    number = lambda c, low, high: F.coalesce(F.col(c).between(low, high) & ~F.isnan(c), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False)), "not an object").when(F.coalesce(F.btrim("key"), F.lit("")) == "", "no key")
        .when(~number("strength", 0.0, dynamics.STRENGTH_CAP), "strength").when(~number("stability", 1e-6, dynamics.STABILITY_CAP), "stability")
        .when(~F.coalesce(F.col("access_count") >= 0, F.lit(False)), "access_count").when(F.col("stamp").isNotNull() & F.col("last_access").isNull(), "last_access")
    )
    rows = rows.withColumn("reason", reason)
    # The rest of a key's rows; a key is on few lines. Lines that don't hold are dealt by what
    # they are, so that all go through one read of the lines and no group of them is large.
    order = [F.col("last_access").desc_nulls_last(), F.col("access_count").desc(), F.col("strength").desc(), F.col("stability").desc(), F.col("line"), F.col("file")]
    group = F.when(F.col("reason").isNull(), F.col("key")).otherwise(F.xxhash64("file", "line").cast("string"))
    place = F.row_number().over(Window.partitionBy(F.col("reason").isNull(), group).orderBy(*order))
    return rows.withColumn("place", place).select("file", "line", *COLUMNS, F.coalesce("reason", F.when(F.col("place") > 1, "repeated")).alias("reason"))


@dataclass
class Loaded:
    """A version's ``state`` and what was set apart from it; version 0 is none."""

    version: int
    state: DataFrame
    quarantine: DataFrame


class Store:
    """The versions under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, version: int) -> str:
        return f"{self.path}/version-{version:08d}"

    def version(self) -> int:
        """The latest version."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at)] if self._fs.exists(self._at) else []
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"version-(\d{8})", n))), default=0)

    def load(self) -> Loaded:
        """The latest state; damaged lines are named, not fatal."""
        version = self.version()
        if not version:
            return Loaded(0, self.spark.createDataFrame([], STATE), self.spark.createDataFrame([], QUARANTINE))
        lines = self.spark.read.text(self._folder(version)).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
        rows = judged(lines)
        return Loaded(version, rows.where("reason is null").select(*COLUMNS), rows.where("reason is not null").select("file", "line", "reason"))

    def commit(self, state: DataFrame, read: int) -> int:
        """Write ``state`` as the version after ``read``; :class:`Conflict` if that one is there already."""
        if self.version() != read:
            raise Conflict(f"version {read} was read, {self.version()} is there")
        made = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/writing-{uuid.uuid4().hex}")
        state.select(*COLUMNS).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(made.toString())
        to = self._jvm.org.apache.hadoop.fs.Path(self._folder(read + 1))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(made, to, options)  # fails where the version exists
        except Exception as error:
            self._fs.delete(made, True)
            if self._fs.exists(to):
                raise Conflict(f"version {read + 1} was written meanwhile") from error
            raise
        return read + 1

    def record(self, log: DataFrame, tries: int = 5) -> int:
        """Fold accesses (key, ts) into the stored state; the new version. A conflict reads and folds again."""
        folded = settle(log.select("key", "ts"), "accesses")
        if not folded.limit(1).count():
            return self.version()
        for last in range(tries):
            now = self.load()
            try:
                return self.commit(folded_into(now.state, folded), now.version)
            except Conflict:
                if last == tries - 1:
                    raise
        raise AssertionError("unreachable")

    def set_aside(self) -> DataFrame:
        """Write the sound rows as a new version, move files with damaged lines to ``quarantine``, and return what was in them."""
        now = self.load()
        bad = settle(now.quarantine, "quarantine")
        files = [r["file"] for r in bad.select("file").distinct().collect()]  # files of a version, not rows
        if files:
            self.commit(now.state, now.version)
            apart = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/quarantine/{now.version:08d}")
            self._fs.mkdirs(apart)
            for name in files:
                self._fs.rename(self._jvm.org.apache.hadoop.fs.Path(f"{self._folder(now.version)}/{name}"), self._jvm.org.apache.hadoop.fs.Path(apart, name))
        return bad


def folded_into(state: DataFrame, log: DataFrame) -> DataFrame:
    """``state`` after the accesses of ``log`` (key, ts), as if they had been folded one by one.

    Strength adds up to its cap; stability grows for each access at least the spacing
    after the one before, the first one being compared with the stored last access.
    """
    before = state.select("key", F.col("strength").alias("s0"), F.col("stability").alias("t0"), F.col("access_count").alias("n0"), F.col("last_access").alias("l0"))
    at = Window.partitionBy("key").orderBy("ts")
    rows = log.where("key is not null and ts is not null").join(before.select("key", "l0"), "key", "left")
    last = F.coalesce(F.lag("ts").over(at), F.col("l0"))
    spaced = F.coalesce((dynamics.seconds(F.col("ts")) - dynamics.seconds(last) >= dynamics.SPACING_SECONDS).cast("int"), F.lit(1))
    new = rows.withColumn("spaced", spaced).groupBy("key").agg(F.count("*").alias("n"), F.sum("spaced").alias("k"), F.max("ts").alias("l"))
    both = before.join(new, "key", "full_outer")
    n = F.coalesce("n", F.lit(0))
    # 400 spaced accesses reach the cap from the least stability; a larger power would overflow.
    grown = F.coalesce("t0", F.lit(dynamics.STABILITY_INIT)) * F.pow(F.lit(dynamics.STABILITY_GROWTH), F.least(F.coalesce("k", F.lit(0)), F.lit(400)))
    return both.select(
        "key", F.least(F.lit(dynamics.STRENGTH_CAP), F.coalesce("s0", F.lit(1.0)) + dynamics.STRENGTH_STEP * n).alias("strength"),
        F.round(F.least(F.lit(dynamics.STABILITY_CAP), grown), 6).alias("stability"), (F.coalesce("n0", F.lit(0)) + n).cast("long").alias("access_count"), F.greatest("l0", "l").alias("last_access"),
    )
