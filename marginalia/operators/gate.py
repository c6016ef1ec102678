"""Mutation plans: validation with reasons, caps, dense links, capacity, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import archived, normal_zone

# Fixed values of the gate.
ARCHIVE_FRACTION, ARCHIVE_MIN = 0.2, 2
DENSE_PER_MOVER, DENSE_PER_PLAN = 10, 500
PROTECTED_TYPES = ("identity", "preference")


def protected() -> Column:
    """Negative, of a protected type, or filed in a zone and linked."""
    filed = (F.coalesce("zone", F.lit("")) != "") & ~archived(F.coalesce("zone", F.lit(""))) & (F.coalesce(F.size("links"), F.lit(0)) > 0)
    return F.coalesce(F.col("polarity") == "negative", F.lit(False)) | F.coalesce(F.col("type").isin(*PROTECTED_TYPES), F.lit(False)) | filed


def archive_cap(notes: DataFrame) -> DataFrame:
    """One row (active, archive_cap): min(max(2, ceil(0.2 active)), active - 1), 0 if none."""
    active = F.count(F.when(~archived(F.coalesce("zone", F.lit(""))), 1))
    cap = F.least(F.greatest(F.lit(ARCHIVE_MIN), F.ceil(ARCHIVE_FRACTION * F.col("active"))), F.greatest(F.lit(0), F.col("active") - 1)).cast("long")
    return notes.agg(active.alias("active")).withColumn("archive_cap", F.when(F.col("active") > 0, cap).otherwise(F.lit(0).cast("long")))


def validate(ops: DataFrame, notes: DataFrame, strength: DataFrame) -> DataFrame:
    """``ops`` with (zone canonical, reason): null reason means accepted.

    ``ops``: (seq, op, slug, zone, a, b, stale, by); ``notes``: (key, zone, type,
    polarity, links); ``strength``: (key, eff). Archives beyond the cap are
    dropped from the strongest down.
    """
    known = notes.select("key", F.coalesce("zone", F.lit("")).alias("kz"), protected().alias("kp"))
    out = ops
    for c in ("slug", "a", "b", "stale", "by"):
        out = out.join(known.select(F.col("key").alias(f"_{c}"), F.col("kz").alias(f"_{c}z"), F.col("kp").alias(f"_{c}p")), F.col(c) == F.col(f"_{c}"), "left")
    canonical = normal_zone(F.col("zone"))
    op, gone = F.col("op"), lambda *cs: F.exists(F.array(*[F.col(f"_{c}").isNull() for c in cs]), lambda x: x)
    reason = (
        F.when(~F.coalesce(op.isin("rezone", "link", "supersede", "archive"), F.lit(False)), "unknown op")
        .when(op.isin("rezone", "archive") & gone("slug"), "unknown slug")
        .when((op == "link") & gone("a", "b"), "unknown slug")
        .when((op == "supersede") & gone("stale", "by"), "unknown slug")
        .when((op == "rezone") & (F.replace(F.lower(F.btrim("zone")), F.lit(" "), F.lit("")) == "_archive"), "rezone_to_archive_rejected")
        .when((op == "rezone") & canonical.isNull(), "invalid zone name")
        .when((op == "rezone") & (canonical == ""), "rezone needs a real zone")
        .when((op == "link") & (F.col("a") == F.col("b")), "self-link")
        .when((op == "supersede") & (F.col("stale") == F.col("by")), "self-supersede")
        .when((op == "archive") & archived(F.col("_slugz")), "already archived")
        .when((op == "archive") & F.col("_slugp"), "protected note")
    )
    judged = out.withColumn("reason", reason).withColumn("zone", F.when(op == "rezone", canonical).otherwise(F.col("zone"))).select(*ops.columns, "reason")
    ranked = judged.join(strength.select(F.col("key").alias("slug"), "eff"), "slug", "left")
    pool = (F.col("op") == "archive") & F.col("reason").isNull()
    # A plan is at most some hundred operations; this window orders its archives.
    place = F.row_number().over(Window.partitionBy(pool).orderBy(F.coalesce("eff", F.lit(1.0)), "seq"))
    capped = ranked.withColumn("place", place).crossJoin(F.broadcast(archive_cap(notes)))
    final = F.when(pool & (F.col("place") > F.col("archive_cap")), F.concat(F.lit("archive_capped (>"), F.col("archive_cap"), F.lit(")"))).otherwise(F.col("reason"))
    return capped.select(*ops.columns, final.alias("reason"))


def dense_links(moves: DataFrame, notes: DataFrame, existing: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """(zone, a, b): links of moved notes to zone-mates, ten a mover, 500 a plan.

    ``moves``: (key, zone) accepted; ``notes``: (key, zone, type, polarity);
    ``existing``: (a, b) sorted pairs; ``superseded``: (key) of notes on either
    side of an accepted supersede, which get no links. Movers link to each other first, in key
    order; a pair counts for the mover that comes first.
    """
    open_ = notes.where(~archived(F.coalesce("zone", F.lit(""))) & (F.coalesce("polarity", F.lit("")) != "negative") & ~F.coalesce(F.col("type").isin(*PROTECTED_TYPES), F.lit(False)))
    if superseded is not None:
        open_ = open_.join(superseded, "key", "left_anti")
    moved = open_.select("key", F.col("zone").alias("was")).join(moves.select("key", F.col("zone").alias("to")), "key").where("was <> to")
    final = open_.join(moved, "key", "left").select("key", F.coalesce("to", "zone").alias("zone"), F.col("to").isNotNull().alias("mover"))
    mover, mate = final.where("mover").alias("m"), final.alias("o")
    # Only the first DENSE_PER_MOVER * 3 mates by (mover first, key) can be reached.
    order = Window.partitionBy("zone").orderBy(F.col("mover").desc(), "key")
    near = final.withColumn("place", F.row_number().over(order)).where(F.col("place") <= DENSE_PER_PLAN + DENSE_PER_MOVER).alias("o")
    pairs = mover.join(near, (F.col("m.zone") == F.col("o.zone")) & (F.col("m.key") != F.col("o.key"))).select(
        F.col("m.zone").alias("zone"), F.col("m.key").alias("m"), F.least("m.key", "o.key").alias("a"), F.greatest("m.key", "o.key").alias("b"), F.col("o.place").alias("place")
    )
    fresh = pairs.join(existing.select("a", "b"), ["a", "b"], "left_anti").dropDuplicates(["m", "a", "b"])
    first = fresh.withColumn("n", F.row_number().over(Window.partitionBy("a", "b").orderBy("m"))).where("n = 1").drop("n")
    per = first.withColumn("n", F.row_number().over(Window.partitionBy("m").orderBy("place"))).where(F.col("n") <= DENSE_PER_MOVER)
    return per.orderBy("zone", "m", "n").limit(DENSE_PER_PLAN).select("zone", "a", "b")


def capacity_report(notes: DataFrame, max_protected: int = 1000, max_bytes: int = 100 << 20) -> DataFrame:
    """One row of counts, bytes and over-budget flags of the active notes."""
    active = notes.where(~archived(F.coalesce("zone", F.lit(""))))
    out = active.agg(F.count("*").alias("notes"), F.count(F.when(protected(), 1)).alias("protected"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
    return out.select("*", (F.col("protected") > max_protected).alias("over_protected"), (F.col("bytes") > max_bytes).alias("over_bytes"))


def retire(notes: DataFrame, max_protected: int, max_bytes: int, limit: int) -> DataFrame:
    """(key, size, place): oldest, least used protected notes, as many as the budget needs.

    ``notes``: (key, size, last_access, access_count, mtime, zone, type, polarity, links).
    The window is over the first ``limit`` rows only.
    """
    report = capacity_report(notes, max_protected, max_bytes)
    pool = notes.where(~archived(F.coalesce("zone", F.lit(""))) & protected())
    order = [F.col("last_access").asc_nulls_first(), F.col("access_count"), F.col("mtime"), F.col("key")]
    first = pool.orderBy(*order).limit(limit)
    w = Window.orderBy(*order)
    rows = first.withColumn("place", F.row_number().over(w)).withColumn("freed", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    over = (F.col("protected") - (F.col("place") - 1) > max_protected) | (F.col("bytes") - F.coalesce("freed", F.lit(0)) > max_bytes)
    return rows.crossJoin(F.broadcast(report.select("protected", "bytes"))).where(over).select("key", "size", "place")


def digest(notes: DataFrame, priority: DataFrame, limit: int = 10, identity_cap: int = 5) -> DataFrame:
    """(place, zone, key): identity first, zones by priority, the inbox last.

    ``notes``: (key, zone, eff, updated), visible ones.
    """
    kind = F.when(F.col("zone") == "identity", 0).when(F.col("zone") == "", 2).otherwise(1)
    ranked = notes.join(priority, "zone", "left").select("key", "zone", kind.alias("kind"), F.coalesce("priority", F.lit(0.0)).alias("p"), "eff", "updated")
    order = [F.col("kind"), F.col("p").desc(), F.col("zone"), F.col("eff").desc(), F.col("updated").desc(), F.col("key")]
    within = Window.partitionBy("zone").orderBy(F.col("eff").desc(), F.col("updated").desc(), F.col("key"))
    capped = ranked.where("kind = 0").orderBy(*order).limit(identity_cap).unionByName(ranked.where("kind <> 0").orderBy(*order).limit(limit))
    del within
    best = capped.orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "zone", "key")
