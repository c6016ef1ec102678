"""Usage dynamics in closed form over an access log, and decay at query time.

For accesses in time order the fold has a closed form: strength grows by 0.25
to 5, stability by 1.5 times to 365 for accesses at least an hour after the
previous one, a zone's moving average decays by 0.9 a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import archived, expired

# Fixed values of the dynamics.
STRENGTH_STEP, STRENGTH_CAP = 0.25, 5.0
STABILITY_INIT, STABILITY_GROWTH, STABILITY_CAP = 7.0, 1.5, 365.0
SPACING_SECONDS, EFF_FLOOR, ZONE_DECAY = 3600, 0.05, 0.9
STALE_EFF, STALE_DAYS, IDENTITY = 0.1, 90, "identity"


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def fold_accesses(log: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """(key, strength, stability, access_count, last_access) from (key, ts).

    ``created``: (key, created), what the first access is compared with; without
    it the first access counts as spaced.
    """
    w = Window.partitionBy("key").orderBy("ts")
    rows = log.select("key", "ts")
    if created is not None:
        rows = rows.join(created.select("key", "created"), "key", "left")
    else:
        rows = rows.withColumn("created", F.lit(None).cast("timestamp"))
    before = F.coalesce(F.lag("ts").over(w), F.col("created"))
    spaced = F.coalesce((seconds(F.col("ts")) - seconds(before) >= SPACING_SECONDS).cast("int"), F.lit(1))
    counts = rows.withColumn("spaced", spaced).groupBy("key").agg(F.count("*").alias("access_count"), F.sum("spaced").alias("k"), F.max("ts").alias("last_access"))
    return counts.select(
        "key",
        F.least(F.lit(STRENGTH_CAP), 1 + STRENGTH_STEP * F.col("access_count")).alias("strength"),
        F.round(F.least(F.lit(STABILITY_CAP), STABILITY_INIT * F.pow(F.lit(STABILITY_GROWTH), F.least(F.col("k"), F.lit(40)))), 6).alias("stability"),
        "access_count",
        "last_access",
    )


def effective(strength: Column, stability: Column, last_access: Column, now: Column) -> Column:
    """max(0.05, strength * exp(-days / stability)); no timestamp, no decay."""
    days = F.greatest(F.lit(0.0), (seconds(now) - seconds(last_access)) / 86400)
    decayed = F.greatest(F.lit(EFF_FLOOR), strength * F.exp(-days / F.greatest(F.lit(1e-6), stability)))
    return F.round(F.when(last_access.isNull(), F.greatest(F.lit(EFF_FLOOR), F.least(strength, F.lit(STRENGTH_CAP)))).otherwise(decayed), 6)


def zone_ema(log: DataFrame, today: Column) -> DataFrame:
    """(zone, ema) at ``today`` from (zone, ts): the sum of 0.9 ** days."""
    days = F.greatest(F.lit(0), F.datediff(today, F.to_date("ts")))
    return log.groupBy("zone").agg(F.round(F.sum(F.pow(F.lit(ZONE_DECAY), days)), 6).alias("ema"))


def zone_priority(ema: DataFrame) -> DataFrame:
    """(zone, priority): the average over the greatest one, 0 where that is 0."""
    top = ema.agg(F.max("ema").alias("top"))
    return ema.crossJoin(F.broadcast(top)).select("zone", F.round(F.when(F.col("top") > 0, F.col("ema") / F.col("top")).otherwise(0.0), 6).alias("priority"))


def stale(notes: DataFrame, now: Column) -> DataFrame:
    """Notes below 0.1 and idle over 90 days; identity, archived, expired and undated ones never."""
    eff = effective(F.col("strength"), F.col("stability"), F.col("last_access"), now)
    idle = (seconds(now) - seconds(F.col("last_access"))) / 86400
    live = (F.col("zone") != IDENTITY) & ~archived(F.col("zone")) & ~expired(F.col("expires_at"), F.to_date(now))
    return notes.where(live & F.col("last_access").isNotNull()).withColumn("eff", eff).where((F.col("eff") < STALE_EFF) & (idle > STALE_DAYS))
