"""Streams: the access fold as keyed state, handoff captures, file changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dynamics as D

STATE = "strength double, stability double, access_count long, last_us long"
OUTPUT = "strength double, stability double, access_count long, last_access timestamp"


def fold_stream(log: DataFrame) -> DataFrame:
    """Update-mode stream (key, strength, stability, access_count, last_access) of (key, ts).

    Accesses are folded in time order within a batch. An access older than the
    state's last one counts, but is neither spaced nor moves the last access, so
    late rows never decrease anything.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        strength, stability, count, last = state.get if state.exists else (1.0, D.STABILITY_INIT, 0, None)
        times = sorted(t.value // 1000 for f in frames for t in f["ts"])
        for us in times:
            if last is None or us - last >= D.SPACING_SECONDS * 1_000_000:
                stability = min(D.STABILITY_CAP, stability * D.STABILITY_GROWTH)
            strength = min(D.STRENGTH_CAP, strength + D.STRENGTH_STEP)
            count += 1
            last = us if last is None else max(last, us)
        state.update((strength, stability, count, last))
        yield pd.DataFrame({"key": [key[0]], "strength": [strength], "stability": [stability], "access_count": [count], "last_access": [pd.Timestamp(last, unit="us")]})

    out = f"key {log.schema['key'].dataType.simpleString()}, {OUTPUT}"  # keys keep their type
    return log.select("key", "ts").groupBy("key").applyInPandasWithState(fold, out, STATE, "update", "NoTimeout")


def zone_stream(log: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Append-mode stream (zone, day, hits) of (zone, ts): what the moving average sums."""
    days = log.withWatermark("ts", watermark).groupBy("zone", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("hits"))
    return days.select("zone", F.to_date("w.start").alias("day"), "hits")


def ema_of(days: DataFrame, today) -> DataFrame:
    """(zone, ema) from the streamed (zone, day, hits)."""
    gap = F.greatest(F.lit(0), F.datediff(today, F.col("day")))
    return days.groupBy("zone").agg(F.round(F.sum(F.col("hits") * F.pow(F.lit(D.ZONE_DECAY), gap)), 6).alias("ema"))


def capture_stream(records: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """First capture of each (scope, capture_id) of a stream with a ``recorded_at`` time."""
    return records.withWatermark("recorded_at", watermark).dropDuplicatesWithinWatermark(["scope", "capture_id"])


def stamp_stream(records: DataFrame) -> DataFrame:
    """Stream (scope, capture_id, stamp) with strictly increasing stamps a scope.

    ``records``: (scope, capture_id, stamp) in microseconds; a late or equal stamp
    becomes the previous one plus 1. A batch's rows of a scope go in order of their
    stamps, whatever frames they come in.
    """

    def bump(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["stamp", "capture_id"])
        out = []
        for s in rows["stamp"]:
            last = int(s) if last is None else max(int(s), last + 1)
            out.append(last)
        yield pd.DataFrame({"scope": rows["scope"], "capture_id": rows["capture_id"], "stamp": out})
        if last is not None:
            state.update((last,))

    return records.groupBy("scope").applyInPandasWithState(bump, "scope string, capture_id string, stamp long", "last long", "append", "NoTimeout")


def session_checkpoints(messages: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Append-mode sessions (conv_id, start, end, messages, last_text) of (conv_id, ts, text)."""
    out = messages.withWatermark("ts", watermark).groupBy("conv_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("messages"), F.max_by("text", "ts").alias("last_text"))
    return out.select("conv_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "messages", "last_text")
