"""Handoff records, transcripts, text lines: folds, islands, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Headings that open a section family of a transcript.
SECTIONS = {"decisions": "decisions", "open items": "open_items", "open questions": "open_questions", "next step": "next_step", "links": "links"}


def latest(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest record of each scope, by aggregation (no sort of a scope)."""
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*")


def older_than_newest(records: DataFrame, keys: list[str], order: list[str], keep: int) -> DataFrame:
    """What a retention fold of the newest ``keep`` would archive."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return records.withColumn("age", F.row_number().over(w)).where(F.col("age") > keep)


def fold_distinct(records: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Each scope's distinct values in order of first appearance."""
    first = records.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(position).alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value]).alias("values"))


def dedupe_captures(records: DataFrame) -> DataFrame:
    """(scope, capture_id, payload, conflict): first payload; conflict where others differ."""
    return records.groupBy("scope", "capture_id").agg(F.min_by("payload", F.struct("recorded_at", "payload")).alias("payload"), (F.count_distinct("payload") > 1).alias("conflict"))


def bump_stamps(records: DataFrame, keys: list[str], order: str, stamp: str) -> DataFrame:
    """Stamps in microseconds made strictly increasing: at least the previous + 1.

    With s' = s - row number, the running maximum plus the row number is the
    closed form of the sequential rule.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.row_number().over(w)
    rows = records.withColumn("_n", n).withColumn("_s", F.col(stamp) - F.col("_n"))
    return rows.withColumn("bumped", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n")).drop("_n", "_s")


def islands(rows: DataFrame, keys: list[str], order: str, breaks: str) -> DataFrame:
    """``rows`` with an island number that grows at each true ``breaks``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(F.col(breaks).cast("int")).over(w))


def line_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, start, length): byte span of each line, its end of line included."""
    rows = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "(?<=\n)", -1)).alias("line", "t")).where("t <> ''")
    size = F.octet_length("t").cast("long")
    w = Window.partitionBy(id_col).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(id_col, "line", F.coalesce(F.sum(size).over(w), F.lit(0)).alias("start"), size.alias("length"))


def last_by_role(messages: DataFrame) -> DataFrame:
    """(conv_id, role, turn, text) of the last message of each role."""
    best = messages.where("text is not null and trim(text) <> ''").groupBy("conv_id", "role").agg(F.max_by(F.struct("turn", "text"), F.struct("turn", "text")).alias("m"))
    return best.select("conv_id", "role", "m.turn", "m.text")


def transcript_sections(messages: DataFrame, names: dict[str, str] = SECTIONS) -> DataFrame:
    """(conv_id, family, items): lines under named headings, list marks off, fences out.

    A heading closes the section before it; a message starts without one.
    """
    rows = messages.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", F.posexplode(F.split("text", "\r?\n", -1)).alias("line", "raw"))
    w = Window.partitionBy("conv_id", "turn").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("raw").rlike("^ {0,3}(```|~~~)")
    rows = rows.withColumn("mark", mark).withColumn("marks", F.sum(mark.cast("int")).over(w)).where("not mark and marks % 2 = 0")
    stripped = F.btrim(F.col("raw"))
    heading = F.regexp_extract(stripped, r"^#{1,6}\s+(.+?)\s*#*\s*$", 1)
    is_heading = heading != ""
    lookup = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    named = F.when(is_heading, F.coalesce(lookup[F.lower(heading)], F.lit("")))
    opened = rows.where(stripped != "").withColumn("family", F.last(named, ignorenulls=True).over(w)).withColumn("head", is_heading)
    item = F.regexp_replace(stripped, r"^(?:[-*+]|\d+[.)])\s*(?=\S)", "")
    kept = opened.where("not head and family <> ''").select("conv_id", "family", F.struct("turn", "line", item.alias("item")).alias("x"))
    return kept.groupBy("conv_id", "family").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))


def canonical_hash(*columns):
    """SHA-256 of the columns as one JSON array, nulls kept."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), F.lit("null")) for c in columns])), 256)


def message_text(content):
    """Text of a message given as a JSON string or a JSON list of parts."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    plain = F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"]
    return F.when(F.btrim(content).startswith("["), joined).otherwise(plain)


def envelope(path, hint):
    """A recalled hint with its source, both escaped."""
    return F.concat(F.lit('<recalled-memory source="[['), T.xml_escape(path), F.lit(']]">\n'), T.xml_escape(hint), F.lit("\n</recalled-memory>"))
