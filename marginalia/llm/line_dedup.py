"""Line dedup with DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits; only hashes travel. A
key in at least ``min_docs`` documents stays in the largest doc_id that holds
it. Dropped positions return to their document, whose other lines are joined
again in order.

Defined cases: null text is one empty line; repeated rows of one doc_id count
as one document; a row without doc_id can't be referred to, so it is not
counted and passes unchanged; an empty table gives an empty table; columns of
the input never clash as only the id and the text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, settle

MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line):
    """The line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def dropped_positions(texts: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, text_hash, gone): sorted line positions to drop; ``texts``: (id, text)."""
    lines = (
        texts.where(F.col("id").isNotNull())
        .select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    lines = settle(lines, "lines")  # texts are split and hashed once
    # The first grouping makes (line, document) pairs, so one hot line is
    # spread over its documents; the second adds up partial counts.
    repeated = (
        lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    )
    # Read from a table, both sides of the join arrive by plain exchanges, so
    # adaptive execution can split a hot line's rows.
    repeated = settle(repeated, "repeated-lines")
    return (
        lines.join(repeated, ["h1", "h2"])
        .where("id <> keeper")
        .groupBy("id", "text_hash")
        .agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    )


def without_positions(lines, gone):
    """``lines`` without the sorted positions ``gone``, in one linear pass."""
    n = F.size(gone)

    def run(i):
        start = F.when(i == 0, 0).otherwise(F.get(gone, i - 1) + 1)
        end = F.when(i == n, F.size(lines)).otherwise(F.get(gone, i))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), n), run))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_dropped, kept): each document with its kept text."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drops = dropped_positions(texts, min_chars, min_docs)
    joined = texts.withColumn("text_hash", F.xxhash64("text")).join(drops, ["id", "text_hash"], "left")
    lines = F.split("text", "\n", -1)
    return joined.select(
        F.col("id").alias(id_col),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(without_positions(lines, F.col("gone")), "\n")).alias("kept"),
    )


def dedup_documents(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the same columns and rows, its texts without dropped lines.

    Only texts that lose a line change; ``n_chars``, where present, follows.
    """
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    drops = dropped_positions(row.select("id", "text"), min_chars, min_docs)
    joined = row.withColumn("text_hash", F.xxhash64("text")).join(drops, ["id", "text_hash"], "left")
    lines = F.split("text", "\n", -1)
    kept = joined.select("row", F.when(F.col("gone").isNotNull(), F.array_join(without_positions(lines, F.col("gone")), "\n")).alias("kept"))
    size = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept")) if "n_chars" in docs.columns else None
    changed = {"text": F.coalesce("kept", "row.text"), "n_chars": size}
    return kept.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce("text", ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce("text", ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, hot.keeper IS NOT NULL AND hot.keeper <> doc_id AS gone
  FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
