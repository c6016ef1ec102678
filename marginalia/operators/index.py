"""Inverted index as tables: postings, lengths, statistics and their upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores where it comes in fewer partitions than half of them.

    A large table has more partitions than cores and is left alone.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 2 * docs.rdd.getNumPartitions() <= cores else docs


#: Texts of one piece of a batch.
TEXTS_AT_ONCE = 512


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(start, TEXTS_AT_ONCE)
            terms, tfs, ends, lengths = [], [], [0], []
            for text in part.column(1).to_pylist():
                own, length = T.token_counts(text)
                terms += own
                tfs += own.values()
                ends.append(len(terms))
                lengths.append(length)
            at = pa.array(ends, pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(terms, pa.string())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "doclen", "terms", "tfs"])


def term_rows(docs: DataFrame, exact: bool = True) -> DataFrame:
    """(doc_id, doclen, terms, tfs): a row a row of ``docs`` (doc_id, text), its distinct tokens and their counts.

    A text is counted where it lies, so nothing is exchanged.
    """
    rows = spread(docs.select("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if exact:
        return rows.mapInArrow(_counted, f"doc_id {kind}, doclen long, terms array<string>, tfs array<long>")
    listed = rows.select("doc_id", T.tokens(F.col("text"), False).alias("all")).withColumn("terms", F.array_distinct("all"))
    counts = F.transform("terms", lambda t: F.size(F.filter("all", lambda x: x == t)).cast("long"))
    return listed.select("doc_id", F.size(F.filter("all", T.counts_in_length)).cast("long").alias("doclen"), "terms", counts.alias("tfs"))


def exploded(rows: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of :func:`term_rows`."""
    return rows.select("doc_id", F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("x")).select("doc_id", "x.term", "x.tf")


def unique_ids(docs: DataFrame) -> bool:
    """Whether no row of ``docs`` has another's doc_id or none."""
    n, distinct = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    return n == distinct


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = True, unique: bool = False) -> DataFrame:
    """(doc_id, term, tf). Terms are counted within the row first; with ``unique`` ids that is all, else rows of an id are added up."""
    post = exploded(term_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), exact))
    return post if unique else post.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))


def doc_lengths(post: DataFrame) -> DataFrame:
    """(doc_id, doclen): tokens less single Han and kana characters."""
    return post.groupBy("doc_id").agg(F.sum(F.when(T.counts_in_length(F.col("term")), F.col("tf")).otherwise(0)).cast("long").alias("doclen"))


def doc_frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row (n_docs, total_len, avgdl) over all documents, empty ones too."""
    return docs.agg(F.count("*").alias("n_docs")).crossJoin(lengths.agg(F.coalesce(F.sum("doclen"), F.lit(0)).alias("total_len"))).withColumn(
        "avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0)
    )


def newest_per_key(files: DataFrame, key: str = "stem") -> DataFrame:
    """Each key's newest file; the smallest path among equals. Others get path keys."""
    w = Window.partitionBy(key).orderBy(F.col("mtime").desc(), F.col("rel"))
    ranked = files.withColumn("place", F.row_number().over(w))
    return ranked.withColumn("key", F.when(F.col("place") == 1, F.col(key)).otherwise(T.path_key(F.col("rel")))).drop("place")


def refresh_plan(scan: DataFrame, index: DataFrame) -> DataFrame:
    """(key, action): insert, update, delete or keep, by (rel, mtime, size)."""
    a, b = scan.alias("a"), index.alias("b")
    same = F.col("a.rel").eqNullSafe(F.col("b.rel")) & F.col("a.mtime").eqNullSafe(F.col("b.mtime")) & F.col("a.size").eqNullSafe(F.col("b.size"))
    action = F.when(F.col("b.key").isNull(), "insert").when(F.col("a.key").isNull(), "delete").when(same, "keep").otherwise("update")
    return a.join(b, F.col("a.key") == F.col("b.key"), "full_outer").select(F.coalesce("a.key", "b.key").alias("key"), action.alias("action"))


def upsert_postings(post: DataFrame, changed: DataFrame, exact: bool = True, text_col: str = "text") -> DataFrame:
    """``post`` with the documents of ``changed`` indexed anew; null text deletes."""
    kept = post.join(changed.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(postings(changed.where(F.col(text_col).isNotNull()), exact=exact).select(*post.columns))


def listing(notes: DataFrame, offset: int = 0, limit: int = 50, newest: str = "updated", key: str = "key") -> DataFrame:
    """A page of ``notes``, newest first, then by key."""
    return notes.orderBy(F.col(newest).desc(), F.col(key).desc()).offset(offset).limit(limit)


def aliases(notes: DataFrame) -> DataFrame:
    """(alias, key): each slug's newest note."""
    return notes.groupBy(T.slug(F.col("title")).alias("alias")).agg(F.max_by("key", F.struct("mtime", "key")).alias("key"))


def resolve(names: DataFrame, notes: DataFrame) -> DataFrame:
    """(name, key): by key, then by slug equal to a key, then by alias."""
    keys = notes.select(F.col("key").alias("k1"))
    slugs = notes.select(F.col("key").alias("k2"))
    return (
        names.join(keys, F.col("name") == F.col("k1"), "left")
        .withColumn("s", T.slug(F.col("name")))
        .join(slugs, F.col("s") == F.col("k2"), "left")
        .join(aliases(notes).withColumnRenamed("key", "k3"), F.col("s") == F.col("alias"), "left")
        .select("name", F.coalesce("k1", "k2", "k3").alias("key"))
    )


def links(notes: DataFrame) -> DataFrame:
    """(src, target slug) of the wikilinks in whole texts, distinct."""
    return notes.select(F.col("key").alias("src"), F.explode(F.array_distinct(T.wikilinks(F.col("text")))).alias("t")).select("src", T.slug(F.col("t")).alias("dst")).distinct()


def archived(zone: Column) -> Column:
    return zone.rlike("(?i)(^|/)_archive(/|$)")


def hidden_or_cache(path: Column) -> Column:
    """A component that starts with a dot, or a cache folder's name."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") | F.lower(p).isin("node_modules", "__pycache__"))


def expired(expires_at: Column, today: Column) -> Column:
    """Strictly before today; what can't be read never expires."""
    return F.coalesce(F.try_to_date(expires_at) < today, F.lit(False))


def normal_zone(zone: Column, allow_archive: bool = False) -> Column:
    """The canonical zone, '' for the inbox, null where the name is refused."""
    z = F.btrim(zone)
    parts = F.split(z, "/")
    bad = F.exists(
        parts,
        lambda p: p.isin("", ".", "..") | p.rlike(r'[\x00-\x1f\x7f<>:"|?*\\]') | p.endswith(" ") | p.endswith(".") | p.startswith(".") | F.lower(p).isin("node_modules", "__pycache__"),
    )
    arch = F.exists(parts, lambda p: F.lower(p) == "_archive")
    low = F.lower(z)
    one = F.when(low.rlike("^[a-z0-9][a-z0-9-]{0,31}$"), low).otherwise(z)
    sole = (F.size(parts) == 1) & (low == "_archive")
    out = F.when(low.isin("", "inbox"), "").when(bad, None)
    if allow_archive:
        return out.when(sole, "_archive").otherwise(F.when(F.size(parts) == 1, one).otherwise(z))
    return out.when(arch, None).otherwise(F.when(F.size(parts) == 1, one).otherwise(z))


def recall_allowed(path: Column) -> Column:
    """Relative, no dot parts, not under system or _archive, no control characters."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    return (
        (F.size(parts) > 0)
        & ~path.startswith("/")
        & ~path.rlike(r"^[A-Za-z]:")
        & ~F.exists(parts, lambda p: p.startswith("."))
        & ~F.lower(F.get(parts, F.lit(0))).isin("system", "_archive")
        & ~path.rlike(r"[\x00-\x1f\\\x{fffe}\x{ffff}]")
    )
