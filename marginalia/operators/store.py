"""The stored index: postings, frequencies, lengths and statistics as tables, refreshed by what changed.

A document's postings are one row (its terms and their counts), made and read where the
document lies. A refresh writes what changed and no more: the new rows, the ids that they
replace, the moves of the frequencies. Readers merge them with what was there. After
``MOST_DELTAS`` refreshes the merged tables are written and reading starts from these.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import settle
from . import index

FORMAT_VERSION = 3
TABLES = ("rows", "dfs", "stats")
#: Terms whose weights go to every task when norms are made; the others are exchanged.
FREQUENT = 200_000
#: Refreshes that readers merge before the tables are written anew.
MOST_DELTAS = 8


@dataclass
class Index:
    """``rows`` (doc_id, doclen, terms, tfs) of every document, ``dfs`` (term, df), ``stats`` (n_docs, total_len, avgdl)."""

    rows: DataFrame
    dfs: DataFrame
    stats: DataFrame
    deltas: int = 0
    _norms: list = field(default_factory=list)

    @property
    def post(self) -> DataFrame:
        """(doc_id, term, tf)."""
        return index.exploded(self.rows)

    @property
    def lengths(self) -> DataFrame:
        """(doc_id, doclen), 0 without a token."""
        return self.rows.select("doc_id", "doclen")

    @property
    def norms(self) -> DataFrame:
        """(doc_id, norm) of the TF-IDF vectors, made at the first use.

        The most frequent terms' weights are broadcast, so most postings add up where
        they lie; only those of other terms are exchanged.
        """
        if not self._norms:
            idf = self.dfs.crossJoin(F.broadcast(self.stats)).select("term", "df", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
            frequent = settle(idf.orderBy(F.col("df").desc(), "term").limit(FREQUENT).select("term", "idf"), "frequent-terms")
            w = (1 + F.log("tf")) * F.col("idf")
            near = self.post.join(F.broadcast(frequent), "term").groupBy("doc_id").agg(F.sum(w * w).alias("square"))
            far = self.post.join(F.broadcast(frequent), "term", "left_anti").join(idf.join(F.broadcast(frequent), "term", "left_anti"), "term")
            both = near.unionByName(far.groupBy("doc_id").agg(F.sum(w * w).alias("square")))
            self._norms.append(settle(both.groupBy("doc_id").agg(F.sqrt(F.sum("square")).alias("norm")), "norms"))
        return self._norms[0]


def _stats(lengths: DataFrame) -> DataFrame:
    total = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doclen"), F.lit(0)).alias("total_len"))
    return total.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_len") / F.col("n_docs")).otherwise(0.0))


def _checked(docs: DataFrame) -> None:
    """Ids must be there, and once: a repeated id would count its postings twice."""
    n, ids, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if not n == ids == distinct:
        raise ValueError(f"of {n} rows {n - ids} have no doc_id and {ids - distinct} repeat one")


def build(docs: DataFrame, exact: bool = True) -> Index:
    """The index of ``docs`` (doc_id, text), each table written once; a null or repeated doc_id is an error."""
    _checked(docs)
    rows = settle(index.term_rows(docs, exact), "term-rows")
    return Index(rows, settle(index.doc_frequencies(index.exploded(rows)), "frequencies"), settle(_stats(rows), "stats"))


def refresh(old: Index, changed: DataFrame, exact: bool = True) -> Index:
    """The index after ``changed`` (doc_id, text): new or edited documents, null text for deleted ones.

    Only these are tokenised, and only what they change is written; a null or repeated
    doc_id among them is an error.
    """
    changed = settle(changed.select("doc_id", "text"), "changed")
    _checked(changed)
    live, ids = changed.where("text is not null"), changed.select("doc_id")
    new = settle(index.term_rows(live, exact), "new-rows")
    gone = index.exploded(old.rows.join(ids, "doc_id", "left_semi"))
    moved = index.exploded(new).select("term", F.lit(1).cast("long").alias("df")).unionByName(gone.select("term", F.lit(-1).cast("long").alias("df")))
    moved = settle(moved.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), "moved-frequencies")
    rows = old.rows.join(ids, "doc_id", "left_anti").unionByName(new)
    dfs = old.dfs.unionByName(moved).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    out = Index(rows, dfs, settle(_stats(rows), "stats"), old.deltas + 1)
    return compact(out) if out.deltas >= MOST_DELTAS else out


def compact(idx: Index) -> Index:
    """The same index with its merged tables written."""
    return Index(settle(idx.rows, "term-rows"), settle(idx.dfs, "frequencies"), idx.stats)


def changes(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(doc_id, text) to give to :func:`refresh`: ``docs`` against ``seen`` (doc_id, digest of the text)."""
    now = docs.select("doc_id", "text", F.sha2("text", 256).alias("now"))
    both = now.join(seen, "doc_id", "full_outer")
    return both.where(~F.col("now").eqNullSafe(F.col("digest"))).select("doc_id", "text")


def save(idx: Index, path: str) -> None:
    """The index as tables under ``path``; an existing one is an error."""
    for name in TABLES:
        getattr(idx, name).withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("errorifexists").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, version: int = FORMAT_VERSION) -> Index | None:
    """The stored index, or None where its format is another one (build anew then)."""
    first = spark.read.parquet(f"{path}/stats").first()
    if first is None or first["format_version"] != version:
        return None
    return Index(**{name: spark.read.parquet(f"{path}/{name}").drop("format_version") for name in TABLES})


def corpus_report(idx: Index, notes: DataFrame, stale: DataFrame) -> DataFrame:
    """One row (notes, zones, terms, stale); ``notes``: (key, zone), ``stale``: (key)."""
    zones = notes.agg(F.count("*").alias("notes"), F.count_distinct("zone").alias("zones"))
    return zones.crossJoin(idx.dfs.agg(F.count("*").alias("terms"))).crossJoin(stale.agg(F.count("*").alias("stale")))
