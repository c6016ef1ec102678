"""Trigger routing: tasks to documents, views of the route table, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that name an action rather than a subject.
GENERIC_WORDS = (
    "check checking work working do doing write writing open opening update updating answer answering report reporting launch launching resume "
    "resuming choose choosing pick picking use using handle handling post posting send sending format formatting decide deciding monitor monitoring "
    "touch touching deal dealing automate automating"
)
#: Task words that stand for each other.
EQUIVALENTS = (("web", "browser", "website", "site", "webpage"), ("login", "log in", "sign in", "authentication"), ("repository", "repo", "codebase"), ("rollback", "backout", "back out", "revert"))


def _generic(spark) -> DataFrame:
    return spark.range(1).select(F.explode(T.task_terms(F.lit(GENERIC_WORDS))).alias("term"))


def _task_terms(tasks: DataFrame) -> DataFrame:
    """(task_id, term) with the equivalents of what a task names."""
    folded = T.squeeze(T.lower_fold(F.col("task")))
    extra = [F.when(folded.rlike(r"(?U)(?<!\w)(" + "|".join(group) + r")(?!\w)"), F.lit(" ".join(group))) for group in EQUIVALENTS]
    return tasks.select("task_id", F.explode(F.array_distinct(F.concat(T.task_terms(F.col("task")), T.task_terms(F.concat_ws(" ", *extra))))).alias("term")).distinct()


def match(routes: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, seq, trigger, document): equal text, or a shared subject term.

    ``routes``: (seq, trigger, document); ``tasks``: (task_id, task). A generic
    action that several triggers name is no subject, unless a trigger has no other.
    """
    triggers = routes.select("trigger").distinct()
    terms = triggers.select("trigger", F.explode(T.task_terms(F.col("trigger"))).alias("term")).distinct()
    repeated = terms.join(F.broadcast(_generic(routes.sparkSession)), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")).where("n > 1").select("term", F.lit(True).alias("weak"))
    marked = terms.join(repeated, "term", "left")
    strong = marked.groupBy("trigger").agg(F.max(F.col("weak").isNull()).alias("has"))
    subjects = marked.join(strong, "trigger").where("weak is null or not has").select("trigger", "term")
    by_term = subjects.join(_task_terms(tasks), "term").select("task_id", "trigger")
    same = triggers.withColumn("n", T.normalized(F.col("trigger"))).join(tasks.withColumn("n", T.normalized(F.col("task"))), "n").select("task_id", "trigger")
    return routes.join(by_term.unionByName(same).distinct(), "trigger").select("task_id", "seq", "trigger", "document")


def register(routes: DataFrame, new: DataFrame) -> DataFrame:
    """Routes with the new ones appended; a known (trigger, document) keeps its place."""
    last = routes.agg(F.max("seq")).first()[0]
    added = new.withColumn("seq", F.col("seq") + (0 if last is None else last + 1))
    return routes.unionByName(added.select(*routes.columns)).groupBy("trigger", "document").agg(F.min("seq").alias("seq")).select(*routes.columns)


def topic(document):
    """dir:<parent> of a document, or file:<document> without one."""
    parent = F.regexp_extract(document, "^(.*)/[^/]*$", 1)
    return F.when(parent == "", F.concat(F.lit("file:"), document)).otherwise(F.concat(F.lit("dir:"), parent))


def topics(routes: DataFrame) -> DataFrame:
    """(topic, routes, documents, digest): the digest doesn't depend on route order."""
    pair = F.to_json(F.struct("trigger", "document"))
    per = routes.select(topic(F.col("document")).alias("topic"), "document", pair.alias("pair"))
    return per.groupBy("topic").agg(F.count("*").alias("routes"), F.count_distinct("document").alias("documents"), F.sha2(F.array_join(F.array_sort(F.collect_list("pair")), "\n"), 256).alias("digest"))


def leaf_lines(routes: DataFrame) -> DataFrame:
    """(document, lines): one alias row a document where it is shorter than its routes."""
    w = F.array_sort(F.collect_list(F.struct("seq", "trigger")))
    per = routes.groupBy("document").agg(w.alias("t"))
    rows = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["trigger"], F.lit(" -> "), F.col("document"))), "\n")
    alias = F.concat(F.lit("- "), F.to_json(F.struct("document", F.transform("t", lambda x: x["trigger"]).alias("triggers"))))
    short = (F.size("t") > 1) & (F.octet_length(alias) < F.octet_length(rows))
    return per.select("document", F.when(short, alias).otherwise(rows).alias("lines"))


def view(routes: DataFrame) -> DataFrame:
    """One row (mode, flat_tokens, grouped_tokens): the smaller complete view."""
    flat = leaf_lines(routes).agg(F.sum(F.octet_length("lines") + 1).alias("b"))
    group = topics(routes)
    grouped = group.agg(F.sum(F.octet_length(F.to_json(F.struct(*group.columns))) + 3).alias("g"), F.max("documents").alias("d"))
    tokens = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / 4).cast("long")
    both = flat.crossJoin(grouped)
    return both.select(F.when((F.col("d") > 1) & (tokens("g") < tokens("b")), "grouped").otherwise("flat").alias("mode"), tokens("b").alias("flat_tokens"), tokens("g").alias("grouped_tokens"))


def integrity(routes: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, problem): orphan documents and dangling routes."""
    linked, known = routes.select("document").distinct(), documents.select("document").distinct()
    orphan = known.join(linked, "document", "left_anti").withColumn("problem", F.lit("orphan"))
    return orphan.unionByName(linked.join(known, "document", "left_anti").withColumn("problem", F.lit("dangling")))


def open_documents(ranked: DataFrame, limit: int) -> DataFrame:
    """(query_id, document, rank) of ranked routes (query_id, rank, document): first ranks, distinct."""
    best = ranked.groupBy("query_id", "document").agg(F.min("rank").alias("best"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best", "document"))).where(F.col("rank") <= limit).drop("best")
