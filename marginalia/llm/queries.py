"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, decontamination, fill_middle, fingerprints, line_dedup, packing, quote_links, secret_scan, simhash, token_alignment, toxicity, url_trust, warc

TOKENIZER = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens from all documents."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage found in a document, with its place and edits."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's line counts and the digest of its kept text."""
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's 64-bit fingerprint and component."""
    out = simhash.classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page; block sizes and digests."""
    out = warc.build_derivatives(table(spark, sf_dir, "pages"))
    headers = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers"))))
    columns = ["page_id", "type", "record_id", "refers_to", "target_uri", "source_payload_digest", "block_digest"]
    return out.select(*columns, headers.alias("headers"), F.octet_length("block").cast("long").alias("block_length"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each text and its edited form, with their likeness."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated views, the combined score and the decision for each document."""
    docs = table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.fit(docs, table(spark, sf_dir, "labels")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its score; the candidate itself only as a digest."""
    words = secret_scan.dictionary(public_tokenizers.path(TOKENIZER))
    out = secret_scan.scan(table(spark, sf_dir, "documents"), words=words)
    shown = F.sha2("candidate", 256).alias("candidate_sha256")
    return out.select("doc_id", "finding", F.char_length("candidate").alias("length"), shown, "score", "secret")


def op9_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict, with its host's trust and distrust."""
    out = url_trust.judge(table(spark, sf_dir, "pages"))
    return out.withColumns({"trust": F.round("trust", 9), "distrust": F.round("distrust", 9)})


def op10_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message without its quotes, with the message it answers, thread and depth."""
    return quote_links.format_chat(table(spark, sf_dir, "conversations"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's form, cuts and the digests of its output and of the text rebuilt from it."""
    out = fill_middle.transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digests)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, groups and links of two tokenizers, its links' corpus counts, and the digest of its groups."""
    out = token_alignment.align(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity and whether its label was held out."""
    return toxicity.score_fitted(toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality_cotraining": op7_quality_cotraining,
    "op8_secret_scan": op8_secret_scan,
    "op9_url_trust": op9_url_trust,
    "op10_quote_links": op10_quote_links,
    "op11_fill_middle": op11_fill_middle,
    "op12_token_alignment": op12_token_alignment,
    "op13_toxicity": op13_toxicity,
}
#: Operators that SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {"op3_line_dedup": line_dedup.OP3_SQL, "op11_fill_middle": fill_middle.OP11_SQL}
