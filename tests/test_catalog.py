"""Registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from marginalia.plans import catalog

SF = "/root/testdata/sf0.001"
QUICK = [
    "tokenize_terms", "doc_length", "corpus_stats", "slug_titles", "text_scalars", "redact_secrets", "iso_dates", "byte_offsets", "refresh_diff", "newest_per_stem", "bm25_topk",
    "shared_ranks", "access_strength", "effective_strength", "zone_priority", "label_filter_and", "list_paginated", "sign_dot_topk", "exact_duplicates", "token_classes", "band_neighbours",
    "orphans_dangling", "capacity_report", "retire_running_total", "keep_newest", "latest_per_scope", "fold_distinct", "monotonic_stamps", "last_role_text", "rank_metrics_grouping_sets",
    "latency_percentiles", "capture_dedupe", "gold_ranks", "related_notes", "tfidf_cosine_topk", "merge_mean_top5", "pairwise_preference", "prompt_digest", "plan_validate", "trigger_match",
    "transcript_sections", "document_sections", "block_coverage", "set_difference", "stale_notes",
]


def plain(value):
    if isinstance(value, float):
        return f"{value:.5f}"
    if isinstance(value, list):
        return [plain(v) for v in value]
    return str(value).removesuffix("+00:00")


@pytest.mark.parametrize("name", QUICK)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {Path(f).stem} as select * from '{f}'")
    want = con.sql(catalog.ORACLE[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
