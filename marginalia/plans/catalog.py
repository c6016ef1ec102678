"""Registered queries of the engine's own operators, with their SQL.

Each query runs over its whole tables. The oracle strings share a few common
table expressions, put together by :func:`sql`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import control, dynamics, evaluate, gate, index, labels, pairs, rank, recall, records, rerank, routing, scan, sections, store, vector
from .tables import settle, stamps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: "Now" and "today" are fixed: results never depend on the clock.
RANKS = ("rank", "position", "age", "place")
NOW, TODAY = "2024-07-01 00:00:00", "2024-07-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Common table expressions of the oracles.
CTE = {
    "toks": """toks AS (
  SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(replace("text", 'ß', 'ss'))), '[\\p{L}\\p{N}]+')) AS w FROM documents),
terms AS (
  SELECT doc_id, w AS term FROM toks
  UNION ALL SELECT doc_id, substr(w, 1, 5) || '~' FROM toks WHERE length(w) >= 6 AND regexp_full_match(w, '\\p{L}+')),
post AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL)""",
    "lens": "lens AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS doclen FROM post GROUP BY 1)",
    "stats": """stats AS (SELECT (SELECT count(*) FROM documents) AS n_docs, CAST(coalesce(sum(doclen), 0) AS BIGINT) AS total_len FROM lens),
st AS (SELECT n_docs, total_len, CASE WHEN n_docs > 0 THEN total_len / n_docs ELSE 0.0 END AS avgdl FROM stats)""",
    "asked": """qtoks AS (
  SELECT item_id AS query_id, unnest(regexp_extract_all(strip_accents(lower(replace("text", 'ß', 'ss'))), '[\\p{L}\\p{N}]+')) AS w FROM benchmark),
qall AS (SELECT query_id, w AS term FROM qtoks
  UNION ALL SELECT query_id, substr(w, 1, 5) || '~' FROM qtoks WHERE length(w) >= 6 AND regexp_full_match(w, '\\p{L}+')),
q AS (SELECT DISTINCT query_id, term FROM qall)""",
    "dfs": "dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1)",
    "bm25": """bm25 AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doclen / avgdl))), 6) AS score
  FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), st GROUP BY 1, 2)""",
    "log": "alog AS (SELECT user_id AS \"key\", event_type AS \"zone\", ts FROM events)",
}


def sql(select: str, *names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + select


def query(name: str, oracle: str | None = None):
    """Register the decorated function as ``name``."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)  # ranks are bigint, as in SQL
            return df.withColumns({c: F.col(c).cast("long") for c in RANKS if dict(df.dtypes).get(c) == "int"})

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# -- text and index ----------------------------------------------------------


def _post(s, d):
    docs = table(s, d, "documents")
    return index.postings(docs, unique=index.unique_ids(docs))


def _queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("tokenize_terms", sql("SELECT term, CAST(sum(tf) AS BIGINT) AS occurrences FROM post GROUP BY 1", "toks"))
def tokenize_terms(s, d):
    terms = table(s, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("occurrences"))


@query("postings_tf", sql("SELECT doc_id, term, tf FROM post", "toks"))
def postings_tf(s, d):
    return _post(s, d)


@query("doc_length", sql("SELECT * FROM lens", "toks", "lens"))
def doc_length(s, d):
    return index.doc_lengths(_post(s, d))


@query("doc_frequency", sql("SELECT * FROM dfs", "toks", "dfs"))
def doc_frequency(s, d):
    return index.doc_frequencies(_post(s, d))


@query("corpus_stats", sql("SELECT n_docs, total_len, round(avgdl, 6) AS avgdl FROM st", "toks", "lens", "stats"))
def corpus_stats(s, d):
    docs = table(s, d, "documents")
    return index.corpus_stats(docs, index.term_rows(docs)).withColumn("avgdl", F.round("avgdl", 6))


@query(
    "slug_titles",
    """SELECT doc_id, CASE WHEN s = '' THEN 'note' ELSE s END AS slug FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(split_part("text", chr(10), 1))), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)""",
)
def slug_titles(s, d):
    return table(s, d, "documents").select("doc_id", T.slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"))


@query("token_estimate", """SELECT doc_id, CAST(ceil(strlen("text") / 4.0) AS BIGINT) AS estimate FROM documents""")
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("estimate"))


@query("term_scripts", sql("SELECT CASE WHEN regexp_full_match(term, '\\p{Nd}+') THEN '' ELSE 'latin' END AS script, count(*) AS terms FROM dfs GROUP BY 1", "toks", "dfs"))
def term_scripts(s, d):
    return index.doc_frequencies(_post(s, d)).groupBy(T.script(F.col("term")).alias("script")).agg(F.count("*").alias("terms"))


@query(
    "text_scalars",
    """SELECT conv_id, turn, sum(0) OVER () + length("text") AS utf16_units, trim(regexp_replace("text", '\\s+', ' ', 'g')) AS squeezed,
  CASE WHEN strlen("text") >= 0 THEN substr("text", 1, 40) END AS clipped,
  replace(replace(replace(replace(replace("text", '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM conversations""",
)
def text_scalars(s, d):
    text = F.col("text")
    units = T.utf16_length(text).cast("decimal(38,0)")
    return table(s, d, "conversations").select("conv_id", "turn", units.alias("utf16_units"), T.squeeze(text).alias("squeezed"), T.clip_utf16(text, 40).alias("clipped"), T.xml_escape(text).alias("escaped"))


ORACLE["text_scalars"] = ORACLE["text_scalars"].replace('sum(0) OVER () + length("text")', 'CAST(length("text") AS DECIMAL(38,0))')


@query("redact_secrets", """SELECT doc_id, sha256(regexp_replace("text", '(?i)\\b(sk-|ghp_|github_pat_)[A-Za-z0-9_-]{16,}|\\bBearer\\s+[A-Za-z0-9._~+/-]{12,}|\\b(password|api[_-]?key|token|secret)\\s*[:=]\\s*["'']?[^\\s"'']{8,}', '[redacted]', 'g')) AS redacted FROM documents""")
def redact_secrets(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(T.redact(F.col("text")), 256).alias("redacted"))


@query("iso_dates", """SELECT o_orderkey, list_sort(list_distinct(list_filter([strftime(o_orderdate, '%Y-%m-%d'), '2024-02-30'], lambda x: try_cast(x AS DATE) IS NOT NULL))) AS dates FROM orders""")
def iso_dates(s, d):
    text = F.concat(F.lit("due "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", not 2024-02-30 or 12024-01-010; again "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(s, d, "orders").select("o_orderkey", T.iso_dates(text).alias("dates"))


@query("script_language", """SELECT doc_id, CASE WHEN len(regexp_extract_all("text", '[\\x{0400}-\\x{052f}]')) >= 4 THEN 'ru' END AS detected FROM documents""")
def script_language(s, d):
    return table(s, d, "documents").select("doc_id", T.script_language(F.col("text")).alias("detected"))


@query("byte_offsets", """SELECT doc_id, i - 1 AS line, CAST(coalesce(sum(strlen(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start", strlen(t) AS length
FROM (SELECT doc_id, unnest(regexp_extract_all("text", '[^\\n]*\\n|[^\\n]+')) AS t, generate_subscripts(regexp_extract_all("text", '[^\\n]*\\n|[^\\n]+'), 1) AS i FROM documents)""")
def byte_offsets(s, d):
    return records.line_offsets(table(s, d, "documents")).withColumn("line", F.col("line").cast("long"))


@query("chunk_text")
def chunk_text(s, d):
    chunks = T.chunks(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")))
    return table(s, d, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


@query("refresh_diff", """SELECT coalesce(a.doc_id, b.doc_id) AS "key", CASE WHEN b.doc_id IS NULL THEN 'insert' WHEN a.doc_id IS NULL THEN 'delete' WHEN a.quality = b.quality THEN 'keep' ELSE 'update' END AS action
FROM (SELECT doc_id, 1 AS quality FROM documents) a FULL JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) b ON a.doc_id = b.doc_id""")
def refresh_diff(s, d):
    scan = table(s, d, "documents").select(F.col("doc_id").alias("key"), F.lit("x").alias("rel"), F.lit(1).alias("mtime"), F.lit(0).alias("size"))
    old = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("mtime")).select(F.col("doc_id").alias("key"), F.lit("x").alias("rel"), "mtime", F.lit(0).alias("size"))
    return index.refresh_plan(scan, old)


@query("newest_per_stem", """SELECT doc_id, source AS stem, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1 THEN source ELSE './' || lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS "key" FROM documents""")
def newest_per_stem(s, d):
    # The window needs one row a stem only; ranks of the rest are not used, so
    # the newest is found by aggregation and joined.
    files = table(s, d, "documents").select("doc_id", F.col("source").alias("stem"), F.col("n_chars").alias("mtime"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("rel"))
    newest = files.groupBy("stem").agg(F.max_by("doc_id", F.struct("mtime", -F.col("doc_id"))).alias("top"))
    joined = files.join(newest, "stem")
    return joined.select("doc_id", "stem", F.when(F.col("doc_id") == F.col("top"), F.col("stem")).otherwise(T.path_key(F.col("rel"))).alias("key"))


# -- ranking -----------------------------------------------------------------


_INDEXES: dict[tuple, store.Index] = {}


def _stored(s, d) -> store.Index:
    """The stored index of ``documents``: built once a session, and anew when the files change."""
    key = (s.sparkContext.applicationId, d, stamps(s, f"{d}/documents.parquet"))
    if key not in _INDEXES:
        _INDEXES[key] = store.build(table(s, d, "documents"))
    return _INDEXES[key]


def _asked(s, d, added=None):
    own = _stored(s, d)
    return rank.asked_bm25(rank.query_terms(_queries(s, d)), own.dfs, own.stats, added)


def _best(s, d, k, **extra):
    """The best ``k`` of each item by BM25; ``extra`` columns boost or replace a document's score."""
    own = _stored(s, d)
    return rank.bm25_best(_asked(s, d), own.rows.withColumns(extra), own.stats.first()["avgdl"], k)


_RANKED = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {}) WHERE rank <= {}"
_BM25 = ("toks", "lens", "stats", "asked", "dfs", "bm25")


@query("bm25_batch_topk", sql(_RANKED.format("bm25", 5), *_BM25))
def bm25_batch_topk(s, d):
    return _best(s, d, 5)


@query("bm25_topk", sql(_RANKED.format("(SELECT * FROM bm25 WHERE query_id = 0)", 10), *_BM25))
def bm25_topk(s, d):
    """The first query alone, as a single search asks it."""
    own, terms = _stored(s, d), rank.query_terms(_queries(s, d).where("query_id = 0"))
    return rank.bm25_best(rank.asked_bm25(terms, own.dfs, own.stats), own.rows, own.stats.first()["avgdl"], 10)


_COS = """, qc AS (SELECT query_id, term, count(*) AS qtf FROM qall GROUP BY ALL),
idf AS (SELECT term, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM dfs, st),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM post JOIN idf USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
qw AS (SELECT query_id, term, (1 + ln(qtf)) * idf AS w FROM qc JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY 1),
cos AS (SELECT qw.query_id, w.doc_id, round(sum(qw.w / qn.n * w.w) / any_value(norms.n), 6) AS score FROM qw JOIN qn USING (query_id) JOIN w USING (term) JOIN norms USING (doc_id) GROUP BY 1, 2)
"""


@query("tfidf_cosine_topk", sql(_COS + _RANKED.format("cos", 5), "toks", "lens", "stats", "asked", "dfs").replace("\n, qc", ", qc"))
def tfidf_cosine_topk(s, d):
    own = _stored(s, d)
    counts = index.postings(_queries(s, d).withColumnRenamed("query_id", "doc_id")).withColumnRenamed("doc_id", "query_id")
    return rank.cosine_best(counts, own.rows, own.stats, own.dfs, own.norms, 5)


@query("coverage_division", sql("SELECT query_id, doc_id FROM q JOIN post USING (term) WHERE NOT ends_with(term, '~') GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM q u WHERE u.query_id = q.query_id AND NOT ends_with(u.term, '~'))", "toks", "asked"))
def coverage_division(s, d):
    return rank.covering_best(rank.query_terms(_queries(s, d)), _stored(s, d).rows)


ORACLE["coverage_division"] = sql(
    """, units AS (SELECT query_id, count(*) AS units FROM q WHERE NOT ends_with(term, '~') GROUP BY 1),
have AS (SELECT query_id, doc_id, count(*) AS have FROM q JOIN post USING (term) WHERE NOT ends_with(term, '~') GROUP BY 1, 2)
SELECT query_id, doc_id FROM have JOIN units USING (query_id) WHERE have = units""",
    "toks", "asked",
).replace("\n, units", ", units")


def _expansions(s, d):
    """Each query is widened by the words of the next item (synonyms) and of itself (related)."""
    items = _queries(s, d)
    nxt = items.select((F.col("query_id") - 1).alias("query_id"), F.lit("synonyms").alias("tier"), "text")
    far = items.select((F.col("query_id") - 2).alias("query_id"), F.lit("related").alias("tier"), "text")
    return nxt.unionByName(far).join(items.select("query_id"), "query_id", "left_semi")


@query(
    "expansion_weighted_topk",
    sql(
        """, ex AS (SELECT query_id - 1 AS query_id, term, 0.75 AS weight FROM qall UNION ALL SELECT query_id - 2, term, 0.4 FROM qall),
ex1 AS (SELECT query_id, term, max(weight) AS weight FROM ex WHERE query_id IN (SELECT query_id FROM q) GROUP BY 1, 2),
ex2 AS (SELECT ex1.* FROM ex1 LEFT JOIN q ON ex1.query_id = q.query_id AND ex1.term = q.term WHERE q.term IS NULL),
units AS (SELECT query_id, count(*) AS units FROM q WHERE NOT ends_with(term, '~') GROUP BY 1),
have AS (SELECT query_id, doc_id, count(*) AS have FROM q JOIN post USING (term) WHERE NOT ends_with(term, '~') GROUP BY 1, 2),
covers AS (SELECT query_id, doc_id FROM have JOIN units USING (query_id) WHERE have = units),
added AS (SELECT query_id, doc_id, round(sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doclen / avgdl))), 6) AS score
  FROM ex2 JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), st GROUP BY 1, 2),
both_ AS (SELECT * FROM bm25 UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM covers c WHERE c.query_id = a.query_id AND c.doc_id = a.doc_id)),
total AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM both_ GROUP BY 1, 2)
"""
        + _RANKED.format("total", 5),
        *_BM25,
    ).replace("\n, ex AS", ", ex AS"),
)
def expansion_weighted_topk(s, d):
    own, terms = _stored(s, d), rank.query_terms(_queries(s, d))
    asked = _asked(s, d, rank.expansion_terms(_expansions(s, d), terms))
    return rank.bm25_best(asked, own.rows, own.stats.first()["avgdl"], 5)


_LEGS = """, a AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm25),
b AS (SELECT query_id, doc_id, -doc_id AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS r FROM bm25)
"""


@query("union_channels", sql(_LEGS + "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen) AS position FROM (SELECT query_id, doc_id, min([c, r]) AS seen FROM (SELECT query_id, doc_id, 0 AS c, r FROM a UNION ALL SELECT query_id, doc_id, 1, r FROM b) WHERE r <= 32 GROUP BY 1, 2)", *_BM25).replace("\n, a AS", ", a AS"))
def union_channels(s, d):
    a = _best(s, d, 32).select("query_id", F.lit(0).alias("channel"), "rank", "doc_id")
    b = _best(s, d, 32, value=-F.col("doc_id").cast("double")).select("query_id", F.lit(1).alias("channel"), "rank", "doc_id")
    return rank.union_channels(a.unionByName(b))


@query("rrf_fusion", sql(_LEGS.replace("-doc_id AS score", "-(doc_id % 7) AS score").replace("ORDER BY doc_id) AS r FROM bm25", "ORDER BY -(doc_id % 7) DESC, doc_id) AS r FROM bm25") + """, ra AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS k FROM a WHERE r <= 100),
rb AS (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS k FROM b WHERE r <= 100)
SELECT query_id, doc_id, round(sum(v), 6) AS score FROM (SELECT query_id, doc_id, 1.0 / (5 + k) AS v FROM ra UNION ALL SELECT query_id, doc_id, 0.4 / (5 + k) FROM rb) GROUP BY 1, 2""", *_BM25).replace("\n, a AS", ", a AS").replace("\n, ra AS", ", ra AS"))
def rrf_fusion(s, d):
    scores = settle(_best(s, d, rank.FUSE_DEPTH).drop("rank"), "scores")
    other = settle(_best(s, d, rank.FUSE_DEPTH, value=-(F.col("doc_id") % 7).cast("double")).drop("rank"), "scores")
    return rank.hybrid(scores, other, scores.select("query_id", "doc_id").limit(0)).select("query_id", "doc_id", "score")


ORACLE["rrf_fusion"] = ORACLE["rrf_fusion"].replace("round(sum(v), 6)", "round(sum(CAST(v AS DOUBLE)), 6)")


@query("shared_ranks", "SELECT o_custkey AS query_id, o_orderkey AS doc_id, floor(o_totalprice / 50000) AS score, rank() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC) AS rank FROM orders")
def shared_ranks(s, d):
    return rank.shared_ranks(table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("score")))


@query("visible_after_cut", sql("SELECT query_id, doc_id, score, rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm25) JOIN documents USING (doc_id) WHERE r <= 32 AND source <> 'src0') WHERE rank <= 8", *_BM25))
def visible_after_cut(s, d):
    scores = settle(_best(s, d, rank.CANDIDATES).drop("rank"), "candidates")
    return rank.cut_then_filter(scores, table(s, d, "documents").where("source <> 'src0'"), 8)


def _strength(s, d):
    log = table(s, d, "events").select(F.col("user_id").alias("key"), "ts")
    return dynamics.fold_accesses(log)


_EFF = """acc AS (SELECT "key", ts, ts - lag(ts) OVER (PARTITION BY "key" ORDER BY ts) AS gap FROM alog),
fold AS (SELECT "key", least(5.0, 1 + 0.25 * count(*)) AS strength, round(least(365.0, 7.0 * pow(1.5, least(sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 1 HOUR THEN 1 ELSE 0 END), 40))), 6) AS stability,
  count(*) AS access_count, max(ts) AS last_access FROM acc GROUP BY 1)"""
CTE["fold"] = _EFF
CTE["eff"] = """eff AS (SELECT *, round(greatest(0.05, strength * exp(-greatest(0.0, epoch_us(TIMESTAMP '2024-07-01') / 1e6 - epoch_us(last_access) / 1e6) / 86400 / stability)), 6) AS eff FROM fold)"""
CTE["zones"] = """ema AS (SELECT "zone", round(sum(pow(0.9, greatest(0, date_diff('day', CAST(ts AS DATE), DATE '2024-07-01')))), 6) AS ema FROM alog GROUP BY 1),
pri AS (SELECT "zone", round(CASE WHEN max(ema) OVER () > 0 THEN ema / max(ema) OVER () ELSE 0.0 END, 6) AS priority FROM ema)"""


@query("access_strength", sql('SELECT "key", CAST(strength AS DOUBLE) AS strength, access_count, last_access FROM fold', "log", "fold"))
def access_strength(s, d):
    return _strength(s, d).select("key", "strength", "access_count", "last_access")


@query("access_stability", sql('SELECT "key", stability FROM fold', "log", "fold"))
def access_stability(s, d):
    return _strength(s, d).select("key", "stability")


def _eff(s, d):
    return _strength(s, d).withColumn("eff", dynamics.effective(F.col("strength"), F.col("stability"), F.col("last_access"), F.lit(NOW).cast("timestamp")))


@query("effective_strength", sql('SELECT "key", eff FROM eff', "log", "fold", "eff"))
def effective_strength(s, d):
    return _eff(s, d).select("key", "eff")


def _ema(s, d):
    return dynamics.zone_ema(table(s, d, "events").select(F.col("event_type").alias("zone"), "ts"), F.lit(TODAY).cast("date"))


@query("zone_ema", sql('SELECT "zone", ema FROM ema', "log", "zones"))
def zone_ema(s, d):
    return _ema(s, d)


@query("zone_priority", sql('SELECT "zone", priority FROM pri', "log", "zones"))
def zone_priority(s, d):
    return dynamics.zone_priority(_ema(s, d))


@query("stale_notes", """WITH n AS (SELECT c_custkey AS "key", 1.0 + c_nationkey % 5 * 0.25 AS strength, 7.0 AS stability, max(o_orderdate) AS last_access, c_mktsegment AS "zone" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
e AS (SELECT "key", "zone", last_access, round(greatest(0.05, strength * exp(-greatest(0.0, epoch_us(TIMESTAMP '2001-09-01') / 1e6 - epoch_us(last_access) / 1e6) / 86400 / stability)), 6) AS eff FROM n WHERE last_access IS NOT NULL)
SELECT "key", eff FROM e WHERE eff < 0.1 AND (epoch_us(TIMESTAMP '2001-09-01') - epoch_us(last_access)) / 1e6 / 86400 > 90 AND "zone" <> 'identity'""")
def stale_notes(s, d):
    last = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_access"))
    c = table(s, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    notes = c.select(F.col("c_custkey").alias("key"), (1 + F.col("c_nationkey") % 5 * 0.25).alias("strength"), F.lit(7.0).alias("stability"), "last_access", F.col("c_mktsegment").alias("zone"), F.lit(None).cast("string").alias("expires_at"))
    return dynamics.stale(notes, F.lit("2001-09-01").cast("timestamp")).select("key", "eff")


@query("boosted_topk", sql("""SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT query_id, b.doc_id, round(score * (1 + 0.3 * coalesce(eff, 1.0) / 5 + 0.2 * CASE WHEN source = 'src0' THEN 1.0 WHEN source = 'src1' THEN 0.5 ELSE 0 END), 6) AS score
FROM bm25 b JOIN documents USING (doc_id) LEFT JOIN eff ON eff."key" = b.doc_id)) WHERE rank <= 5""", *_BM25, "log", "fold", "eff"))
def boosted_topk(s, d):
    own, docs, asked = _stored(s, d), table(s, d, "documents"), _asked(s, d)
    priority = s.createDataFrame([("src0", 1.0), ("src1", 0.5)], "zone string, priority double")
    lifts = rank.boosts(docs.select("doc_id", F.col("source").alias("zone")), _eff(s, d).select(F.col("key").alias("doc_id"), "eff"), F.broadcast(priority))
    rows = scan.only_asked(own.rows, asked).where(F.size("terms") > 0).join(lifts, "doc_id")
    return rank.bm25_best(asked, rows, own.stats.first()["avgdl"], 5)


_TOPS = """, tops AS (SELECT doc_id AS query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS place FROM post WHERE NOT ends_with(term, '~') AND doc_id % 100 = 0) WHERE place <= 12),
near AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doclen / avgdl))), 6) AS score
  FROM tops JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), st WHERE query_id <> doc_id GROUP BY 1, 2)
"""


@query("related_notes", sql(_TOPS + _RANKED.format("near", 5), "toks", "lens", "stats", "dfs").replace("\n, tops", ", tops"))
def related_notes(s, d):
    """Top-5 neighbours among all documents by a document's own top terms; every hundredth one asks."""
    own = _stored(s, d)
    none = s.createDataFrame([], "src long, dst long")
    return rank.related_best(own.rows, own.stats, own.dfs, none, asking=F.col("doc_id") % 100 == 0)


@query("recall_select", sql("""SELECT query_id, doc_id, round(1 / (1 + score), 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doclen / (SELECT avg(doclen) FROM lens)))), 6) AS score
FROM q JOIN post USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), st GROUP BY 1, 2)) WHERE rank <= 3""", "toks", "lens", "stats", "asked", "dfs"))
def recall_select(s, d):
    none = s.createDataFrame([], "query_id long, doc_id long")
    return recall.select(table(s, d, "documents"), _stored(s, d), _queries(s, d), none).drop("excerpt")


# -- labels and listing --------------------------------------------------------


def _labelled(s, d):
    votes = table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    joined = table(s, d, "documents").join(votes, "doc_id", "left")
    made = F.array(F.concat(F.lit(" Lang: "), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("quality:"), F.col("quality").cast("string")))
    return joined.select("doc_id", "n_chars", F.col("source").alias("zone"), labels.normalize(F.filter(made, lambda x: x.isNotNull())).alias("labels"))


_LABELS = """WITH l AS (SELECT doc_id, n_chars, list_sort(list_filter(['lang:' || lang, 'quality:' || max(quality), 'source:' || source], lambda x: x IS NOT NULL)) AS labels FROM documents LEFT JOIN labels USING (doc_id) GROUP BY doc_id, n_chars, lang, source)
"""


@query("label_normalize", _LABELS + "SELECT doc_id, labels FROM l")
def label_normalize(s, d):
    return _labelled(s, d).select("doc_id", "labels")


@query("label_filter_and", _LABELS + "SELECT doc_id FROM l WHERE list_has_all(labels, ['lang:en', 'quality:1'])")
def label_filter_and(s, d):
    return _labelled(s, d).where(labels.has_all(F.col("labels"), F.array(F.lit("lang:en"), F.lit("quality:1")))).select("doc_id")


@query("label_histogram", _LABELS + "SELECT label, count(*) AS notes FROM (SELECT unnest(labels) AS label FROM l) GROUP BY 1")
def label_histogram(s, d):
    return labels.histogram(_labelled(s, d))


@query("list_paginated", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 20 OFFSET 40")
def list_paginated(s, d):
    return index.listing(table(s, d, "documents").select("doc_id", "n_chars"), 40, 20, "n_chars", "doc_id")


@query("zone_normalize", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN lower(n_name) END AS \"zone\" FROM nation")
def zone_normalize(s, d):
    low = F.concat(F.lit(" "), F.replace(F.replace(F.col("n_name"), F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-")), F.lit(" "))
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.lit(" Inbox ")).when(F.col("n_nationkey") % 3 == 1, low).otherwise(F.concat(F.lit("../"), "n_name"))
    return table(s, d, "nation").select("n_nationkey", index.normal_zone(raw).alias("zone"))


ORACLE["zone_normalize"] = ORACLE["zone_normalize"].replace("lower(n_name)", "lower(replace(replace(n_name, ' ', '-'), '_', '-'))")

# -- vectors -------------------------------------------------------------------


@query("sign_dot_topk", """WITH qv AS (SELECT vec_id AS query_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, v.vec_id AS doc_id, round(list_sum(list_transform(list_zip(qv.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) / n * CASE WHEN p[2] > 0 THEN 1 ELSE -1 END)), 6) AS score FROM qv, embeddings v)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def sign_dot_topk(s, d):
    v = table(s, d, "embeddings")
    return vector.sign_search(v.select(F.col("vec_id").alias("doc_id"), "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


@query("chunk_maxpool", """WITH qv AS (SELECT vec_id AS query_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, v.label AS doc_id, max(round(list_sum(list_transform(list_zip(qv.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) / n * CASE WHEN p[2] > 0 THEN 1 ELSE -1 END)), 6)) AS score FROM qv, embeddings v GROUP BY 1, 2)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def chunk_maxpool(s, d):
    v = table(s, d, "embeddings")
    return vector.sign_search(v.select(F.col("label").alias("doc_id"), "embedding"), v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 3)


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / 127, 9) AS scale FROM embeddings")
def vector_norms(s, d):
    v = F.col("embedding")
    return table(s, d, "embeddings").select("vec_id", F.round(vector.norm(v), 6).alias("norm"), F.round(vector.int8_rows(v)["scale"], 9).alias("scale"))


# -- pairs ---------------------------------------------------------------------


@query("exact_duplicates", """WITH k AS (SELECT doc_id, trim(regexp_replace(lower(replace("text", 'ß', 'ss')), '\\s+', ' ', 'g')) AS k FROM documents)
SELECT doc_id, class_id, copies FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS copies FROM k) WHERE copies > 1""")
def exact_duplicates(s, d):
    return pairs.exact_duplicates(table(s, d, "documents"))


CTE["sets"] = """sets AS (SELECT doc_id, list_sort(list(term)) AS t FROM post GROUP BY 1),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS class_size, t FROM sets),
heads AS (SELECT doc_id, t, len(t) AS n FROM cls WHERE doc_id = class_id),
hp AS (SELECT doc_id, n, unnest(t) AS term FROM heads),
cp AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS common FROM hp x JOIN hp y ON x.term = y.term AND x.doc_id < y.doc_id WHERE x.n >= y.n * 0.55 - 1e-9 AND y.n >= x.n * 0.55 - 1e-9 GROUP BY ALL),
jp AS (SELECT a, b, common, common / (na + nb - common) AS share FROM cp WHERE common / (na + nb - common) >= 0.55 AND common >= 3)"""


@query("token_classes", sql("SELECT doc_id, class_id, class_size FROM cls", "toks", "sets"))
def token_classes(s, d):
    return pairs.classes(pairs.token_sets(table(s, d, "documents")))


def _pairs(s, d):
    return pairs.similar_pairs(settle(pairs.token_sets(table(s, d, "documents")), "token-sets", **pairs.TERMS_ONCE))


@query("jaccard_pairs", sql("SELECT a, b, common, round(share, 6) AS similarity FROM jp", "toks", "sets"))
def jaccard_pairs(s, d):
    return _pairs(s, d).withColumn("common", F.col("common").cast("long"))


@query("topk_partners", sql("""SELECT doc_id, partner, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, partner) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY common DESC, partner) AS r FROM (SELECT a AS doc_id, b AS partner, common, round(share, 6) AS similarity FROM jp UNION ALL SELECT b, a, common, round(share, 6) FROM jp)) WHERE r <= 80) WHERE rank <= 20""", "toks", "sets"))
def topk_partners(s, d):
    return pairs.partners(_pairs(s, d))


@query("band_neighbours", """WITH w AS (SELECT item_id AS doc_id, unnest(regexp_extract_all(strip_accents(lower(replace("text", 'ß', 'ss'))), '[\\p{L}\\p{N}]+')) AS w FROM benchmark),
p AS (SELECT DISTINCT doc_id, w AS term FROM w UNION SELECT DISTINCT doc_id, substr(w, 1, 5) || '~' FROM w WHERE length(w) >= 6 AND regexp_full_match(w, '\\p{L}+')),
n AS (SELECT doc_id, term, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY term) AS df FROM p)
SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS tokens FROM n x JOIN n y ON x.term = y.term AND y.i > x.i AND y.i <= x.i + 3 WHERE x.df > 5 GROUP BY 1, 2""")
def band_neighbours(s, d):
    post = index.postings(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    return pairs.band_neighbours(post, max_df=5, width=3)


@query("near_duplicates_set_cosine", sql(""", qs AS (SELECT query_id, count(*) AS qn FROM q GROUP BY 1),
c AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm25) WHERE r <= 5),
ds AS (SELECT doc_id, count(*) AS dn FROM post GROUP BY 1),
s AS (SELECT c.query_id, c.doc_id, round(count(*) / sqrt(CAST(any_value(qn) AS DOUBLE) * any_value(dn)), 3) AS similarity FROM c JOIN q USING (query_id) JOIN post USING (doc_id, term) JOIN qs USING (query_id) JOIN ds USING (doc_id) GROUP BY 1, 2)
SELECT query_id, doc_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s) WHERE rank <= 3""", *_BM25).replace("\n, qs", ", qs"))
def near_duplicates_set_cosine(s, d):
    best = settle(_best(s, d, 5), "candidates")
    docs = table(s, d, "documents").join(F.broadcast(best.select("doc_id").distinct()), "doc_id", "left_semi")
    drafts = pairs.token_sets(_queries(s, d), "query_id").withColumnRenamed("doc_id", "query_id")
    return pairs.near_duplicates(drafts, pairs.token_sets(docs), best)


# -- routing, gate, records, evaluation ------------------------------------------


def _routes(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("trigger"), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), (F.col("p_size") % 7).cast("string"), F.lit(".md")).alias("document"))


_NOUNS = ("ring", "widget", "bolt", "gear", "gizmo")


@query("trigger_match", """SELECT r_regionkey AS task_id, p_partkey AS seq, p_name AS trigger, lower(replace(p_brand, '#', '')) || '/' || p_size % 7 || '.md' AS document
FROM region JOIN part ON list_contains(string_split(p_name, ' '), ['ring', 'widget', 'bolt', 'gear', 'gizmo'][r_regionkey + 1])""")
def trigger_match(s, d):
    """Tasks that name a kind of part against all parts' triggers."""
    noun = F.element_at(F.array(*map(F.lit, _NOUNS)), F.col("r_regionkey") + 1)
    return routing.match(_routes(s, d), table(s, d, "region").select(F.col("r_regionkey").alias("task_id"), F.concat(F.lit("the "), noun).alias("task")))


_ROUTES = """WITH r AS (SELECT p_partkey AS seq, p_name AS trigger_, lower(replace(p_brand, '#', '')) || '/' || (p_size % 7) || '.md' AS document FROM part)
"""


@query("orphans_dangling", _ROUTES + """, k AS (SELECT DISTINCT lower(replace(p_brand, '#', '')) || '/' || (p_size % 9) || '.md' AS document FROM part)
SELECT document, 'orphan' AS problem FROM k WHERE document NOT IN (SELECT document FROM r) UNION ALL SELECT DISTINCT document, 'dangling' FROM r WHERE document NOT IN (SELECT document FROM k)""")
def orphans_dangling(s, d):
    known = table(s, d, "part").select(F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("/"), (F.col("p_size") % 9).cast("string"), F.lit(".md")).alias("document"))
    return routing.integrity(_routes(s, d), known)


@query("route_topics", _ROUTES + "SELECT 'dir:' || split_part(document, '/', 1) AS topic, count(*) AS routes, count(DISTINCT document) AS documents FROM r GROUP BY 1")
def route_topics(s, d):
    return routing.topics(_routes(s, d)).drop("digest")


@query("archive_cap_clamp", "SELECT count(*) AS active, CAST(least(greatest(2, ceil(0.2 * count(*))), greatest(0, count(*) - 1)) AS BIGINT) AS archive_cap FROM supplier WHERE s_nationkey <> 3")
def archive_cap_clamp(s, d):
    notes = table(s, d, "supplier").select(F.when(F.col("s_nationkey") == 3, "_archive").otherwise("work").alias("zone"))
    return gate.archive_cap(notes)


def _notes(s, d):
    c = table(s, d, "customer")
    zone = F.when(F.col("c_nationkey") % 4 == 0, "").when(F.col("c_nationkey") % 4 == 1, "_archive/old").otherwise(F.col("c_mktsegment"))
    links = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return c.select(
        F.col("c_custkey").alias("key"), zone.alias("zone"), F.when(F.col("c_custkey") % 10 == 0, "preference").otherwise("topic").alias("type"),
        F.when(F.col("c_acctbal") < 0, "negative").otherwise("positive").alias("polarity"), links.alias("links"), F.length("c_name").cast("long").alias("size"),
        (F.col("c_custkey") % 7).cast("long").alias("access_count"), F.lit(None).cast("timestamp").alias("last_access"), F.col("c_custkey").cast("double").alias("mtime"),
    )


_NOTES = """WITH n AS (SELECT c_custkey AS "key", CASE WHEN c_nationkey % 4 = 0 THEN '' WHEN c_nationkey % 4 = 1 THEN '_archive/old' ELSE c_mktsegment END AS "zone", c_custkey % 10 = 0 AS preferred, c_acctbal < 0 AS neg, c_custkey % 3 = 0 AS linked, length(c_name) AS size, c_custkey % 7 AS uses FROM customer),
p AS (SELECT *, neg OR preferred OR ("zone" <> '' AND NOT starts_with("zone", '_archive') AND linked) AS prot FROM n)
"""


@query("protected_notes", _NOTES + 'SELECT "key" FROM p WHERE prot')
def protected_notes(s, d):
    return _notes(s, d).where(gate.protected()).select("key")


@query("capacity_report", _NOTES + "SELECT count(*) AS notes, count(*) FILTER (prot) AS protected, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (prot) > 100 AS over_protected, sum(size) > 1000000 AS over_bytes FROM p WHERE NOT starts_with(\"zone\", '_archive')")
def capacity_report(s, d):
    return gate.capacity_report(_notes(s, d), 100, 1_000_000)


@query("retire_running_total", _NOTES + """, a AS (SELECT * FROM p WHERE NOT starts_with("zone", '_archive')),
t AS (SELECT count(*) FILTER (prot) AS c, sum(size) AS b FROM a),
o AS (SELECT "key", size, row_number() OVER (ORDER BY uses, "key") AS place, coalesce(sum(size) OVER (ORDER BY uses, "key" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM a WHERE prot)
SELECT "key", size, place FROM o, t WHERE place <= 50 AND (c - (place - 1) > 300 OR b - freed > 15000)""")
def retire_running_total(s, d):
    return gate.retire(_notes(s, d), 300, 15_000, 50)


@query("plan_validate", _NOTES + """, o(seq, op, slug, "zone", reason) AS (VALUES (1, 'rezone', 1, 'Deep Work', NULL), (2, 'rezone', 1, NULL, 'rezone_to_archive_rejected'), (3, 'link', NULL, NULL, 'self-link'), (4, 'link', NULL, NULL, NULL),
(5, 'supersede', NULL, NULL, 'unknown slug'), (6, 'archive', 2, NULL, NULL), (7, 'archive', 10, NULL, NULL), (8, 'burn', 2, NULL, 'unknown op'), (9, 'rezone', 2, NULL, 'invalid zone name'))
SELECT seq, op, o."zone", CASE WHEN op = 'archive' AND starts_with(p."zone", '_archive') THEN 'already archived' WHEN op = 'archive' AND prot THEN 'protected note' ELSE reason END AS reason FROM o LEFT JOIN p ON p."key" = slug""")
def plan_validate(s, d):
    ops = s.createDataFrame(
        [(1, "rezone", "1", " Deep Work ", *[None] * 4), (2, "rezone", "1", "_archive", *[None] * 4), (3, "link", None, None, "1", "1", None, None), (4, "link", None, None, "1", "2", None, None),
         (5, "supersede", None, None, None, None, "3", "99999999"), (6, "archive", "2", *[None] * 5), (7, "archive", "10", *[None] * 5), (8, "burn", "2", *[None] * 5), (9, "rezone", "2", "../x", *[None] * 4)],
        "seq int, op string, slug string, zone string, a string, b string, stale string, by string",
    )
    notes = _notes(s, d).withColumn("key", F.col("key").cast("string"))
    return gate.validate(ops, notes, notes.select("key", (F.col("mtime") / 1e6).alias("eff"))).select("seq", "op", "zone", "reason")


@query("keep_newest", "SELECT o_custkey, o_orderkey, age FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS age FROM orders) WHERE age > 3")
def keep_newest(s, d):
    return records.older_than_newest(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).drop("o_orderdate")


@query("latest_per_scope", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def latest_per_scope(s, d):
    return records.latest(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("fold_distinct", "SELECT o_custkey, list(o_orderpriority ORDER BY seen) AS \"values\" FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS seen FROM orders GROUP BY 1, 2) GROUP BY 1")
def fold_distinct(s, d):
    return records.fold_distinct(table(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority")


@query("monotonic_stamps", "SELECT user_id, event_id, max(epoch_us(date_trunc('day', ts)) - n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + n AS bumped FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def monotonic_stamps(s, d):
    rows = table(s, d, "events").select("user_id", "event_id", F.unix_micros(F.date_trunc("day", "ts")).alias("stamp"))
    return records.bump_stamps(rows, ["user_id"], "event_id", "stamp").drop("stamp")


@query("gap_islands", "SELECT user_id, event_id, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS brk FROM events)")
def gap_islands(s, d):
    rows = table(s, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("brk"))
    return records.islands(rows, ["user_id"], "event_id", "brk").select("user_id", "event_id", F.col("island").cast("decimal(38,0)").alias("island"))


ORACLE["gap_islands"] = ORACLE["gap_islands"].replace("sum(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)", "CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,0))")


@query("last_role_text", """SELECT conv_id, role, max(turn) AS turn, arg_max("text", turn) AS "text" FROM conversations WHERE "text" IS NOT NULL AND trim("text") <> '' GROUP BY 1, 2""")
def last_role_text(s, d):
    return records.last_by_role(table(s, d, "conversations"))


@query("transcript_sections", """WITH m AS (SELECT conv_id, turn, role || ' ' || turn AS item FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, 'decisions' AS family, list(item ORDER BY turn) AS items FROM m GROUP BY 1""")
def transcript_sections(s, d):
    """Every message with a headed list put after its text, fenced and unnamed parts included."""
    after = F.concat(F.lit("\n## Decisions\n- "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n```\ncode\n```\n# Other\n1. none"))
    return records.transcript_sections(table(s, d, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), after)))


@query("document_sections", """WITH t AS (SELECT doc_id, source, lang, coalesce("text", '') AS x FROM documents),
n AS (SELECT *, length(x) - length(replace(x, chr(10), '')) + 1 AS k FROM t)
SELECT doc_id, 0 AS section, substr(sha256(source || chr(0) || '1'), 1, 16) AS anchor, source AS heading, 1 AS level, 1 AS first_line, CAST(1 + k AS INT) AS last_line FROM n
UNION ALL SELECT doc_id, 1, substr(sha256(source || chr(0) || lang || chr(0) || '1'), 1, 16), lang, 2, CAST(2 + k AS INT), CAST(3 + k AS INT) FROM n""")
def document_sections(s, d):
    """Each text under a heading of its source, with a second one of its language after it."""
    text = F.concat(F.lit("# "), "source", F.lit(" #\n"), F.coalesce("text", F.lit("")), F.lit("\n"), "lang", F.lit("\n-----"))
    rows = sections.sections(table(s, d, "documents").withColumn("text", text))
    return rows.select("doc_id", "section", "anchor", "heading", "level", "first_line", "last_line")


@query("block_coverage", "SELECT doc_id AS path, TRUE AS ok FROM documents")
def block_coverage(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return sections.verify_blocks(sections.blocks(docs), docs)


def _sides(s, d):
    own = _stored(s, d)
    counts = index.postings(_queries(s, d).withColumnRenamed("query_id", "doc_id")).withColumnRenamed("doc_id", "query_id")
    judged = lambda x: x.withColumn("score", F.round(((F.col("doc_id") * 37 + F.col("query_id")) % 101) / 100, 6))
    left, right = _best(s, d, rerank.WIDTH), rank.cosine_best(counts, own.rows, own.stats, own.dfs, own.norms, rerank.WIDTH)
    return settle(judged(left), "left"), settle(judged(right), "right")


_MERGED = _COS + """, lft AS (SELECT query_id, doc_id, r AS ra FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM bm25) WHERE r <= 32),
rgt AS (SELECT query_id, doc_id, r AS rb FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM cos WHERE score > 0) WHERE r <= 32),
cards AS (SELECT query_id, doc_id, ra, rb, round(((doc_id * 37 + query_id) % 101) / 100, 6) AS score FROM lft FULL JOIN rgt USING (query_id, doc_id)),
five AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ra NULLS LAST, rb NULLS LAST, doc_id) AS rank FROM cards) WHERE rank <= 5)
"""


@query("merge_mean_top5", sql(_MERGED + "SELECT * FROM five", *_BM25).replace("\n, qc", ", qc").replace("\n, lft", ", lft"))
def merge_mean_top5(s, d):
    """Both retrievers' cards with a stand-in judge that depends on the ids alone."""
    return rerank.merge_top(*_sides(s, d))


_PAIRED = _MERGED + """, pr AS (SELECT a.query_id, a.rank AS i, a.doc_id, ((a.doc_id * 13 + b.doc_id * 7) % 11) / 10 AS p, ((b.doc_id * 13 + a.doc_id * 7) % 11) / 10 AS r FROM five a JOIN five b ON a.query_id = b.query_id AND a.rank <> b.rank),
tot AS (SELECT query_id, i, doc_id, round(sum((p + 1 - r) / 2), 6) AS preference FROM pr GROUP BY ALL)
SELECT query_id, doc_id, preference, row_number() OVER (PARTITION BY query_id ORDER BY preference DESC, i) AS rank FROM tot"""


@query("pairwise_preference", sql(_PAIRED, *_BM25).replace("\n, qc", ", qc").replace("\n, lft", ", lft").replace("\n, pr", ", pr"))
def pairwise_preference(s, d):
    answers = rerank.ordered_pairs(rerank.merge_top(*_sides(s, d))).withColumn("p", ((F.col("a") * 13 + F.col("b") * 7) % 11) / 10)
    return rerank.pairwise_order(answers)


@query("rank_metrics_grouping_sets", """WITH r AS (SELECT c_mktsegment AS kind, c_nationkey % 3 AS lang, CASE WHEN c_custkey % 13 < 11 THEN c_custkey % 13 + 1 END AS rank FROM customer)
SELECT kind, lang, round(sum(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) / count(*), 6) AS r1, round(sum(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) / count(*), 6) AS r5, round(sum(coalesce(1.0 / rank, 0)) / count(*), 6) AS mrr, round(sum(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END) / count(*), 6) AS ndcg10, count(*) AS n FROM r GROUP BY GROUPING SETS ((kind), (lang), (kind, lang))""")
def rank_metrics_grouping_sets(s, d):
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("kind"), (F.col("c_nationkey") % 3).alias("lang"), F.when(F.col("c_custkey") % 13 < 11, F.col("c_custkey") % 13 + 1).alias("rank"))
    return evaluate.by_grouping_sets(rows, [["kind"], ["lang"], ["kind", "lang"]])


@query("latency_percentiles", "SELECT p AS point, round(quantile_cont(\"value\", p / 100), 6) AS \"value\" FROM events, (SELECT unnest([50.0, 95.0, 99.0]) AS p) GROUP BY p")
def latency_percentiles(s, d):
    return evaluate.percentiles(table(s, d, "events"), "value", [50.0, 95.0, 99.0])


ORACLE["latency_percentiles"] = "SELECT CAST(50 AS DOUBLE) AS point, round(quantile_cont(\"value\", 0.5), 6) AS \"value\" FROM events UNION ALL SELECT 95.0, round(quantile_cont(\"value\", 0.95), 6) FROM events UNION ALL SELECT 99.0, round(quantile_cont(\"value\", 0.99), 6) FROM events"


@query("prompt_digest", """WITH n AS (SELECT doc_id AS "key", CASE source WHEN 'src0' THEN 'identity' WHEN 'src1' THEN '' ELSE source END AS "zone", n_chars % 100 / 10 AS eff, n_chars AS updated FROM documents),
k AS (SELECT *, CASE "zone" WHEN 'identity' THEN 0 WHEN '' THEN 2 ELSE 1 END AS kind, CASE "zone" WHEN 'src2' THEN 1.0 WHEN 'src3' THEN 0.5 ELSE 0 END AS p FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY kind = 0 ORDER BY kind, p DESC, "zone", eff DESC, updated DESC, "key") AS own, row_number() OVER (ORDER BY kind, p DESC, "zone", eff DESC, updated DESC, "key") AS ord FROM k)
SELECT row_number() OVER (ORDER BY ord) AS place, "zone", "key" FROM o WHERE own <= CASE WHEN kind = 0 THEN 5 ELSE 20 END QUALIFY place <= 20""")
def prompt_digest(s, d):
    notes = table(s, d, "documents").select(F.col("doc_id").alias("key"), F.when(F.col("source") == "src0", "identity").when(F.col("source") == "src1", "").otherwise(F.col("source")).alias("zone"), (F.col("n_chars") % 100 / 10).alias("eff"), F.col("n_chars").alias("updated"))
    return gate.digest(notes, s.createDataFrame([("src2", 1.0), ("src3", 0.5)], "zone string, priority double"), 20)


@query("content_hashes", """SELECT doc_id, sha256("text") AS digest FROM documents""")
def content_hashes(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("set_difference", sql("SELECT doc_id, term, tf FROM post WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)", "toks"))
def set_difference(s, d):
    """Postings without those of vanished documents, for which the bad ones stand in."""
    gone = table(s, d, "labels").where("quality = 0").select("doc_id", F.lit(None).cast("string").alias("text")).distinct()
    return index.upsert_postings(_stored(s, d).post, gone)


@query("capture_dedupe", """WITH r AS (SELECT event_type AS scope, user_id AS capture_id, CAST("value" AS BIGINT) % 3 AS payload, ts FROM events)
SELECT scope, capture_id, arg_min(payload, struct_pack(t := ts, p := payload)) AS payload, count(DISTINCT payload) > 1 AS conflict FROM r GROUP BY 1, 2""")
def capture_dedupe(s, d):
    rows = table(s, d, "events").select(F.col("event_type").alias("scope"), F.col("user_id").alias("capture_id"), (F.rint("value").cast("long") % 3).alias("payload"), F.col("ts").alias("recorded_at"))
    return records.dedupe_captures(rows)


@query("reference_closure", """WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey * 7) % 50 FROM supplier),
r AS (SELECT 97 AS document UNION SELECT dst FROM e JOIN r ON e.src = r.document) SELECT CAST(document AS BIGINT) AS document FROM r""")
def reference_closure(s, d):
    k = table(s, d, "supplier").select("s_suppkey")
    half = k.select(F.col("s_suppkey").alias("src"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("dst"))
    edges = half.unionByName(k.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 7 % 50).alias("dst")))
    return sections.closure(edges, s.createDataFrame([(97,)], "document long")).select("document")


@query("sampled_df", """SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(substr("text", 1, 400)), '[a-z0-9\\x{ac00}-\\x{d7a3}]{2,}')) AS term FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 4000)) GROUP BY 1""")
def sampled_df(s, d):
    return rerank.sampled_df(table(s, d, "documents"))


@query("gold_ranks", """WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_orderpriority = '1-URGENT' AS sib, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
k AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM h WHERE NOT sib),
g AS (SELECT o_custkey AS query_id, min(o_orderkey) AS doc_id FROM orders GROUP BY 1)
SELECT g.query_id, min(CASE WHEN place <= 5 THEN place END) AS rank FROM g LEFT JOIN k USING (query_id, doc_id) GROUP BY 1""")
def gold_ranks(s, d):
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_orderpriority")
    hits = rank.top_k(orders, 1 << 30, [F.col("o_totalprice").desc(), F.col("doc_id")]).select("query_id", "doc_id", "rank")
    gold = orders.groupBy("query_id").agg(F.min("doc_id").alias("doc_id"))
    return evaluate.gold_ranks(hits, gold, orders.where("o_orderpriority = '1-URGENT'").select("query_id", "doc_id"), 5)


@query("onboarding_topics", """SELECT topic, list("key" ORDER BY "key") AS "keys" FROM (SELECT p_partkey AS "key", CASE WHEN p_size % 5 = 0 THEN lower(p_brand) WHEN p_size % 5 = 1 THEN split_part(p_type, ' ', 1) ELSE 'fact' END AS topic FROM part) GROUP BY 1""")
def onboarding_topics(s, d):
    none = F.array().cast("array<string>")
    size = F.col("p_size") % 5
    notes = table(s, d, "part").select(
        F.col("p_partkey").alias("key"), F.when(size == 0, F.array(F.concat(F.lit("topic:"), F.lower("p_brand")))).otherwise(none).alias("labels"), none.alias("tags"),
        F.when(size == 1, F.concat(F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("/x.md"))).otherwise("x.md").alias("rel"), F.lit("fact").alias("type"),
    )
    return control.onboarding_topics(notes)
