"""URL filters: explicit rules first, then trust propagated over the host graph.

Rules name a host (with its subdomains) and a path prefix; the longest rule that
fits decides. Other urls get the verdict of their host: trust starts at hosts in
proportion to their pages that rules allow and follows links; distrust starts
at hosts in proportion to their blocked pages and follows links backwards (who
links to a blocked host shares in it). Both are personalised PageRank sums. A
host is blocked if its distrust exceeds its trust by ``THRESHOLD`` of what a
wholly blocked host without links has, and is allowed otherwise.

Pages are reduced to counts a host and a pair of hosts before any join, so a
host that holds a third of all pages costs partial sums only. Nothing is pruned:
ranks are summed over links followed once, twice, and so on, until all that is
still on its way, wherever it may end, is below ``TOLERANCE``; each step leaves
at most ``DAMPING`` of it, so the number of steps follows from the seeds.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null html links to nothing; a page that links twice
to a host counts once; links to the own host are dropped; repeated rows stay
repeated; a null page_id is kept; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_table, settle, write_table

#: (verdict, host, path), as dealt.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-6, 0.5
#: Lineage is cut each so many steps.
SETTLE_STEPS = 5
#: Every run of white space is taken by one possessive part, so no run is tried in two ways.
LINK = r"""(?i)href\s*+=\s*+(?:["']\s*+)?+[a-z][a-z0-9+.-]*://([^/?#"'\s<>]+)"""


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))).otherwise("")


def path_of(url):
    """After the host up to ``?``, ``#`` or the end; else empty."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host, path, rules=RULES):
    """The longest fitting rule as (rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer rules win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of host ``src`` that link to host ``dst``."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), ascii_lower))).alias("dst"))
    return links.where("dst <> host and host <> ''").groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): (1 - damping) * seed + damping * what the links bring, no rank off by more than ``tolerance``.

    ``seeds``: (host, seed); ``links``: (src, dst, n), shared out in proportion to n.
    """
    spark = links.sparkSession
    out_sum = links.groupBy("src").agg(F.sum("n").alias("total"))
    share = settle(links.join(out_sum, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w")), "shares")
    reached = share.select("dst").distinct().count()
    start = seeds.where("seed > 0").select("host", (F.col("seed") * (1 - damping)).alias("rank"))
    ranks = wave = settle(start, "seeds")  # the series: seed, seed over one link, over two, ...
    done, step = [], 0
    while reached and (wave.agg(F.sum("rank")).first()[0] or 0.0) * damping / (1 - damping) > tolerance:
        brought = wave.join(share, wave["host"] == share["src"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("w")) * damping).alias("rank"))
        done.append(write_table(brought, "wave", reached))
        wave, step = spark.read.parquet(done[-1]), step + 1
        ranks = ranks.unionByName(wave)
        if step % SETTLE_STEPS == 0:
            ranks = settle(ranks.groupBy("host").agg(F.sum("rank").alias("rank")), "ranks")
            for path in done[:-1]:  # the last is still the wave
                drop_table(spark, path)
            done = done[-1:]
    return ranks.groupBy("host").agg(F.sum("rank").alias("rank"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    own = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    own = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.col("r.verdict")
    hosts = own.where("host <> ''").groupBy("host").agg(F.avg(F.coalesce((verdict == "allow").cast("double"), F.lit(0.0))).alias("allowed"), F.avg(F.coalesce((verdict == "block").cast("double"), F.lit(0.0))).alias("blocked"))
    # Pages of no host are kept aside: they never meet in a join.
    hosts, links = settle(hosts, "hosts"), settle(host_links(own), "host-links")
    trust = propagate(hosts.select("host", F.col("allowed").alias("seed")), links, damping, tolerance).withColumnRenamed("rank", "trust")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(hosts.select("host", F.col("blocked").alias("seed")), back, damping, tolerance).withColumnRenamed("rank", "distrust")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    ranks = settle(hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", zero("trust"), zero("distrust")), "host-ranks")
    shown = own.select("page_id", "host", "path", "r")
    unranked = shown.where("host = ''").withColumns({"trust": F.lit(None).cast("double"), "distrust": F.lit(None).cast("double")})
    judged = shown.where("host <> ''").join(ranks, "host", "left").select("page_id", "host", "path", "r", "trust", "distrust").unionByName(unranked.select("page_id", "host", "path", "r", "trust", "distrust"))
    low = F.coalesce(F.col("distrust") - F.col("trust") >= threshold * (1 - damping), F.lit(False))
    final = F.coalesce(F.col("r.verdict"), F.when(low, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), final.alias("verdict"), zero("trust"), zero("distrust"))
