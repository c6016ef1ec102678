"""Shared plumbing: durable intermediate tables, component search, small helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that the text contracts strip and split on.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in a file of a small intermediate table.
ROWS_A_FILE = 1_000_000


def work_dir(spark: SparkSession) -> str:
    """The folder that every executor shares, from ``spark.checkpoint.dir``.

    Without the setting one is made only for a driver that is its own executor;
    on a cluster a folder of each machine would lose rows without an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/marginalia-checkpoints"


def write_table(df: DataFrame, name: str, rows: int | None = None) -> str:
    """Write ``df`` as Parquet in the shared folder and return its path.

    A written table cuts the lineage: if an executor is lost later, readers
    reread files instead of recomputing Python stages. With a bound on its
    ``rows``, a small table gets few files instead of one a partition.
    """
    path = f"{work_dir(df.sparkSession)}/marginalia/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.repartition(1 + rows // ROWS_A_FILE)
    df.write.parquet(path)
    return path


def settle(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written by :func:`write_table` and read back with its schema."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name, rows))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table nobody reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows while eager Python stages run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: bigint).

    Alternating large-star and small-star steps; every step ends in a written
    table, so the lineage stays one step long, and hub nodes meet their
    neighbours only in joins that adaptive execution can split.

    Returns (node, component): each node of an edge with the smallest node it
    reaches. Self-loops and repeated edges are ignored; no edges, no rows.
    """
    spark = edges.sparkSession
    one = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = write_table(one, "edges")
    now, before = spark.read.parquet(path), None
    for _ in range(rounds):
        sign = _signature(now)
        if sign[0] == 0 or sign == before:
            break
        before, most = sign, 2 * sign[0]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large_path = write_table(large.where("a <> b").distinct(), "large-star", most)
        large = spark.read.parquet(large_path)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        )
        next_path = write_table(small.select("e.a", "e.b").where("a <> b").distinct(), "small-star", most)
        drop_table(spark, path)
        drop_table(spark, large_path)
        path, now = next_path, spark.read.parquet(next_path)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # Settled: every edge joins a node to the smallest node of its component.
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
