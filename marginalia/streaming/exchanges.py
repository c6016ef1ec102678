"""The review of exchanges as a stream: each batch is reviewed once, in order, and errors come out at the flush.

A reviewer turns a batch of exchanges into proposals. What it makes of a batch is put in
place whole, under the batch's number, before the stream's checkpoint moves on. A restart
that gives a batch again finds its number taken and leaves it, so nothing is repeated; a
batch whose review failed has no table and is given again, so nothing is lost.

Defined cases: an empty batch has an empty table; a null user or assistant text is an
empty one; exchanges of one batch keep their order by (``seq``); a reviewer's error ends
the stream and is raised by :func:`flush`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.tables import Folder

EXCHANGE = "seq bigint, user string, assistant string"


def _name(batch: int) -> str:
    return f"batch-{batch:012d}"


def review_stream(exchanges: DataFrame, review: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, on_written: Callable[[int], None] = lambda batch: None) -> StreamingQuery:
    """Start reviewing a stream of exchanges (``EXCHANGE``) into tables under ``path``.

    ``review`` takes (seq, user, assistant) of a batch and gives proposals with their
    ``seq``. ``on_written`` is called once a batch's table is in place.
    """
    spark = exchanges.sparkSession

    def sink(batch: DataFrame, number: int) -> None:
        folder = Folder(spark, path)
        if _name(number) not in folder.names():
            rows = batch.select("seq", *(F.coalesce(c, F.lit("")).alias(c) for c in ("user", "assistant")))
            try:
                folder.publish(review(rows).withColumn("batch", F.lit(number).cast("long")), _name(number))
            except FileExistsError:
                pass  # an earlier run of the same batch was slower than its restart
        on_written(number)

    return exchanges.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def flush(query: StreamingQuery) -> None:
    """Wait until all that is there has been reviewed; raises what a review raised."""
    query.processAllAvailable()
    if query.exception() is not None:
        raise query.exception()


def proposals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All proposals so far (``schema`` and ``batch``), of whole batches only."""
    folder = Folder(spark, path)
    out = spark.createDataFrame([], f"{schema}, batch bigint")
    for name in folder.names():
        out = out.unionByName(folder.read(name))
    return out
