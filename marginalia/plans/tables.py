"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder for a local master and an error on a cluster."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/marginalia-checkpoints"


def settle(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet, with ``options`` of its writer, and read back: a short lineage that survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/marginalia/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamps(spark: SparkSession, path: str) -> tuple:
    """(name, length, modification time) of the files of a table, as its file system tells them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(at)))


class Folder:
    """A folder of named tables, each of which appears whole or not at all.

    A table is written under a name of its own and renamed into place. The rename
    fails where the name is taken, so of two writers of a name one succeeds.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Names of what is in place; unfinished writes are not."""
        own = [x.getPath().getName() for x in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []
        return sorted(n for n in own if not n.startswith("writing-"))

    def inside(self, name: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(name)))

    def publish(self, df: DataFrame, name: str, inside: str = "") -> None:
        """Put ``df`` in place as ``name`` (and in it as ``inside``); FileExistsError where the name is taken."""
        made = f"writing-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{made}/{inside}".rstrip("/"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._at(made), self._at(name), options)
        except Exception as error:
            self._fs.delete(self._at(made), True)
            if self._fs.exists(self._at(name)):
                raise FileExistsError(name) from error
            raise

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")
