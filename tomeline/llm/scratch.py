"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tomeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Lets Spark delete an execution's shuffle files as it ends, rather than when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables under one folder of :func:`shared_dir`.

    ``table`` writes a DataFrame and reads it back, so that a lost executor costs no more than the
    tasks it ran. ``drop`` removes a table that nothing will read again; the others go when the
    interpreter ends, because a returned DataFrame may still read them.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{name}"
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)  # what it shuffled is of no use to later jobs, which read the table
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.path}/{name}")

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.path)
