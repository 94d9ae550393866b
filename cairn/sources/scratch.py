"""Tables that queries write and read again, below the folder that the driver and all workers share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of one run, deleted when the Python process ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/cairn-{what}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def put(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write *df* and read it again: its plan ends there."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
