"""Shared storage, session settings and input normalisation of the corpus operators.

Intermediate tables go below ``spark.checkpoint.dir``, the one folder that the
driver and every executor share.  Only when a local session has none (tests) is a folder
made and set; a cluster without that setting is refused.  A run's tables go when the
Python process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold; bounds a Python worker's memory when texts are long.
BATCH_ROWS = 256
#: Bytes that end a batch of fewer rows.
BATCH_BYTES = 16 << 20


def session(spark: SparkSession) -> SparkSession:
    """Set the Arrow batch size, as long texts need few rows in a batch, and how bucketed tables are read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    # Read bucketed tables in their order (each bucket is one file), so that merge joins need not sort them again.
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    # Spark 4.1 takes a union of bucketed tables for dealt by their key, but strings their column batches together.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local one is set only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, local, True)
        found = "file://" + local
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """Tables of one run, written below the shared folder and read again."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = session(spark)
        self.root = f"{shared_dir(spark)}/cairn-{what}-{uuid.uuid4().hex[:12]}"
        self._n, self._tables = 0, []
        atexit.register(self.clear)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write *df* and return it read again: a cut lineage that outlives executors."""
        self._n += 1
        path = f"{self.root}/{self._n}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cairn_path = path
        return out

    def put_bucketed(self, df: DataFrame, name: str, *key: str) -> DataFrame:
        """As put, dealt and sorted by *key*, so that joins on it need not move this table."""
        self._n += 1
        path, table = f"{self.root}/{self._n}-{name}", f"cairn_{uuid.uuid4().hex[:12]}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, *key).write.bucketBy(n, *key).sortBy(*key).option("path", path).format("parquet").saveAsTable(table)
        out = self.spark.table(table)
        out._cairn_path, out._cairn_table = path, table
        self._tables.append(table)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_cairn_path", None)
            if table := getattr(t, "_cairn_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

    def clear(self) -> None:
        """Delete all tables of the run, if the session is still there."""
        with contextlib.suppress(Exception):
            for table in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; extra columns, whatever their names, go no further."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in types.items()])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{table}.parquet")
