"""An append-only feed of revisions: checkouts by day as a stream (an extension of A11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.sources.scratch import Scratch


def activity(feed: DataFrame, lateness: str = "1 day") -> DataFrame:
    """day, count of feed(ts timestamp, physical_path, revision_type): each file once, late rows up to *lateness*.

    Works the same over a batch table, where all days are final at once.
    """
    own = feed.where("revision_type = 'DEVELOP'")
    own = own.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["physical_path"]) if feed.isStreaming else own.dropDuplicates(["physical_path"])
    days = own.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("count"))
    return days.select(F.date_format("w.start", "yyyyMMdd").alias("day"), "count")


def run_to_end(spark: SparkSession, feed: DataFrame, lateness: str = "1 day") -> DataFrame:
    """day, count after a streaming *feed* has been read to its present end.

    The query stops by itself when all that is there has been read; its state and its sink
    are below the shared folder.  Each batch adds the days that it changed, and a day's last
    row stands.  A batch that runs again writes its own folder again, so none counts twice.
    """
    keep = Scratch(spark, "activity")
    sink = keep.path("days")

    def add(days: DataFrame, batch: int) -> None:
        days.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    started = activity(feed, lateness).writeStream.outputMode("update").option("checkpointLocation", keep.path("state")).trigger(availableNow=True).foreachBatch(add).start()
    started.awaitTermination()
    days = spark.read.schema("day string, count long, batch long").option("basePath", sink).parquet(sink)
    last = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("batch")))
    return days.withColumn("_n", last).where("_n = 1").select("day", "count")
