"""Substring search from stored trigrams: they choose candidates, and the exact test decides.

A text that holds a needle holds all of its runs of three characters.  So of a needle's
trigrams the rarest are looked up, and only rows that have all of them are tested.  Needles
under three characters have none; they need the plain scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.exprs import ascii_lower
from cairn.sources.scratch import Scratch

SIZE = 3
#: Ids of a block; trigrams of a needle that are looked up; candidates that go into a scan's filter.
BLOCK_IDS, RAREST, MOST_IDS = 4096, 3, 1000
ROW_GROUP = 1 << 20
#: Trigrams that a task makes or sorts, about.
TASK_GRAMS = 1 << 21


def store_grams(path: str, texts: dict[str, DataFrame]) -> None:
    """Write ``postings(kind, gram, block, n, ids)`` of texts(id, text), by kind, sorted by kind, gram and block.

    An id counts once for a trigram, whatever its number of texts; ASCII letters are lower-cased.
    """
    rows = reduce(DataFrame.unionByName, [t.select(F.lit(kind).alias("kind"), "id", ascii_lower(F.col("text")).alias("text")) for kind, t in texts.items()])
    keep = Scratch(rows.sparkSession, "grams")
    rows = keep.put(rows.where(F.char_length("text") >= SIZE), "texts")
    # A text is some dozens of trigrams, so tasks are dealt out by those and not by bytes of texts.
    tasks = max(1, -(-(rows.agg(F.sum(F.char_length("text") - SIZE + 1)).first()[0] or 0) // TASK_GRAMS))
    # Texts of an id come together, so no trigram of it is told twice.
    own = rows.repartition(tasks, "kind", "id").groupBy("kind", "id").agg(F.collect_set("text").alias("texts"))
    grams = F.flatten(F.transform("texts", lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - SIZE + 1), lambda i: F.substring(t, i, F.lit(SIZE)))))
    own = own.select("kind", "id", F.floor(F.col("id") / BLOCK_IDS).alias("block"), F.explode(F.array_distinct(grams)).alias("gram"))
    blocks = own.repartition(tasks, "kind", "gram", "block").groupBy("kind", "gram", "block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    # Stored first, as finding the ranges reads them once more.
    blocks = keep.put(blocks, "blocks").repartitionByRange("kind", "gram", "block")
    blocks.sortWithinPartitions("kind", "gram", "block").write.option("parquet.block.size", ROW_GROUP).parquet(path)


@dataclass(frozen=True)
class Grams:
    """Stored trigrams, opened."""

    postings: DataFrame

    @staticmethod
    def open(spark: SparkSession, path: str) -> Grams:
        return Grams(spark.read.parquet(path))

    def candidates(self, kind: str, *parts: str) -> DataFrame | None:
        """Ids of the rows whose texts may hold all of the parts (lower case); None where no part has three characters."""
        wanted = sorted({p[i : i + SIZE] for p in parts for i in range(len(p) - SIZE + 1)})
        if not wanted:
            return None
        own = self.postings.where((F.col("kind") == kind) & F.col("gram").isin(wanted))
        counts = {r.gram: r.n for r in own.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a trigram of the needle
        if len(counts) < len(wanted):
            return own.where("false").select(F.lit(0).cast("long").alias("id"))
        chosen = sorted(wanted, key=lambda g: (counts[g], g))[:RAREST]
        ids = own.where(F.col("gram").isin(chosen)).select(F.explode("ids").alias("id"))
        return ids.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(chosen)).select("id")


def narrowed(rows: DataFrame, key: str, candidates: DataFrame | None) -> DataFrame:
    """*rows* whose key is a candidate; a few candidates go into the filter of the scan, more are joined."""
    if candidates is None:
        return rows
    few = [r.id for r in candidates.limit(MOST_IDS + 1).collect()]
    if len(few) <= MOST_IDS:
        return rows.where(F.col(key).isin(few))
    return rows.join(candidates.withColumnRenamed("id", key), key, "left_semi")
