"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

Documents come in batches, the largest doc_ids first.  A batch's line hashes, one row a
key with the number of its documents and the largest of them, are merge-anti-joined with
the runs so far: what is new was met in its largest document, what is not only adds to
the count.  Both go into a new sorted run; when a level has FANOUT runs they are merged
into one run of the next level.  The last compaction gives every key its count and its
keeper, and lines of keys in enough documents go everywhere else.

A key is hashed to 64 + 32 bits with its length.  Only hashes are shuffled to find the
keys; texts meet their dropped line numbers in one equi-join.

Defined results: null or empty text is one empty line; a doc_id in several rows counts
as one document, and a null doc_id as one document of its own; repeated lines within a
document count once and go or stay together; columns besides doc_id and text pass
through whatever their names, but for n_lines and n_dropped, which the result's own
replace; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.store import Store

BATCHES, FANOUT = 4, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    cut = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    # lower() is the faster one, and the same where all is ASCII.
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, _UPPER, _LOWER))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, row, pos, h1, h2 of every line whose key has at least *min_chars* code points."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    # A key is no longer than its line, so short lines need no key.
    keys = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return keys.select("doc", "row", "pos", F.xxhash64("key").alias("h1"), (F.hash("key").cast("long") * (1 << 24) + F.char_length("key") % (1 << 24)).alias("h2"))


class Runs:
    """Sorted runs (h1, h2, docs, last), by levels.

    All runs are dealt by key into the same buckets and sorted within each, so that a new
    batch meets them by merge joins that neither move nor sort a run: a task reads one
    bucket of each.  Only compaction deals the rows of its runs anew.
    """

    def __init__(self, store: Store, fanout: int = FANOUT):
        self.store, self.fanout = store, fanout
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged = self.store.put_bucketed(_merged(self.levels[level]), f"level{level + 1}", *KEY)
            self.store.drop(*self.levels[level])
            self.levels[level] = []
            self._push(level + 1, merged)

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in batch(h1, h2, doc); returns its new keys, those that no run had (to be read before the next batch)."""
        own = batch.select(*KEY, "doc").distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("last"))
        own = self.store.put_bucketed(own, "batch", *KEY)
        seen = self._all()
        if not seen:
            self._push(0, own)
            return own
        new = own
        for run in seen:
            new = new.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        new = self.store.put_bucketed(new, "new", *KEY)
        # Keys met before only add to the count; their keeper is in an earlier run.
        fresh = new.select(*KEY, F.lit(True).alias("fresh")).hint("merge")
        rows = own.join(fresh, KEY, "left").select(*KEY, "docs", F.when(F.col("fresh"), F.col("last")).alias("last"))
        self._push(0, self.store.put_bucketed(rows, "run", *KEY))
        self.store.drop(own)
        return new

    def compact(self) -> DataFrame:
        """All runs as one: every key with its documents and the largest of them."""
        return _merged(self._all())


def _merged(runs: list[DataFrame]) -> DataFrame:
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)
    return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """*docs* with text cut to the lines that stay, and n_lines, n_dropped."""
    store = Store(spark, "lines")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    hashed = store.put(hashed_lines(docs.select("doc_id", "text"), min_chars), "lines")
    low, high = hashed.agg(F.min("doc"), F.max("doc")).first()
    runs = Runs(store)
    if low is None:
        runs.add(hashed)
    else:
        step = max(1, -(-(high - low + 1) // BATCHES))
        for i in range(BATCHES):
            top = high - i * step
            if i == 0 or top >= low:
                inside = (F.col("doc") <= top) & (F.col("doc") > top - step)
                runs.add(hashed.where(inside | F.col("doc").isNull() if i == 0 else inside))
    common = store.put(runs.compact().where(F.col("docs") >= min_docs).select(*KEY, "last"), "common")
    cut = hashed.join(common, KEY).where(~F.col("doc").eqNullSafe(F.col("last")))
    # The input's columns travel under numbers, so that none of their names can clash.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    doc, text = names["doc_id"], F.coalesce(names["text"], F.lit(""))
    cut = cut.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    rows = docs.toDF(*names.values()).withColumn("own", F.xxhash64(text))
    both = rows.join(cut, rows[doc].eqNullSafe(cut.doc) & (rows.own == cut.row), "left")
    lines = F.split(text, "\n", -1)
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n"))
    n = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = {c: F.col(own) for c, own in names.items()} | {"text": kept, "n_lines": n, "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    return both.select(*[e.alias(c) for c, e in out.items()])
