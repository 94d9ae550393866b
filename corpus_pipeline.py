"""The training-data pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage gets what its predecessor kept, written as Parquet and read again.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import contamination, lines, minhash, packing, toxicity
from cairn.llm.queries import tokenizer_path
from cairn.llm.store import Store, read

#: No SQL: two stages are learned or packed by search; tests hold stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression rejects go."""
    return toxicity.drop_toxic(spark, docs, toxicity.labelled_texts(docs, read(spark, sf_dir, "labels"), "toxic"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    cut = lines.dedup_lines(spark, docs, min_chars=40, min_docs=5)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five words, similarity 0.8)."""
    gone = minhash.near_duplicates(spark, docs, k=5, threshold=80).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id == gone._gone, "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return contamination.decontaminate(spark, docs, read(spark, sf_dir, "benchmark"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in pieces with their sequence and offset."""
    return packing.pack(spark, docs, tokenizer_path(), packing.CAPACITY)


STAGES = [("toxicity", toxic), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("best-fit packing", best_fit)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    store, docs = Store(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
