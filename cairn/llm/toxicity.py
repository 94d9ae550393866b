"""Toxicity by cumulative-link ordinal regression on sparse word features.

One weight vector scores a text from the distinct words and beginnings of words it holds; ordered thresholds cut
the score into severity grades, P(grade <= k) = sigmoid(threshold_k - score), and the
expected grade is the severity.  Weights are shared across all thresholds.

Labels may be grades already.  Where they only say toxic or not, the toxic training texts
are graded 1 to 3 by how many indicative words they hold, in thirds.  The model is fit on
a bounded sample of labelled rows, about SAMPLE of them.  Words are 64-bit
hashes, and only those whose share differs clearly between toxic and other texts have a
weight, so that long texts gather no noise.

Defined results: null and empty texts have no feature and are not toxic; rows that
repeat a doc_id are scored by their own text; null labels are no labels; with no toxic
or no clean label nothing is toxic; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.store import Store, columns, session

SAMPLE = 12_000
#: Features: least z-score of a word's shares, most words with a weight, bytes of a beginning.
LEAST_Z, WORDS, HEAD = 5.0, 4096, 4
#: Grades made of a toxic label, the weight of a toxic text, ridge, and gradient steps.
GRADES, WEIGHT, RIDGE, STEPS = 3, 2.0, 1e-4, 400
#: A text is toxic if its chance of any grade is at least this.
TOXIC = 0.6


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the first bytes of longer words, and each row's offsets."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    words, at, heads = tv.word_hashes(*tv.buffers(pc.utf8_lower(column.fill_null(""))), tv.ALNUM, prefix=HEAD)
    return np.stack([words, heads], 1).ravel(), 2 * at  # a head of 0 stands for none


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """grade, a digest of the distinct words, and the words: 0, which stands for no beginning, is none."""
    for b in batches:
        h, at = features(b.column("text"))
        words = [np.unique(h[at[i] : at[i + 1]]) for i in range(b.num_rows)]
        words = [w[w != 0] for w in words]
        key = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words]
        yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(key, pa.binary()), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64()))], ["grade", "key", "words"])


def _columns(keys: np.ndarray):
    """Words to the numbers of those that have a weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [np.searchsorted(keys, w[np.isin(w, keys)]).astype(np.int16) for w in (np.asarray(x.values).view(tv.U) for x in b.column("words"))]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(cols, pa.list_(pa.int16()))], ["grade", "cols"])

    return run


class Ordinal:
    """Proportional-odds regression over binary features, by accelerated gradient steps."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int):
        grades = int(y.max())
        n, self.w = len(y), np.zeros(width)
        share = np.array([(y <= k).mean() for k in range(grades)]).clip(1e-3, 1 - 1e-3)
        self.cuts = np.log(share / (1 - share))
        weight = np.where(y > 0, WEIGHT, 1.0)
        weight /= weight.sum()
        m, v = np.zeros(width + grades), np.zeros(width + grades)
        for t in range(1, STEPS + 1):
            score = np.bincount(rows, self.w[cols], n)
            up, low = self._side(y, score, 0), self._side(y, score, -1)
            p = np.maximum(up - low, 1e-12)
            d_up, d_low = weight * up * (1 - up) / p, weight * low * (1 - low) / p  # of log p by each cut
            g_w = np.bincount(cols, (d_up - d_low)[rows], width) + RIDGE * self.w
            g_cut = np.array([d_low[y == k + 1].sum() - d_up[y == k].sum() for k in range(grades)])
            g = np.concatenate([g_w, g_cut])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            self.w -= step[:width]
            self.cuts = np.sort(self.cuts - step[width:])

    def _side(self, y: np.ndarray, score: np.ndarray, shift: int) -> np.ndarray:
        cuts = np.concatenate([[-40.0], self.cuts, [40.0]])
        return 1 / (1 + np.exp(np.clip(score - cuts[y + 1 + shift], -40, 40)))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None] - score[:, None], -40, 40)))


class Model:
    """keys: sorted hashes of the words with a weight, and whether each is indicative; rows: grades and word numbers."""

    def __init__(self, keys: np.ndarray, indicative: np.ndarray, grade: np.ndarray, rows: np.ndarray, cols: np.ndarray):
        self.keys, toxic = keys, grade > 0
        if grade.max() == 1:  # grades by the number of indicative words
            held = np.bincount(rows, indicative[cols], len(grade))[toxic]
            cuts = np.quantile(held, [i / GRADES for i in range(1, GRADES)])
            grade = grade.copy()
            grade[toxic] = 1 + (held[:, None] > cuts[None]).sum(axis=1)
        self.grades = np.unique(grade)  # as labelled; the regression sees 0, 1, 2 ...
        self.fit = Ordinal(rows, cols, np.searchsorted(self.grades, grade), len(keys))

    def score(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Weight sums of the distinct known words of each document."""
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == h)
        doc = np.searchsorted(at, hit, side="right") - 1
        once = np.unique(doc * len(self.keys) + place[hit])
        return np.bincount(once // len(self.keys), self.fit.w[once % len(self.keys)], len(at) - 1)


def fit(labelled: DataFrame) -> Model | None:
    """A model from labelled(doc_id, text, grade), SAMPLE rows of it at most in expectation.

    Words are counted and chosen where the texts are; the driver gets WORDS words at most,
    and of each text of the sample the numbers of those it holds.
    """
    store = Store(labelled.sparkSession, "toxicity")
    rows = labelled.select("grade", "text").mapInArrow(_distinct, "grade int, key binary, words array<long>")
    # Copies of a text count once, else their rare words look indicative.
    rows = store.put(rows.groupBy("key").agg(F.max(F.greatest("grade", F.lit(0))).alias("grade"), F.first("words").alias("words")), "words")
    toxic = (F.col("grade") > 0).cast("long")
    n1, n0 = rows.agg(F.coalesce(F.sum(toxic), F.lit(0)), F.coalesce(F.sum(1 - toxic), F.lit(0))).first()
    if not n1 or not n0:
        return None
    counts = rows.select(toxic.alias("t"), F.explode("words").alias("word")).groupBy("word").agg(F.sum("t").alias("c1"), F.sum(1 - F.col("t")).alias("c0"))
    p = (F.col("c1") + F.col("c0") + 1) / (n1 + n0 + 2)
    z = (F.col("c1") / n1 - F.col("c0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    told = counts.where("c1 + c0 >= 5").select("word", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "word").limit(WORDS).collect()
    if not told:
        return None
    keys, z = np.array([r.word for r in told], np.int64).view(tv.U), np.array([r.z for r in told])
    order = np.argsort(keys)
    keys, z = keys[order], z[order]
    table = rows.select("grade", "words").mapInArrow(_columns(keys), "grade int, cols array<short>").toArrow()
    grade, cols = table.column("grade").to_numpy().astype(np.int64), table.column("cols").combine_chunks()
    each = np.diff(cols.offsets.to_numpy())
    store.clear()
    return Model(keys, z > 0, grade, np.repeat(np.arange(len(grade)), each), cols.values.to_numpy())


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, grade of labelled documents, about *sample* of them chosen by hash; one label a doc_id, the largest."""
    own = columns(labels, doc_id="long", **{label: "int"}).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    share = min(1.0, sample / max(1, own.select(F.approx_count_distinct("doc_id", 0.02)).first()[0]))
    chosen = own.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share * 1_000_000).groupBy("doc_id").agg(F.max(label).alias("grade"))
    # The chosen labels number about `sample`, so the texts stay where they are.
    return columns(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")


def grade_texts(spark: SparkSession, docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, severity, p_toxic, toxic of every row of ``docs(doc_id, text)``."""
    session(spark)
    model = spark.sparkContext.broadcast(fit(labelled))  # at most WORDS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            severity, p = np.zeros(b.num_rows), np.zeros(b.num_rows)
            if own is not None and b.num_rows:
                above = own.fit.above(own.score(*features(b.column("text"))))
                severity, p = own.grades[0] + above @ np.diff(own.grades), above[:, 0]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(severity), pa.array(p), pa.array(p >= TOXIC)], ["doc_id", "severity", "p_toxic", "toxic"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")


def drop_toxic(spark: SparkSession, docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """*docs* without toxic rows; all columns stay and nothing is shuffled."""
    model = session(spark).sparkContext.broadcast(fit(labelled))  # at most WORDS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for b in batches:
            if own is not None and b.num_rows:
                b = b.filter(pa.array(own.fit.above(own.score(*features(b.column("text").cast(pa.string()))))[:, 0] < TOXIC))
            yield b

    return docs.mapInArrow(run, docs.schema)
