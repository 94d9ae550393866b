"""Quality by weak supervision: labeller accuracies by EM, posteriors train a linear scorer.

Overlapping heuristic labellers each call a text good, bad, or abstain.  What is counted
over all documents is how often each pattern of votes occurs, a table of bounded size;
expectation-maximisation on it gives the labellers' accuracies and every pattern's
posterior.  The posteriors of a bounded sample of documents then train a linear scorer
on hashed shape features (runs of character classes, repeated words), which scores all
documents and generalises beyond the labellers' cut-offs.

Defined results: null texts, empty ones and those without a word have quality 0 and are
not kept; rows that repeat a doc_id are scored by their own text; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.store import Store, columns

#: Documents in the scorer's training sample (in expectation), and its hashed features.
SAMPLE, FEATURES = 4000, 1 << 11
STEPS, RIDGE = 300, 1e-4
#: Character classes: 1 lower or non-ASCII, 2 upper, 3 digit, 4 blank, others each their own.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[0x61:0x7B] = 1
CLASS[0x80:] = 1
CLASS[0x41:0x5B] = 2
CLASS[0x30:0x3A] = 3
CLASS[[0x20, *range(0x09, 0x0E)]] = 4
#: Calls a text bad at or above the second number; the last labeller calls it good if all are below the first.
LABELLERS = {
    "symbols": (0.04, 0.12),  # share of characters that are neither letter, digit, blank nor . , ; : ' -
    "upper": (0.15, 0.5),  # share of letters that are capitals
    "repeats": (0.06, 0.2),  # share of words that equal the word before
    "marked_words": (0.15, 0.5),  # share of words that end in a mark other than . , ; :
    "bars": (0.02, 0.15),  # share of words that are a lone mark
    "sameness": (0.75, 0.92),  # 1 - distinct words / words, of texts with at least 20 words
    "ordinary": (0.0, 0.0),  # all of the above are low
}
_ORDINARY = np.zeros(256, bool)
_ORDINARY[[ord(c) for c in ".,;:'-"]] = True


def measures(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The labellers' measures of one whole text."""
    c, n = CLASS[data], len(words)
    mark = (c > 4) & ~_ORDINARY[data]
    letters = max(1, int(((c == 1) | (c == 2)).sum()))
    blank = c == 4
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    lone = mark[begins] & mark[ends] & (ends - begins < 3)
    same = 1 - len(np.unique(words)) / n if n >= 20 else np.nan
    return np.array([mark.mean(), (c == 2).sum() / letters, (words[1:] == words[:-1]).mean() if n > 4 else np.nan, (mark[ends] & ~lone).mean(), lone.mean(), same])


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 abstains."""
    low, high = np.array(list(LABELLERS.values())[:-1]).T
    known = ~np.isnan(m)
    with np.errstate(invalid="ignore"):
        return np.append(np.where((m >= high) & known, -1, 0), int(((m <= low) | ~known).all()))


def shapes(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashed shares of three runs of character classes, and the share of repeated words in place 0."""
    c = CLASS[data]
    c = c[np.concatenate([[True], c[1:] != c[:-1]])].astype(tv.U)
    c = np.concatenate([[tv.U(4)], c, [tv.U(4)]])
    h = (c[:-2] << tv.U(16)) | (c[1:-1] << tv.U(8)) | c[2:]
    out = np.bincount(1 + (tv.mix(h) % tv.U(FEATURES - 1)).astype(np.int64), minlength=FEATURES).astype(np.float64)
    out /= len(h) + 12  # short texts stay near the bias
    out[0] = (words[1:] == words[:-1]).mean() if len(words) > 1 else 0.0
    return np.sqrt(out)


def _texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = tv.buffers(b.column("text"))
    words, at = tv.word_hashes(data, offsets, tv.NOT_SPACE, tv.ASCII_LOWER)
    for i in range(b.num_rows):
        yield data[offsets[i] : offsets[i + 1]], words[at[i] : at[i + 1]]


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's count of every pattern of votes, as base-3 digits."""
    base = 3 ** np.arange(len(LABELLERS))
    total: dict[int, int] = {}
    for b in batches:
        for data, words in _texts(b):
            if len(words):
                p = int((votes(measures(data, words)) + 1) @ base)
                total[p] = total.get(p, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])


class Labels:
    """EM over pattern counts: P(good), and each labeller's chances of its votes given the class."""

    def __init__(self, counts: dict[int, int]):
        k = len(LABELLERS)
        self.patterns = np.array(sorted(counts), np.int64)
        n = np.array([counts[p] for p in self.patterns], np.float64)
        v = (self.patterns[:, None] // 3 ** np.arange(k)) % 3  # 0 bad, 1 abstains, 2 good
        self.prior = 0.8
        # Labellers are taken as better than chance to begin with, which fixes the classes' names.
        self.table = np.stack([np.tile([0.3, 0.6, 0.1], (k, 1)), np.tile([0.01, 0.49, 0.5], (k, 1))])  # class bad, good
        for _ in range(100):
            logs = np.stack([np.log(self.table[c][np.arange(k), v]).sum(1) for c in (0, 1)])
            logs += np.log([[1 - self.prior], [self.prior]])
            logs -= logs.max(0)
            q = np.exp(logs)
            q /= q.sum(0)
            self.good = q[1]
            self.prior = float(np.clip((n * q[1]).sum() / n.sum(), 0.01, 0.99))
            for c in (0, 1):
                for j in range(k):
                    t = np.array([(n * q[c])[v[:, j] == x].sum() + 1 for x in range(3)])
                    self.table[c, j] = t / t.sum()

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self.good[np.searchsorted(self.patterns, patterns)]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = 3 ** np.arange(len(LABELLERS))
    for b in batches:
        pattern, x = [], []
        for data, words in _texts(b):
            if len(words):
                pattern.append(int((votes(measures(data, words)) + 1) @ base))
                x.append(shapes(data, words).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array(x, pa.list_(pa.float32()))], ["pattern", "x"])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels, both classes of equal weight."""
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    weight = np.where(y >= 0.5, 0.5 / max(1, (y >= 0.5).sum()), 0.5 / max(1, (y < 0.5).sum())).astype(np.float32)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        err = (weight * (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y)).astype(np.float32)
        g = np.append(x.T @ err + RIDGE * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = (w - step[:-1]).astype(np.float32), bias - float(step[-1])
    return w, bias


def rate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, quality, kept of every row of ``docs(doc_id, text)``."""
    store = Store(spark, "quality")
    docs = columns(docs, doc_id="long", text="string")
    counted = store.put(docs.mapInArrow(_vote, "pattern long, n long"), "patterns")
    counts = {r.pattern: r.n for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # at most 3 ** labellers
    if not counts:
        return docs.select("doc_id", F.lit(0.0).alias("quality"), F.lit(False).alias("kept"))
    labels = Labels(counts)
    share = min(1.0, SAMPLE / sum(counts.values()))
    # By id and text, so that rows which share either are drawn apart; the limit bounds a table of equal rows.
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(1_000_000)) < share * 1_000_000).limit(4 * SAMPLE)
    table = chosen.mapInArrow(_train, "pattern long, x array<float>").toArrow()
    if not table.num_rows:  # thousands of rows of which the hash drew none: nearly all are alike
        table = docs.orderBy(F.xxhash64("doc_id", "text")).limit(SAMPLE).mapInArrow(_train, "pattern long, x array<float>").toArrow()
    if not table.num_rows:
        return docs.select("doc_id", F.lit(0.0).alias("quality"), F.lit(False).alias("kept"))
    y = labels.posterior(table.column("pattern").to_numpy())
    x = np.concatenate([c.flatten().to_numpy() for c in table.column("x").chunks]).reshape(len(y), FEATURES)
    w, bias = logistic(x, y) if (y >= 0.5).any() and (y < 0.5).any() else (np.zeros(FEATURES, np.float32), 4.0 if y.mean() >= 0.5 else -4.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = [float(1 / (1 + np.exp(-np.clip(shapes(d, words) @ w + bias, -30, 30)))) if len(words) else 0.0 for d, words in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(q, pa.float64()), pa.array([v >= 0.5 for v in q], pa.bool_())], ["doc_id", "quality", "kept"])

    return docs.mapInArrow(run, "doc_id long, quality double, kept boolean")
