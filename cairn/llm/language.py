"""Language identification by blended-spectrum string kernels with Nystroem landmarks.

A text's features are the hashed character n-grams (n = 1, 2, 3 together) that occur in
it; the kernel of two texts is the number of shared ones over the geometric mean of
their numbers.  Landmark texts of every language span the kernel space, and one-versus-
rest kernel ridge regression gives each language's weights.  Batches of texts are scored
as products of their presence matrix with the landmarks and the weights.

The model is fit on a bounded sample of labelled rows, SAMPLE a language and TEXTS in all
at most in expectation; all texts are read whole, in training and prediction.  What is
broadcast has at most 2**SPACE_BITS rows (n-grams) of MARKS numbers, or of one a language
where there are more languages than that: 0.5 GB at most for up to 480 languages, and 4
bytes for each n-gram that a landmark holds and language in practice.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no
labelled row all are; rows that repeat a doc_id are predicted alike by their text; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.store import columns, session

SPACE_BITS = 18
#: Labelled texts a language, and in all (the bound of the sample); landmarks a language, and in all; the ridge.
SAMPLE, TEXTS, LANDMARKS, MARKS, RIDGE = 400, 20_000, 24, 480, 1e-3
_letter = re.compile(r"[^\W\d_]")
_mark: list[np.ndarray] = []


def features(text: str) -> np.ndarray:
    """Sorted hashed n-grams of the whole text."""
    if not _mark:
        _mark.append(np.zeros(1 << SPACE_BITS, bool))
    mark = _mark[0]
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for a in range(0, len(c), tv.CHUNK):  # two characters over, so that no n-gram is lost between chunks
        part = c[a : a + tv.CHUNK + 2].astype(tv.U)
        h = part.copy()
        for n in (1, 2, 3):
            if n > 1:
                h = h[:-1] * tv.U(0x9FB21C651E98DF25) + part[n - 1 :]
            if len(h):
                mark[((h + tv.U(n)) * tv.U(0x9E3779B97F4A7C15) >> tv.U(64 - SPACE_BITS)).astype(np.int64)] = True
    out = np.flatnonzero(mark)
    mark[out] = False
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [features(t).astype(np.int32) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(out, pa.list_(pa.int32()))], ["lang", "grams"])


class Model:
    """Landmarks over their own n-grams, and a weight a landmark and language."""

    def __init__(self, langs: list[str], grams: list[np.ndarray]):
        self.langs = sorted(set(langs))
        # Every language has a landmark; beyond MARKS in all, each has as many as fit, one at least.
        marks: list[int] = []
        each = max(1, min(LANDMARKS, MARKS // len(self.langs)))
        by: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            by.setdefault(lang, []).append(i)
        for lang in self.langs:
            own = by[lang]
            marks += own[:: max(1, len(own) // each)][:each]
        used = np.unique(np.concatenate([grams[i] for i in marks]))
        self.row = np.full(1 << SPACE_BITS, -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.z = np.zeros((len(used), len(marks)), np.float32)
        for j, i in enumerate(marks):
            self.z[self.row[grams[i]], j] = 1 / np.sqrt(len(grams[i]))
        k = np.concatenate([self.kernel(grams[a : a + 64]) for a in range(0, len(grams), 64)]).astype(np.float64)
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None], 1.0, -1.0)
        # Every language weighs the same, however many texts it has.
        share = np.array([1 / len(by[x]) for x in self.langs])[np.searchsorted(self.langs, langs)]
        kw = k * (share / share.mean())[:, None]
        self.alpha = np.linalg.solve(kw.T @ k + RIDGE * len(k) * (k[marks] + 1e-6 * np.eye(len(marks))), kw.T @ y).astype(np.float32)

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Kernel values of a batch with all landmarks."""
        x = np.zeros((len(grams), len(self.z)), np.float32)
        for i, g in enumerate(grams):
            own = self.row[g]
            x[i, own[own >= 0]] = 1 / np.sqrt(max(1, len(g)))
        return x @ self.z

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        some = [i for i, t in enumerate(texts) if t and _letter.search(t)]
        for a in range(0, len(some), 32):
            part = some[a : a + 32]
            s = self.kernel([features(texts[i]) for i in part]) @ self.alpha
            p = np.exp(3 * (s - s.max(axis=1, keepdims=True)).astype(np.float64))
            p /= p.sum(axis=1, keepdims=True)
            for i, j, q in zip(part, s.argmax(axis=1).tolist(), p, strict=True):
                lang[i], score[i] = self.langs[j], float(q[j])
        return lang, score


def fit(spark: SparkSession, labelled: DataFrame) -> Model | None:
    """A model from labelled(doc_id, text, lang); a hash of doc_id chooses the sample."""
    counts = labelled.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    most = min(SAMPLE, max(1, TEXTS // len(counts)))
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, most / r["count"]))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < shares[F.col("lang")] * 1_000_000)
    table = chosen.select("lang", "text").mapInArrow(_featured, "lang string, grams array<int>").toArrow()
    if not table.num_rows:
        return None
    rows = sorted(((lang, g.values.to_numpy()) for lang, g in zip(table.column("lang").to_pylist(), table.column("grams"), strict=True)), key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    return Model([r[0] for r in rows], [r[1] for r in rows])


def identify(spark: SparkSession, docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score of every row of ``docs(doc_id, text)``."""
    session(spark)
    model = spark.sparkContext.broadcast(fit(spark, labelled))  # bounded by landmarks and n-gram space

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            lang, score = model.value.predict(texts) if model.value else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double")
