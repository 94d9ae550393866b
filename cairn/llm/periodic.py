"""Periodic runs of words: a harmonic grid of longest common extensions.

A run is a longest stretch of words in which words *period* apart are identical, at least
twice as long as its smallest period and at least *min_words* long.  For each period p the
grid asks at the places 0, p, 2p, ... of a document how far words agree with those p
further on, forward and backward.  A run of period p holds two neighbouring places of p's
grid, so n/p questions a period, n ln n in all, find every run.  Each question is one range
minimum over the longest common prefixes of a suffix array, backward over those of the
reversed sequence.  Places whose own words differ need no question.

Scale: a document is worked on in one task, in about 150 bytes a word; nothing is
shuffled.  Documents of a batch share one pair of suffix arrays, in which every document
has words of its own, so that nothing agrees across documents.

Defined results: null and empty texts and texts without words have no runs and an empty
collapsed text; rows that repeat a doc_id, or have none, are each a document of its own;
columns besides doc_id and text go no further; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.store import columns, session

#: Words that share suffix arrays; a longer document has its own.
GROUP = 1 << 17
#: Grid places asked at once.
PLACES = 1 << 20
#: Values of a block of the range minima.
BLOCK = 16
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's place in the suffix array of dense *symbols*, and the common prefix of each with the one before.

    Ranks by prefixes of 1, 2, 4, ... symbols; only suffixes that still share theirs are
    sorted again.  Those ranks, from the longest prefixes down, then give common prefixes.
    """
    n = len(symbols)
    counts = np.bincount(symbols)
    rank = np.full(n + 1, -1, np.int64)  # the end ranks below all
    rank[:n] = (np.cumsum(counts) - counts)[symbols]
    tied, levels, span = np.flatnonzero(counts[symbols] > 1), [], 1
    while len(tied):
        levels.append(rank.astype(np.int32))
        key = rank[tied] * (n + 1) + rank[np.minimum(tied + span, n)] + 1
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        was = rank[tied]
        place = np.arange(len(tied))
        own = np.diff(key, prepend=-1) != 0
        before = np.diff(was, prepend=-1) != 0
        rank[tied] = was + place[own][np.cumsum(own) - 1] - place[before][np.cumsum(before) - 1]
        sizes = np.diff(np.append(place[own], len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        span *= 2
    rank = rank[:n]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    a, b, length = order[:-1], order[1:], common[1:]
    for k in reversed(range(len(levels))):
        length += (levels[k][np.minimum(a + length, n)] == levels[k][np.minimum(b + length, n)]).astype(np.int64) << k
    return rank, common.astype(np.int32)


class RangeMinimum:
    """Least of values[lo..hi]: running minima within blocks, and doubled spans of whole blocks between."""

    def __init__(self, values: np.ndarray):
        self.values = np.full(-(-max(len(values), 1) // BLOCK) * BLOCK, np.iinfo(values.dtype).max, values.dtype)
        self.values[: len(values)] = values
        blocks = self.values.reshape(-1, BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        spans = [blocks.min(axis=1)]
        while 2 ** len(spans) <= len(blocks):
            half, wide = 2 ** (len(spans) - 1), spans[-1].copy()
            wide[:-half] = np.minimum(wide[:-half], spans[-1][half:])
            spans.append(wide)
        self.spans = np.stack(spans)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        first, last = lo // BLOCK, hi // BLOCK
        out = np.minimum(self.since[lo], self.upto[hi])
        far = np.flatnonzero(last - first > 1)
        if len(far):
            a, b = first[far] + 1, last[far]
            k = np.frexp((b - a).astype(np.float64))[1] - 1
            between = np.minimum(self.spans[k, a], self.spans[k, b - (1 << k)])
            out[far] = np.minimum(out[far], between)
        near = np.flatnonzero(last == first)
        if len(near):
            at, end = lo[near], hi[near]
            least = self.values[at]
            for _ in range(BLOCK - 1):
                at = np.minimum(at + 1, end)
                least = np.minimum(least, self.values[at])
            out[near] = least
        return out


class CommonExtension:
    """How many symbols from places a and b on agree, for many pairs of different places."""

    def __init__(self, symbols: np.ndarray):
        self.rank, common = suffix_ranks(symbols)
        self.least = RangeMinimum(common)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.rank[a], self.rank[b]
        return self.least(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)


def _smallest_periods(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> list[np.ndarray]:
    """Of equal stretches the one with the smallest period, by start, then period."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = (np.diff(start, prepend=-1) != 0) | (np.diff(end, prepend=-1) != 0)
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return [start[order], end[order], period[order]]


def grid_runs(symbols: np.ndarray, bounds: np.ndarray, min_words: int = 12) -> list[np.ndarray]:
    """(start, end, period) of all runs of the documents symbols[bounds[i]:bounds[i + 1]], which share no symbol."""
    n, sizes = len(symbols), np.diff(bounds)
    half = sizes // 2
    if not half.any():
        return [np.zeros(0, np.int64)] * 3
    forward, backward = CommonExtension(symbols), CommonExtension(symbols[::-1])
    doc = np.repeat(np.arange(len(sizes)), half)
    periods = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(half) - half, half)
    places = (sizes[doc] - 1) // periods
    upto = np.cumsum(places)
    cuts = np.unique(np.append(np.searchsorted(upto, np.arange(PLACES, upto[-1], PLACES)), len(doc)))
    found, lo = [], 0
    for hi in cuts:
        if hi == lo:
            continue
        part = places[lo:hi]
        step = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        p = np.repeat(periods[lo:hi], part)
        i = np.repeat(bounds[doc[lo:hi]], part) + step * p
        lo = hi
        same = symbols[i] == symbols[i + p]
        i, p = i[same], p[same]
        on = forward(i, i + p)
        back = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        back[inner] = backward(n - i[inner], n - i[inner] - p[inner])
        run = (on + back >= p) & (on + back + p >= min_words)
        i, p, on, back = i[run], p[run], on[run], back[run]
        found.append(_smallest_periods(i - back, i + p + on, p))
    return _smallest_periods(*[np.concatenate(c) for c in zip(*found)])


def _documents(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """(doc_id, words) of the rows, in groups."""
    group, size = [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary())):
        words = (text.as_py() or b"").split()  # splits bytes at ASCII white space alone
        if group and size + len(words) > GROUP:
            yield group
            group, size = [], 0
        group.append((doc_id, words))
        size += len(words)
    if group:
        yield group


def _symbols(group: list[tuple]) -> np.ndarray:
    """Dense numbers of the words; no two documents share one."""
    parts, base = [], 0
    for _, words in group:
        ids: dict[bytes, int] = {}
        parts.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) + base)
        base += len(ids)
    return np.concatenate(parts)


def _find(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _documents(batch):
                bounds = np.cumsum([0] + [len(words) for _, words in group])
                start, end, period = grid_runs(_symbols(group), bounds, min_words)
                cover = np.zeros(bounds[-1] + 1, np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, end, -1)
                stays = np.cumsum(cover) == 0
                at = np.searchsorted(start, bounds)
                collapsed = []
                for i, (_, words) in enumerate(group):
                    kept = compress(words, stays[bounds[i] : bounds[i + 1]].tolist()) if at[i] < at[i + 1] else words
                    collapsed.append(b" ".join(kept))
                own = np.repeat(bounds[:-1], np.diff(at))
                rows = pa.StructArray.from_arrays([pa.array(start - own), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in group], pa.int64()), runs, texts], ["doc_id", "runs", "collapsed"])

    return run


def find_runs(spark: SparkSession, docs: DataFrame, min_words: int = 12) -> DataFrame:
    """doc_id, runs(start, length, period) by start and period, and collapsed: the words without those that a run repeats after its first period."""
    session(spark)
    return columns(docs, doc_id="long", text="string").mapInArrow(_find(min_words), SCHEMA)
