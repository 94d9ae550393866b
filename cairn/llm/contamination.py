"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

Items and documents are sequences of words (lower case; letters, digits and non-ASCII
characters).  An item-sized window of a document matches if at most ``edits`` of the
item's words, a share rounded down, are edited.  The CGK random walk copies a window's
words and stays or steps on by random bits of the word, so that windows at a small edit
distance land at a small Hamming distance; bit-sampling LSH then compares a few places
of the walk, repeated with fresh walks until the target recall is reached, and an exact
edit distance confirms every candidate.

Before the walks, windows are dropped that share too few word pairs with every item of
their length: an edit breaks two pairs at most, so no match is lost.

Scale: documents are read once, in place, and only matches leave the workers.  What is
broadcast are the items, whose words are counted against a bound; more are taken in
several passes of bounded size, with the same result.  A worker builds a pass's tables
once, for all its tasks.

Defined results: null and empty texts match nothing; items that are null or without a
word are left out; items of fewer than five words match unedited, as a share of them is
no whole word; of items with equal words, in whatever pass, the smallest item_id stands;
repeated doc_ids match by row; extra columns are ignored; an empty table of documents or
items gives no match.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.store import columns, session

EDITS = 0.2
#: Sampled places of a walk, and the recall that repetitions must reach for the farthest match.
PLACES, RECALL = 3, 0.99
#: Words of all items that one pass carries to the workers (8 bytes each, and tables of that order).
PASS_WORDS = 1_000_000
FILTER_BITS = 22
#: Walks that are tried before the rest.
FIRST = 6


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the lower-cased texts, and each row's offsets."""
    column = pc.utf8_lower(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return tv.word_hashes(*tv.buffers(column), tv.ALNUM)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Words to insert, delete or replace; most + 1 stands for more than *most*."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if np.array_equal(a, b):
        return 0
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for i, w in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (b != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # insertions along the row
        if row.min() > most:
            return most + 1
    return int(min(row[-1], most + 1))


def walks(windows: np.ndarray, seeds: np.ndarray, steps: int) -> np.ndarray:
    """The first *steps* words of the CGK walks over equally long windows: (walks, windows, steps).

    A walk puts out the word it stands on and steps on if the word's bit for this walk and
    step says so; past the end it stands on zero.
    """
    count, n = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), tv.U)], axis=1).ravel()
    at = np.tile(np.arange(count) * (n + 1), (len(seeds), 1))
    end = np.arange(count) * (n + 1) + n
    out = np.empty((steps, len(seeds), count), tv.U)
    salt = tv.mix(seeds.astype(tv.U) * tv.U(0xD1342543DE82EF95))[:, None]
    for j in range(steps):
        w = padded[at]
        out[j] = w
        bit = ((w ^ salt) * tv.U(2 * j + 0x9E3779B97F4A7C15) >> tv.U(63)).astype(np.int64)
        at = np.minimum(at + bit, end)
    return out.transpose(1, 2, 0)


class Items:
    """The items of one pass with their filters and LSH tables."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], edits: float):
        self.edits = edits
        # A single word has no pairs; it is found by itself.
        self.single = sorted((int(w[0]), i) for i, w in zip(ids, texts, strict=True) if len(w) == 1)
        ids, texts = [i for i, w in zip(ids, texts, strict=True) if len(w) > 1], [w for w in texts if len(w) > 1]
        self.ids = ids
        self.by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, w in zip(ids, texts, strict=True):
            self.by_length.setdefault(len(w), []).append((i, w))
        self.lengths = np.array([len(w) for w in texts], np.int64)
        self.tables = {n: self._tables(n, [w for _, w in own]) for n, own in self.by_length.items()}
        # Which items have a word pair: a bit for each slot, then (slot, item) rows in order.
        rows = np.unique(np.concatenate([np.zeros((0, 2), np.int64)] + [np.stack([self.pair(w), np.full(len(w) - 1, k)], 1) for k, w in enumerate(texts)]), axis=0)
        self.slots, self.owners = rows[:, 0].copy(), rows[:, 1].copy()
        self.by_item = [np.unique(self.pair(w)) for w in texts]
        self.pairs = np.zeros(1 << FILTER_BITS, bool)
        self.pairs[self.slots] = True

    @staticmethod
    def pair(words: np.ndarray) -> np.ndarray:
        return (tv.mix(words[:-1] * tv.U(0x9FB21C651E98DF25) + words[1:]) >> tv.U(64 - FILTER_BITS)).astype(np.int64)

    def most(self, n: int) -> int:
        return int(self.edits * n)

    def repeats(self, n: int) -> int:
        """Walks needed: the farthest match keeps about (1 - 2 edits / n) of its places."""
        same = max(0.05, 1 - 2.5 * self.most(n) / n) ** PLACES
        return max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - min(same, 0.999))))

    def keys(self, windows: np.ndarray, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """(repetitions first..last-1, windows) keys of a few sampled places of each walk."""
        times = np.arange(first, self.repeats(n) if last is None else min(last, self.repeats(n)))
        places = np.stack([np.sort(np.random.default_rng((n, t)).choice(2 * n, PLACES, replace=False)) for t in times])
        walked = walks(windows, times + 1, int(places.max()) + 1)
        key = np.broadcast_to(times.astype(tv.U)[:, None], (len(times), len(windows)))
        for c in range(PLACES):
            key = tv.mix(key * tv.U(0x9FB21C651E98DF25) + walked[np.arange(len(times)), :, places[:, c]])
        return key

    def _tables(self, n: int, texts: list[np.ndarray]) -> list[dict[int, list[int]]]:
        out = []
        for key in self.keys(np.stack(texts), n):
            table: dict[int, list[int]] = {}
            for i, k in enumerate(key.tolist()):
                table.setdefault(k, []).append(i)
            out.append(table)
        return out

    def find(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item_id, first word, words, edits): the best window of each item in each document."""
        out = self._singles(hashes, at)
        if len(hashes) < 2 or not len(self.ids):
            return out
        inside = np.ones(len(hashes) - 1, bool)
        inside[at[(at > 0) & (at < len(hashes))] - 1] = False  # pairs that cross documents
        slot = self.pair(hashes)
        hits = np.flatnonzero(self.pairs[slot] & inside)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        lo, hi = np.searchsorted(self.slots, slot[hits]), np.searchsorted(self.slots, slot[hits], side="right")
        each = hi - lo
        owner = self.owners[np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        place = np.repeat(hits, each)
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order]
        # Windows of an item's length with at least `need` of its pairs: from a hit to the need-th after it.
        n = self.lengths[owner]
        need = np.maximum(1, n - 1 - 2 * (self.edits * n).astype(np.int64))
        last = np.arange(len(owner)) + need - 1
        ok = last < len(owner)
        end = np.minimum(last, len(owner) - 1)
        ok &= (owner[end] == owner) & (place[end] - place <= n - 2)
        spans: dict[int, set[tuple[int, int]]] = {}
        for first, to, size, item in zip(place[ok].tolist(), place[end][ok].tolist(), n[ok].tolist(), owner[ok].tolist(), strict=True):
            spans.setdefault(size, set()).update((s, item) for s in range(max(0, to - (size - 2)), first + 1))
        for size, found in spans.items():
            start, item = np.array(sorted(found), np.int64).T
            doc = np.searchsorted(at, start, side="right") - 1
            # A window at a document's end may be short by the words edited away.
            stop = np.minimum(start + size, at[doc + 1])
            keep = stop - start >= size - self.most(size)
            rows = np.stack([start, stop, doc, item], 1)[keep]
            rows = rows[self._distinct(slot, rows, size)]
            for a in range(0, len(rows), 512):
                self._confirm(hashes, rows[a : a + 512], size, best)
        return out + [(d, i, s, k, e) for (d, i), (e, s, k) in best.items()]

    def _singles(self, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Items of one word: the first place in each document that holds it."""
        if not self.single or not len(hashes):
            return []
        keys = np.array([k for k, _ in self.single], tv.U)
        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hits = np.flatnonzero(keys[place] == hashes)
        doc = np.searchsorted(at, hits, side="right") - 1
        _, first = np.unique(doc * len(keys) + place[hits], return_index=True)
        return [(int(doc[f]), self.single[place[hits[f]]][1], int(hits[f]), 1, 0) for f in first]

    def _distinct(self, slot: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Whether a window has enough different pairs of its item: text that repeats a pair has not."""
        out = np.zeros(len(rows), bool)
        for item in np.unique(rows[:, 3]):
            own = self.by_item[item]
            at = np.flatnonzero(rows[:, 3] == item)
            for a in range(0, len(at), 4096):
                part = at[a : a + 4096]
                places = rows[part, :1] + np.arange(n - 1)
                seen = slot[np.minimum(places, len(slot) - 1)]
                mine = own[np.minimum(np.searchsorted(own, seen), len(own) - 1)] == seen
                seen = np.sort(np.where(mine & (places < rows[part, 1:2] - 1), seen, -1), axis=1)
                found = (seen[:, 1:] != seen[:, :-1]).sum(1) + (seen[:, 0] >= 0)
                out[part] = found >= max(1, n - 1 - 2 * self.most(n)) - (n - 1 - len(own))
        return out

    def _confirm(self, hashes: np.ndarray, rows: np.ndarray, n: int, best: dict) -> None:
        """Candidates by the first walks, then by all, but for windows whose item already stands there unedited."""
        for first, last in ((0, FIRST), (FIRST, self.repeats(n))):
            rows = rows[[best.get((d, self.ids[i]), (1,))[0] > 0 for d, i in rows[:, 2:].tolist()]] if len(rows) else rows
            if not len(rows) or first >= last:
                return
            places = rows[:, :1] + np.arange(n)
            windows = np.where(places < rows[:, 1:2], hashes[np.minimum(places, len(hashes) - 1)], tv.U(0))
            pairs = {(w, i) for t, key in enumerate(self.keys(windows, n, first, last), first) for w, k in enumerate(key.tolist()) for i in self.tables[n][t].get(k, ())}
            own = self.by_length[n]
            # The windows that look most like the item come first, so that the rest end soon.
            for _, w, i in sorted((-int((windows[w] == own[i][1]).sum()), w, i) for w, i in pairs):
                item, text = own[i]
                start, stop, doc, _ = rows[w].tolist()
                mine = best.get((doc, item))
                most = self.most(n) if mine is None else mine[0] - 1
                if most >= 0 and (e := edit_distance(hashes[start:stop], text, most)) <= most:
                    best[doc, item] = (e, start, stop - start)


_built: dict[str, Items] = {}


def _items(name: str, words: Broadcast, edits: float) -> Items:
    """The tables of a pass, built once in each worker, which keeps the last one alone."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(*words.value, edits)
    return _built[name]


def _search(name: str, words: Broadcast, edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(name, words, edits)
        for b in batches:
            hashes, at = words_of(b.column("text").fill_null(""))
            found = items.find(hashes, at)
            doc = np.array([f[0] for f in found], np.int64)
            cols = [b.column("doc_id").take(pa.array(doc, pa.int64()))]
            for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.int32())):
                cols.append(pa.array([f[k] - (int(at[f[0]]) if k == 2 else 0) for f in found], kind))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "first_word", "n_words", "edits"])

    return run


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, edits: each item's best window in each document that holds it."""
    session(spark)
    docs = columns(docs, doc_id="long", text="string")
    out: DataFrame | None = None
    for name, words in passes(columns(items, item_id="long", text="string")):
        found = docs.where("text is not null").mapInArrow(_search(name, words, edits), "doc_id long, item_id long, first_word long, n_words int, edits int")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, first_word long, n_words int, edits int")


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes, at = words_of(b.column("text").fill_null(""))
        words = [hashes[at[i] : at[i + 1]] for i in range(b.num_rows)]
        keys = [hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None for w in words]
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(keys, pa.binary()), pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64()))], ["item_id", "key", "words"])


def passes(items: DataFrame) -> Iterator[tuple[str, Broadcast]]:
    """(name, (ids, words)) of items in blocks of at most PASS_WORDS words; of equal words the smallest id."""
    worded = items.where("item_id is not null").mapInArrow(_worded, "item_id long, key binary, words array<long>").where("key is not null")
    once = worded.groupBy("key").agg(F.min("item_id").alias("item_id"), F.first("words").alias("words")).orderBy("item_id")
    ids: list[int] = []
    texts: list[np.ndarray] = []
    size = 0

    def block() -> tuple[str, Broadcast]:
        return uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast((list(ids), list(texts)))  # PASS_WORDS words, or one item

    for row in once.toLocalIterator():
        words = np.array(row.words, np.int64).view(tv.U)
        if texts and size + len(words) > PASS_WORDS:
            yield block()
            ids, texts, size = [], [], 0
        ids.append(row.item_id), texts.append(words)
        size += len(words)
    if texts:
        yield block()


def _without(name: str, words: Broadcast, edits: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(name, words, edits)
        for b in batches:
            if b.num_rows:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in items.find(*words_of(b.column("text").cast(pa.string()).fill_null("")))]] = False
                b = b.filter(pa.array(keep))
            yield b

    return run


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, edits: float = EDITS) -> DataFrame:
    """*docs* without the rows that hold a benchmark item; all columns stay and nothing is shuffled."""
    session(spark)
    for name, words in passes(columns(items, item_id="long", text="string")):
        docs = docs.mapInArrow(_without(name, words, edits), docs.schema)
    return docs
