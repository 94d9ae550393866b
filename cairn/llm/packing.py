"""Best-fit packing of token pieces into fixed sequences by bin completion.

Tokens are counted where the texts are; what packing needs of them is one number for
each length from 1 to the capacity, a table of fixed size however many documents there
are.  On it a branch-and-bound search by bin completion runs: take the largest
remaining piece, enumerate the undominated fillings of the space beside it, and prune
what wastes more than the best known solution allows.  Best-fit solutions are the
incumbents.  The search is the same for any number of pieces, and it says whether its
packing is proved to be best or how far from the bound it may be.  The answer is a list of patterns with multiplicities; every piece then
finds its sequence and offset from its rank among the pieces of its length, row by row.

Defined results: null text is empty and packs as its closing id 0 alone; repeated
doc_ids are packed once a row; extra columns are ignored; an empty table gives an
empty result.  Texts are tokenized whole, whatever their length.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.store import Store, columns

CAPACITY = 2048
#: Fillings that the branch-and-bound tries before its best incumbent stands, and from one to the next best-fit of the rest.
NODES, TAIL = 12_000, 256
#: Words that a tokenizing worker remembers before it starts anew, and the size of its lookup tables.
WORDS, SLOT_BITS = 1_000_000, 20

Pattern = tuple[int, ...]


# -- bin completion --------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> dict[Pattern, int]:
    """Best-fit decreasing over a histogram: {pattern: times}; equal bins move together."""
    open_: dict[int, Counter] = defaultdict(Counter)  # free space -> patterns
    free: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = bisect.bisect_left(free, length)
        while left and at < len(free):
            room = free[at]
            fits = room // length
            bins = open_[room]
            for pattern in list(bins):
                if left < fits:
                    break
                use = min(bins[pattern], left // fits)
                bins[pattern] -= use
                if not bins[pattern]:
                    del bins[pattern]
                left -= use * fits
                _open(open_, free, room - fits * length, pattern + (length,) * fits, use)
            if left and left < fits and bins:
                pattern = next(iter(bins))
                bins[pattern] -= 1
                if not bins[pattern]:
                    del bins[pattern]
                _open(open_, free, room - left * length, pattern + (length,) * left, 1)
                left = 0
            if not bins:
                del open_[room]
                free.remove(room)
            at = bisect.bisect_left(free, max(length, room + 1 if bins else length)) if left else at
        fits = capacity // length
        if left >= fits:
            _open(open_, free, capacity - fits * length, (length,) * fits, left // fits)
            left %= fits
        if left:
            _open(open_, free, capacity - left * length, (length,) * left, 1)
    out: Counter = Counter()
    for bins in open_.values():
        out.update(bins)
    return dict(out)


def _open(open_: dict, free: list[int], room: int, pattern: Pattern, times: int) -> None:
    if room not in open_:
        bisect.insort(free, room)
    open_[room][pattern] += times


def fillings(lengths: list[int], counts: dict[int, int], room: int, most: int) -> Iterator[Pattern]:
    """Undominated sets of lengths that fit in *room* and leave at most *most* of it, fullest first, one by one.

    A set is dominated if one of its members can be swapped for a larger piece that is
    still there, or another piece added, without overflowing.  Sums that the lengths from
    each place on can reach, as bits, lead the way, so no step of it is in vain.
    """
    lengths = [n for n in lengths if n <= room and counts[n]]  # descending
    mask = (1 << (room + 1)) - 1

    def sums_of(lengths: list[int]) -> list[int]:
        reach = [1]
        for n in reversed(lengths):
            sums, left, step = reach[-1], min(counts[n], room // n), 1
            while left:
                take = min(step, left)
                sums |= (sums << (take * n)) & mask
                left, step = left - take, 2 * step
            reach.append(sums)
        return reach[::-1]

    def of(i: int, total: int) -> Iterator[Pattern]:
        if not total:
            yield ()
            return
        for j in range(bisect.bisect_left(lengths, -total, lo=i, key=lambda n: -n), len(lengths)):
            n = lengths[j]
            for k in range(min(counts[n], total // n), 0, -1):
                if reach[j + 1] >> (total - k * n) & 1:
                    for rest in of(j + 1, total - k * n):
                        yield (n,) * k + rest

    def undominated(chosen: Pattern, waste: int) -> bool:
        used = Counter(chosen)
        return not any(counts[n] > used[n] for c in used for n in range(c + 1, c + waste + 1) if n in counts)

    reach, small = sums_of(lengths), ()
    for waste in range(0, min(most, room) + 1):
        # Whatever fits beside the others must be among them, all of it.
        while lengths and lengths[-1] <= waste:
            small = (lengths[-1],) * counts[lengths[-1]] + small
            reach = sums_of(lengths := lengths[:-1])
            if sum(small) > room - waste:
                return
        total = room - waste - sum(small)
        if total >= 0 and reach[0] >> total & 1:
            for chosen in of(0, total):
                if undominated(chosen + small, waste):
                    yield chosen + small


class Packing(NamedTuple):
    """Patterns with their times, the least number of bins that any packing needs, whether no packing has fewer
    bins than this one for certain, and how many fillings the search has tried."""

    patterns: dict[Pattern, int]
    bound: int
    proved: bool
    tried: int


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> Packing:
    """The histogram packed by bin completion, into no more bins than best-fit takes.

    The largest piece left gets each undominated filling in turn; a filling goes into as
    many bins as its pieces last for, and on the way back into one.  A branch ends when it
    wastes more than an improvement may, or a bound on the rest says so.  Best-fit of what
    is left gives incumbents.  The search ends when the bound on all bins is met, when all
    branches are done, or when *nodes* fillings were tried.
    """
    counts = Counter({n: c for n, c in counts.items() if c})
    total, bound = sum(n * c for n, c in counts.items()), lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins, own, tried = sum(best.values()), False, 0

    def children(left: Counter[int], wasted: int) -> Iterator[tuple[Pattern, int]]:
        top = max(n for n, c in left.items() if c)
        rest = Counter({n: c for n, c in left.items() if c})
        rest[top] -= 1
        lengths = sorted((n for n, c in rest.items() if c), reverse=True)
        # A solution of the search's own may be as good as the first incumbent; later ones must be better.
        spare = (bins - own) * capacity - total - wasted
        for filling in fillings(lengths, rest, capacity - top, max(0, spare)):
            pattern = (top, *filling)
            times = min(left[n] // c for n, c in Counter(pattern).items())
            yield pattern, times
            if times > 1:
                yield pattern, 1

    # The way from the root: its steps, and how many children of each node on it were tried.  One table of what is
    # left goes down and up with it; a node's fillings are listed anew on the way back.
    left, used, wasted, pieces = counts.copy(), 0, 0, sum(counts.values())
    done: list[tuple[Pattern, int]] = []
    turns, more = [0] if counts else [], None
    while turns and tried < nodes and (bins > bound or not own):
        if more is None:
            more = children(left, wasted)
            for _ in range(turns[-1]):
                next(more, None)
        step = next(more, None)
        turns[-1] += 1
        back = step is None
        if not back:
            tried += 1
            pattern, times = step
            for n in pattern:
                left[n] -= times
            done.append(step)
            used, wasted, pieces = used + times, wasted + times * (capacity - sum(pattern)), pieces - times * len(pattern)
            if not pieces:
                if used < bins + (not own):
                    best, bins, own = dict(_sum(done)), used, True
            elif wasted <= (bins - own) * capacity - total and used - (-(total - used * capacity + wasted) // capacity) <= bins - own:
                if tried % TAIL == 0:
                    tail = best_fit({n: c for n, c in left.items() if c}, capacity)
                    if used + sum(tail.values()) < bins:
                        best, bins, own = dict(_sum([*done, *tail.items()])), used + sum(tail.values()), True
                turns.append(0)
                more = None
                continue
        else:
            turns.pop()
            more = None
        if done and (turns or not back):
            pattern, times = done.pop()
            for n in pattern:
                left[n] += times
            used, wasted, pieces = used - times, wasted - times * (capacity - sum(pattern)), pieces + times * len(pattern)
    return Packing(best, bound, bins == bound or not turns, tried)


def _sum(steps: Iterable[tuple[Pattern, int]]) -> Counter:
    out: Counter = Counter()
    for pattern, times in steps:
        out[tuple(sorted(pattern, reverse=True))] += times
    return out


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any solution needs: by total length, and by pieces of over half a bin with what fits no such bin."""
    out = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in {capacity - n + 1 for n in counts if 2 * n > capacity} | {capacity // 2 + 1}:
        if 2 * k > capacity:  # pieces of at least k fill a bin with nothing of at least capacity - k + 1
            k = capacity - k + 1
        big = sum(c for n, c in counts.items() if n > capacity - k)
        mid = [(n, c) for n, c in counts.items() if capacity // 2 < n <= capacity - k]
        low = sum(n * c for n, c in counts.items() if k <= n <= capacity // 2)
        spare = sum((capacity - n) * c for n, c in mid)
        out = max(out, big + sum(c for _, c in mid) + max(0, -(-(low - spare) // capacity)))
    return out


def slots(patterns: dict[Pattern, int]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, times, first sequence, offset, each) rows: where the pieces of a length go.

    Ranks first .. first + times * each - 1 go to sequences first_seq .. first_seq + times - 1,
    ``each`` to a sequence, from ``offset`` on.
    """
    out, used, seq = [], Counter(), 0
    for pattern in sorted(patterns, reverse=True):
        times, offset = patterns[pattern], 0
        for n, each in sorted(Counter(pattern).items(), reverse=True):
            out.append((n, used[n], times, seq, offset, each))
            used[n] += times * each
            offset += n * each
        seq += times
    return out


# -- tokens ----------------------------------------------------------------------------


class WordTokens:
    """Token ids of whole texts, by words between ASCII white space.

    The tokenizer drops white space and never merges across it, so a text's ids are those
    of its words in order.  Words are hashed and looked up together; only words not seen
    before are tokenized: those of Latin letters, then ASCII punctuation, through the same
    merges as byte ranks, where END marks the end of a word; all others by the tokenizer.
    """

    _plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
    END = "\x01"

    def __init__(self, path: str):
        import json
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, byte, end = spec["model"]["end_of_word_suffix"], _byte_symbols(), self.END.encode()
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in special:
                stem = token.removesuffix(suffix)
                ranks[bytes(byte[c] for c in stem) + (end if stem != token else b"")] = i
        self._ends = np.zeros(max(ranks.values()) + 1, bool)
        self._ends[[i for t, i in ranks.items() if t.endswith(end) and len(t) > 1]] = True
        self._bpe = tiktoken.Encoding("words", pat_str=f"[^{self.END}]+{self.END}", mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        """Entry 0 is the id 0 that closes a document; tables give entries by parts of a word's hash."""
        self._tables = [np.zeros(1 << SLOT_BITS, np.int32) for _ in range(3)]
        self._keys, self._start, self._size = np.zeros(1024, tv.U), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self._flat, self._used, self._n = np.zeros(4096, "<u4"), 1, 1
        self._size[0] = 1

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> tv.U(k * SLOT_BITS)) & tv.U((1 << SLOT_BITS) - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        out = self._tables[0][self._slot(h, 0)].astype(np.int64)
        wrong = np.flatnonzero((self._keys[out] != h) | (out == 0))
        for k in (1, 2):
            e = self._tables[k][self._slot(h[wrong], k)]
            out[wrong] = e
            wrong = wrong[(self._keys[e] != h[wrong]) | (e == 0)]
        out[wrong] = -1
        return out

    def _add(self, hashes: np.ndarray, ids: list[bytes]) -> None:
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        n, used = self._n + len(ids), self._used + len(flat)
        for name, need in (("_keys", n), ("_start", n), ("_size", n), ("_flat", used)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need, 2 * len(have)) - len(have), have.dtype)]))
        self._keys[self._n : n], self._size[self._n : n] = hashes, sizes
        self._start[self._n : n] = self._used + np.cumsum(sizes) - sizes
        self._flat[self._used : used] = flat
        entries = np.arange(self._n, n, dtype=np.int32)
        self._n, self._used = n, used
        for k in range(3):  # each goes to the first free place of three; the last place may push another out
            s = self._slot(hashes, k)
            if k == 2:
                self._tables[k][s] = entries
                return
            table = self._tables[k]
            free = table[s] == 0
            table[s[free]] = entries[free]
            missed = table[s] != entries
            hashes, entries = hashes[missed], entries[missed]

    def _learn(self, words: list[str]) -> list[bytes]:
        plain, stems = [], {}
        for w in words:
            m = self._plain.fullmatch(w)
            plain.append((m[1].lower(), m[2]) if m else None)
            if m:
                stems[plain[-1][0]] = stems[m[2]] = b""
        stems.pop("", None)
        if stems:
            ids = np.array(self._bpe.encode_ordinary(self.END.join(stems) + self.END), "<u4")
            flat, at = ids.tobytes(), 0
            for stem, e in zip(stems, (np.flatnonzero(self._ends[ids]) + 1).tolist(), strict=True):
                stems[stem] = flat[4 * at : 4 * e]
                at = e
        stems[""] = b""
        other = lambda w: np.array(self._tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        return [stems[p[0]] + stems[p[1]] if p else other(w) for p, w in zip(plain, words, strict=True)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of documents given as bytes and offsets; id 0 closes each document."""
        if self._n > WORDS:
            self._forget()
        h, at, where = tv.word_hashes(data, offsets, tv.NOT_SPACE, places=True)
        entries = self._find(h)
        new = np.flatnonzero(entries < 0)
        if len(new):
            keys, first = np.unique(h[new], return_index=True)
            begin, stop = where
            raw = data.tobytes()
            spans = new[first]
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin[spans].tolist(), stop[spans].tolist(), strict=True)]
            base = self._n
            self._add(keys, self._learn(words))
            entries[new] = base + np.searchsorted(keys, h[new])
        entries = np.insert(entries, at[1:], 0)
        sizes = self._size[entries]
        to = np.cumsum(sizes)
        ids = self._flat[np.repeat(self._start[entries] - (to - sizes), sizes) + np.arange(to[-1] if len(to) else 0)]
        ends = to[at[1:] + np.arange(len(at) - 1)] if len(to) else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], ends])


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    out, n = {}, 0
    for b in range(256):
        shown = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out[chr(b) if shown else chr(256 + n)] = b
        n += not shown
    return out


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One encoder for each Python worker, kept between its tasks."""
    if path not in _tokens:
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def tokenize(path: str, capacity: int):
    """Batches of (doc_id, text) to pieces, with a rank among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        task = ctx.partitionId() if ctx else 0
        tokens, seen = word_tokens(path), Counter()
        for b in batches:
            rows: list[tuple] = []
            flat, at = tokens.encode(*tv.buffers(b.column("text")))
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                raw = flat[at[i] : at[i + 1]].tobytes()
                for piece, start in enumerate(range(0, len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    n = len(part) // 4
                    rows.append((doc, piece, start, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return run


def _place(table: list[tuple[int, int, int, int, int, int]]):
    """Rows with a global rank to their sequence and offset, by the slot table of bounded size."""
    by: dict[int, list] = defaultdict(list)
    for row in table:
        by[row[0]].append(row[1:])
    by = {n: np.array(sorted(r), np.int64) for n, r in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                m = length == n
                t = by[int(n)]
                s = t[np.searchsorted(t[:, 0], rank[m], side="right") - 1]
                k = rank[m] - s[:, 0]
                seq[m], offset[m] = s[:, 2] + k // s[:, 4], s[:, 3] + (k % s[:, 4]) * n
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(seq), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)`` with their sequence and gapless offset."""
    store = Store(spark, "packing")
    docs = columns(docs, doc_id="long", text="string")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    # Written once: ranks within a task are part of the stored rows, so retries cannot change them.
    pieces = store.put(docs.mapInArrow(tokenize(tokenizer, capacity), f"{schema}, task int, rank long"), "pieces")
    each = pieces.groupBy("length", "task").agg(F.count("*").alias("c"))
    counts = {r.length: r.c for r in each.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # at most `capacity` rows
    table = slots(complete(counts, capacity).patterns)
    before = each.select("length", "task", (F.sum("c").over(Window.partitionBy("length").orderBy("task")) - F.col("c")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_place(table), f"{schema}, sequence_id long, offset long")
