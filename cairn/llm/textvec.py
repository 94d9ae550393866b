"""Vectorised words and hashes over the buffers of Arrow string arrays (numpy only)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
#: Bytes hashed at once; longer texts are cut between words.
CHUNK = 1 << 20
_tables: dict[int, np.ndarray] = {}

#: ASCII white space: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_lo : _hi + 1] = True
#: A-Z to a-z, all else unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 32


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(CHUNK + 1, n)
        step = np.full(size, base, U)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size == CHUNK + 1:
            _tables[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None, places: bool = False, prefix: int = 0) -> tuple:
    """64-bit hashes of all words, in order, and each document's offsets into them.

    A word is a longest run of bytes with ``is_word``; it never crosses a document.
    With *places*, also (starts, ends) of the words; with *prefix*, also hashes of the first
    *prefix* bytes of each word that is longer.
    """
    total = len(data)
    hashes, at, to, heads = [], [], [], []
    a = 0
    doc_start = np.zeros(total + 1, bool)
    doc_start[offsets] = True
    while a < total:
        b = min(total, a + CHUNK)
        if b < total:
            cut = (~is_word[data[a:b]]) | doc_start[a:b]
            last = len(cut) - 1 - int(np.argmax(cut[::-1])) if cut.any() else 0
            if last > 0:
                b = a + last
            else:  # one word longer than a chunk: go on to its end
                ends = np.flatnonzero((~is_word[data[b:]]) | doc_start[b:total])
                b = b + int(ends[0]) if len(ends) else total
        part = data[a:b]
        w = is_word[part]
        start = w.copy()
        start[1:] &= ~w[:-1] | doc_start[a + 1 : b]
        s = np.flatnonzero(start)
        if len(s):
            end = w.copy()
            end[:-1] &= ~w[1:] | doc_start[a + 1 : b]
            e = np.flatnonzero(end) + 1
            values = (fold[part] if fold is not None else part).astype(U)
            values += U(1)
            values *= _powers(_MULT, len(part))[: len(part)]
            total_to = np.empty(len(part) + 1, U)
            total_to[0] = 0
            np.cumsum(values, out=total_to[1:])
            h = (total_to[e] - total_to[s]) * _powers(_INV, len(part))[s]
            hashes.append(mix(h ^ ((e - s).astype(U) * U(0xD6E8FEB86659FD93))))
            if prefix:
                head = (total_to[np.minimum(s + prefix, e)] - total_to[s]) * _powers(_INV, len(part))[s]
                heads.append(np.where(e - s > prefix, mix(head ^ U(0x8CB92BA72F3D8DD7)), U(0)))
            at.append(s + a)
            to.append(e + a)
        a = b
    if not hashes:
        none = np.zeros(0, np.int64)
        return (np.zeros(0, U), np.zeros(len(offsets), np.int64)) + (((none, none),) if places else ()) + ((np.zeros(0, U),) if prefix else ())
    starts = np.concatenate(at)
    out = np.concatenate(hashes), np.searchsorted(starts, offsets).astype(np.int64)
    return out + (((starts, np.concatenate(to)),) if places else ()) + ((np.concatenate(heads),) if prefix else ())


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the *k*-word shingles; fewer words: the whole sequence as one; none: empty."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        return np.sort(_window(words, n, 1) ^ U(n))
    return np.unique(_window(words, k, n - k + 1))


def _window(words: np.ndarray, k: int, count: int) -> np.ndarray:
    h = np.full(count, k, U)
    for j in range(k):
        h *= U(0x9FB21C651E98DF25)
        h += words[j : j + count]
        h ^= h >> U(29)
    return mix(h)
