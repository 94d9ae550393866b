import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import packing as P
from cairn.llm import textvec as tv
from cairn.llm.queries import tokenizer_path


def fewest(items, cap):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b >= items[i]}:
            j = bins.index(room)
            bins[j] -= items[i]
            go(i + 1, bins)
            bins[j] += items[i]
        bins.append(cap - items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_search_is_optimal_on_small_sets():
    r = random.Random(2)
    for _ in range(80):
        items = [r.randint(3, 20) for _ in range(r.randint(0, 11))]
        solved = P.complete(dict(Counter(items)), 30)
        got = solved.patterns
        assert Counter(n for p, t in got.items() for n in p for _ in range(t)) == Counter(items)
        assert all(sum(p) <= 30 for p in got)
        assert sum(got.values()) == fewest(items, 30) and solved.proved


def test_fillings_are_undominated():
    counts = {7: 1, 5: 2, 3: 1}
    assert list(P.fillings([7, 5, 3], counts, 10, 10)) == [(7, 3), (5, 5)]
    r = random.Random(5)
    for _ in range(60):
        counts = Counter(r.randint(2, 9) for _ in range(7))
        room = r.randint(3, 25)
        every = {()}
        for n, c in sorted(counts.items(), reverse=True):
            every = {p + (n,) * k for p in every for k in range(c + 1) if sum(p) + n * k <= room}
        def better(p):
            rest = counts - Counter(p)
            return any(sum(p) + n <= room for n in rest) or any(n > c and sum(p) - c + n <= room for c in p for n in rest)
        got = list(P.fillings(sorted(counts, reverse=True), counts, room, room))
        assert sorted(got) == sorted(p for p in every if not better(p)) and [sum(p) for p in got] == sorted(map(sum, got), reverse=True)


@pytest.mark.parametrize("pieces", [300, 3000, 200_000])
def test_completion_packs_any_number_of_pieces(pieces):
    r = np.random.default_rng(pieces)
    counts = Counter(np.minimum(2048, r.lognormal(5.6, 1.1, pieces).astype(int) + 1).tolist())
    solved = P.complete(dict(counts), 2048)
    assert Counter({n: c for n, c in sum((Counter({n: t * k for n, k in Counter(p).items()}) for p, t in solved.patterns.items()), Counter()).items()}) == counts
    assert all(sum(p) <= 2048 for p in solved.patterns) and 0 < solved.tried <= P.NODES
    assert sum(solved.patterns.values()) <= sum(P.best_fit(dict(counts), 2048).values()) and sum(solved.patterns.values()) - solved.bound <= 1
    assert sum(solved.patterns.values()) == solved.bound or not solved.proved


def test_ties_and_single_lengths():
    assert P.complete({10: 7}, 20).patterns == {(10, 10): 3, (10,): 1} and P.complete({}, 20).patterns == {} and P.complete({20: 4}, 20).patterns == {(20,): 4}


def test_slots_cover_all_ranks():
    patterns = {(5, 5, 2): 3, (7,): 2, (5, 7): 1}
    for n in (5, 7, 2):
        rows = sorted(r for r in P.slots(patterns) if r[0] == n)
        at = 0
        for _, first, times, _, _, each in rows:
            assert first == at
            at += times * each


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TEXTS = ["", "The cat, sat!! don't", "a<|endoftext|>b It'sé \x1cq", "ΑΣ Σ 日本語  x", "x\x01y \x01", "$$$a %%% a1b2 | é é", "ab " * 3000, "word" * 1500]


def test_ids_are_the_tokenizers(exact):
    words = P.WordTokens(tokenizer_path())
    for _ in range(2):
        ids, at = words.encode(*tv.buffers(pa.array([*TEXTS, None])))
        for i, t in enumerate([*TEXTS, ""]):
            assert ids[at[i] : at[i + 1]].tolist() == [*exact.encode(t, add_special_tokens=False).ids, 0]


def test_packed_rows(spark, exact):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None, "same", "same"])] + [(3, "again", "x")], "doc_id long, text string, sequence_id string")
    rows = P.pack(spark, docs, tokenizer_path(), 512).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        ids = np.array([*exact.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 512))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
        assert sum(r.length for r in own) == len(ids)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 512
    assert len(by_doc[3]) == 2
    assert P.pack(spark, docs.limit(0), tokenizer_path()).count() == 0
