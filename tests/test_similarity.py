"""Pairs and outliers over many blocks against brute force, with blocks left out."""

import numpy as np
import pytest

from cairn.operators import similarity


def made(spark, rows):
    return spark.createDataFrame([(i, f"/c/{i:04d}", [float(x) for x in v] if v is not None else None) for i, v in enumerate(rows)], "script_id long, logical_path string, embedding array<double>")


def unit(v):
    v = np.asarray(v if v is not None else [], float)
    n = np.sqrt((v * v).sum())
    return v / n if len(v) and 0 < n < np.inf else np.zeros(len(v))


def score(a, b):
    return float(a @ b) if len(a) == len(b) and len(a) else similarity.F32_MIN


@pytest.fixture
def rows(monkeypatch):
    """Forty tight groups, a dense spot, lone vectors, and vectors that have no place among them."""
    monkeypatch.setattr(similarity, "BLOCK", 40)
    r = np.random.default_rng(7)
    spots = r.normal(size=(40, 12))
    out = [s + r.normal(size=12) * 0.02 for s in spots for _ in range(8)]
    out += [spots[0] + r.normal(size=12) * 0.001 for _ in range(150)] + list(r.normal(size=(40, 12)))
    out += [np.zeros(12), np.zeros(12), [1.0, 2.0], [2.0, 4.0], [], None, [float("inf")] * 12, spots[3], spots[3] * 5, -spots[3]]
    order = r.permutation(len(out))
    return [out[i] for i in order]


def test_near_duplicates_over_blocks(spark, rows):
    vectors = made(spark, rows).repartition(5)
    units = [unit(v) for v in rows]
    for threshold in (0.97, 0.9999):
        want = {(f"/c/{i:04d}", f"/c/{j:04d}"): score(a, units[j]) for i, a in enumerate(units) for j in range(i + 1, len(units)) if score(a, units[j]) >= threshold}
        got = similarity.near_duplicates(vectors, threshold).collect()
        assert len(got) == len(want) and all(abs(want[r.path_a, r.path_b] - r.score) < 1e-9 for r in got)
        assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert similarity.left_out(vectors, 0.97) > 0.4 and similarity.left_out(vectors, -1.0) == 0


def test_outliers_over_blocks(spark, rows):
    vectors = made(spark, rows).repartition(5)
    units = [unit(v) for v in rows]
    best = [max(score(a, b) for j, b in enumerate(units) if j != i) for i, a in enumerate(units)]
    for threshold in (0.3, 0.9):
        got = {r.logical_path: r.score for r in similarity.outliers(vectors, threshold).collect()}
        want = {f"/c/{i:04d}": s for i, s in enumerate(best) if s < threshold}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert similarity.outliers(vectors.limit(1), 0.9).count() == 0
    assert similarity.outliers(vectors.limit(0), 0.9).count() == 0 and similarity.near_duplicates(vectors.limit(0), 0.9).count() == 0


def test_copies_of_a_vector_do_not_grow_with_the_blocks(spark, monkeypatch):
    r = np.random.default_rng(3)
    data = [v for v in r.normal(size=(300, 6))] + [np.zeros(6)]
    monkeypatch.setattr(similarity, "GROUPS", 3)
    vectors, units = made(spark, data), [unit(v) for v in data]
    want = {(f"/c/{i:04d}", f"/c/{j:04d}") for i in range(301) for j in range(i + 1, 301) if score(units[i], units[j]) >= 0.5}
    for block in (40, 10):
        monkeypatch.setattr(similarity, "BLOCK", block)
        units_, rings = similarity.gathered(vectors, similarity.Scratch(spark, "t"))
        asks = similarity._asking(units_, rings, lambda bound, _: bound <= np.pi, True)
        assert asks.count() <= 301 * 3
        got = [(x.path_a, x.path_b) for x in similarity.near_duplicates(vectors, 0.5).collect()]
        assert len(got) == len(want) and set(got) == want


def test_similar_says_what_is_missing(spark):
    from tests.test_catalog import scripts

    s = scripts(spark, [{"logical_path": f"/c/{i:04d}"} for i in range(4)])
    vectors = made(spark, [[1, 0], [1, 0.1], [0, 1]])
    found, notes = similarity.similar_checked(s, ("ok", vectors, "b1"), "/c/0000", 1, "b2")
    assert [r.logical_path for r in found.collect()] == ["/c/0001"]
    assert len(notes) == 2 and "b1" in notes[0] and "3 of 4" in notes[1]
    assert similarity.similar_checked(s.limit(3), ("ok", vectors, "b1"), "/c/0000", 1, "b1")[1] == []
    for opened, path, said in ((("ok", vectors, "b1"), "/none", "not found"), (("absent", None, None), "/c/0000", "no vectors"), (("newer", None, "b9"), "/c/0000", "newer"), (("unreadable", None, None), "/c/0000", "read"), (("ok", vectors, "b1"), "/c/0003", "no vector")):
        with pytest.raises(similarity.NoVectors, match=said):
            similarity.similar_checked(s, opened, path, 1)
