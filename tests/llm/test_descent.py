"""NN-descent over several leaves and blocks: rare links, a dense third, repeated ids."""

import numpy as np

from cairn.llm import neighbours
from tests.llm.test_dedup import roots


def made(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)


def check(spark, monkeypatch, v, most):
    """Results by brute force; how many vectors were compared with all, of those that may be."""
    compared = []
    finish = neighbours._finish

    def counting(store, nodes, lists, unproven, n, threshold):
        compared.append(unproven.count())
        return finish(store, nodes, lists, unproven, n, threshold)

    monkeypatch.setattr(neighbours, "_finish", counting)
    monkeypatch.setattr(neighbours, "LEAF", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    got = {x.vec_id: x for x in neighbours.near_vectors(spark, made(spark, v)).collect()}
    m = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    want = roots(range(len(v)), list(zip(*np.nonzero(near), strict=True)))
    assert {i: (got[i].n_links, got[i].component_id) for i in range(len(v))} == {i: (int(near[i].sum()), want[i]) for i in range(len(v))}
    assert len(compared) == 1 and compared[0] <= most, compared
    return near.sum()


def test_rare_links(spark, monkeypatch):
    r = np.random.default_rng(31)
    v = [r.standard_normal(24) for _ in range(900)]
    v += [v[i] + 0.15 * r.standard_normal(24) * np.linalg.norm(v[i]) / np.sqrt(24) for i in range(0, 900, 100)]
    order = r.permutation(len(v))
    assert 0 < check(spark, monkeypatch, [v[i] for i in order], 0) <= 18  # fewer links than an audit asks for


def test_no_links_at_all(spark, monkeypatch):
    r = np.random.default_rng(32)
    assert check(spark, monkeypatch, [r.standard_normal(24) for _ in range(400)], 0) == 0


def test_dense_third(spark, monkeypatch):
    r = np.random.default_rng(33)
    centre = r.standard_normal(24)
    v = [r.standard_normal(24) for _ in range(400)] + [centre + 0.02 * r.standard_normal(24) for _ in range(250)]
    v += [v[i] + 0.02 * r.standard_normal(24) for i in range(60)]
    order = r.permutation(len(v))
    assert check(spark, monkeypatch, [v[i] for i in order], 260) > 50_000  # the dense spot alone


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (None, [1.0, 0.01])]
    got = neighbours.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((x.vec_id or 0, x.n_links) for x in got) == [(0, 2), (1, 1), (1, 2), (1, 2), (2, 1)]
