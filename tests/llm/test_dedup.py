import random
import re

import numpy as np
import pytest

from cairn.llm import lines, minhash, neighbours
from cairn.llm.components import components
from cairn.llm.store import Store


def roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {x.node: x.component for x in components(Store(spark, "t"), spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({x for pair in links for x in pair}, links)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}
    assert components(Store(spark, "t"), spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_short_chains(spark):
    r = random.Random(7)
    links = [(1, 2), (2, 3), (3, 4), (4, 0)]
    assert {x.component for x in components(Store(spark, "t"), spark.createDataFrame(links, "u long, v long")).collect()} == {0}
    # One tree at a time: side by side, the slowest carries the others on.
    for low in (100, 200, 300):
        ids = r.sample(range(low, low + 8), 8)
        tree = [(ids[i], ids[r.randrange(i)]) for i in range(1, 8)]
        got = components(Store(spark, "t"), spark.createDataFrame(tree, "u long, v long")).collect()
        assert sorted((x.node, x.component) for x in got) == [(low + i, low) for i in range(8)]


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_are_those_of_brute_force(spark, k):
    r = random.Random(k)
    base = [[f"w{r.randrange(400)}" for _ in range(120)] for _ in range(6)]
    docs = [None, "", "  \n", "one", "ONE", "one two", "É x", "é x"]
    for _ in range(110):
        w = list(r.choice(base))
        for _ in range(r.randrange(12)):
            w[r.randrange(len(w))] = f"v{r.randrange(9)}"
        docs.append(" ".join(w))
    docs += docs[8:20]
    rows = [(i, t, 1) for i, t in enumerate(docs)]
    got = {x.doc_id: x for x in minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, component_id int"), k=k).collect()}
    sets = [shingles(t, k) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(range(len(docs)), links)
    assert {i: (x.n_shingles, x.component_id, x.kept) for i, x in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_near_duplicates_with_repeated_ids_and_none(spark):
    text = " ".join(f"a{i}" for i in range(40))
    other = " ".join(f"b{i}" for i in range(40))
    rows = [(1, text), (5, text), (5, other), (9, other)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (5, 1), (9, 1)}
    assert minhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cells_cut_a_bucket_and_lose_no_link(spark, monkeypatch):
    # A cloud around one text, where some members link with others but not with the leader, in cells of few members.
    monkeypatch.setattr(minhash, "MEMBERS", 7)
    r = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for _ in range(120):
        w = list(base)
        for i in r.sample(range(100), r.randrange(1, 9)):
            w[i] = f"v{r.randrange(4)}"
        docs.append(" ".join(w))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), k=2).collect()}
    sets = [shingles(t, 2) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(range(len(docs)), links)
    assert 3 < len(set(want.values())) < 110 and got == want


def test_meet_is_brute_force():
    r = np.random.default_rng(2)
    for m, spread in ((1, 5), (30, 3), (200, 12)):
        base = np.arange(40)
        sets = [np.unique(np.concatenate([r.choice(base, r.integers(30, 41), replace=False), r.integers(100, 140, r.integers(0, spread))])) for _ in range(m)]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        comp, asks, told = r.integers(0, 4, m), r.random(m) < 0.5, r.random(m) < 0.8
        x, y = minhash.meet(np.concatenate(sets), at, comp, asks, told, 80)
        own = [set(s.tolist()) for s in sets]
        link = [(i, j) for i in range(m) for j in range(m) if asks[i] and told[j] and comp[i] != comp[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])]
        assert set(zip(x.tolist(), y.tolist(), strict=True)) <= set(link)
        assert {(i, comp[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)} == {(i, comp[j]) for i, j in link}


def test_very_long_sets_agree_only_where_they_are_alike(spark):
    r = np.random.default_rng(8)
    long = [np.unique(r.integers(0, 1 << 63, 400_000).astype(np.uint64) * np.uint64(2)) for _ in range(2)]
    near = np.unique(np.concatenate([long[0][:360_000], long[1][:40_000]]))
    sig = [minhash.signature(s) for s in (*long, near)]
    assert (sig[0] == sig[1]).sum() == 0 and 0.7 < (sig[0] == sig[2]).mean() < 0.93
    words = [" ".join(f"{p}{i}" for i in range(100_000)) for p in "ab"]
    docs = [(1, words[0]), (2, words[1]), (3, words[0][:500_000]), (4, words[0][:640_000]), (None, "x y"), (None, None), (7, words[1])]
    got = minhash.near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.component_id, x.kept) for x in got if x.doc_id} == {1: (1, True), 2: (2, True), 3: (3, True), 4: (1, False), 7: (2, False)}
    assert [(x.component_id, x.kept) for x in got if x.doc_id is None] == [(None, True)] * 2


def test_components_over_several_tasks(spark, monkeypatch):
    from cairn.llm import components as C

    monkeypatch.setattr(C, "EDGES", 40)
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 300)] + [(r.randrange(400, 800), r.randrange(400, 800)) for _ in range(300)] + [(None, 3), (7, 7)]
    got = {x.node: x.component for x in C.components(Store(spark, "t"), spark.createDataFrame(links, "u long, v long")).collect()}
    links = links[:-2]
    want = roots({x for pair in links for x in pair}, links)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}


def test_circulant_signature_estimates_jaccard():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        x = r.integers(0, 1 << 63, 300).astype(np.uint64)
        y = np.concatenate([x[:200], r.integers(0, 1 << 63, 100).astype(np.uint64)])
        errors.append((minhash.signature(np.sort(x)) == minhash.signature(np.sort(y))).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02


def cut(docs, min_docs):
    keys = {}
    strip = " \t\n\x0b\x0c\r"

    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))

    for d, t in docs:
        for line in (t or "").split("\n"):
            keys.setdefault(key(line), set()).add(d)
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        keep = [x for x in own if not (len(key(x)) >= 40 and len(keys[key(x)]) >= min_docs and max(keys[key(x)]) != d)]
        out.append((d, len(own), len(own) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_lines(spark):
    common, accent = "C" * 39 + "x", "É" + "e" * 45
    docs = [(i, f"a{i}\n {common}\t\n{common.lower()}\n{accent}") for i in range(7)] + [(10, None), (11, ""), (12, common), (13, "c" * 39), (14, f"{accent.lower()}\n\n")]
    docs += [(3, common), (20, "\n".join(["z" * 50] * 9))]
    df = spark.createDataFrame([(d, t, "n") for d, t in docs], "doc_id long, text string, n_lines string")
    out = lines.dedup_lines(spark, df)
    got = sorted((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in out.collect())
    assert got == cut(docs, 5)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert lines.dedup_lines(spark, df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text", "'a' AS `_row`", "'b' AS `_gone`", "'c' AS row", "'d' AS `x.y`", "'e' AS doc", "'f' AS own", "'g' AS c1", "'h' AS pos", "'i' AS n_dropped")
    out = lines.dedup_lines(spark, clash)
    assert sorted((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in out.collect()) == cut(docs, 5)
    assert {tuple(x) for x in out.select("_row", "_gone", "row", "`x.y`", "doc", "own", "c1", "pos").collect()} == {tuple("abcdefgh")}
    long = spark.createDataFrame([(i, "L" * 2_000_000 + f"\n{i}") for i in range(6)], "doc_id long, text string")
    assert sorted((x.doc_id, x.n_dropped) for x in lines.dedup_lines(spark, long).collect()) == [(i, int(i < 5)) for i in range(6)]


def test_runs_meet_each_key_once(spark):
    runs = lines.Runs(Store(spark, "t"), fanout=2)
    news = []
    for part in ([1, 2, 3], [2, 3, 4], [4, 5], [1, 6]):
        news.append(sorted(x.h1 for x in runs.add(spark.createDataFrame([(k, 0, k) for k in part], "h1 long, h2 long, doc long")).collect()))
    assert news == [[1, 2, 3], [4], [5], [6]]
    assert {x.h1: x.docs for x in runs.compact().collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1}


def test_runs_are_met_in_place(spark):
    runs = lines.Runs(Store(spark, "t"), fanout=9)
    for part in ([1, 2, 3], [2, 3, 4], [3, 4, 5]):
        runs.add(spark.createDataFrame([(k, 0, k) for k in part], "h1 long, h2 long, doc long"))
    one, two, _ = runs._all()
    text = one.join(two.select(*lines.KEY).hint("merge"), lines.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Sort [" not in text and "Bucketed: true" in text
    assert sorted(tuple(x) for x in runs.compact().collect()) == [(1, 0, 1, 1), (2, 0, 2, 2), (3, 0, 3, 3), (4, 0, 2, 4), (5, 0, 1, 5)]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "K_MOST", 12)
    monkeypatch.setattr(neighbours, "K", 6)
    r = np.random.default_rng(4)
    centre = r.standard_normal((5, 16))
    v = [r.standard_normal(16) for _ in range(150)] + [c + 0.03 * r.standard_normal(16) for c in centre for _ in range(25)]
    v += [v[0], 2 * v[0], np.zeros(16)]
    rows = [(i, [float(x) for x in a], 0) for i, a in enumerate(v)]
    rows += [(500, None, 0), (501, [float("nan")] * 16, 0), (502, [1.0, None], 0), (503, [], 0), (504, [3.0], 0)]
    got = {x.vec_id: x for x in neighbours.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")).collect()}
    m = np.array(v)
    n = np.linalg.norm(m, axis=1)
    near = (m @ m.T) / np.maximum(np.outer(n, n), 1e-300) >= 0.95
    np.fill_diagonal(near, False)
    links = list(zip(*np.nonzero(near), strict=True))
    want = roots(range(len(v)), links)
    assert {i: (got[i].n_links, got[i].component_id) for i in range(len(v))} == {i: (int(near[i].sum()), want[i]) for i in range(len(v))}
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 505))
    empty = neighbours.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert empty.count() == 0


def test_batches_of_trees_hold_the_chance_of_a_miss(spark):
    for n in (1_000, 80_000, 320_000, 50_000_000):
        bits = max(0, int(np.ceil(np.log2(n / neighbours.LEAF))))
        together = (1 - np.arccos(0.95) / np.pi) ** bits
        assert (1 - together) ** (neighbours.TREES * neighbours._batches(bits, 0.95)) <= neighbours.MISS
    # Where no round brings the recall asked for, all is compared: with one vector a leaf, trees find nothing.
    r = np.random.default_rng(9)
    v = [x for _ in range(60) for c in [r.standard_normal(32)] for x in (c, c + 0.2 * r.standard_normal(32))]
    m = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    near = m @ m.T >= 0.95
    with pytest.MonkeyPatch.context() as p:
        p.setattr(neighbours, "_in_leaf", lambda t, *least: t.select(["node"]).slice(0, 0).rename_columns(["u"]).append_column("v", t["node"].slice(0, 0)).append_column("sim", t["node"].slice(0, 0).cast("double")))
        p.setattr(neighbours, "ROUNDS", 1)
        got = neighbours.near_vectors(spark, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert {x.vec_id: x.n_links for x in got} == {i: int(near[i].sum()) - 1 for i in range(len(v))}


def test_few_links_are_no_audit(spark):
    nodes = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(np.random.default_rng(5).standard_normal((300, 16)))], "node long, times long, vec array<double>")
    unit = nodes.selectExpr("node", "times", "transform(vec, x -> x / sqrt(aggregate(vec, 0D, (s, y) -> s + y * y))) AS vec")
    assert neighbours._audit(unit, 300, 0.95) is None
    assert sum(neighbours._audit(unit, 300, -1.1).values()) >= neighbours.LINKS
    # A list full of links is unproven at any room it has; an audit that leaves few links is none.
    lists = spark.createDataFrame([(u, 100 * u + v, 0.99 if u else 0.5) for u in range(3) for v in range(1, 11 if u < 2 else 21)], "u long, v long, sim double")
    caps = spark.createDataFrame([(2, 20)], "u long, cap long")
    assert sorted(x.node for x in neighbours._saturated(lists, caps, 0.95).collect()) == [1, 2]
    assert neighbours._recall({0: 3, 1: 10, 2: 20}, lists, caps, 0.95) == 0.0


def test_entries_cut_at_a_pivot_stay_new(spark):
    store, hub = Store(spark, "t"), 0
    m = np.random.default_rng(6).standard_normal((31, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(m)], "node long, times long, vec array<double>")
    lists = store.put(spark.createDataFrame([(i, hub, float(m[i] @ m[hub]) + 2, True) for i in range(1, 31)], "u long, v long, sim double, new boolean"), "lists")
    waiting, caps = [], None
    for _ in range(3):
        lists, caps, _ = neighbours._round(store, nodes, lists, caps, 9.0)
        waiting.append(lists.where(f"v = {hub} and new and u > 0 and sim > 1.01").count())
    assert waiting == [20, 10, 0]
