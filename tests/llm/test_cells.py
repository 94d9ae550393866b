"""Cells of buckets that span several components: copies of sets, and links in clouds near the threshold."""

import random

from cairn.llm import minhash
from tests.llm.test_dedup import roots


def test_few_outsiders_cost_one_copy(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", 500)
    rows = [(7, i, 10, 1 if i < 5000 else i) for i in range(5003)] + [(8, 1, 10, 1), (8, 2, 10, 1)]
    placed = minhash._placed(spark.createDataFrame(rows, "bucket long, node long, n long, c long"))
    cells = placed.select("node", "x.*").collect()
    assert {x.node for x in cells} == set(range(5003)) and len(cells) == 5003 + 3 * 10  # eleven parts, one group of askers
    held = {}
    for x in cells:
        held.setdefault((x.i, x.j), []).append(x)
    # Every asker meets every told member once.
    met = [(a.node, b.node) for own in held.values() for a in own if a.asks for b in own if b.told]
    assert len(met) == len(set(met)) == 3 * 5003
    assert max(sum(x.told for x in own) for own in held.values()) < 700


def test_many_outsiders_meet_all(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", 20)
    rows = [(b, i, 5, i % 9 + 1) for b in (1, 2) for i in range(90)]
    cells = minhash._placed(spark.createDataFrame(rows, "bucket long, node long, n long, c long")).select("bucket", "node", "c", "x.*").collect()
    held = {}
    for x in cells:
        held.setdefault((x.bucket, x.i, x.j), []).append(x)
    met = [(k[0], a.node, b.node) for k, own in held.items() for a in own if a.asks for b in own if b.told]
    main = max(x.c for x in cells if not any(y.asks and y.c == x.c for y in cells))
    assert len(met) == len(set(met)) == 2 * 90 * sum(i % 9 + 1 != main for i in range(90))


def test_cloud_near_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MEMBERS", 8)
    monkeypatch.setattr(minhash, "CELL", 400)
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):  # each two of them share about eight tenths of their pairs of words
        own = list(base)
        for at in r.sample(range(60), r.choice([1, 2, 2, 3])):
            own[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{(a, b) for a, b in zip(t.split(), t.split()[1:])} for t in texts]
    links = [(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert 100 < len(links) < 1600
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark, docs, k=2, threshold=80).collect()}
    assert got == roots(range(60), links)
