"""The stored full-text index: equal to the pass over all texts, and it reads and scores less."""

import random

import pytest

from cairn.functions import fts
from cairn.functions.querytext import phrases
from cairn.operators import search
from cairn.sources.scratch import Scratch
from tests.ran import moved, nodes
from tests.test_catalog import scripts

RARE, COMMON = [f"rare{i}" for i in range(40)], ["load", "save", "the", "job"]


@pytest.fixture(scope="module")
def stored(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        words = [r.choice(COMMON) for _ in range(r.randrange(0, 60))] + [r.choice(RARE) for _ in range(r.randrange(0, 3))]
        if i % 90 == 7:
            words = ["zebra"] * (1 + i // 90) + words[:5]
        r.shuffle(words)
        rows.append({"logical_path": f"/c/d{i % 7}/s{i}.py", "content": " ".join(words) or None, "owner": r.choice(["Kim", "amy", None]), "purpose": r.choice(["Load the job", "", None]), "language": r.choice(["python", "shell"])})
    s = scripts(spark, rows).cache()
    path = Scratch(spark, "fts").path("index")
    fts.store_index(s, path, block_ids=16)
    return s, path, fts.Index.open(spark, path)


def scored(found):
    return [(r.id, round(r.score, 9)) for r in sorted(found.collect(), key=lambda r: r["rank"])]


@pytest.mark.parametrize("query", ["the zebra", '"the jo"* rar*', '"nothing load"'])
def test_index_equals_one_pass(stored, query):
    s, _, index = stored
    whole = scored(search.full_text(s, query, 500))
    for limit in (2, 500):
        assert scored(search.full_text(s, query, limit, index=index)) == whole[:limit]
    some = search.Filters(language="Shell", owner="m")
    assert scored(search.full_text(s, query, 5, some, index)) == scored(search.full_text(s, query, 5, some))


def test_blocks_that_cannot_enter_are_not_scored(spark, stored):
    s, _, index = stored
    best = fts.best_of_index(index, phrases("zebra"), 1, Scratch(spark, "t"))
    assert best.blocks == 5 and best.scored == 5  # fewer blocks than are scored at first
    best = fts.best_of_index(index, phrases("the"), 3, Scratch(spark, "t"))
    assert best.blocks == 26 and best.scored < 20
    assert len(best.rows.collect()) == 3
    # With the filter few rows count, so more blocks have to be scored.
    few = s.where("id % 97 = 5").select("id")
    assert fts.best_of_index(index, phrases("the"), 3, Scratch(spark, "t"), few).scored >= best.scored


def test_scan_reads_few_row_groups(spark, stored, monkeypatch):
    s, _, _ = stored
    monkeypatch.setattr(fts, "ROW_GROUP", 4096)
    path = Scratch(spark, "fts").path("index")
    fts.store_index(s, path, block_ids=16)
    index = fts.Index.open(spark, path)
    total = index.postings.count()
    own = index.of("zebra")
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,zebra)]" in own._jdf.queryExecution().toString()
    assert len(own.collect()) == 5
    read = max(n for name, n in nodes(own) if name.startswith("Scan"))
    assert read < total / 2, (read, total)


def test_empty_catalog(spark):
    path = Scratch(spark, "fts").path("index")
    none = scripts(spark, [{"logical_path": "/c/x.py"}]).where("false")
    fts.store_index(none, path)
    assert search.full_text(none, "x y*", 5, index=fts.Index.open(spark, path)).count() == 0


def test_tokens_do_not_move_one_by_one(spark, stored):
    s, _, _ = stored
    n = moved(spark, lambda: fts.store_index(s, Scratch(spark, "fts").path("index"), block_ids=16))
    # A task's rows of a term move together, however many they are; each of the 400 rows has a word of its own.
    assert n < 400 + s.rdd.getNumPartitions() * 60, n


def test_parts_of_a_block_from_many_tasks(spark, monkeypatch):
    """Ids of a block that lie in several tasks and batches, rows without words, and a phrase over the end of a column."""
    r = random.Random(5)
    rows = [{"logical_path": f"/c/s{i}.py", "content": " ".join(r.choice(COMMON + RARE[:3]) for _ in range(i % 9)) or None, "owner": "load" if i % 3 else None, "purpose": "the job the job"} for i in range(120)]
    rows.append({"logical_path": "", "content": None})
    s = scripts(spark, rows).repartition(7).cache()
    monkeypatch.setattr(fts, "PART_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        path = Scratch(spark, "fts").path("index")
        fts.store_index(s, path, block_ids=16)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = fts.Index.open(spark, path)
    assert index.n == 121
    assert index.postings.groupBy("term", "block").count().where("count > 1").count() == 0
    for row in index.postings.collect():
        ids = [e.id for e in row.entries]
        assert ids == sorted(set(ids)) and len(ids) == row.n and {i // 16 for i in ids} == {row.block}
        assert all(e.f == len(e.places) for e in row.entries)
    for query in ["load", '"the job the"', '"job load"', '"save load" ra*', '"load load"']:
        assert scored(search.full_text(s, query, 500, index=index)) == scored(search.full_text(s, query, 500)), query
