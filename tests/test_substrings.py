"""Substring searches over stored trigrams against the plain scans."""

import random

import pytest

from cairn.functions import grams
from cairn.operators import search
from cairn.sources.scratch import Scratch
from tests.test_catalog import deps, scripts


@pytest.fixture(scope="module")
def stored(spark):
    r = random.Random(21)
    part = lambda: "".join(r.choice("abAB_%é1") for _ in range(r.randrange(1, 7)))
    s = scripts(spark, [{"logical_path": f"/c/{part()}/{part()}{i}.py", "language": r.choice(["python", "shell"])} for i in range(300)]).cache()
    fd = spark.createDataFrame([(i, 1 + r.randrange(300), part(), "function", 1, None, None) for i in range(600)], "id long, script_id long, name string, kind string, line int, docstring string, decorators string").cache()
    d = deps(spark, [(1 + r.randrange(300), f"/data/{part()}.csv", None, r.choice(["inputfile", "outputfile", "import"])) for i in range(600)]).cache()
    path = Scratch(spark, "grams").path("postings")
    search.store_grams(path, s, fd, d)
    return s, fd, d, grams.Grams.open(spark, path)


def paths(df):
    return [r.logical_path for r in df.collect()]


def test_rows_are_those_of_the_scan(stored, monkeypatch):
    s, fd, d, index = stored
    some = search.Filters(language="Shell")
    found = 0
    for most in (1000, 2):  # as a filter of the scan, and as a join
        monkeypatch.setattr(grams, "MOST_IDS", most)
        for needle in ("ABA", "/c/a", "b_%", "é1", "", "zzz", "a%b_a"):
            for plain, indexed in (
                (search.by_path(s, needle, 40, some), search.by_path(s, needle, 40, some, index)),
                (search.by_function(s, fd, needle, 40), search.by_function(s, fd, needle, 40, index=index)),
                (search.by_declared(s, d, needle, 40, "inputfile"), search.by_declared(s, d, needle, 40, "inputfile", index=index)),
            ):
                want = paths(plain)
                assert paths(indexed) == want
                found += len(want)
    assert found > 200


def test_candidates_are_few(stored):
    s, _, _, index = stored
    matches = search.by_path(s, "aba", 1000).count()
    candidates = index.candidates("path", "aba").count()
    assert matches <= candidates < 60 and matches == candidates  # one trigram: exact
    assert index.candidates("path", "a", "b/") is None and index.candidates("path", "zzzz").count() == 0
    both = {r.id for r in index.candidates("path", "/c/a", "ab").collect()}
    assert {r.id for r in search.by_path(s, "/c/a", 1000).collect()} <= both
    assert index.postings.where("kind = 'declared' and gram = '.cs'").count() == 1 and index.candidates("declared", ".csv").count() <= 300


def test_no_texts(spark):
    path = Scratch(spark, "grams").path("postings")
    none = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    grams.store_grams(path, {"path": none})
    index = grams.Grams.open(spark, path)
    assert index.candidates("path", "abc").count() == 0 and index.candidates("other", "abc").count() == 0


def test_tasks_are_dealt_out_by_trigrams(spark, monkeypatch):
    monkeypatch.setattr(grams, "TASK_GRAMS", 2000)
    texts = spark.range(300).selectExpr("id div 2 AS id", "concat('/C/', sha2(cast(id AS string), 256)) AS text")
    seen = []
    put = Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name="table": put(self, seen.append((name, df)) or df, name))
    path = Scratch(spark, "t").path("grams")
    grams.store_grams(path, {"path": texts})
    blocks = dict(seen)["blocks"]
    assert blocks.rdd.getNumPartitions() == -(-300 * 65 // 2000)
    want = {}
    for r in texts.collect():
        for k in range(len(r.text) - 2):
            want.setdefault(r.text.lower()[k : k + 3], set()).add(r.id)
    assert {r.gram: (r.n, r.ids) for r in spark.read.parquet(path).collect()} == {g: (len(i), sorted(i)) for g, i in want.items()}
