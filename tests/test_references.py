"""References to scripts: as they stand, else seen from the script's folder; each moves a few times."""

import pytest

from cairn.plans import ingest_queries, resolve
from tests.ran import moved
from tests.test_catalog import scripts


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_as_they_stand_else_from_the_folder(spark):
    s = scripts(spark, [{"logical_path": p} for p in ("/c/a.py", "/c/d/b.py", "d/b.py", "/c/d/e.py", "top.py", "/top.py")])
    edges = [(1, "/c/d/b.py", 2), (1, "d/b.py", 3), (1, "d/e.py", 4), (2, "../a.py", 1), (2, "..\\a.py", 1), (2, "./x/../e.py", 4), (3, "top.py", 5), (5, "./top.py", 6), (4, "/c/d/e.py", 4)]
    none = [(1, "/d/e.py"), (1, "./a.py"), (1, "a.py"), (2, "../../../a.py"), (2, ""), (2, None), (99, "/c/a.py"), (4, "b")]
    rows = [e[:2] for e in edges] * 2 + none
    found = resolve.resolve_references(spark.createDataFrame(rows, "script_id long, depends_on_path string"), s)
    assert sorted(map(tuple, found.collect())) == sorted(edges)


def test_a_reference_moves_four_times_at_most(spark, no_broadcast):
    s = scripts(spark, [{"logical_path": f"/c/d{i % 3}/s{i}.py"} for i in range(40)]).cache()
    edges = spark.createDataFrame([(i + 1, f"../d{j % 3}/s{j}.py") for i in range(40) for j in range(40)], "script_id long, depends_on_path string").cache()
    assert edges.count() == 1600 and s.count() == 40
    n = moved(spark, lambda: resolve.resolve_references(edges, s).collect())
    assert n <= 4 * 1600 + 3 * 40, n


def test_names_of_edges_are_not_made_distinct(spark, no_broadcast):
    s = scripts(spark, [{"logical_path": f"/catalog/dir{i % 3}/sub/s{i}.py"} for i in range(40)]).cache()
    rows = [(i * 40 + j, i + 1, f"p{k}", j + 1, "import") for i in range(40) for j in range(40) for k in range(3)]
    d = spark.createDataFrame(rows, "id long, script_id long, depends_on_path string, resolved_script_id long, kind string")
    d = d.groupBy("script_id", "depends_on_path", "resolved_script_id", "kind").min("id")
    plan = ingest_queries._t17(s, d)._jdf.queryExecution().optimizedPlan().toString()
    # The relation's aggregate by names goes, as the distinct pairs of ids above it need no other.
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "kind#" in x], plan
