"""Callers by name: wildcards against SQLite's LIKE, and a script with many calls and definitions."""

import random
import sqlite3

from pyspark.sql import functions as F

from cairn.operators import graph
from tests.ran import nodes


def made(spark, definitions, calls, n):
    scripts = spark.createDataFrame([(i, f"/c/s{i}.py") for i in range(n)], "id long, logical_path string")
    d = spark.createDataFrame(definitions, "script_id long, name string, line int")
    c = spark.createDataFrame(calls, "script_id long, caller string, callee string, line int, resolved_target_script_id long")
    return scripts, d, c


def by_sqlite(definitions, calls):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE d (script_id, name, line)")
    con.execute("CREATE TABLE c (script_id, caller, callee, line, target)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?)", definitions)
    con.executemany("INSERT INTO c VALUES (?, ?, ?, ?, ?)", calls)
    sql = "SELECT d.name, '/c/s' || c.script_id || '.py', c.caller, c.line, min(d.line) FROM d JOIN c ON c.target = d.script_id AND (c.callee = d.name OR c.callee LIKE '%.' || d.name) GROUP BY 1, 2, 3, 4"
    return set(con.execute(sql).fetchall())


def test_names_against_like(spark):
    r = random.Random(4)
    names = ["run", "Run", "r_n", "_", "__", "a.b", "a_b", "run%", "%", "é_x", "", ".", "\\n", "r\\_", "x" * 40, None]
    callees = ["run", "m.run", "m.RUN", "m.rAn", "run.run", "a.b", "q.a.b", "qa.b", "m.run.x", "m.", "..", "é.éyx", "m.\\n", "n.r\\q", "m.rin", "y." + "x" * 40, None, "m.a.xb", "m.running.on"]
    definitions = [(r.randrange(3), r.choice(names), r.randrange(9)) for _ in range(60)]
    calls = [(r.randrange(4), r.choice(["f", "g"]), r.choice(callees), r.randrange(5), r.choice([0, 1, 2, 7, None])) for _ in range(300)]
    scripts, d, c = made(spark, definitions, calls, 4)
    got = {tuple(x) for x in graph.all_callers(scripts, d, c).select("name", "logical_path", "caller", "line", "at").collect()}
    assert got == by_sqlite(definitions, calls) and len(got) > 30


def test_many_calls_of_many_definitions(spark):
    """10,000 calls of one script with 1,000 definitions: what is compared grows with the calls."""
    r = random.Random(5)
    names = [f"{r.choice(['load', 'save', 'send'])}_{r.choice(['all', 'row', 'job'])}_{i}" for i in range(1000)]
    definitions = [(0, n, i) for i, n in enumerate(names)]
    calls = [(1 + i % 9, "main", f"pkg.mod.{names[r.randrange(1000)]}" if i % 2 else f"other.name{i}", i, 0) for i in range(10_000)]
    scripts, d, c = made(spark, definitions, calls, 10)
    found = graph.all_callers(scripts, d, c)
    assert {(x.name, x.line) for x in found.collect()} == {(call[2].rpartition(".")[2], call[3]) for call in calls if call[3] % 2}
    joins = [n for name, n in nodes(found) if "Join" in name]
    assert len(joins) >= 3 and max(joins) < 60_000, joins  # two ends a call, a few shapes a length; the product has 10,000,000


def test_callers_of_one_script(spark):
    scripts, d, c = made(spark, [(0, "go", 3), (0, "a", 1), (1, "go", 1)], [(1, "m", "x.go", 2, 0), (1, "m", "a", 4, 0), (2, "m", "go", 2, 1)], 3)
    assert [tuple(x) for x in graph.callers(scripts, d, c, "/c/s0.py").collect()] == [("a", "/c/s1.py", "m", 4), ("go", "/c/s1.py", "m", 2)]
    assert graph.all_callers(scripts, d.where(F.lit(False)), c).count() == 0
