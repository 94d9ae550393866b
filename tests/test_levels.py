"""Scripts within a number of steps: levels, cycles, and plans that do not grow with depth."""

from cairn.operators import graph
from tests.test_catalog import deps, scripts


def test_levels_of_a_long_chain_with_a_cycle(spark):
    s = scripts(spark, [{"logical_path": f"/c/{i}"} for i in range(30)])
    edges = [(i, f"/c/{i}", i + 1, "import") for i in range(1, 30)] + [(12, "/c/0", 1, "import"), (1, "/c/4", 5, "import"), (1, "x", None, "import")]
    d = deps(spark, edges)
    for depth in (0, 1, 6, 99):
        want, front = {1: 0}, [1]
        for n in range(1, depth + 1):
            front = [t for a in front for s_, _, t, _ in edges if s_ == a and t and t not in want]
            want |= {t: n for t in front if t not in want}
        assert {r.id: r.depth for r in graph.reachable(s, d, "/c/0", depth).collect()} == want
    assert {r.id: r.depth for r in graph.reachable(s, d, "/c/3", 2, reverse=True).collect()} == {4: 0, 3: 1, 2: 2}
    assert graph.reachable(s, d, "/none", 3).count() == 0


def test_plan_grows_by_a_level_for_a_step(spark):
    s = scripts(spark, [{"logical_path": f"/c/{i}"} for i in range(12)])
    d = deps(spark, [(i, "", i + 1, "import") for i in range(1, 12)])
    size = [len(graph.reachable(s, d, "/c/0", n)._jdf.queryExecution().optimizedPlan().toString().splitlines()) for n in (2, 4, 8)]
    assert size[2] - size[1] == 2 * (size[1] - size[0])
