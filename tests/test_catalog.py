"""Query fixtures on hand-made rows."""

import sqlite3

import pytest

from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.functions.querytext import ValidationError, sanitised
from cairn.operators import audit, diffing, graph, search, show, similarity, stats, status, warnings
from cairn.schema import TABLES


def scripts(spark, rows):
    """rows: dicts of some columns; ids count from 1."""
    names = TABLES["scripts"].names
    base = {"tags": "[]", "related": "[]", "metadata_json": "{}"}
    return spark.createDataFrame([tuple(({"id": i + 1} | base | r).get(n) for n in names) for i, r in enumerate(rows)], TABLES["scripts"])


def deps(spark, rows):
    """(script, path, target, kind)"""
    return spark.createDataFrame([(i + 1, s, p, t, k) for i, (s, p, t, k) in enumerate(rows)], TABLES["dependencies"])


def revs(spark, rows):
    """(path, type, user, timestamp, age)"""
    return spark.createDataFrame([(i, p, f"{p}#{i}", t, "LINUX", u, ts, a) for i, (p, t, u, ts, a) in enumerate(rows)], TABLES["revisions"])


def paths(df):
    return [r.logical_path for r in df.collect()]


def test_ranking_and_filters(spark):
    s = scripts(spark, [{"logical_path": "/w/kelp.ksh", "content": "tide of the harbour", "language": "shell"}, {"logical_path": "/w/buoy.py", "content": "tide, tide and ebb tide", "language": "python"}])
    assert [r.logical_path for r in sorted(search.full_text(s, "tide", 5).collect(), key=lambda r: r["rank"])] == ["/w/buoy.py", "/w/kelp.ksh"]
    assert paths(search.full_text(s, "tide", 5, search.Filters(language="SHELL"))) == ["/w/kelp.ksh"]
    assert search.full_text(s, '"', 5).count() == 0
    assert search.full_text(s, "***", 5).count() == 0


@pytest.mark.parametrize("query", ["nightly backup", "nightly-backup", '"backup job"', "nigh*", "x-1", "common", "AND", "cafe"])
def test_bm25_is_that_of_sqlite(spark, query):
    texts = ["nightly backup job nightly", "backup of the job, nightly-backup x-1", "common common words", "common café AND or", "", "common night"]
    rows = [{"logical_path": f"/c/f{i}.sh", "content": t, "owner": "bob" if i % 2 else None, "purpose": "common purpose" if i == 2 else ""} for i, t in enumerate(texts)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(logical_path, content, owner, purpose, tags)")
    for i, r in enumerate(rows):
        con.execute("INSERT INTO f(rowid, logical_path, content, owner, purpose, tags) VALUES (?,?,?,?,?,'[]')", (i + 1, r["logical_path"], r["content"], r["owner"], r["purpose"]))
    want = {i: round(x, 9) for i, x in con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (sanitised(query),))}
    assert {r.id: round(r.score, 9) for r in search.full_text(scripts(spark, rows), query, 10).collect()} == want


def test_limits_come_first(spark):
    s = scripts(spark, [{"logical_path": "/a"}])
    for f in (lambda: search.full_text(s, "a", 0), lambda: search.by_path(s, "a", 0), lambda: search.by_regex(s, "(", 0), lambda: search.listing(s, 0)):
        with pytest.raises(ValidationError, match="limit"):
            f()


def test_path_and_text_once(spark):
    s = scripts(spark, [{"logical_path": "/w/tide.ksh", "content": "see moon.v2 and notes"}, {"logical_path": "/w/moon.v2.lst", "content": ""}, {"logical_path": "/w/reef.py", "content": "moon v3"}, {"logical_path": "/w/both/tide.ksh.bak.py", "content": "tide.ksh"}])
    assert paths(search.text_search(s, "moon.v2", 10)) == ["/w/moon.v2.lst", "/w/tide.ksh"]
    assert sorted(paths(search.text_search(s, "tide.ksh", 10))) == ["/w/both/tide.ksh.bak.py", "/w/tide.ksh"]
    assert paths(search.text_search(s, "reef.py", 10)) == ["/w/reef.py"]


def test_wildcards(spark):
    s = scripts(spark, [{"logical_path": "/a.py"}, {"logical_path": "/b.py"}])
    fd = spark.createDataFrame([(1, 1, "run_x", "function", 1, None, None), (2, 2, "runax", "function", 1, None, None)], TABLES["function_definitions"])
    assert paths(search.by_function(s, fd, "RUN_X", 5)) == ["/a.py", "/b.py"]
    assert paths(search.by_function(s, fd, "run\\", 5)) == []
    odd = spark.createDataFrame([(1, 1, "a\\b", "function", 1, None, None)], TABLES["function_definitions"])
    assert paths(search.by_function(s, odd, "A\\B", 5)) == ["/a.py"]
    d = deps(spark, [(1, "/x/a_b.csv", None, "inputfile"), (2, "/x/aXb.csv", None, "inputfile")])
    assert paths(search.by_declared(s, d, "a_b", 5)) == ["/a.py"]


def test_histograms_keep_empty_buckets(spark):
    s = scripts(spark, [{"logical_path": "/a", "size": 100}, {"logical_path": "/b", "size": 2_000_000}, {"logical_path": "/c"}])
    h = stats.size_histogram(s).collect()
    assert [r["count"] for r in h] == [1, 0, 0, 0, 0, 0, 0, 0, 1]
    r = revs(spark, [("/a", "DEVELOP", "u", "20260101", 2 * 86400.0), ("/b", "DEVELOP", "u", "20260101", 400 * 86400.0), ("/b", "ARCHIVE", "u", "20260101", 1.0)])
    assert {x.bucket: x["count"] for x in stats.staleness_histogram(r).collect()} == {"0-7d": 1, "7-30d": 0, "30-90d": 0, "90-180d": 0, "180-365d": 0, ">365d": 1}


def test_revision_stats(spark):
    rows = [("/a", "DEVELOP", "alice"), ("/a", "DEVELOP", "bob"), ("/b", "DEVELOP", "alice"), ("/a", "ARCHIVE", "x"), ("/c", "ARCHIVE", "x"), ("/c", "ARCHIVE", "y"), ("/a", "WORKING", ""), ("/a", "WORKING", "")]
    got = stats.revision_stats(revs(spark, [(p, t, u, "20260101", 1.0) for p, t, u in rows])).first().asDict()
    assert got == {"active_checkouts": 2, "archive_scripts": 2, "working_scripts": 1, "develop_files": 3, "archive_files": 3, "working_files": 2, "multi_user_scripts": 1}
    assert stats.revision_stats(revs(spark, [])).count() == 0


def test_folders_are_literal(spark):
    s = scripts(spark, [{"logical_path": p} for p in ("/w/Quay/a", "/w/quay/b", "/w/q%_.*(y/c", "/w/qXY.y/d", "/w/e", "/w/quay/inner/f")])
    assert paths(graph.scripts_in(s, "/w/quay")) == ["/w/quay/b"]
    assert paths(graph.scripts_in(s, "/w/q%_.*(y")) == ["/w/q%_.*(y/c"]
    assert paths(graph.scripts_in(s, "")) == []
    assert [r.name for r in graph.subdirs(s, "/").collect()] == ["w"]
    assert [r.name for r in graph.subdirs(s, "/w").collect()] == ["Quay", "q%_.*(y", "qXY.y", "quay"]


@pytest.fixture(scope="module")
def diamond(spark):
    s = scripts(spark, [{"logical_path": f"/w/{n}"} for n in ("dock", "crane", "truck", "pier", "rope")])
    return s, deps(spark, [(1, "/w/crane", 2, "import"), (1, "/w/truck", 3, "import"), (2, "/w/pier", 4, "import"), (3, "/w/pier", 4, "import"), (4, "/w/rope", 5, "import"), (1, "harbour.toolkit", None, "import")])


def test_tree_marks(spark, diamond):
    t = {(r.logical_path, r.repeated, r.indexed) for r in graph.tree(spark, *diamond, "/w/dock", 5).collect()}
    assert {("/w/pier", False, True), ("/w/pier", True, True), ("harbour.toolkit", False, False)} <= t
    cut = {r.logical_path: r.truncated for r in graph.tree(spark, *diamond, "/w/dock", 2).collect()}
    assert cut["/w/pier"] and not cut["/w/crane"]
    s = scripts(spark, [{"logical_path": "/a"}, {"logical_path": "/b"}])
    loop = graph.tree(spark, s, deps(spark, [(1, "/b", 2, "import"), (2, "/a", 1, "import")]), "/a").orderBy("node_id").collect()
    assert [(r.logical_path, r.cycle) for r in loop] == [("/a", False), ("/b", False), ("/a", True)]
    assert graph.render_tree(loop) == ["/a", "└── /b", "    └── /a (cycle)"]
    assert graph.tree(spark, *diamond, "/none").count() == 0
    back = [r.logical_path for r in graph.tree(spark, *diamond, "/w/rope", 1, reverse=True).orderBy("node_id").collect()]
    assert back == ["/w/rope", "/w/pier"]


def walked(edges, root, depth):
    """(path, depth, parent, cycle, repeated, truncated) in preorder, by a depth-first walk."""
    children = {}
    for a, kind, path, b in sorted(edges, key=lambda e: (e[1], e[2])):
        children.setdefault(a, []).append((path, b))
    rows, opened = [(f"/s{root:02d}", 0, None, False, False, False)], {root}

    def walk(node, a, left, above):
        for path, b in children.get(a, []):
            below = b is not None and bool(children.get(b))
            cycle = b in above
            repeated = not cycle and b in opened
            last = left <= 1
            rows.append((path, depth - left + 1, node, cycle, repeated, not cycle and not repeated and last and below))
            if b is not None and not cycle and not repeated and not last:
                opened.update([b] if below else [])
                walk(len(rows) - 1, b, left - 1, above | {b})

    walk(0, root, depth, {root})
    return rows


@pytest.mark.parametrize("depth", [1, 2, 3, 6])
def test_tree_equals_the_walk_of_any_graph(spark, depth):
    import random

    s = scripts(spark, [{"logical_path": f"/s{i:02d}"} for i in range(1, 26)])
    r = random.Random(depth)
    chain = {(i, "import", f"/s{i + 1:02d}", i + 1) for i in range(1, 25)} | {(1, "import", f"/s{i:02d}", i) for i in range(3, 26)}
    mixed = {(a, r.choice(["import", "referenced"]), f"/s{b:02d}", b) for a, b in ((r.randrange(1, 26), r.randrange(1, 26)) for _ in range(70))} | {(3, "import", "lost.mod", None)}
    for edges in (chain, mixed):
        d = deps(spark, [(a, path, b, kind) for a, kind, path, b in edges])
        got = graph.tree(spark, s, d, "/s01", depth).collect()
        assert [r.node_id for r in got] == list(range(len(got)))
        assert [(r.logical_path, r.depth, r.parent_id, r.cycle, r.repeated, r.truncated) for r in got] == walked(edges, 1, depth)


def test_tree_takes_its_walk_to_no_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    s = scripts(spark, [{"logical_path": f"/s{i:02d}"} for i in range(1, 26)])
    d = deps(spark, [(a, f"/s{b:02d}", b, "import") for a in range(1, 26) for b in range(1, 26)])
    taken, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: taken.append(rows := collect(self)) or rows)
    found = graph.tree(spark, s, d, "/s01", 2)
    assert max((len(t) for t in taken), default=0) <= 1
    monkeypatch.undo()
    assert found.count() == 1 + 25 + 24 * 25


def test_show_and_fallback(spark, diamond):
    s, d = diamond
    linked = scripts(spark, [r.asDict() for r in s.collect()] + [{"id": 6, "logical_path": "/w/alias", "symlink_target": "/w/pier"}, {"id": 7, "logical_path": "/w/lost", "symlink_target": "/gone"}])
    catalog = {"scripts": linked, "dependencies": d, "revisions": revs(spark, [("/w/pier", "DEVELOP", "amy", "20250101_0101", 5.0)])}
    row = show.show(catalog, "/w/alias", ("owner", "uses", "used_by", "siblings", "linked_by", "folder", "tags", "revisions", "contributors", "nope")).first()
    assert row.path == "/w/pier" and [u.path for u in row.uses] == ["/w/rope"] and [u.logical_path for u in row.used_by] == ["/w/crane", "/w/truck"]
    assert len(row.siblings) == 6 and [x.logical_path for x in row.linked_by] == ["/w/alias"] and row.folder == "/w" and row.tags == [] and row.revisions[0].user == "amy"
    assert "nope" not in row.asDict() and row.contributors == []
    assert show.show(catalog, "/w/lost").first().path == "/w/lost"
    with pytest.raises(show.UnknownScript):
        show.show(catalog, "/none")
    more = {"scripts": s, "dependencies": deps(spark, [(1, "/ext/tide.csv", None, "inputfile"), (2, "/ext/tide.csv", None, "paramfile")])}
    assert [(r.relation, r.path, r.kind) for r in show.dependencies_of(more, "/ext/tide.csv").orderBy("path").collect()] == [("declared_by", "/w/crane", "paramfile"), ("declared_by", "/w/dock", "inputfile")]
    assert [(r.relation, r.path) for r in show.dependencies_of(catalog, "/w/rope").collect()] == [("used_by", "/w/pier")]
    with pytest.raises(show.UnknownScript):
        show.dependencies_of(more, "/ext/none")


def test_diff_against_revisions(spark):
    s = scripts(spark, [{"logical_path": "/w/a.py", "content": "x\ny\n", "language": "python"}, {"logical_path": "/w/b.csv", "content": "x\n", "language": "csv"}])
    r = revs(spark, [("/w/a.py", "DEVELOP", "amy", "20250101", 1.0), ("/w/a.py", "DEVELOP", "bob", "20250201", 1.0), ("/w/a.py", "ARCHIVE", "", "20240101", 1.0), ("/w/b.csv", "DEVELOP", "amy", "20250101", 1.0)])
    texts = spark.createDataFrame([(f"/w/a.py#{i}", t) for i, t in enumerate(("old", "x\nz\n", "x\ny\n"))] + [("/w/b.csv#3", "z")], "physical_path string, content string")
    got = diffing.against_newest_checkouts(s, r, texts).collect()
    assert [(g.logical_path, g.new_label, g.new_kind, g.lines) for g in got] == [("/w/a.py", "/w/a.py#1", "checkout", [" x", "-y", "+z"])]
    kept = status.chosen_revision(r, "/w/a.py", "archive")
    assert diffing.against_revision(s, kept, texts).count() == 0
    assert diffing.against_revision(s, status.chosen_revision(r, "/w/a.py", "develop", user="amy"), texts).first().new_kind == "checkout"
    with pytest.raises(status.NoRevision, match="bob 20250201"):
        status.chosen_revision(r, "/w/a.py", "DEVELOP", user="eve")
    assert diffing.two_files(("a", "x\n"), ("b", "x\n")) == "(no differences)" and "+y" in diffing.two_files(("a", "x\n"), ("b", "y\n"))
    for bad in (None, s.where("language = 'csv'").first()):
        with pytest.raises(diffing.DiffError):
            diffing.comparable(bad)


def test_audit_of_vectors(spark):
    v = spark.createDataFrame([(1, "/a", [1.0, 0.0]), (2, "/b", [1.0, 0.001]), (3, "/c", [0.0, 1.0])], "script_id long, logical_path string, embedding array<float>")
    catalog = {"scripts": scripts(spark, [{"logical_path": p} for p in ("/a", "/b", "/c")]), "dependencies": deps(spark, []), "revisions": revs(spark, []), "script_embeddings": v}
    found = audit.audit(catalog, ["near-duplicates", "outliers"], near=0.99, far=0.5).collect()
    assert [(f.check, f.logical_path, f.detail) for f in found] == [("near-duplicates", "/a", "like /b"), ("outliers", "/c", "like no other script")]
    assert tuple(stats.severity_summary(audit.audit(catalog, ["near-duplicates", "outliers"], near=0.99, far=0.5)).first()) == (0, 1, 1)
    near = similarity.nearest_of(v, v.where("script_id = 2"), 1).collect()
    assert [(r.of, r.logical_path, r.place) for r in near] == [("/b", "/a", 1)]


def test_shown_values(spark):
    rows = [(1126, 59.0, 1700000000.9, "inputfile"), (1 << 30, 5400.0, 0.0, "import"), (1279, 200_000.0, -0.5, "parentfile")]
    df = spark.createDataFrame(rows, "size long, age double, mtime double, kind string")
    got = [tuple(r) for r in df.select(X.human_size(F.col("size")), X.relative_age(F.col("age")), X.iso_mtime(F.col("mtime")), X.kind_label(F.col("kind"))).collect()]
    assert got == [("1.1 KB", "1m ago", "2023-11-14T22:13:20Z", "input"), ("1.0 GB", "2h ago", "1970-01-01T00:00:00Z", "import"), ("1.2 KB", "2d ago", "1969-12-31T23:59:59Z", "parent")]


def test_status(spark):
    s = scripts(spark, [{"logical_path": "/a"}, {"logical_path": "/clean"}])
    r = revs(spark, [("/a", "DEVELOP", "jdoe", "20240315_1430", 5.0), ("/lost", "DEVELOP", "amy", "20240315_1430", 5.0)])
    assert {x.logical_path: (x.checkout_user, "without" in (x.vc_warnings or "")) for x in status.checkout_status(s, r).collect()} == {"/a": ("jdoe", False), "/lost": ("amy", True)}
    assert paths(status.checkout_status(s, r, "/clean")) == ["/clean"]


def test_audit(spark):
    s = scripts(spark, [{"logical_path": "/w/harbour/crane.py", "language": "python", "owner": "kim", "metadata_json": '{"techowner":"pilots"}'}, {"logical_path": "/w/moor.ksh", "language": "shell", "owner": "kim"}])
    names = ["bisect", "email.mime.text", "wsgiref", "seaborn", "tides.almanac", "harbour.lost", "harbour.dock.sunk", "..up", "ropes/knot.py"]
    d = deps(spark, [(1, n, None, "import") for n in names] + [(2, "lines.ksh", None, "import"), (2, "berths.csv", None, "inputfile")])
    r = revs(spark, [("/w/moor.ksh", "DEVELOP", "kim", "20230506", 130 * 86400.0), ("/w/harbour/crane.py", "DEVELOP", "kim", "20230506", 2 * 86400.0)])
    catalog = {"scripts": s, "dependencies": d, "revisions": r}
    found = audit.audit(catalog, ["broken-deps"]).collect()
    assert {f.detail.removeprefix("unresolved: ") for f in found} == {"..up", "lines.ksh", "harbour.lost", "harbour.dock.sunk", "ropes/knot.py"}
    assert {f.detail for f in audit.audit(catalog, ["external-deps "]).collect()} == {"external: seaborn", "external: tides.almanac"}
    assert paths(audit.audit(catalog, ["unowned"])) == ["/w/moor.ksh"]
    assert [(f.logical_path, f.detail) for f in audit.audit(catalog, ["stale-checkouts"]).collect()] == [("/w/moor.ksh", "130 days")]
    for bad in (["nonsense"], ["outliers"]):
        with pytest.raises(ValidationError):
            audit.audit(catalog, bad)
    assert "external-deps" not in {f.check for f in audit.audit(catalog).collect()}
    assert stats.exit_code(1, 0) == 2 and stats.exit_code(0, 3, True) == 1 and stats.exit_code(0, 3) == 0


def test_similarity(spark):
    def vectors(*rows):
        return spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(rows)], "script_id long, logical_path string, embedding array<float>")

    pair = vectors(("/b", [0.999, 0.001]), ("/a", [1.0, 0.0]), ("/z", [0.0, 0.0]), ("/w", [1.0]))
    assert [(r.path_a, r.path_b) for r in similarity.near_duplicates(pair, 0.99).collect()] == [("/a", "/b")]
    far = vectors(("/a", [1.0, 0.0]), ("/b", [0.99, 0.14]), ("/c", [0.0, 1.0]))
    assert paths(similarity.outliers(far, 0.5)) == ["/c"]
    assert similarity.outliers(vectors(("/a", [1.0])), 0.5).count() == 0
    assert similarity.nearest(far, "/none", 3).count() == 0
    assert paths(similarity.nearest(far, "/a", 1)) == ["/b"]


def test_diffs(spark):
    old = scripts(spark, [{"logical_path": "/old"}, {"logical_path": "/load", "metadata_json": '{"techowner":"Alice"}'}])
    new = scripts(spark, [{"logical_path": "/load", "metadata_json": '{"techowner":"Bob"}'}, {"logical_path": "/new"}])
    got = {r.logical_path: (r.change, r.changes) for r in diffing.catalog_diff(old, new).collect()}
    assert got["/old"][0] == "removed" and got["/new"][0] == "added" and tuple(got["/load"][1]["techowner"]) == ("Alice", "Bob")
    h = diffing.hunks("a\nb\nc\nd\ne\n", "a\nb\nX\nd\ne\n")
    assert h[0]["lines"] == [" a", " b", "-c", "+X", " d", " e"] and h[0]["old_start"] == 1
    assert diffing.render("x", "y", []) == "(no differences)"
    assert diffing.hunks("", "a")[0]["old_start"] == 0


def test_warnings(spark):
    links = [("/ring", "/ring"), ("/oar", "/sail"), ("/net", "/net_20230506"), ("/winch_port", "/winch"), ("/winch_stern", "/win")]
    s = scripts(spark, [{"logical_path": a, "symlink_target": b} for a, b in links])
    assert paths(warnings.self_referential(s)) == ["/ring"]
    assert sorted(paths(warnings.name_mismatch(s))) == ["/oar", "/winch_stern"]
    r = revs(spark, [("/oar", "DEVELOP", "kim", "20230506_091500", 1.0), ("/net", "DEVELOP", "kim", "20230506", 1.0), ("/net", "ARCHIVE", "kim", "20230506", 1.0)])
    assert paths(warnings.missing_archive(r)) == ["/oar"]
    at = scripts(spark, [{"logical_path": "/oar", "mtime": 1683360000.0}])  # 08:00 UTC of that day
    assert warnings.timestamp_drift(at, r, "UTC").count() == 0
    assert warnings.timestamp_drift(at, r, "+02:00").count() == 1
    none = spark.createDataFrame([("  ",)], "path string")
    assert warnings.registration(s, none).count() == 0


def test_hunks_leave_as_soon_as_enough_text_is_compared(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(diffing, "CHARS", 100)
    texts = [("\n".join("abcdefgh"[: 2 + i % 6]) * 3, "x") for i in range(40)]
    pairs = pa.RecordBatch.from_pydict({"logical_path": [f"/{i}" for i in range(40)], "old": [a for a, _ in texts], "new": [b for _, b in texts], "of": ["o"] * 40})
    out = list(diffing.diffed(iter([pairs])))
    assert len(out) > 5 and sum(b.num_rows for b in out) == 40
    got = [r for b in out for r in b.to_pylist()]
    assert [(r["logical_path"], r["lines"], r["of"]) for r in got] == [(f"/{i}", diffing.hunks(*t)[0]["lines"], "o") for i, t in enumerate(texts)]


def test_comparing_with_checkouts_joins_texts_once(spark):
    s = scripts(spark, [{"logical_path": "/w/a", "content": "x\ny\n", "language": "python"}])
    files = spark.createDataFrame([("/w/a", "/vc/a", "x\nz\n")], "logical_path string, physical_path string, content string")
    found = diffing.catalog_against(s, files, "checkout")
    assert [(r.lines, r.old_label, r.new_label) for r in found.collect()] == [([" x", "-y", "+z"], "catalog:/w/a", "/vc/a")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
