import hashlib
import json
import os
from datetime import datetime, timezone

import pytest

from cairn.functions.querytext import ValidationError
from cairn.operators import similarity
from cairn.plans import build
from cairn.schema import TABLES
from cairn.sources import extract as X
from cairn.sources import scan, store
from cairn.streaming.activity import activity, run_to_end


def test_header_rules():
    text = "#!/bin/sh\n# @brief Loads data\n# @author Amy\n# @techowner Team\n# @history 2024-05-10 alice 1.2.3 Fixed it\n# @inputfile \"in.csv\"\n# @inputfile b.csv\n# @usage\n# run it\n# @endusage\necho\n# @purpose late\n"
    m = X.metadata(text, "shell")
    assert m["purpose"] == "Loads data" and m["owner"] == "Amy" and "techowner" not in m["fields"]
    assert m["fields"]["history_entries"][0] == {"raw": "2024-05-10 alice 1.2.3 Fixed it", "date": "2024-05-10", "version": "1.2.3", "author": "alice", "summary": "Fixed it"}
    assert m["related"] == ["in.csv", "b.csv"] and m["fields"]["usage"] == "run it"
    assert X.metadata('"""Doc line\nmore"""', "python")["purpose"] == "Doc line"
    assert X.metadata('#!/x\n"""Doc"""', "python")["purpose"] == ""
    assert X.history_entry("Fixed 1.0")["summary"] == "Fixed 1.0"
    assert X.history_entry("  amy (2025-01-02)  3.4  moved   the docks ") == {"raw": "amy (2025-01-02)  3.4  moved   the docks", "date": "2025-01-02", "version": "3.4", "author": "amy", "summary": "() moved the docks"}
    assert X.history_entry("2025-01-02 2025-02-03 later")["author"] is None and X.history_entry("2025-01-02")["summary"] is None


def test_python_facts():
    f = X.python_facts("import os.path as p\nfrom a.b import c\nfrom . import d\nclass K:\n  def m(self):\n    p.join(c())\n    def inner(): pass\ndef g(): K()\ng()\n")
    assert f["imports"] == ["os.path", "a.b", ".d"]
    assert [(d[0], d[1]) for d in f["definitions"]] == [("K", "class"), ("K.m", "function"), ("g", "function")]
    assert {(c[0], c[1], c[3]) for c in f["calls"]} == {("K.m", "p.join", "os.path.join"), ("K.m", "c", "a.b.c"), ("g", "K", "K"), ("__module__", "g", "g")}
    assert X.python_facts("import x\nprint 'old'\n")["imports"] == ["x"]


def test_python_facts_of_text_too_deep_for_the_parser(monkeypatch):
    assert X.python_facts("import x\nx = " + "-" * 20_000 + "1\n")["imports"] == ["x"]

    def full(text):
        raise MemoryError

    monkeypatch.setattr(X.ast, "parse", full)
    with pytest.raises(MemoryError):
        X.python_facts("import x\n")


def test_references():
    assert X.path_references("x/a.sh/b.py.bak ..\\lib\\c.py c.py /t/d.yml~ run /t/e.yaml") == ["../lib/c.py", "/t/e.yaml"]
    assert X.yaml_references("- import_playbook: a/b.yml\n- roles: [plain, ns/x]\n- ansible.builtin.include_tasks: {file: t.yml, other: no.yml}\n") and "no.yml" not in X.yaml_references("- include_tasks: {file: t.yml, other: no.yml}\n")
    assert X.shell_sources("source common.sh\n. ./x.sh\n") == ["common.sh"]
    text = "if true; then source a.sh; fi\ntrue && . b.sh || . 'c.sh'\n# . no.sh\necho . no.sh 'x\n. no.sh\n' \"\n. no.sh\"\ncat <<EOF >out\n. no.sh\nEOF\n"
    text += "X=1 Y=$(. d.sh) . \"e.sh\" arg\n{ . f.sh; }\n(. g.sh)\nfor i in a; do . $v h.sh; done\ncase x in a) . i.sh ;; esac\ncat <<-'E' | . j.sh\n\t. no.sh\n\tE\n! . k.sh >&2 2>no.sh\n. l\\\n.sh; . m.sh#x\n"
    assert X.shell_sources(text) == ["a.sh", "b.sh", "c.sh", "d.sh", "e.sh", "f.sh", "g.sh", "h.sh", "i.sh", "j.sh", "k.sh", "l\\\n.sh", "m.sh#x"]
    assert X.shell_sources("echo 'open\n. no.sh") == [] and X.shell_sources("") == [] and X.shell_sources("$(" * 5000 + ". x") is not None


def test_ignore_rules():
    i = scan.Ignore(["*.log", "!keep.log", "/top/", "a/**/z", "# no", ""])
    assert i.decides("x/y.log", False) and i.decides("keep.log", False) is False and i.decides("top", True) and i.decides("top", False) is None and i.decides("a/b/c/z", False)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("src") / "linux"
    files = {
        "lib/helper.py": "def run():\n    pass\n",
        "main.py": "import lib.helper\nlib.helper.run()\n",
        "jobs/go.sh": "#!/bin/sh\n# @inputfile data.csv\n# @childfile ../main.py\n../lib/helper.py /tmp/none.py\n",
        "jobs/data.csv": "\n".join(map(str, range(501))),
        "jobs/go.sh_20240101_1200_amy": "old",
        "bin/tool": "#!/usr/bin/env python3\n",
        "notes.md": "x",
        "x.py~": "x",
        "DEVELOP/main.py_20240101_bob": "x",
        "skip/me.py": "x",
        ".catignore": "skip/\n",
    }
    for name, text in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    out = str(tmp_path_factory.mktemp("out") / "catalog")
    for n in ("20240101T000000", "20240102T000000"):
        build.build(spark, build.Settings({str(top): "/cat"}), out, n, now=2e9, keep=2)
    return store.open_catalog(spark, out), out


def test_build(spark, catalog):
    c, out = catalog
    s = {r.logical_path: r for r in c["scripts"].collect()}
    assert sorted(s) == ["/cat/bin/tool", "/cat/jobs/data.csv", "/cat/jobs/go.sh", "/cat/lib/helper.py", "/cat/main.py"]
    assert [s[p].id for p in sorted(s)] == [1, 2, 3, 4, 5]
    assert s["/cat/jobs/data.csv"].content.count("\n") == 20 and s["/cat/bin/tool"].language == "python"
    name = {r.id: r.logical_path for r in s.values()}
    edges = {(name[d.script_id], d.kind, d.depends_on_path, name.get(d.resolved_script_id)) for d in c["dependencies"].collect()}
    assert ("/cat/main.py", "import", "lib.helper", "/cat/lib/helper.py") in edges
    assert ("/cat/jobs/go.sh", "inputfile", "/cat/jobs/data.csv", "/cat/jobs/data.csv") in edges
    assert ("/cat/jobs/go.sh", "referenced", "../lib/helper.py", "/cat/lib/helper.py") in edges
    assert not any("none" in e[2] for e in edges)
    assert [(r.logical_path, r.user, r.revision_type) for r in c["revisions"].collect()] == [("/cat/jobs/go.sh", "amy", "WORKING")]
    call = c["function_calls"].first()
    assert call.callee == "lib.helper.run" and name[call.resolved_target_script_id] == "/cat/lib/helper.py"
    assert store.builds(spark, out) == ["build=20240101T000000", "build=20240102T000000"] and store.previous_pair(spark, out)[1] == "20240102T000000"


def test_snapshot_pairs(spark, catalog, tmp_path):
    out = catalog[1]
    names = [tuple(t["index_metadata"].first().build_timestamp for t in pair) for pair in (store.snapshots(spark, out), store.snapshots(spark, out, "20240102T000000", "20240101T000000"))]
    assert names == [("20240101T000000", "20240102T000000"), ("20240102T000000", "20240101T000000")]
    for wrong in ({"old": "20240101T000000"}, {"new": "20240101T000000"}, {"old": "20240101T000000", "new": "20240102T000000", "against": "/x"}):
        with pytest.raises(ValidationError):
            store.snapshots(spark, out, **wrong)
    with pytest.raises(store.NotFound):
        store.snapshots(spark, out, "20240101T000000", "20200101T000000")


def test_catalog_errors(spark, catalog, tmp_path):
    with pytest.raises(store.NotFound):
        store.open_catalog(spark, str(tmp_path / "none"))
    twice = catalog[0]["scripts"].unionByName(catalog[0]["scripts"])
    with pytest.raises(store.Invalid):
        store.publish(spark, str(tmp_path / "bad"), {"scripts": twice}, "b1")
    assert [store.compatibility(v) for v in (13, 14, 15, None)] == ["older", "compatible", "newer", "older"]


def test_exports(catalog):
    s = catalog[0]["scripts"].where("logical_path = '/cat/main.py'")
    assert store.csv_header(["path", "lang", "path", "nope"]) == "path,language" and store.fields(["nope"])[1] == ["nope"]
    assert store.csv_lines(s, ["path", "tags"]).first().value == "/cat/main.py,[]"
    assert json.loads(store.json_lines(s, ["path", "checkout"]).first().value) == {"path": "/cat/main.py", "checkout": None}


def test_publish_again_and_vectors(spark, catalog, tmp_path):
    root = str(tmp_path / "c")
    for n in (1, 2):
        own = catalog[0]["scripts"].limit(n)
        store.publish(spark, root, {"scripts": own}, "b1")
        assert store.open_catalog(spark, root)["scripts"].count() == n
    assert store.open_vectors(spark, root) == ("absent", None, None)
    rows = [(1, "/cat/main.py", "m", 2, [0.6, 0.8], "h1")]
    store.publish_vectors(spark, root, spark.createDataFrame(rows, TABLES["script_embeddings"]), "b1")
    state, vectors, build = store.open_vectors(spark, root)
    assert state == "ok" and build == "b1" and vectors.first().logical_path == "/cat/main.py"
    texts = spark.createDataFrame([("/cat/main.py", "h1"), ("/cat/x.py", "h2")], "logical_path string, text_hash string")
    again = {r.logical_path: r.embedding for r in similarity.reuse_vectors(texts, vectors, "m").collect()}
    assert again["/cat/x.py"] is None and len(again["/cat/main.py"]) == 2
    assert similarity.provenance_note("b1", "b2") and similarity.provenance_note("b1", "b1") is None
    spark.createDataFrame([(1, 99, "b9")], TABLES["embedding_metadata"]).write.mode("overwrite").parquet(f"{root}/vectors/embedding_metadata")
    assert store.open_vectors(spark, root)[0] == "newer"
    for f in (tmp_path / "c/vectors/script_embeddings").glob("part-*"):
        f.write_bytes(b"torn")
    spark.catalog.clearCache()
    assert store.open_vectors(spark, root)[0] == "unreadable"


def test_checkout_scan(spark):
    rows = [("/w/aix/src", f"{p}", 90.0) for p in ("pier/DEVELOP/moor.ksh_20230506_0915_kim", "pier/DEVELOP/winch_20230607_081500_RB_lee", "ARCHIVE/hull/keel_20230506", "DEVELOP/.knot_20230506_kim", "DEVELOP/rope_20230506_lee.org")]
    got = {r.logical_path: r for r in scan.checkouts(spark.createDataFrame(rows, "root string, rel string, mtime double"), 100.0).collect()}
    assert sorted(got) == ["/hull/keel", "/pier/moor.ksh", "/pier/winch"]
    assert got["/pier/winch"].revision_type == "ROLLBACK" and got["/pier/winch"].user == "lee" and got["/hull/keel"].user == ""
    assert got["/pier/moor.ksh"].os_flavor == "aix" and got["/pier/moor.ksh"].age_seconds == 10.0


def test_stream_is_the_batch(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "/a", "DEVELOP"), ("2024-01-01 11:00:00", "/a", "DEVELOP"), ("2024-01-02 01:00:00", "/b", "DEVELOP"), ("2024-01-02 02:00:00", "/c", "ARCHIVE"), ("2024-01-09 02:00:00", "/d", "DEVELOP")]
    more = [("2024-01-09 03:00:00", "/e", "DEVELOP"), ("2024-01-09 02:00:00", "/d", "DEVELOP"), ("2024-01-08 12:00:00", "/f", "DEVELOP")]

    def feed(rows):
        return spark.createDataFrame(rows, "t string, physical_path string, revision_type string").selectExpr("cast(t as timestamp) as ts", "physical_path", "revision_type")

    for i, part in enumerate((rows, more)):  # one file a batch, the second with a repeated row and an earlier one
        feed(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*"):
            if os.stat(f).st_mtime > 1.5e9:
                os.utime(f, (1e9 + i, 1e9 + i))
    stream = spark.readStream.schema(feed(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, run_to_end(spark, stream).collect()))
    assert got == sorted(map(tuple, activity(feed(rows + more)).collect())) == [("20240101", 1), ("20240102", 1), ("20240108", 1), ("20240109", 2)]
    late = [("2024-01-01 12:00:00", "/late", "DEVELOP")]  # beyond the lateness when it comes: left out
    feed(late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(feed(rows).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, run_to_end(spark, stream).collect())) == got


def _listing(files, times, sizes=None):
    rows = [(p, len(t) if t is not None else 7, float(times.get(p, 1.0)), None) for p, t in files.items()]
    return rows, "logical_path string, size long, mtime double, symlink_target string"


def _reader(spark, files, asked):
    def read(listed):
        asked.append(listed)
        rows = [(p, t, None if t is None else hashlib.sha256(t.encode()).hexdigest(), "gone" if t is None else None) for p, t in files.items()]
        texts = spark.createDataFrame(rows, "logical_path string, content string, content_hash string, error string")
        return texts.join(listed.select("logical_path"), "logical_path")

    return read


def test_incremental_build_equals_a_full_one(spark, tmp_path):
    first = {f"/r/d{i % 3}/m{i}.py": f"import m{(i + 1) % 12}\ndef f{i}():\n    m{(i + 1) % 12}.f{(i + 1) % 12}()\n" for i in range(12)}
    first |= {"/r/run.sh": "#!/bin/sh\nsh d0/m0.py ./d1/m1.py\n", "/r/run.sh_20240101_1200_kim": "old", "/r/tool": "#!/usr/bin/env bash\n. run.sh\n", "/r/notes.md": "x", "/r/gone.py": "import m1\n", "/r/locked.sh": "sh d2/m2.py\n"}
    second = dict(first)
    del second["/r/gone.py"], second["/r/d1/m1.py"]
    second |= {"/r/d2/m2.py": "import m5\ndef g():\n    pass\n", "/r/m1.py": "def f1():\n    pass\n", "/r/locked.sh": None, "/r/never.sh": None}
    times = {"/r/d2/m2.py": 5.0, "/r/run.sh": 6.0, "/r/m1.py": 5.0, "/r/locked.sh": 8.0, "/r/never.sh": 8.0}
    made = build.increment(spark, spark.createDataFrame(*_listing(first, {})), _reader(spark, first, []), None, "20240101T000000", 1e9)
    out = str(tmp_path / "c")
    store.publish(spark, out, {n: t for n, t in made.items() if n != "changes"}, "20240101T000000", "a.b")
    asked = []
    old = store.open_catalog(spark, out)
    some = build.increment(spark, spark.createDataFrame(*_listing(second, times)), _reader(spark, second, asked), old, "20240102T000000", 1e9)
    how = {r.logical_path: r.how for r in some["changes"].collect()}
    want = {p: "same" for p in second if not p.endswith((".md", "_kim"))}
    want |= {"/r/d2/m2.py": "changed", "/r/run.sh": "touched", "/r/m1.py": "added", "/r/locked.sh": "kept", "/r/never.sh": "lost", "/r/gone.py": "removed", "/r/d1/m1.py": "removed"}
    assert how == want
    assert {r.logical_path for r in asked[0].collect()} == {"/r/d2/m2.py", "/r/run.sh", "/r/m1.py", "/r/locked.sh", "/r/never.sh"}
    assert {r.error for r in some["changes"].where("how in ('kept', 'lost')").collect()} == {"gone"}
    # A full build over the same files, in which the locked one can still be read as it was.
    readable = {p: first["/r/locked.sh"] if p == "/r/locked.sh" else t for p, t in second.items()}
    whole = build.increment(spark, spark.createDataFrame(*_listing(readable, {p: t for p, t in times.items() if p != "/r/locked.sh"})), _reader(spark, readable, []), None, "20240102T000000", 1e9)
    for name in ("scripts", "dependencies", "revisions", "function_definitions", "function_calls", "facts"):
        a, b = (sorted(map(str, t[name].select(*sorted(t[name].columns)).collect())) for t in (some, whole))
        assert a == b, name
    # An edge that went to the removed script goes to the one that now has its name.
    target = {r.id: r.logical_path for r in some["scripts"].collect()}
    edges = {(target[r.script_id], r.depends_on_path): target.get(r.resolved_script_id) for r in some["dependencies"].collect()}
    assert edges["/r/d0/m0.py", "m1"] == "/r/m1.py" and edges["/r/d2/m2.py", "m5"] == "/r/d2/m5.py"


def test_build_skips_and_carries(spark, tmp_path, monkeypatch):
    top = tmp_path / "src"
    (top / "sub/DEVELOP").mkdir(parents=True)
    (top / "a.py").write_text("import b\n")
    (top / "sub/b.py").write_text("def run(): pass\n")
    (top / "sub/DEVELOP/b.py_20240101_kim").write_text("x")
    out, settings = str(tmp_path / "c"), build.Settings({str(top): "/r"})
    now = max(os.stat(p).st_mtime for p in top.rglob("*"))
    names = [datetime.fromtimestamp(int(now) + 10 * i, timezone.utc).strftime("%Y%m%dT%H%M%S") for i in range(1, 5)]
    assert build.build(spark, settings, out, names[0], now) == f"{out}/build={names[0]}"
    extracted = []
    extract = build.facts_of
    monkeypatch.setattr(build, "facts_of", lambda scripts: extracted.append(sorted(r.logical_path for r in scripts.collect())) or extract(scripts))
    assert build.build(spark, settings, out, names[1], now) is None and extracted == []
    # Other settings: everything derived is made anew, but no file is extracted again.
    assert build.build(spark, build.Settings({str(top): "/r"}, manifest=("/r/a.py",)), out, names[1], now) and extracted == [[]]
    monkeypatch.setattr(build, "EXTRACTOR_REVISION", 2)
    assert build.build(spark, settings, out, names[2], now) and extracted[1:] == [["/r/a.py", "/r/sub/b.py"]]
    later = int(now) + 35
    os.utime(top / "a.py", (later, later))
    assert build.build(spark, settings, out, names[3], now) and extracted[2:] == [[]]
    assert store.open_catalog(spark, out)["scripts"].where(f"mtime = {later}").count() == 1


def test_failed_build_goes_on(spark, tmp_path, monkeypatch):
    top = tmp_path / "src"
    top.mkdir()
    for i in range(4):
        (top / f"m{i}.py").write_text(f"import m{(i + 1) % 4}\ndef f{i}(): pass\n")
    settings, clean, out = build.Settings({str(top): "/r"}), str(tmp_path / "clean"), str(tmp_path / "c")
    build.build(spark, settings, clean, "20240101T000000", 9.0)
    want = {n: sorted(map(str, t.collect())) for n, t in store.open_catalog(spark, clean).items()}
    done, stop = [], {"files": True, "facts": True, "publish": True}
    put, publish = store.Work.put, store.publish

    def stopping(self, df, name, mark):
        got = put(self, df, name, mark)
        done.append((name, name in self.done))
        if stop.pop(name, False):
            raise OSError(f"lost after {name}")
        return got

    monkeypatch.setattr(store.Work, "put", stopping)
    monkeypatch.setattr(store, "publish", lambda *a, **k: publish(*a, **k) if not stop.pop("publish", False) else (_ for _ in ()).throw(OSError("lost before publishing")))
    for _ in range(3):  # after each stage
        with pytest.raises(OSError):
            build.build(spark, settings, out, "20240101T000000", 9.0)
        assert store.builds(spark, out) == []
    assert build.build(spark, settings, out, "20240101T000000", 9.0)
    assert done == [("files", False), ("files", True), ("facts", False), ("files", True), ("facts", True), ("files", True), ("facts", True)]
    assert {n: sorted(map(str, t.collect())) for n, t in store.open_catalog(spark, out).items()} == want
    assert not (tmp_path / "c/_work").exists()
    # A file changed since the failure: nothing of that run is used.
    stop["facts"] = True
    (top / "m0.py").write_text("import m2\n")
    with pytest.raises(OSError):
        build.build(spark, settings, out, "20240102T000000", 9.0)
    (top / "m0.py").write_text("import m3\n\n")
    done.clear()
    assert build.build(spark, settings, out, "20240102T000000", 9.0) and done == [("files", False), ("facts", False)]
    edges = store.open_catalog(spark, out)["dependencies"].where("script_id = 1").collect()
    assert [(e.depends_on_path, e.resolved_script_id) for e in edges] == [("m3", 4)]


def test_newest_time(spark, tmp_path):
    top = tmp_path / "a b+c%20"
    (top / "x/DEVELOP/deep").mkdir(parents=True)
    (top / "x/f.py").write_text("1")
    (top / "x/DEVELOP/deep/f.py_20240101_kim").write_text("1")
    for i, p in enumerate((top / "x/f.py", top / "x/DEVELOP/deep/f.py_20240101_kim", top / "x/DEVELOP/deep", top / "x/DEVELOP", top / "x", top)):
        os.utime(p, (1000 + i, 1000 + i))
    roots = {str(top): "/r"}
    assert scan.newest(spark, roots) == 1005
    os.utime(top / "x/DEVELOP", (2000, 2000))  # a checkout came or went
    assert scan.newest(spark, roots) == 2000
    os.utime(top / "x/DEVELOP/deep/f.py_20240101_kim", (3000, 3000))  # what it holds does not count
    assert scan.newest(spark, roots) == 2000
    os.utime(top / "x/f.py", (4000.5, 4000.5))
    assert scan.newest(spark, roots) == 4000.5
    assert build.up_to_date(4000.5, 4001, "a", "a") and not build.up_to_date(4000.5, 4000, "a", "a") and not build.up_to_date(None, 9, "a", "a") and not build.up_to_date(1, 9, "a", "b")


def test_fingerprint_halves():
    base = build.Settings({"/a": "/r"})
    for other in (build.Settings({"/b": "/r"}), build.Settings({"/a": "/r"}, ("*.log",)), build.Settings({"/a": "/r"}, systems={"/a": "AIX"}), build.Settings({"/a": "/r"}, manifest=("/r/x",))):
        a, b = base.fingerprint().split("."), other.fingerprint().split(".")
        assert a[0] == b[0] and a[1] != b[1]


def test_unreadable_and_large_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "MOST_BYTES", 10)
    for name, text in (("a.py", "1"), ("big.py", "x" * 11)):
        (tmp_path / name).write_text(text)
    rows = [(f"/r/{n}", str(tmp_path / n), z) for n, z in (("a.py", 1), ("big.py", 11), ("none.py", 1))]
    got = {r.logical_path: (r.content, r.error) for r in scan.read_files(spark.createDataFrame(rows, "logical_path string, physical_path string, size long")).collect()}
    assert got == {"/r/a.py": ("1", None), "/r/big.py": (None, "larger than 10 bytes"), "/r/none.py": (None, "No such file or directory")}


def test_numbers_lose_no_row_where_plans_cut_ranges_differently(spark):
    sizes = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        files = spark.range(3000, numPartitions=3).selectExpr("format_string('/c/%05d', 2999 - id) AS logical_path", "repeat(sha2(cast(id AS string), 256), 20) AS content")
        got = sorted((r.logical_path, r.id) for r in build.numbered(files).select("logical_path", "id", "content").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(f"/c/{i:05d}", i + 1) for i in range(3000)]
