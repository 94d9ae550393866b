"""Prefix mapping: first match, boundaries, files; system warnings; reading trees."""

import json

import pytest

from cairn.functions.querytext import ValidationError
from cairn.sources import mapping, scan

MAP = [("/a/b", "/m1"), ("/a", "/m2/x"), ("/a/b/c", "/never"), ("rel", "/m3"), ("", "/all"), ("/d", "")]


def by_hand(path, pairs):
    for a, b in pairs:
        if path == a or (a and path.startswith(a + "/")):
            return b + path[len(a):]
    return path


def test_first_prefix_wins(spark):
    paths = ["/a/b", "/a/b/c/d.py", "/a/bc", "/a", "/a/", "/ab", "rel/x", "rel", "", "/", "/a//b", "/d/e", "x", "/a/b"]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths)] + [(None, 99)], "p string, physical int")
    table = mapping.mapping_table(spark, MAP)
    got = {r.physical: (r.p, r.physical_path) for r in mapping.to_physical(rows, "p", table).collect()}
    assert got == {i: (p, by_hand(p, MAP)) for i, p in enumerate(paths)} | {99: (None, None)}
    back = [(b, a) for a, b in MAP]
    paths = ["/m1/x", "/m2/x/y", "/m2/xy", "/m3", "/never", "/all/z", ""]
    got = [(r.p, r.logical_path) for r in mapping.to_logical(spark.createDataFrame([(p,) for p in paths], "p string"), "p", table).collect()]
    assert sorted(got) == sorted((p, by_hand(p, back)) for p in paths)


def test_mapping_files():
    good = {"mappings": [{"logical_prefix": "/a/", "linux": "/m//"}, {"logical_prefix": "/b", "linux": "/n"}]}
    want = [("/a", "/m"), ("/b", "/n")]
    assert mapping.parse_mapping(json.dumps(good), "m.json") == want
    assert mapping.parse_mapping("mappings:\n- {logical_prefix: /a/, linux: /m//}\n- logical_prefix: /b\n  linux: /n\n", "m.YML") == want
    for text, name in (("{", "m.json"), ("a: [", "m.yaml"), ("[]", "m.json"), ('{"mappings": [], "x": 1}', "m.json"), ('{"mappings": [{"logical_prefix": "/a"}]}', "m.json"), ('{"mappings": [{"logical_prefix": "/a", "linux": 3}]}', "m.json"), ('{"mappings": [{"logical_prefix": "/a", "linux": "/b", "aix": "/c"}]}', "m.json")):
        with pytest.raises(ValidationError, match="invalid mapping file"):
            mapping.parse_mapping(text, name)


def test_system_warnings(spark):
    roots = spark.createDataFrame([("/",), ("/top/",), ("/x/aix/src",), ("rel",)], "root string")
    named = spark.createDataFrame([("/top", "linux"), ("/typo", "aix"), ("/x/aix/src/", " ")], "root string, os string")
    revisions = spark.createDataFrame([("/top/DEVELOP/a", ""), ("/topper/DEVELOP/a", "x"), ("rel/DEVELOP/a", "")], "physical_path string, os_flavor string")
    got = {(r.root, r.kind) for r in mapping.system_warnings(roots, named, revisions).collect()}
    assert got == {("/", "root_without_system"), ("rel", "root_without_system"), ("/typo", "system_without_root")}
    assert mapping.system_warnings(roots, named.where("root = '/top'"), revisions.where("os_flavor <> ''")).count() == 0


def test_tree_of_any_store(spark, tmp_path):
    for name, text in (("a/b.py", "é\n"), ("a/b+c d.sh", "1"), ("empty.py", ""), ("big.txt", "x" * 50)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bytes.sh").write_bytes(b"a\xffb")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        files, errors = scan.read_tree(spark, root, 20)
        assert {(r.path, r.size, r.content) for r in files.collect()} == {("a/b.py", 3, "é\n"), ("a/b+c d.sh", 1, "1"), ("bytes.sh", 3, "a\ufffdb")}
        assert [tuple(r) for r in errors.collect()] == [("big.txt", "larger than 20 bytes")]
    assert "LessThanOrEqual(length,20)" in files._jdf.queryExecution().toString()


def test_manifest_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "m").write_text(" /a/x \n\n/b\n")
    rows, warning = scan.manifest(spark, str(tmp_path / "m"))
    assert [r.path for r in rows.collect()] == ["/a/x", "/b"] and warning is None
    rows, warning = scan.manifest(spark, str(tmp_path / "none"))
    assert rows.count() == 0 and "none cannot be read" in warning
