"""Dependency and call graphs, folders, symlinks and the transitive tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.exprs import ascii_lower, in_folder, json_list
from cairn.functions.querytext import ROLES
from cairn.sources.scratch import Scratch

TREE = "node_id long, parent_id long, depth int, logical_path string, kind string, via string, indexed boolean, cycle boolean, repeated boolean, truncated boolean"


def _ids(scripts: DataFrame, path: str) -> DataFrame:
    return scripts.where(F.col("logical_path") == path).select("id")


def related(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    """Indexed scripts that the script names as related, depends on, or that depend on it."""
    me = scripts.where(F.col("logical_path") == path)
    names = me.select(F.explode(json_list(F.col("related"))).alias("logical_path"))
    uses = dependencies.join(_ids(scripts, path).withColumnRenamed("id", "script_id"), "script_id", "left_semi").select(F.col("resolved_script_id").alias("id"))
    users = dependencies.join(_ids(scripts, path).withColumnRenamed("id", "resolved_script_id"), "resolved_script_id", "left_semi").select(F.col("script_id").alias("id"))
    by_id = scripts.join(uses.union(users).distinct(), "id", "left_semi").select("logical_path")
    found = names.union(by_id).distinct().where(F.col("logical_path") != path)
    return scripts.join(found, "logical_path", "left_semi").orderBy("logical_path")


def uses(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    own = dependencies.join(_ids(scripts, path).withColumnRenamed("id", "script_id"), "script_id", "left_semi")
    target = scripts.select(F.col("id").alias("resolved_script_id"), "logical_path")
    shown = F.coalesce("logical_path", "depends_on_path")
    return own.join(target, "resolved_script_id", "left").select("kind", shown.alias("path"), F.col("logical_path").isNotNull().alias("indexed")).orderBy("kind", "path")


def used_by(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    own = dependencies.join(_ids(scripts, path).withColumnRenamed("id", "resolved_script_id"), "resolved_script_id", "left_semi")
    return own.join(scripts.select(F.col("id").alias("script_id"), "logical_path"), "script_id").select("logical_path", "kind").distinct().orderBy("logical_path", "kind")


def declared_by(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    own = dependencies.where((F.col("depends_on_path") == path) & F.col("kind").isin(list(ROLES)))
    return own.join(scripts.select(F.col("id").alias("script_id"), "logical_path"), "script_id").select("logical_path", "kind").orderBy("logical_path", "kind")


def shared_files(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    """Declared files that are not indexed, with the other scripts that declare them."""
    declared = dependencies.where(F.col("kind").isin(list(ROLES)))
    mine = declared.where("resolved_script_id is null").join(_ids(scripts, path).withColumnRenamed("id", "script_id"), "script_id", "left_semi").select("depends_on_path", F.col("script_id").alias("me")).distinct()
    others = declared.join(mine, "depends_on_path").where("script_id <> me")
    return others.join(scripts.select(F.col("id").alias("script_id"), "logical_path"), "script_id").select("depends_on_path", "logical_path", "kind").orderBy("depends_on_path", "logical_path", "kind")


def functions_in(scripts: DataFrame, definitions: DataFrame, path: str) -> DataFrame:
    return definitions.join(_ids(scripts, path).withColumnRenamed("id", "script_id"), "script_id", "left_semi").select("name", "kind", "line").orderBy("line", "name")


def callers(scripts: DataFrame, definitions: DataFrame, calls: DataFrame, path: str) -> DataFrame:
    """Calls that resolve to the script and end in one of its names; % and _ in a name are wildcards."""
    mine = definitions.join(_ids(scripts, path).withColumnRenamed("id", "script_id"), "script_id", "left_semi")
    return all_callers(scripts, mine, calls).orderBy("at", "logical_path", "line", "name", "caller").select("name", "logical_path", "caller", "line")


def all_callers(scripts: DataFrame, definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """name, logical_path, caller, line, at (the definition's line): as callers, of every definition given.

    A call belongs to a name that it is, or that ends it after a dot, where _ in the name
    stands for any character and % for any characters.  Calls are exploded by their
    dotted ends, and an end meets a name by its text: for the names with _, an end is first
    overlaid with the few shapes (places of _) that names of its length have in the target
    script.  So no call is compared with names one by one, but for names with %.
    """
    own = definitions.select(F.col("script_id").alias("target"), "name", ascii_lower(F.col("name")).alias("text"), F.col("line").alias("at"))
    none = F.array().cast("array<int>")
    wild = F.contains("name", F.lit("%"))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1))), lambda i: F.substring("text", i, F.lit(1)) == "_")
    shaped = own.where(~wild).select("target", F.char_length("text").alias("width"), F.when(F.contains("text", F.lit("_")), places).otherwise(none).alias("shape"), "text", "name", "at")
    # A whole callee is like an end of no width, which only the name as it is written equals.
    whole = own.select("target", F.lit(-1).alias("width"), none.alias("shape"), F.col("name").alias("text"), "name", "at")
    names = shaped.unionByName(whole)
    shapes = names.select("target", "width", "shape").distinct()
    made = calls.where("resolved_target_script_id is not null and callee is not null").select(F.col("resolved_target_script_id").alias("target"), "script_id", "caller", "callee", "line")
    lower, end = ascii_lower(F.col("callee")), lambda text, width: F.struct(text.alias("text"), width.alias("width"))
    parts = F.split(lower, "\\.", -1)
    cut = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = F.when(F.contains("callee", F.lit(".")), F.transform(cut, lambda t: end(t, F.char_length(t)))).otherwise(F.array().cast("array<struct<text:string,width:int>>"))
    ends = made.select("target", "script_id", "caller", "line", F.explode(F.concat(F.array(end(F.col("callee"), F.lit(-1))), ends)).alias("end"))
    laid = F.aggregate("shape", F.col("end.text"), lambda text, i: F.overlay(text, F.lit("_"), i, F.lit(1)))
    tried = ends.withColumn("width", F.col("end.width")).join(shapes, ["target", "width"]).withColumn("text", laid)
    shown = ["script_id", "caller", "line", "name", "at"]
    found = tried.join(names, ["target", "width", "shape", "text"]).select(*shown)
    if not own.where(wild).isEmpty():
        # LIKE has no escape here, so a backslash in a name stands for itself.
        tail = F.concat(F.lit("%."), F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")))
        found = found.unionByName(made.join(own.where(wild), "target").where(F.like(lower, tail)).select(*shown))
    found = found.join(scripts.select(F.col("id").alias("script_id"), "logical_path"), "script_id")
    return found.groupBy("name", "logical_path", "caller", "line").agg(F.min("at").alias("at"))


def calls_from(scripts: DataFrame, calls: DataFrame, path: str) -> DataFrame:
    own = calls.join(_ids(scripts, path).withColumnRenamed("id", "script_id"), "script_id", "left_semi")
    target = scripts.select(F.col("id").alias("resolved_target_script_id"), F.col("logical_path").alias("target"))
    return own.join(target, "resolved_target_script_id", "left").select("caller", "callee", "line", "target").orderBy("line", "callee", "caller", "target")


def links_to(scripts: DataFrame, path: str) -> DataFrame:
    return scripts.where(F.col("symlink_target") == path).select("logical_path").orderBy("logical_path")


def points_to(scripts: DataFrame) -> DataFrame:
    """Every symlink with its target and whether that is indexed."""
    target = scripts.select(F.col("logical_path").alias("symlink_target"), F.lit(True).alias("here"))
    return scripts.where("symlink_target is not null").select("logical_path", "symlink_target").join(target, "symlink_target", "left").select("logical_path", "symlink_target", F.coalesce("here", F.lit(False)).alias("indexed"))


def scripts_in(scripts: DataFrame, folder: str) -> DataFrame:
    return scripts.where(in_folder(F.col("logical_path"), folder)).orderBy("logical_path")


def siblings(scripts: DataFrame, path: str) -> DataFrame:
    folder = path.rpartition("/")[0] or ("/" if path.startswith("/") else "")
    return scripts_in(scripts, folder).where(F.col("logical_path") != path)


def subdirs(scripts: DataFrame, folder: str) -> DataFrame:
    prefix = folder.rstrip("/") + "/"
    rest = F.substring("logical_path", len(prefix) + 1, 1 << 30)
    return scripts.where(F.col("logical_path").startswith(prefix) & rest.contains("/")).select(F.substring_index(rest, "/", 1).alias("name")).distinct().orderBy("name")


def detail(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    """Distinct (relation, path): what the script uses, what uses it, and its symlinks both ways."""
    out = uses(scripts, dependencies, path).select(F.lit("uses").alias("relation"), "path")
    out = out.union(used_by(scripts, dependencies, path).select(F.lit("used_by"), "logical_path"))
    out = out.union(scripts.where((F.col("logical_path") == path) & F.col("symlink_target").isNotNull()).select(F.lit("symlink"), "symlink_target"))
    return out.union(links_to(scripts, path).select(F.lit("linked"), "logical_path")).dropDuplicates(["relation", "path"])


def _record(rows: DataFrame, *more: str) -> DataFrame:
    """value: a JSON object of a script's path, language, owner, purpose and *more*, nulls included."""
    own = F.struct(F.col("logical_path").alias("path"), "language", "owner", "purpose", *more)
    return rows.select("logical_path", F.to_json(own, {"ignoreNullFields": "false"}).alias("value"))


_OWN = ["logical_path", "language", "owner", "purpose"]


def dependency_records(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    """What the script uses, as JSON objects; a target that is not indexed has only the path as written."""
    own = dependencies.join(_ids(scripts, path).withColumnRenamed("id", "script_id"), "script_id", "left_semi")
    target = scripts.select(F.col("id").alias("resolved_script_id"), *_OWN)
    rows = own.join(target, "resolved_script_id", "left")
    shape = F.struct(F.coalesce("logical_path", "depends_on_path").alias("path"), "depends_on_path", "language", "owner", "purpose", F.col("logical_path").isNotNull().alias("indexed"), "kind")
    return rows.select(F.coalesce("logical_path", "depends_on_path").alias("logical_path"), F.to_json(shape, {"ignoreNullFields": "false"}).alias("value"))


def used_by_records(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    return _record(used_by(scripts, dependencies, path).join(scripts.select(*_OWN), "logical_path"), "kind")


def sibling_records(scripts: DataFrame, path: str) -> DataFrame:
    return _record(siblings(scripts, path))


def declared_by_records(scripts: DataFrame, dependencies: DataFrame, path: str) -> DataFrame:
    """Scripts that declare a file, with the role in which they do."""
    return _record(declared_by(scripts, dependencies, path).withColumnRenamed("kind", "role").join(scripts.select(*_OWN), "logical_path"), "role")


def _edges(scripts: DataFrame, dependencies: DataFrame, reverse: bool) -> DataFrame:
    """(a, b, kind, via, path): from node a to b, which is null where the target is not indexed."""
    names = scripts.select(F.col("id").alias("b"), "logical_path")
    if reverse:
        own = dependencies.where("resolved_script_id is not null").select(F.col("resolved_script_id").alias("a"), F.col("script_id").alias("b"), "kind", F.lit(None).cast("string").alias("via"))
    else:
        own = dependencies.select(F.col("script_id").alias("a"), F.col("resolved_script_id").alias("b"), "kind", F.col("depends_on_path").alias("via"))
    known = own.join(names, "b", "left")
    return known.select("a", F.when(F.col("logical_path").isNotNull(), F.col("b")).alias("b"), "kind", F.coalesce("logical_path", "via").alias("path"))


def reachable(scripts: DataFrame, dependencies: DataFrame, path: str, depth: int, reverse: bool = False) -> DataFrame:
    """(id, depth): every script within *depth* steps with its least number of steps.

    Edges and each level are stored, so a level is one pass over the edges and the ids
    found so far, however deep; it ends where a level is empty.
    """
    keep = Scratch(scripts.sparkSession, "levels")
    edges = keep.put(_edges(scripts, dependencies, reverse).where("b is not null").select("a", "b").distinct(), "edges")
    levels = [keep.put(_ids(scripts, path).withColumn("depth", F.lit(0)), "0")]
    for d in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, levels)
        front = edges.join(levels[-1].select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        levels.append(keep.put(front.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), str(d)))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def tree(spark: SparkSession, scripts: DataFrame, dependencies: DataFrame, path: str, depth: int = 5, reverse: bool = False) -> DataFrame:
    """The dependency tree in preorder, with cycle, repeated and truncated marks.

    Those marks follow the order of a depth-first walk: of the places of a script above the
    last level, the first in preorder is opened.  A place is written as the ranks of the
    edges that lead to it, so preorder is the order of those arrays, and whether a place is
    opened depends on places before it alone.  So the opened places are the only ones that
    a round of "open the first place of each script below the opened ones" leaves as they
    are, and rounds are run until none changes; each is a join with the edges of scripts
    that can be opened.
    """
    keep = Scratch(spark, "tree")
    least = max(depth, 1)
    near = reachable(scripts, dependencies, path, least - 1, reverse)
    start = "resolved_script_id" if reverse else "script_id"
    level = near.select(F.col("id").alias("a"), F.col("depth").alias("level"))
    own = _edges(scripts, dependencies.join(near.select(F.col("id").alias(start)), start, "left_semi"), reverse).join(level, "a")
    own = keep.put(own.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("kind", "path", "b"))), "own")
    # Without a depth, further children are known of the script itself alone.
    asked = own.where("b is not null").select(F.col("b").alias(start)).distinct() if depth > 0 else _ids(scripts, path).withColumnRenamed("id", start)
    more = dependencies.join(asked, start, "left_semi").select(F.col(start).alias("b"), F.lit(True).alias("below")).distinct()
    edges = keep.put(own.join(more, "b", "left").withColumn("below", F.coalesce("below", F.lit(False))), "edges")
    # Only these lead to places above the last level.
    inner = keep.put(edges.where(F.col("below") & (F.col("level") < least - 1)).select("a", "b", "rank"), "inner")
    root = _ids(scripts, path).limit(1).select(F.col("id").alias("a"), F.array().cast("array<int>").alias("at"), F.array("id").alias("above"))
    root = keep.put(root, "root")
    opened = root
    while True:
        steps = inner.join(opened.where(F.size("at") < least - 1), "a").where(~F.array_contains("above", F.col("b")))
        first = steps.groupBy("b").agg(F.min(F.struct(F.array_append("at", F.col("rank")).alias("at"), "above")).alias("x"))
        found = keep.put(root.unionByName(first.select(F.col("b").alias("a"), "x.at", F.array_append("x.above", F.col("b")).alias("above"))), "opened")
        same = found.join(opened.select("a", "at"), ["a", "at"], "left_semi").count()
        last, opened = opened, found
        if same == found.count() == last.count():
            break
    places = edges.join(opened, "a").withColumn("parent", F.col("a")).withColumn("at", F.array_append("at", F.col("rank")))
    places = places.join(opened.select(F.col("a").alias("b"), F.col("at").alias("first")), "b", "left")
    cycle = F.coalesce(F.array_contains("above", F.col("b")), F.lit(False))
    repeated = ~cycle & F.col("below") & F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    shown = places.select("at", "parent", F.when(F.col("first") == F.col("at"), F.col("b")).alias("opens"), F.size("at").alias("depth"), F.col("path").alias("logical_path"), "kind", F.col("b").isNotNull().alias("indexed"), cycle.alias("cycle"), repeated.alias("repeated"), (~cycle & ~repeated & F.col("below") & (F.size("at") == least)).alias("truncated"))
    top = root.select("at", F.lit(None).cast("long").alias("parent"), F.col("a").alias("opens"), F.lit(0).alias("depth"), F.lit(path).alias("logical_path"), F.lit(None).cast("string").alias("kind"), F.lit(True).alias("indexed"), *[F.lit(False).alias(m) for m in ("cycle", "repeated", "truncated")])
    # Stored with their place in the range partitions, which are in preorder, so the numbers are of one plan.
    n = F.monotonically_increasing_id()
    rows = keep.put(keep.put(top.unionByName(shown), "places").repartitionByRange("at").sortWithinPartitions("at").select("*", F.shiftright(n, 33).alias("_p"), n.bitwiseAND(F.lit((1 << 33) - 1)).alias("_n")), "rows")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a partition
    rows = rows.join(F.broadcast(before), "_p").withColumn("node_id", (F.col("_b") + F.col("_n")).cast("long"))
    parents = rows.where("opens is not null").select(F.col("opens").alias("parent"), F.col("node_id").alias("parent_id"))
    return rows.join(parents, "parent", "left").withColumn("via", F.col("kind")).select(*[x.split()[0] for x in TREE.split(", ")]).orderBy("node_id")


def render_tree(rows: list) -> list[str]:
    """Lines of a tree in preorder with box-drawing branches and marks."""
    last, out = {}, []
    for r in rows:
        last[r.parent_id] = r.node_id
    open_: dict[int, bool] = {}
    for r in rows:
        if r.depth == 0:
            out.append(r.logical_path)
            continue
        open_[r.depth] = last[r.parent_id] != r.node_id
        marks = [] if r.kind in (None, "import") else [f"({'ref' if r.kind == 'referenced' else r.kind.removesuffix('file')})"]
        marks += [m for m, on in (("(not indexed)", not r.indexed), ("(cycle)", r.cycle), ("(*)", r.repeated), ("(…)", r.truncated)) if on]
        out.append("".join("│   " if open_[d] else "    " for d in range(1, r.depth)) + ("├── " if open_[r.depth] else "└── ") + " ".join([r.logical_path, *marks]))
    return out
