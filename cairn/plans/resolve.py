"""Names to scripts: module map, imports, path references, declared files and calls, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import parent_dir
from cairn.functions.querytext import ROLES

#: File types that a path's last part may be; they name no module.
BARE = "py sh bash ksh csv json yml yaml txt ini cfg autocfg lst".split()


def module_name(path: Column) -> Column:
    """The dotted name of a path: without .py, and without a last __init__."""
    cut = F.regexp_replace(F.regexp_replace(path, r"^/+", ""), r"\.py$", "")
    parts = F.filter(F.split(cut, "/"), lambda x: x != "")
    last = F.element_at(parts, -1) == "__init__"
    return F.array_join(F.when(last & (F.size(parts) > 0), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), ".")


def suffixes(name: Column) -> Column:
    """All dotted ends of a name, the longest first."""
    parts = F.split(name, "\\.")
    n = F.size(parts)
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), ".")))


def module_map(scripts: DataFrame) -> DataFrame:
    """name, target: every suffix of every script's module name; the smallest id of equals has it."""
    names = scripts.select("id", F.explode(suffixes(module_name(F.col("logical_path")))).alias("name"))
    return names.where(~F.col("name").isin(BARE)).groupBy("name").agg(F.min("id").alias("target"))


def absolute_import(name: Column, caller: Column) -> Column:
    """A relative import as a dotted name seen from the caller's module; null if it leaves the root."""
    dots = F.length(F.regexp_extract(name, r"^\.+", 0))
    up = F.when(caller.endswith("__init__.py"), F.greatest(dots - 1, F.lit(0))).otherwise(dots)
    parts = F.split(module_name(caller), "\\.")
    rest = F.regexp_replace(name, r"^\.+", "")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)))
    full = F.array_join(F.when(rest == "", kept).otherwise(F.array_append(kept, rest)), ".")
    return F.when(dots == 0, name).when(up < F.size(parts), full)


def resolve_imports(dependencies: DataFrame, scripts: DataFrame) -> DataFrame:
    """id, target of import edges: the longest suffix of the name that some script has."""
    own = dependencies.where("kind = 'import' and resolved_script_id is null").join(scripts.select(F.col("id").alias("script_id"), "logical_path"), "script_id")
    tries = own.select("id", F.posexplode(suffixes(absolute_import(F.col("depends_on_path"), F.col("logical_path")))).alias("rank", "name"))
    return tries.join(module_map(scripts), "name").groupBy("id").agg(F.min_by("target", "rank").alias("target"))


def normal_path(base: Column, reference: Column) -> Column:
    """A reference seen from a folder, without . and ..; null if it leaves the root or is empty."""
    parts = F.filter(F.concat(F.split(base, "/"), F.split(F.replace(reference, F.lit("\\"), F.lit("/")), "/")), lambda x: ~x.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))

    def step(acc: Column, x: Column) -> Column:
        up = x == ".."
        ok = acc["ok"] & (~up | (F.size(acc["p"]) > 0))
        p = F.when(up, F.slice(acc["p"], F.lit(1), F.greatest(F.size(acc["p"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["p"], x))
        return F.struct(p.alias("p"), ok.alias("ok"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["ok"] & (F.size(acc["p"]) > 0), F.concat(F.lit("/"), F.array_join(acc["p"], "/"))))


def resolve_references(edges: DataFrame, scripts: DataFrame) -> DataFrame:
    """script_id, depends_on_path, target of references that name a script: as they stand, else seen from the script's folder.

    Each reference goes one way: it first learns whether a script has it as its path, then its
    script's folder, and then meets the script that it names.
    """
    as_is = scripts.select(F.col("logical_path").alias("depends_on_path"), F.lit(True).alias("as_is"))
    at = scripts.select(F.col("id").alias("script_id"), F.coalesce(parent_dir(F.col("logical_path")), F.lit("")).alias("folder"))
    known = scripts.select(F.col("id").alias("target"), F.col("logical_path").alias("path"))
    told = edges.select("script_id", "depends_on_path").join(as_is, "depends_on_path", "left").where(F.col("as_is") | ~F.col("depends_on_path").startswith("/"))
    path = F.when(F.col("as_is"), F.col("depends_on_path")).otherwise(normal_path(F.col("folder"), F.col("depends_on_path")))
    found = told.join(at, "script_id").select("script_id", "depends_on_path", "as_is", path.alias("path")).join(known, "path").where(F.col("as_is") | (F.col("target") != F.col("script_id")))
    return found.groupBy("script_id", "depends_on_path").agg(F.min("target").alias("target"))


def declared_path(value: Column, own: Column) -> Column:
    """A declared file as written if it is external, else seen from the script's folder, else as written."""
    external = value.rlike(r"^(?:/|~|\\\\|\$|%|[A-Za-z]:[\\/])")
    return F.when(external, F.replace(value, F.lit("\\"), F.lit("/"))).otherwise(F.coalesce(normal_path(F.coalesce(parent_dir(own), F.lit("")), value), value))


def assemble(scripts: DataFrame, facts: DataFrame) -> DataFrame:
    """dependencies of extracted facts: imports, references that resolve, and declared files, each once."""
    own = facts.join(scripts.select("id", "logical_path"), "id")
    known = scripts.select(F.col("id").alias("t"), F.col("logical_path").alias("depends_on_path"))
    imports = own.select(F.col("id").alias("script_id"), F.explode("imports").alias("depends_on_path"), F.lit("import").alias("kind"))
    declared = own.select(F.col("id").alias("script_id"), "logical_path", F.explode("declared").alias("d")).select("script_id", declared_path(F.col("d.value"), F.col("logical_path")).alias("depends_on_path"), F.col("d.kind").alias("kind"), "logical_path").where("depends_on_path <> logical_path").drop("logical_path").distinct()
    refs = own.select(F.col("id").alias("script_id"), "logical_path", F.explode(F.array_union("refs", "yaml_refs")).alias("depends_on_path")).where("depends_on_path <> logical_path").select("script_id", "depends_on_path").join(declared, ["script_id", "depends_on_path"], "left_anti")
    found = resolve_references(refs, scripts).where("target <> script_id").select("script_id", "depends_on_path", F.lit("referenced").alias("kind"), F.col("target").alias("resolved_script_id"))
    none = F.lit(None).cast("long")
    rest = imports.distinct().withColumn("resolved_script_id", none).withColumn("id", F.xxhash64("script_id", "depends_on_path", "kind"))
    hit = resolve_imports(rest, scripts)
    rest = rest.drop("resolved_script_id").join(hit, "id", "left").select("script_id", "depends_on_path", "kind", F.col("target").alias("resolved_script_id"))
    files = declared.join(known, "depends_on_path", "left").select("script_id", "depends_on_path", "kind", F.when(F.col("t") != F.col("script_id"), F.col("t")).alias("resolved_script_id"))
    out = rest.unionByName(found).unionByName(files)
    return out.select(F.xxhash64("script_id", "depends_on_path", "kind").alias("id"), "script_id", "depends_on_path", "resolved_script_id", "kind")


def resolve_calls(calls: DataFrame, definitions: DataFrame, scripts: DataFrame) -> DataFrame:
    """calls with resolved_target_name and resolved_target_script_id.

    A call without a bound name may mean a definition of its own script; a bound name means
    the script of its longest known beginning.
    """
    local = definitions.select("script_id", F.col("name").alias("first")).distinct().withColumn("here", F.lit(True))
    own = calls.withColumn("first", F.substring_index("callee", ".", 1)).join(local, ["script_id", "first"], "left")
    parts = F.split("resolved_target_name", "\\.")
    starts = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    tries = calls.where("resolved_target_name is not null").select("id", F.posexplode(starts).alias("rank", "name"))
    target = tries.join(module_map(scripts), "name").groupBy("id").agg(F.min_by("target", "rank").alias("module_target"))
    out = own.join(target, "id", "left")
    mine = F.when(F.col("resolved_target_name").isNull() & F.col("here"), F.col("script_id"))
    return out.withColumn("resolved_target_script_id", F.coalesce(mine, "module_target")).withColumn("resolved_target_name", F.coalesce("resolved_target_name", F.when(F.col("here"), F.col("callee")))).drop("first", "here", "module_target")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """logical_path, change: same (size and time, or the hash), changed, added or removed."""
    a, b = old.select("logical_path", *[F.col(c).alias(f"o_{c}") for c in ("size", "mtime", "content_hash")]), new.select("logical_path", "size", "mtime", "content_hash")
    both = a.join(b, "logical_path", "full_outer")
    stat = F.col("size").eqNullSafe(F.col("o_size")) & F.col("mtime").eqNullSafe(F.col("o_mtime"))
    kind = F.when(F.col("o_mtime").isNull() & F.col("o_content_hash").isNull(), "added").when(F.col("mtime").isNull() & F.col("content_hash").isNull(), "removed").when(stat | (F.col("content_hash") == F.col("o_content_hash")), "same").otherwise("changed")
    return both.select("logical_path", kind.alias("change"))


__all__ = ["ROLES", "absolute_import", "assemble", "changes", "declared_path", "module_map", "module_name", "normal_path", "resolve_calls", "resolve_imports", "resolve_references", "suffixes"]
