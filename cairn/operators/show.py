"""One script's record: its own fields with what it uses, what uses it, its folder, links, functions and revisions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import json_field, json_list, parent_dir
from cairn.operators import graph, search
from cairn.operators.stats import contributor_names
from cairn.operators.status import revisions_of

DEFAULT = ("language", "owner", "purpose", "checkout", "size", "indexed", "uses", "used_by")
OWN = {"language": "language", "owner": "owner", "purpose": "purpose", "size": "size", "indexed": "indexed_at", "mtime": "mtime", "symlink": "symlink_target"}
LISTS = ("tags", "entry_points", "related")


class UnknownScript(ValueError):
    """The catalog has no script at this path, and no header declares it."""


def target_of(scripts: DataFrame, path: str) -> str:
    """The path whose record is shown: a symlink's target where that is indexed."""
    row = search.lookup(scripts, path).select("symlink_target").first()
    if row is None:
        raise UnknownScript(f"script '{path}' not found in catalog")
    target = row.symlink_target
    return target if target and search.lookup(scripts, target).limit(1).count() else path


def checkout_label() -> Column:
    """Who holds the script since when, or that nobody does."""
    since = F.when(F.coalesce("checkout_timestamp", F.lit("")) != "", F.concat(F.lit(" since "), "checkout_timestamp")).otherwise("")
    return F.when(F.coalesce("checkout_user", F.lit("")) != "", F.concat(F.lit("checked out by "), "checkout_user", since)).otherwise("clean")


def _parts(catalog: dict[str, DataFrame], shown: str) -> dict[str, Callable[[], DataFrame]]:
    """What belongs to a script besides its own fields, by field; read only when called."""
    scripts = catalog["scripts"]
    return {
        "uses": lambda: graph.uses(scripts, catalog["dependencies"], shown),
        "used_by": lambda: graph.used_by(scripts, catalog["dependencies"], shown),
        "siblings": lambda: graph.siblings(scripts, shown).select("logical_path"),
        "linked_by": lambda: graph.links_to(scripts, shown),
        "functions": lambda: graph.functions_in(scripts, catalog["function_definitions"], shown),
        "call_sites": lambda: graph.callers(scripts, catalog["function_definitions"], catalog["function_calls"], shown),
        "subdirs": lambda: graph.subdirs(scripts, shown.rpartition("/")[0] or "/"),
        "revisions": lambda: revisions_of(catalog["revisions"], shown).select("revision_type", "timestamp", "user", "os_flavor", "physical_path"),
    }


def related_rows(catalog: dict[str, DataFrame], path: str, fields: tuple[str, ...]) -> DataFrame:
    """field, value: a row, as a JSON object, for each script, function, call or revision of the named fields.

    The form for scripts with any number of users: nothing is gathered in one row.
    """
    shown = target_of(catalog["scripts"], path)
    parts = _parts(catalog, shown)
    rows = [parts[f]() for f in dict.fromkeys(fields) if f in parts]
    names = [f for f in dict.fromkeys(fields) if f in parts]
    if not rows:
        return catalog["scripts"].sparkSession.createDataFrame([], "field string, value string")
    out = [r.select(F.lit(f).alias("field"), F.to_json(F.struct(*r.columns), {"ignoreNullFields": "false"}).alias("value")) for f, r in zip(names, rows, strict=True)]
    return reduce(DataFrame.unionByName, out)


def _collected(rows: DataFrame, name: str) -> DataFrame:
    """All rows of one script's table as one sorted array of structs."""
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))


def show(catalog: dict[str, DataFrame], path: str, fields: tuple[str, ...] = DEFAULT) -> DataFrame:
    """path and the named fields in one row; lists of other scripts are sorted arrays of structs.

    Unknown fields are left out.  Relations are read only for the fields that need them.
    A record is one row, lists included; ``related_rows`` has the lists as rows.
    """
    scripts = catalog["scripts"]
    shown = target_of(scripts, path)
    me, parts = search.lookup(scripts, shown), _parts(catalog, shown)
    wanted = list(dict.fromkeys(fields))
    own = {"folder": parent_dir(F.col("logical_path")), "checkout": checkout_label()} | {f: F.col(c) for f, c in OWN.items()}
    own |= {f: json_list(F.col(f)) for f in LISTS} | {f: json_field(F.col("metadata_json"), f) for f in ("usage", "description")}
    past = F.from_json(json_field(F.col("metadata_json"), "history_entries"), "array<struct<author:string>>")
    own["contributors"] = contributor_names(F.coalesce(past["author"], F.array().cast("array<string>")))
    out = me.select(F.col("logical_path").alias("path"), *[own[f].alias(f) for f in wanted if f in own])
    for f in wanted:
        if f in parts:
            out = out.join(_collected(parts[f](), f).withColumn("path", F.lit(shown)), "path")  # one row each
    return out.select("path", *[f for f in wanted if f in own or f in parts])


def dependencies_of(catalog: dict[str, DataFrame], path: str) -> DataFrame:
    """relation, path, kind of an indexed script; of a file that is only declared, the scripts that declare it."""
    scripts, edges = catalog["scripts"], catalog["dependencies"]
    if search.lookup(scripts, path).limit(1).count():
        uses = graph.uses(scripts, edges, path).select(F.lit("uses").alias("relation"), "path", "kind")
        return uses.union(graph.used_by(scripts, edges, path).select(F.lit("used_by"), "logical_path", "kind"))
    declared = graph.declared_by(scripts, edges, path)
    if not declared.limit(1).count():
        raise UnknownScript(f"script '{path}' not found in catalog")
    return declared.select(F.lit("declared_by").alias("relation"), F.col("logical_path").alias("path"), "kind")
