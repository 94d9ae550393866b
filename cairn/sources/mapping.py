"""Logical and physical paths: mapping files, and first matching prefixes by joins."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.querytext import ValidationError

#: The keys of a mapping file and of its entries.
TOP, ENTRY = {"mappings"}, {"logical_prefix", "linux"}


def parse_mapping(text: str, name: str) -> list[tuple[str, str]]:
    """(logical prefix, physical prefix) of a mapping file in order, without slashes at their ends.

    Names that end in .yml or .yaml are YAML, all others JSON.  Unknown or missing keys, and
    values that are no texts, are errors.
    """
    try:
        if name.lower().endswith((".yml", ".yaml")):
            import yaml

            found = yaml.safe_load(text)
        else:
            found = json.loads(text)
    except ValueError as e:
        raise ValidationError(f"invalid mapping file {name}: {e}") from e
    except Exception as e:  # yaml's errors are of its own
        if type(e).__module__.partition(".")[0] != "yaml":
            raise
        raise ValidationError(f"invalid mapping file {name}: {e}") from e
    if not isinstance(found, dict) or set(found) != TOP or not isinstance(found["mappings"], list):
        raise ValidationError(f"invalid mapping file {name}: wants one list, mappings")
    out = []
    for e in found["mappings"]:
        if not isinstance(e, dict) or set(e) != ENTRY or not all(isinstance(v, str) for v in e.values()):
            raise ValidationError(f"invalid mapping file {name}: an entry has a {' and a '.join(sorted(ENTRY))}, both texts")
        out.append((e["logical_prefix"].rstrip("/"), e["linux"].rstrip("/")))
    return out


def mapping_table(spark: SparkSession, mapping: list[tuple[str, str]]) -> DataFrame:
    """position, logical_prefix, physical_prefix."""
    return spark.createDataFrame([(i, *m) for i, m in enumerate(mapping)], "position long, logical_prefix string, physical_prefix string")


def folders(path: Column) -> Column:
    """The path, and all of its beginnings that a slash follows."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _mapped(paths: DataFrame, column: str, mapping: DataFrame, source: str, target: str, out: str) -> DataFrame:
    ends = mapping.select("position", F.regexp_replace(source, "/+$", "").alias("prefix"), F.regexp_replace(target, "/+$", "").alias("to"))
    known = paths.select(F.col(column).alias("own")).where(F.col(column).isNotNull()).distinct()
    tries = known.select("own", F.explode(folders(F.col("own"))).alias("prefix"))
    # The empty prefix is that of the empty path alone, not of every absolute one.
    tries = tries.where((F.col("prefix") != "") | (F.col("own") == ""))
    found = tries.join(ends, "prefix").groupBy("own").agg(F.min_by(F.struct("prefix", "to"), "position").alias("m"))
    rest = F.substring("own", F.char_length("m.prefix") + 1, F.char_length("own"))
    found = found.select("own", F.concat("m.to", rest).alias("mapped"))
    both = paths.join(found, F.col(column) == F.col("own"), "left")
    return both.select(*[paths[c] for c in paths.columns], F.coalesce("mapped", F.col(column)).alias(out))


def to_physical(paths: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """*paths* with physical_path: the first entry whose logical prefix is the path or a folder above it gives its physical prefix.

    A path that no entry fits stays as it is.
    """
    return _mapped(paths, column, mapping, "logical_prefix", "physical_prefix", "physical_path")


def to_logical(paths: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """*paths* with logical_path, the other way round."""
    return _mapped(paths, column, mapping, "physical_prefix", "logical_prefix", "logical_path")


def system_of_root(root: Column) -> Column:
    """The folder above a root names its system; empty for a root without one."""
    return F.regexp_extract(root, r"([^/]+)/+[^/]+/*$", 1)


def system_warnings(roots: DataFrame, overrides: DataFrame, revisions: DataFrame) -> DataFrame:
    """root, kind, message: roots whose checkouts have no system's name, and overrides of no root.

    roots(root), overrides(root, os) and revisions(physical_path, os_flavor).
    """
    bare = lambda c: F.when(F.col(c).rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(c, "/+$", "")).alias("root")
    own, named = roots.select(bare("root")).distinct(), overrides.select(bare("root"), F.trim("os").alias("os")).where("os <> ''")
    without = own.join(named, "root", "left_anti").where(system_of_root(F.col("root")) == "")
    # A path's folders meet the roots by name; the root folder is above all absolute paths.
    above = F.concat(folders(F.col("physical_path")), F.when(F.col("physical_path").startswith("/"), F.array(F.lit("/"))).otherwise(F.array().cast("array<string>")))
    unnamed = revisions.where("os_flavor = ''").select(F.explode(above).alias("root")).distinct()
    lost = without.join(unnamed, "root", "left_semi").select("root", F.lit("root_without_system").alias("kind"), F.concat(F.lit("checkouts below "), "root", F.lit(" have no system's name, as no folder is above it: name it")).alias("message"))
    stray = overrides.select(bare("root")).distinct().join(own, "root", "left_anti")
    return lost.unionByName(stray.select("root", F.lit("system_without_root").alias("kind"), F.concat(F.lit("a system is named for "), "root", F.lit(", which is no root")).alias("message")))
