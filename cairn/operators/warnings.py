"""Revision-consistency warnings: (logical_path, kind, message, details) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import iso_mtime, json_field, stem

#: Script types that name a language.
TYPES = {"py": "python", "python": "python", "python3": "python", "sh": "shell", "bash": "shell", "ksh": "shell", "shell": "shell"}

#: What a warning says, by its kind.
MESSAGES = {
    "checkout_without_catalog_entry": "A revision exists, but no script is indexed at its path.",
    "timestamp_drift": "The script is newer than its newest checkout.",
    "self_referential_symlink": "The symlink's target is the symlink.",
    "symlink_name_mismatch": "The symlink's name is not like its target's.",
    "missing_archive_entries": "The script is checked out, but has no archived revision.",
    "scripttype_language_mismatch": "The declared script type is not of the detected language.",
    "registered_with_vc_but_not_indexed": "The manifest lists the path, but no script was found there.",
    "not_registered_with_vc": "The script is indexed, but the manifest does not list it.",
}


def _warning(df: DataFrame, kind: str, *details: Column) -> DataFrame:
    """details: name, value, name, value ..."""
    values = F.create_map(*[d.cast("string") for d in details]) if details else F.create_map().cast("map<string,string>")
    return df.select("logical_path", F.lit(kind).alias("kind"), F.lit(MESSAGES[kind]).alias("message"), values.alias("details"))


def without_entry(scripts: DataFrame, revisions: DataFrame) -> DataFrame:
    lost = revisions.join(scripts.select("logical_path"), "logical_path", "left_anti").groupBy("logical_path").agg(F.count("*").alias("n"))
    return _warning(lost, "checkout_without_catalog_entry", F.lit("checkouts"), F.col("n"))


def checkout_time(timestamp: Column, zone: str = "UTC") -> Column:
    """A revision's timestamp of day, minute or second precision as an instant; null if it isn't one."""
    size = F.length(timestamp)
    local = F.when(size == 8, F.try_to_timestamp(timestamp, F.lit("yyyyMMdd"))).when(size == 13, F.try_to_timestamp(timestamp, F.lit("yyyyMMdd_HHmm"))).when(size == 15, F.try_to_timestamp(timestamp, F.lit("yyyyMMdd_HHmmss")))
    return F.to_utc_timestamp(local, zone)


def timestamp_drift(scripts: DataFrame, revisions: DataFrame, zone: str = "UTC") -> DataFrame:
    newest = revisions.where("revision_type = 'DEVELOP'").groupBy("logical_path").agg(F.max("timestamp").alias("timestamp"))
    at = F.unix_timestamp(checkout_time(F.col("timestamp"), zone)).cast("double")
    late = scripts.select("logical_path", F.coalesce("mtime", F.lit(0.0)).alias("mtime")).join(newest, "logical_path").where(F.col("mtime") > at)
    return _warning(late, "timestamp_drift", F.lit("checkout_timestamp"), F.col("timestamp"), F.lit("active_mtime"), iso_mtime(F.col("mtime")))


def self_referential(scripts: DataFrame) -> DataFrame:
    return _warning(scripts.where("symlink_target = logical_path"), "self_referential_symlink")


def name_mismatch(scripts: DataFrame) -> DataFrame:
    """The target's stem neither begins with the link's nor is what the link's name extends after _ or -."""
    own = scripts.where("symlink_target is not null and symlink_target <> logical_path").withColumns({"a": stem(F.col("logical_path")), "b": stem(F.col("symlink_target"))})
    fits = F.expr("startswith(b, a) OR startswith(a, concat(b, '_')) OR startswith(a, concat(b, '-'))")
    return _warning(own.where(~fits), "symlink_name_mismatch", F.lit("symlink_target"), F.col("symlink_target"))


def missing_archive(revisions: DataFrame) -> DataFrame:
    paths = revisions.select("logical_path", "revision_type")
    out = paths.where("revision_type = 'DEVELOP'").select("logical_path").distinct().join(paths.where("revision_type = 'ARCHIVE'"), "logical_path", "left_anti")
    return _warning(out, "missing_archive_entries")


def type_mismatch(scripts: DataFrame) -> DataFrame:
    """The declared script type names another language; unknown types are skipped."""
    kind = F.lower(json_field(F.col("metadata_json"), "scripttype"))
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    own = scripts.where("language is not null").withColumns({"t": kind, "wanted": names[kind]}).where("wanted is not null and wanted <> language")
    return _warning(own, "scripttype_language_mismatch", F.lit("declared_scripttype"), F.col("t"), F.lit("detected_language"), F.col("language"))


def registration(scripts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Differences of manifest(path) and indexed paths, both ways; an empty manifest says nothing."""
    listed = manifest.select(F.trim("path").alias("logical_path")).where("logical_path <> ''").distinct()
    any_ = listed.limit(1).select(F.lit(1).alias("any"))
    lost = _warning(listed.join(scripts.select("logical_path"), "logical_path", "left_anti"), "registered_with_vc_but_not_indexed")
    extra = _warning(scripts.select("logical_path").join(listed, "logical_path", "left_anti").crossJoin(F.broadcast(any_)), "not_registered_with_vc")  # at most one row
    return lost.unionByName(extra)


def all_warnings(scripts: DataFrame, revisions: DataFrame, zone: str = "UTC") -> DataFrame:
    parts = [without_entry(scripts, revisions), timestamp_drift(scripts, revisions, zone), self_referential(scripts), name_mismatch(scripts), missing_archive(revisions), type_mismatch(scripts)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grouped(scripts: DataFrame, warnings: DataFrame) -> DataFrame:
    """Each script's warnings as JSON; those of paths without a script have nowhere to go."""
    own = warnings.groupBy("logical_path").agg(F.array_sort(F.collect_list(F.to_json(F.struct("kind", "message", "details")))).alias("w"))
    return scripts.select("id", "logical_path").join(own, "logical_path").select("id", "logical_path", F.concat(F.lit("["), F.array_join("w", ","), F.lit("]")).alias("vc_warnings"))
