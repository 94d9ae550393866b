"""A catalog from source trees: scan, classify, extract, resolve, derive, publish."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.operators import status, warnings
from cairn.plans import resolve
from cairn.schema import VERSION
from cairn.sources import extract as ex
from cairn.sources import scan, store
from cairn.sources.scratch import Scratch


#: Raised whenever extraction finds other facts in the same text.
EXTRACTOR_REVISION = 1


def _digest(*fields: object) -> str:
    """A hash of fields that no other list of fields has."""
    return hashlib.sha256(json.dumps([str(f) for f in fields]).encode()).hexdigest()


@dataclass(frozen=True)
class Settings:
    """What a build depends on besides its files: roots by logical prefix, lines of extra ignore files, names of systems by root, lines of the manifest."""

    roots: dict[str, str]
    ignores: tuple[str, ...] = ()
    systems: dict[str, str] = field(default_factory=dict)
    manifest: tuple[str, ...] = ()

    def fingerprint(self) -> str:
        """Two hashes: what extraction depends on, and everything."""
        extraction = _digest(EXTRACTOR_REVISION, VERSION, scan.SAMPLE_LINES, scan.MOST_BYTES)
        inputs = _digest(extraction, *[sorted(x) for x in (self.roots.items(), self.systems.items())], list(self.ignores), scan.CHECKOUT_DIRS, sorted(self.manifest))
        return f"{extraction}.{inputs}"


def up_to_date(newest_mtime: float | None, indexed_at: float, old: str, new: str) -> bool:
    """No file is newer than the build, in whole seconds, and nothing else that it depends on has changed."""
    return newest_mtime is not None and math.floor(newest_mtime) < indexed_at and old == new


def numbered(files: DataFrame) -> DataFrame:
    """Ids by path order: counted within range partitions, then shifted by the partitions before.

    The paths are stored with their place first: which partition holds a path depends on
    the plan, so two plans over the ranges need not agree.
    """
    place = F.monotonically_increasing_id()  # a partition's number in the high bits, the row's below
    ranged = files.select("logical_path").repartitionByRange("logical_path").sortWithinPartitions("logical_path")
    part = Scratch(files.sparkSession, "numbered").put(ranged.select("logical_path", F.shiftright(place, 33).alias("_p"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_n")), "paths")
    sizes = part.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", (F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_b"))  # a row a partition
    ids = part.join(F.broadcast(before), "_p").select("logical_path", (F.col("_b") + F.col("_n") + 1).cast("long").alias("id"))
    return files.join(ids, "logical_path")


def facts_of(scripts: DataFrame) -> DataFrame:
    """Facts of scripts(logical_path, language, content), by path."""
    found = ex.extract(scripts.select(F.col("logical_path").alias("id"), "language", "content"), "string")
    return found.withColumnRenamed("id", "logical_path")


def derived(files: DataFrame, facts: DataFrame, built: str, now: float, revisions: DataFrame | None = None) -> dict[str, DataFrame]:
    """All catalog tables of classified files and their facts; ids, edges, calls and warnings are made anew."""
    scripts = numbered(files.where("class = 'script'"))
    facts = facts.join(scripts.select("id", "logical_path"), "logical_path")
    scripts = scripts.join(facts.select("id", "purpose", "owner", "related", "metadata_json"), "id").withColumns({"tags": F.lit("[]"), "entry_points": F.lit("[]"), "indexed_at": F.lit(built)})
    dependencies = resolve.assemble(scripts, facts.drop("logical_path"))
    definitions = facts.select(F.col("id").alias("script_id"), F.explode("definitions").alias("d")).select("script_id", "d.*").distinct().withColumn("id", F.xxhash64("script_id", "kind", "name", "line"))
    calls = facts.select(F.col("id").alias("script_id"), F.posexplode("calls").alias("pos", "c")).select(F.xxhash64("script_id", "pos").alias("id"), "script_id", "c.caller", "c.callee", "c.line", F.col("c.target").alias("resolved_target_name"))
    calls = resolve.resolve_calls(calls, definitions, scripts)
    working = files.where("class = 'revision'").select(F.concat(F.regexp_replace("logical_path", "[^/]*$", ""), F.col("checkout.script")).alias("logical_path"), F.col("logical_path").alias("physical_path"), F.lit("WORKING").alias("revision_type"), F.lit("").alias("os_flavor"), F.col("checkout.user").alias("user"), F.col("checkout.timestamp").alias("timestamp"), F.greatest(F.lit(0.0), F.lit(now) - F.col("mtime")).alias("age_seconds"))
    revs = working if revisions is None else working.unionByName(revisions)
    revs = revs.dropDuplicates(["physical_path"]).withColumn("id", F.xxhash64("physical_path"))
    noted = warnings.grouped(scripts, warnings.all_warnings(scripts, revs)).select("id", "vc_warnings")
    scripts = status.denormalise(scripts, revs).join(noted, "id", "left").withColumn("vc_warnings", F.coalesce("vc_warnings", F.lit("[]")))
    return {"scripts": scripts, "dependencies": dependencies, "revisions": revs, "function_definitions": definitions, "function_calls": calls}


#: Gives content, content_hash and error of listed files (logical_path, size, mtime ...); null content where one cannot be read.
Reader = Callable[[DataFrame], DataFrame]


def carried(listed: DataFrame, read: Reader, old: DataFrame | None) -> DataFrame:
    """listed(logical_path, size, mtime, symlink_target) with content, content_hash, error and how they came about.

    ``same``: size and time are those of *old*, which keeps its content unread.
    ``touched``: read, and the hash is the old one; only size and time are new.
    ``changed`` and ``added``: read, and their facts have to be extracted.
    ``kept``: cannot be read, so the old row stays as it was, to be tried again.
    ``lost``: cannot be read and never was; the row has no content.
    ``unread``: its name says that it is no script, so nothing reads it.
    """
    text, before = F.col("content"), ["size", "mtime", "content", "content_hash"]
    if old is None:
        known = listed.select("logical_path").where("false").withColumn("known", F.lit(True)).withColumns({f"old_{c}": F.lit(None).cast(t) for c, t in zip(before, ("long", "double", "string", "string"), strict=True)})
    else:
        known = old.select("logical_path", F.lit(True).alias("known"), *[F.col(c).alias(f"old_{c}") for c in before])
    same = F.coalesce(F.col("known") & F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime")), F.lit(False))
    may = scan.may_be_script(F.col("logical_path"))
    moved = listed.join(known.drop("old_content", "old_content_hash"), "logical_path", "left").where(may & ~same).select(*listed.columns)
    rows = listed.join(known, "logical_path", "left").join(read(moved).select("logical_path", "content", "content_hash", "error"), "logical_path", "left")
    how = (
        F.when(same, "same").when(~may, "unread").when(text.isNull() & F.col("known"), "kept").when(text.isNull(), "lost")
        .when(F.col("known").isNull(), "added").when(F.col("content_hash") == F.col("old_content_hash"), "touched").otherwise("changed")
    )
    rows = rows.withColumn("how", how)
    stays = {"size": ("kept",), "mtime": ("kept",), "content": ("same", "touched", "kept"), "content_hash": ("same", "touched", "kept")}
    return rows.select("logical_path", "symlink_target", *[F.when(F.col("how").isin(*h), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c, h in stays.items()], "how", "error")


def increment(spark: SparkSession, listed: DataFrame, read: Reader, old: dict[str, DataFrame] | None, built: str, now: float, revisions: DataFrame | None = None, put: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of the listed files, with ``facts`` and ``changes`` (logical_path, how, error).

    Only changed and added scripts are extracted.  Facts of the others are those of *old*
    (the tables of the last build, or None), which are kept by path; scripts no longer
    listed go, and are ``removed`` in changes.  Everything derived is made anew, so no edge
    points to what a new script now shadows.  *put* stores the files and the facts.
    """
    put = put or Scratch(spark, "build").put
    files = put(scan.classify(carried(listed, read, old and old["scripts"])), "files")
    scripts = files.where("class = 'script' and how <> 'lost'")
    changes = files.where("class = 'script'").select("logical_path", "how", "error")
    facts = scripts
    if old is not None:
        stand = _reusable(scripts, old["facts"])
        facts = scripts.join(stand, "logical_path", "left_anti")
        changes = changes.unionByName(old["scripts"].join(listed, "logical_path", "left_anti").select("logical_path", F.lit("removed").alias("how"), F.lit(None).cast("string").alias("error")))
    facts = facts_of(facts)
    if old is not None:
        facts = old["facts"].join(stand, "logical_path", "left_semi").unionByName(facts)
    facts = put(facts, "facts")
    made = derived(files.where("how <> 'lost'").drop("how", "error"), facts, built, now, revisions)
    return made | {"facts": facts, "changes": changes}


def _reusable(scripts: DataFrame, facts: DataFrame) -> DataFrame:
    """Paths of scripts whose text is as it was when the facts were found."""
    return scripts.where("how in ('same', 'touched', 'kept')").join(facts, "logical_path", "left_semi").select("logical_path")


def listing(spark: SparkSession, settings: Settings) -> DataFrame:
    """logical_path, physical_path, size, mtime, symlink_target of all files below the roots."""
    found = scan.walk(settings.roots, settings.ignores)
    shadow = {f[2]: f[1] for f in found.files}
    rows = [(f[1], f[2], f[3], f[4], shadow.get(f[5], f[5])) for f in found.files]
    return spark.createDataFrame(rows, "logical_path string, physical_path string, size long, mtime double, symlink_target string")


def listing_mark(listed: DataFrame) -> str:
    """A hash of a listing: any file that comes, goes or moves its size or time gives another."""
    row = F.xxhash64("logical_path", "size", "mtime", "symlink_target")
    return _digest(*listed.agg(F.count("*"), F.sum(F.pmod(row, F.lit(1 << 40))), F.bit_xor(row)).first())


def last_build(spark: SparkSession, out: str) -> tuple[dict[str, DataFrame], str, str] | None:
    """Tables, name and fingerprint of the newest build that this engine can read."""
    try:
        old = store.open_catalog(spark, out)
    except store.CatalogError:
        return None
    meta = old["index_metadata"].first()
    return old, meta.build_timestamp, meta.manifest_fingerprint or ""


def build(spark: SparkSession, settings: Settings, out: str, built: str, now: float, keep: int = 3, full: bool = False) -> str | None:
    """Build and publish; the folder of the new build, or None where the last one is up to date.

    The last build's facts stand where extraction has not changed; *full* extracts all anew.
    A build that failed goes on where its files and facts were stored, if no file has changed.
    Names of builds are times (yyyymmddThhmmss, UTC), which the skip rule compares with the newest file.
    """
    mark = settings.fingerprint()
    last = None if full else last_build(spark, out)
    if last and up_to_date(scan.newest(spark, settings.roots), store.built_at(last[1]), last[2], mark):
        return None
    old, before = (last[0], last[1]) if last and "facts" in last[0] and last[2].partition(".")[0] == mark.partition(".")[0] else (None, "")
    listed, work = listing(spark, settings), store.Work(spark, out)
    own = _digest(mark, before, listing_mark(listed))[:32]
    made = increment(spark, listed, scan.read_files, old, built, now, put=lambda df, name: work.put(df, name, own))
    path = store.publish(spark, out, {n: t for n, t in made.items() if n != "changes"}, built, mark, keep)
    work.clear()
    return path
