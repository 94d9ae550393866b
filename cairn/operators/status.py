"""Checkout status and revisions: summaries, orphans, display order and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORPHAN_WARNING = '[{"kind":"checkout_without_catalog_entry","message":"checkout has no catalog entry"}]'


def summary(revisions: DataFrame) -> DataFrame:
    """A row for each checked-out path: users and systems (distinct, sorted, comma-joined), newest time and greatest age."""
    def names(c: str):
        return F.array_join(F.array_sort(F.collect_set(c)), ",")

    return revisions.where("revision_type = 'DEVELOP'").groupBy("logical_path").agg(names("user").alias("checkout_user"), F.max("timestamp").alias("checkout_timestamp"), names("os_flavor").alias("checkout_os"), F.max("age_seconds").alias("checkout_age_seconds"))


STATUS = ["logical_path", "language", "owner", "purpose", "vc_warnings", "checkout_user", "checkout_timestamp", "checkout_os", "checkout_age_seconds"]


def checkout_status(scripts: DataFrame, revisions: DataFrame, path: str | None = None) -> DataFrame:
    """Checked-out or warned-about scripts and orphan checkouts by path; one path: its row even if clean."""
    fresh = summary(revisions)
    # Fresh aggregates replace columns of the same names in scripts.
    own = scripts.select(*STATUS[:5])
    rows = own.join(fresh, "logical_path", "left")
    if path is None:
        rows = rows.where("checkout_timestamp is not null or (vc_warnings is not null and vc_warnings not in ('', '[]'))")
    lost = fresh.join(scripts.select("logical_path"), "logical_path", "left_anti")
    null = F.lit(None).cast("string")
    lost = lost.withColumns({"language": null, "owner": null, "purpose": null, "vc_warnings": F.lit(ORPHAN_WARNING)})
    out = rows.select(*STATUS).unionByName(lost.select(*STATUS))
    return (out if path is None else out.where(F.col("logical_path") == path)).orderBy("logical_path")


def revisions_of(revisions: DataFrame, path: str) -> DataFrame:
    return revisions.where(F.col("logical_path") == path).orderBy("revision_type", F.desc("timestamp"), "physical_path")


def display_order(revisions: DataFrame) -> DataFrame:
    """place: checkouts, rollbacks, working copies, archive, others; then system, newest first, user."""
    rank = F.when(F.col("revision_type").isin("DEVELOP", ""), 0).when(F.col("revision_type") == "ROLLBACK", 1).when(F.col("revision_type") == "WORKING", 2).when(F.col("revision_type") == "ARCHIVE", 3).otherwise(4)
    w = Window.partitionBy("logical_path").orderBy(rank, "os_flavor", F.desc("timestamp"), "user", "physical_path")
    return revisions.withColumn("place", F.row_number().over(w))


def newest_checkouts(revisions: DataFrame) -> DataFrame:
    """The newest checkout of each path."""
    newest = F.max_by(F.struct("physical_path", "user", "timestamp"), F.struct("timestamp", "physical_path")).alias("r")
    return revisions.where("revision_type = 'DEVELOP'").groupBy("logical_path").agg(newest).select("logical_path", "r.*")


def stale(revisions: DataFrame, days: float) -> DataFrame:
    """logical_path, age: paths whose oldest checkout is at least so old."""
    return revisions.where("revision_type = 'DEVELOP'").groupBy("logical_path").agg(F.max("age_seconds").alias("age")).where(F.col("age") >= days * 86400.0)


def multi_user(revisions: DataFrame) -> DataFrame:
    """logical_path, users: paths that several users have checked out."""
    return revisions.where("revision_type = 'DEVELOP'").groupBy("logical_path").agg(F.count_distinct("user").alias("users")).where("users > 1")


class NoRevision(ValueError):
    """No revision fits; the message names those of the kind that there are."""


def chosen_revision(revisions: DataFrame, path: str, kind: str, user: str | None = None, timestamp: str | None = None):
    """As select_revision, the row itself; where none fits, an error with the candidates."""
    found = select_revision(revisions, path, kind, user, timestamp).first()
    if found is None:
        own = revisions_of(revisions, path).where(F.upper("revision_type") == kind.upper()).select("user", "timestamp").collect()  # of one path
        there = "; ".join(f"{r.user or '-'} {r.timestamp or '-'}" for r in own) or "none"
        raise NoRevision(f"no {kind.upper()} revision of '{path}' fits; available: {there}")
    return found


def select_revision(revisions: DataFrame, path: str, kind: str | None = None, user: str | None = None, timestamp: str | None = None) -> DataFrame:
    """The first revision, in display order, that fits; the kind in any case."""
    own = display_order(revisions.where(F.col("logical_path") == path))
    if kind is not None:
        own = own.where(F.upper("revision_type") == kind.upper())
    if user is not None:
        own = own.where(F.col("user") == user)
    if timestamp is not None:
        own = own.where(F.col("timestamp") == timestamp)
    return own.orderBy("place").limit(1).drop("place")


def denormalise(scripts: DataFrame, revisions: DataFrame) -> DataFrame:
    """Scripts with their checkout columns written anew."""
    fresh = summary(revisions)
    return scripts.drop(*[c for c in fresh.columns if c != "logical_path"]).join(fresh, "logical_path", "left")
