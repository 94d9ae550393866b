"""Catalog statistics: counts, rankings, histograms, activity and revision summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import json_list

TOP = 10
#: Labels and exclusive upper bounds (bytes; days).
SIZE_BUCKETS = [("<1KB", 1024), ("1-5KB", 5120), ("5-10KB", 10240), ("10-25KB", 25600), ("25-50KB", 51200), ("50-100KB", 102400), ("100-250KB", 256000), ("250KB-1MB", 1048576), (">1MB", None)]
AGE_BUCKETS = [("0-7d", 7), ("7-30d", 30), ("30-90d", 90), ("90-180d", 180), ("180-365d", 365), (">365d", None)]


def total(scripts: DataFrame) -> DataFrame:
    return scripts.agg(F.count("*").alias("total"))


def by_label(scripts: DataFrame, column: str) -> DataFrame:
    """Counts by the raw value: null and the literal 'unknown' are two rows of one label."""
    return scripts.groupBy(column).agg(F.count("*").alias("count")).select(F.coalesce(column, F.lit("unknown")).alias(column), "count").orderBy(F.desc("count"), column)


def most_depended_upon(scripts: DataFrame, dependencies: DataFrame, top: int = TOP) -> DataFrame:
    edges = dependencies.where("resolved_script_id is not null").groupBy(F.col("resolved_script_id").alias("id")).agg(F.count("*").alias("count"))
    return edges.join(scripts.select("id", "logical_path"), "id").orderBy(F.desc("count"), "logical_path").limit(top).select("logical_path", "count")


def top_tags(scripts: DataFrame, top: int = TOP) -> DataFrame:
    return scripts.select(F.explode(json_list(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "tag").limit(top)


def most_functions(scripts: DataFrame, definitions: DataFrame, top: int = TOP) -> DataFrame:
    own = definitions.groupBy(F.col("script_id").alias("id")).agg(F.count("*").alias("count"))
    return own.join(scripts.select("id", "logical_path"), "id").orderBy(F.desc("count"), "logical_path").limit(top).select("logical_path", "count")


def checkouts_by(revisions: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """Checked-out revisions by operating system or by (named) user."""
    own = revisions.where((F.col("revision_type") == "DEVELOP") & (F.col(column) != "" if column == "user" else F.lit(True)))
    return own.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column).limit(top)


def histogram(values: DataFrame, value: Column, buckets: list[tuple[str, int | None]]) -> DataFrame:
    """position, bucket, count of every bucket, the empty ones too; null values are left out."""
    place = F.lit(len(buckets) - 1)
    for i in range(len(buckets) - 2, -1, -1):
        place = F.when(value < buckets[i][1], i).otherwise(place)
    counts = values.where(value.isNotNull()).groupBy(place.cast("int").alias("position")).agg(F.count("*").alias("count"))
    labels = values.sparkSession.createDataFrame([(i, b) for i, (b, _) in enumerate(buckets)], "position int, bucket string")
    return labels.join(counts, "position", "left").select("position", "bucket", F.coalesce("count", F.lit(0).cast("long")).alias("count")).orderBy("position")


def size_histogram(scripts: DataFrame) -> DataFrame:
    return histogram(scripts, F.col("size"), SIZE_BUCKETS)


def staleness_histogram(revisions: DataFrame) -> DataFrame:
    return histogram(revisions.where("revision_type = 'DEVELOP'"), F.col("age_seconds") / 86400.0, AGE_BUCKETS)


def activity_by_day(revisions: DataFrame) -> DataFrame:
    return revisions.where("revision_type = 'DEVELOP'").groupBy(F.substring("timestamp", 1, 8).alias("day")).agg(F.count("*").alias("count")).orderBy("day")


def busiest_day(activity: DataFrame) -> DataFrame:
    """The day of most checkouts, the last one of equals."""
    return activity.agg(F.max_by("day", F.struct("count", "day")).alias("day"), F.max("count").alias("count"))


def revision_stats(revisions: DataFrame) -> DataFrame:
    """Distinct paths and files of each kind, and paths that several users hold; no row when there are none."""
    kind = F.col("revision_type")
    names = [("DEVELOP", "active_checkouts", "develop_files"), ("ARCHIVE", "archive_scripts", "archive_files"), ("WORKING", "working_scripts", "working_files")]
    per = revisions.groupBy("logical_path").agg(*[F.count(F.when(kind == k, 1)).alias(files) for k, _, files in names], F.count_distinct(F.when((kind == "DEVELOP") & (F.col("user") != ""), F.col("user"))).alias("users"))
    out = per.agg(*[F.count(F.when(F.col(files) > 0, 1)).alias(paths) for _, paths, files in names], *[F.sum(files).alias(files) for _, _, files in names], F.count(F.when(F.col("users") > 1, 1)).alias("multi_user_scripts"))
    return out.where("develop_files is not null")


def contributor_names(authors: Column) -> Column:
    """Sorted distinct trimmed names of owner and history authors, blanks left out."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(F.array("owner"), authors), lambda n: F.trim(n)), lambda n: n != "")))


def contributors(scripts: DataFrame, authors: Column) -> DataFrame:
    return scripts.select("id", "logical_path", contributor_names(authors).alias("contributors"))


def severity_summary(findings: DataFrame) -> DataFrame:
    s = F.col("severity")
    return findings.agg(F.count(F.when(s == "error", 1)).alias("errors"), F.count(F.when(s == "warn", 1)).alias("warnings"), F.count(F.when(~s.isin("error", "warn"), 1)).alias("infos"))


def exit_code(errors: int, warnings: int, strict: bool = False) -> int:
    return 2 if errors else 1 if strict and warnings else 0


def checkout_statistics(catalog: dict[str, DataFrame], configured: bool = True) -> dict[str, DataFrame] | None:
    """The statistics of checkouts by name; None for a catalog without revisions.

    Without version control configured they are empty, as revisions may outlive the
    setting that they came from.
    """
    revisions = catalog.get("revisions")
    if revisions is None:
        return None
    own = revisions if configured else revisions.where(F.lit(False))
    return {"by_os": checkouts_by(own, "os_flavor"), "users": checkouts_by(own, "user"), "staleness": staleness_histogram(own), "by_day": activity_by_day(own)}
