"""Audit rules: each gives (check, severity, logical_path, detail) rows."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import blank, json_field, stem
from cairn.functions.querytext import ValidationError
from cairn.operators import similarity

#: Modules that newer Pythons no longer list but older scripts import.
RETIRED = "BaseHTTPServer ConfigParser Cookie HTMLParser Queue SocketServer StringIO __builtin__ aifc asynchat asyncore audioop cPickle cStringIO cgi cgitb chunk commands cookielib crypt dircache distutils exceptions formatter htmlentitydefs httplib imghdr imp mailcap md5 mimetools msilib new nis nntplib optparse ossaudiodev parser pipes popen2 sets sha smtpd sndhdr spwd sunau symbol telnetlib thread urllib2 urlparse user uu xdrlib xmlrpclib".split()
STDLIB = sorted({*sys.stdlib_module_names, *RETIRED})
DEFAULT = ["unowned", "no-purpose", "broken-deps", "orphan-checkouts", "stale-checkouts", "dead-scripts", "no-description"]
VECTOR = ["near-duplicates", "outliers"]
CHECKS = [*DEFAULT, "external-deps", *VECTOR]
STALE_DAYS, NEAR, FAR = 90, 0.97, 0.3


def _finding(df: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "logical_path", detail.alias("detail"))


def unowned(scripts: DataFrame) -> DataFrame:
    meta = F.col("metadata_json")
    return _finding(scripts.where(blank(json_field(meta, "techowner")) & blank(json_field(meta, "funcowner"))), "unowned", "warn", F.lit("no technical or functional owner"))


def no_purpose(scripts: DataFrame) -> DataFrame:
    return _finding(scripts.where(blank(F.col("purpose"))), "no-purpose", "warn", F.lit("no purpose"))


def no_description(scripts: DataFrame) -> DataFrame:
    meta = F.col("metadata_json")
    return _finding(scripts.where(blank(json_field(meta, "brief")) & blank(json_field(meta, "docstring"))), "no-description", "info", F.lit("no brief or docstring"))


def local_names(scripts: DataFrame) -> DataFrame:
    """Names that an import can mean here: folders of indexed paths and stems of their files."""
    parts = F.filter(F.slice(F.split("logical_path", "/"), 1, F.size(F.split("logical_path", "/")) - 1), lambda x: x != "")
    return scripts.select(F.explode(F.array_append(parts, stem(F.col("logical_path")))).alias("top")).distinct()


def classified(scripts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Unresolved imports with class Local, Stdlib or External; the standard library goes before local names."""
    lost = dependencies.where("kind = 'import' and resolved_script_id is null")
    own = lost.join(scripts.select(F.col("id").alias("script_id"), "logical_path", "language"), "script_id")
    name = F.col("depends_on_path")
    own = own.withColumn("top", F.substring_index(name, ".", 1))
    here = own.join(local_names(scripts).withColumn("local", F.lit(True)), "top", "left")
    kind = F.when(~F.col("language").eqNullSafe("python") | name.startswith(".") | name.contains("/") | name.contains("\\") | (F.col("top") == ""), "Local")
    return here.withColumn("class", kind.when(F.col("top").isin(STDLIB), "Stdlib").when(F.col("local"), "Local").otherwise("External"))


def broken_deps(scripts: DataFrame, dependencies: DataFrame) -> DataFrame:
    return _finding(classified(scripts, dependencies).where("class = 'Local'"), "broken-deps", "error", F.concat(F.lit("unresolved: "), F.col("depends_on_path")))


def external_deps(scripts: DataFrame, dependencies: DataFrame) -> DataFrame:
    return _finding(classified(scripts, dependencies).where("class = 'External'"), "external-deps", "info", F.concat(F.lit("external: "), F.col("depends_on_path")))


def orphan_checkouts(scripts: DataFrame, revisions: DataFrame) -> DataFrame:
    lost = revisions.where("revision_type = 'DEVELOP'").select("logical_path").distinct().join(scripts.select("logical_path"), "logical_path", "left_anti")
    return _finding(lost, "orphan-checkouts", "warn", F.lit("checkout without a script"))


def stale_checkouts(revisions: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    days = max(0, days)
    old = revisions.where("revision_type = 'DEVELOP'").groupBy("logical_path").agg(F.max("age_seconds").alias("age")).where(F.col("age") >= days * 86400.0)
    return _finding(old, "stale-checkouts", "info", F.concat(F.rint(F.col("age") / 86400.0).cast("bigint").cast("string"), F.lit(" days")))


def dead_scripts(scripts: DataFrame, dependencies: DataFrame, revisions: DataFrame) -> DataFrame:
    used = dependencies.where("resolved_script_id is not null").select(F.col("resolved_script_id").alias("id"))
    out = revisions.where("revision_type = 'DEVELOP'").select("logical_path")
    linked = scripts.where("symlink_target is not null").select(F.col("symlink_target").alias("logical_path"))
    # Three anti-joins instead of a fan-out of outer joins.
    dead = scripts.select("id", "logical_path").join(used, "id", "left_anti").join(out, "logical_path", "left_anti").join(linked, "logical_path", "left_anti")
    return _finding(dead, "dead-scripts", "info", F.lit("nothing refers to it"))


def audit(catalog: dict[str, DataFrame], checks: list[str] | None = None, stale_days: int = STALE_DAYS, near: float = NEAR, far: float = FAR) -> DataFrame:
    """Findings of the chosen checks by check, path and detail; vector checks need script_embeddings."""
    vectors = catalog.get("script_embeddings")
    wanted = [c.strip() for c in checks] if checks else [*DEFAULT, *(VECTOR if vectors is not None else [])]
    for c in wanted:
        if c not in CHECKS:
            raise ValidationError(f"unknown check {c!r}")
        if c in VECTOR and vectors is None:
            raise ValidationError(f"{c} needs embeddings")
    s, d, r = catalog["scripts"], catalog["dependencies"], catalog["revisions"]
    run = {
        "unowned": lambda: unowned(s), "no-purpose": lambda: no_purpose(s), "no-description": lambda: no_description(s),
        "broken-deps": lambda: broken_deps(s, d), "external-deps": lambda: external_deps(s, d), "orphan-checkouts": lambda: orphan_checkouts(s, r),
        "stale-checkouts": lambda: stale_checkouts(r, stale_days), "dead-scripts": lambda: dead_scripts(s, d, r),
        "near-duplicates": lambda: _finding(similarity.near_duplicates(vectors, near).withColumn("logical_path", F.col("path_a")), "near-duplicates", "warn", F.concat(F.lit("like "), F.col("path_b"))),
        "outliers": lambda: _finding(similarity.outliers(vectors, far), "outliers", "info", F.lit("like no other script")),
    }
    out = None
    for c in dict.fromkeys(wanted):
        found = run[c]()
        out = found if out is None else out.unionByName(found)
    return out.orderBy("check", "logical_path", "detail")


def findings_by_check(findings: DataFrame) -> DataFrame:
    return findings.groupBy("check").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "check")
