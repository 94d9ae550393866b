"""Catalogs at rest: one folder of Parquet tables a build, published whole, opened read-only."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.querytext import ValidationError
from cairn.schema import KEYS, TABLES, VERSION


class CatalogError(Exception):
    """A catalog that can't be used."""


class NotFound(CatalogError):
    pass


class SchemaMismatch(CatalogError):
    pass


class Invalid(CatalogError):
    pass


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def builds(spark: SparkSession, root: str) -> list[str]:
    """Published builds, the oldest first."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(n for n in names if n.startswith("build="))


def built_at(name: str) -> float:
    """Seconds of a build's name (yyyymmddThhmmss, UTC)."""
    return datetime.strptime(name, "%Y%m%dT%H%M%S").replace(tzinfo=timezone.utc).timestamp()


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order, cast; missing ones are null."""
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES[name].fields])


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], built: str, fingerprint: str = "", keep: int = 3) -> str:
    """Write tables to a staging folder, check their keys, rename it in, and keep the last builds."""
    fs, _ = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    staging, final = f"{root}/_staging-{built}", f"{root}/build={built}"
    fs.delete(path(staging), True)
    meta = spark.createDataFrame([(1, built, VERSION, fingerprint)], TABLES["index_metadata"])
    for name, df in {**tables, "index_metadata": meta}.items():
        conform(df, name).sort(KEYS.get(name, ["id"])[0]).write.parquet(f"{staging}/{name}")
    for name, keys in KEYS.items():
        if name in tables:
            own = spark.read.parquet(f"{staging}/{name}")
            twice = own.groupBy(*keys).count().where("count > 1").limit(1).collect()
            if twice:
                fs.delete(path(staging), True)
                raise Invalid(f"{name}: {[twice[0][k] for k in keys]} occurs more than once")
    # A build of that name stands aside until the new one is in its place.
    aside = path(f"{root}/_old-{built}")
    if fs.exists(path(final)):
        fs.delete(aside, True)
        fs.rename(path(final), aside)
    if not fs.rename(path(staging), path(final)):
        if fs.exists(aside):
            fs.rename(aside, path(final))
        raise CatalogError(f"cannot publish {final}")
    fs.delete(aside, True)
    for old in builds(spark, root)[: -max(1, keep)]:
        fs.delete(path(f"{root}/{old}"), True)
    return final


class Work:
    """Stages of a build that is not published yet, in a folder beside the builds.

    A stage is stored under a mark of all that it depends on.  A build that is started
    again finds the stages that were finished, and makes anew those that were not, or whose
    mark has changed.  ``done`` lists what was found.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder, self.done = spark, f"{root}/_work", []

    def put(self, df: DataFrame, name: str, mark: str) -> DataFrame:
        """*df* stored, or what an earlier run has stored of it."""
        path = f"{self.folder}/{name}-{mark}"
        fs, finished = _fs(self.spark, f"{path}/_SUCCESS")  # written when all of a table is there
        if fs.exists(finished):
            self.done.append(name)
        else:
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        fs, folder = _fs(self.spark, self.folder)
        fs.delete(folder, True)


def compatibility(found: int | None) -> str:
    return "compatible" if found == VERSION else "older" if found is None or found < VERSION else "newer"


def open_catalog(spark: SparkSession, root: str, build: str | None = None) -> dict[str, DataFrame]:
    """The tables of a build, the newest by default."""
    known = builds(spark, root)
    if not known or (build and f"build={build}" not in known):
        raise NotFound(f"no catalog in {root}")
    folder = f"{root}/{f'build={build}' if build else known[-1]}"
    fs, _ = _fs(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    meta = spark.read.parquet(f"{folder}/index_metadata").first()
    if compatibility(meta.schema_version if meta else None) != "compatible":
        raise SchemaMismatch(f"the catalog has schema {meta.schema_version if meta else None}, this engine reads {VERSION}")
    return {n: spark.read.schema(t).parquet(f"{folder}/{n}") for n, t in TABLES.items() if fs.exists(path(f"{folder}/{n}"))}


def previous_pair(spark: SparkSession, root: str) -> tuple[str, str]:
    """The last two builds, old and new."""
    known = builds(spark, root)
    if len(known) < 2:
        raise NotFound("there is no older build to compare with")
    return known[-2].removeprefix("build="), known[-1].removeprefix("build=")


def snapshots(spark: SparkSession, root: str, old: str | None = None, new: str | None = None, against: str | None = None) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables of two builds to compare: both named, or the last two.

    One name alone, and names beside a comparison *against* something else, are refused.
    """
    if (old is None) != (new is None):
        raise ValidationError("an old and a new build come together")
    if old is not None and against is not None:
        raise ValidationError("two builds are not compared against anything else")
    old, new = (old, new) if old is not None else previous_pair(spark, root)
    return open_catalog(spark, root, old), open_catalog(spark, root, new)


# -- vectors beside the catalog ----------------------------------------------------------
#: The layout of published vectors that this engine reads.
VECTORS_VERSION = 1


def publish_vectors(spark: SparkSession, root: str, vectors: DataFrame, catalog_build: str) -> str:
    """Write script_embeddings and their metadata to a staging folder and swap it in."""
    fs, _ = _fs(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    staging, final, aside = (path(f"{root}/{n}") for n in ("_staging-vectors", "vectors", "_old-vectors"))
    fs.delete(staging, True)
    own = conform(vectors, "script_embeddings")
    own.sort("logical_path").write.parquet(f"{root}/_staging-vectors/script_embeddings")
    meta = spark.createDataFrame([(1, VECTORS_VERSION, catalog_build)], TABLES["embedding_metadata"])
    meta.coalesce(1).write.parquet(f"{root}/_staging-vectors/embedding_metadata")
    fs.delete(aside, True)
    if fs.exists(final):
        fs.rename(final, aside)
    if not fs.rename(staging, final):
        raise CatalogError(f"cannot publish vectors in {root}")
    fs.delete(aside, True)
    return f"{root}/vectors"


def open_vectors(spark: SparkSession, root: str) -> tuple[str, DataFrame | None, str | None]:
    """(state, vectors, catalog build): state is ok, absent, newer or unreadable; vectors only where ok."""
    fs, folder = _fs(spark, f"{root}/vectors")
    if not fs.exists(folder):
        return "absent", None, None
    try:
        meta = spark.read.schema(TABLES["embedding_metadata"]).parquet(f"{root}/vectors/embedding_metadata").first()
        vectors = spark.read.schema(TABLES["script_embeddings"]).parquet(f"{root}/vectors/script_embeddings")
        vectors.limit(1).collect()
    except Exception:  # whatever Spark raises for a torn folder
        return "unreadable", None, None
    if meta is None or meta.format_version is None:
        return "unreadable", None, None
    if meta.format_version > VECTORS_VERSION:
        return "newer", None, meta.catalog_build_timestamp
    return "ok", vectors, meta.catalog_build_timestamp


#: Field names of exports, with other names for them.
FIELDS = {"path": "logical_path", "language": "language", "owner": "owner", "purpose": "purpose", "tags": "tags", "size": "size", "mtime": "mtime", "indexed": "indexed_at", "symlink": "symlink_target", "checkout": "checkout_user", "hash": "content_hash", "related": "related"}
ALIASES = {"logical_path": "path", "lang": "language", "indexed_at": "indexed", "symlink_target": "symlink"}


def fields(names: list[str]) -> tuple[list[str], list[str]]:
    """(known fields, once each; unknown ones)."""
    known, unknown = [], []
    for n in names:
        n = ALIASES.get(n, n)
        (known if n in FIELDS else unknown).append(n)
    return list(dict.fromkeys(known)), unknown


def project(scripts: DataFrame, names: list[str]) -> DataFrame:
    return scripts.select(*[F.col(FIELDS[n]).alias(n) for n in fields(names)[0]])


def csv_lines(scripts: DataFrame, names: list[str]) -> DataFrame:
    """value: RFC 4180 lines, quoted only where needed (the header is `csv_header`)."""
    def cell(c: str):
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    own = project(scripts, names)
    return own.select(F.concat_ws(",", *[cell(c) for c in own.columns]).alias("value"))


def csv_header(names: list[str]) -> str:
    return ",".join(fields(names)[0])


def json_lines(scripts: DataFrame, names: list[str]) -> DataFrame:
    own = project(scripts, names)
    return own.select(F.to_json(F.struct(*own.columns), {"ignoreNullFields": "false"}).alias("value"))
