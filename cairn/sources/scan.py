"""Source trees to file tables: walk with ignore files, classify, read, hash and sample."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions and shebang programs of each language; sampled languages; limits.
EXTENSIONS = {"py": "python", "sh": "shell", "bash": "shell", "ksh": "shell", "yml": "yaml", "yaml": "yaml", "csv": "csv", "json": "json", "txt": "text", "ini": "ini", "cfg": "cfg", "autocfg": "cfg", "lst": "lst"}
PROGRAMS = {"python": "python", "python2": "python", "python3": "python", "sh": "shell", "bash": "shell", "ksh": "shell", "dash": "shell", "zsh": "shell"}
SAMPLED, SAMPLE_LINES, MOST_BYTES = ("csv", "text", "lst"), 20, 8 * 1024 * 1024
CHECKOUT_DIRS = ("DEVELOP", "ARCHIVE")
#: Fixed value: a checkout's file name, as script, time stamp and user.
CHECKOUT = r"^(.+)_(\d{8}(?:_\d{4}(?:\d{2})?)?)(?:_([^\\/]+))?$"
IGNORE_FILE = ".catignore"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.*[^/]\.([^./]+)$", 1))


def language_of_extension(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(table[ext], F.lit("unknown"))


def language_of_shebang(first_line: Column) -> Column:
    """The program of the line, or its argument behind env; null if it names no known language."""
    program = F.substring_index(F.regexp_extract(first_line, r"^#!\s*(\S+)(?:\s+(\S+))?", 1), "/", -1)
    argument = F.substring_index(F.regexp_extract(first_line, r"^#!\s*(\S+)(?:\s+(\S+))?", 2), "/", -1)
    name = F.when(program == "env", argument).otherwise(program)
    bare = F.regexp_replace(name, r"^(python[23]?)[\d.]*$", "$1")
    return F.create_map(*[F.lit(x) for pair in PROGRAMS.items() for x in pair])[bare]


def parse_checkout(name: Column) -> Column:
    """script, timestamp, user of a checkout's file name; null where it is none."""
    return F.when(name.rlike(CHECKOUT), F.struct(*[F.regexp_extract(name, CHECKOUT, i + 1).alias(c) for i, c in enumerate(("script", "timestamp", "user"))]))


class Ignore:
    """Patterns of a gitignore-style file; the last that fits decides."""

    def __init__(self, lines: list[str], base: str = ""):
        self.rules = []
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line.removeprefix("!").removeprefix("\\")
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            body = re.escape(line.lstrip("/")).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "(?:/.*)?").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
            body = re.sub(r"\\\[(.*?)\\\]", lambda m: "[" + m[1].replace("\\-", "-").replace("!", "^", 1) + "]", body)
            self.rules.append((re.compile(("^" if anchored else r"(?:^|.*/)") + body + "$"), keep, folder))
        self.base = base

    def decides(self, path: str, folder: bool) -> bool | None:
        if self.base and not path.startswith(self.base + "/"):
            return None
        inside = path[len(self.base) + 1 :] if self.base else path
        out = None
        for pattern, keep, only_folders in self.rules:
            if (folder or not only_folders) and pattern.match(inside):
                out = not keep
        return out


@dataclass
class Scan:
    """Files found, sorted by path, and what could not be read."""

    files: list[tuple[str, str, str, int, float, str | None]] = field(default_factory=list)  # root, logical, physical, size, mtime, symlink
    errors: list[str] = field(default_factory=list)


def walk(roots: dict[str, str], extra_ignores: list[str] = ()) -> Scan:
    """All files below the roots (physical folder to logical prefix), each real folder once.

    Symlinks are followed only while they stay inside a root; checkout folders are left
    out, as are names that end in a tilde and what ignore files name.
    """
    out, seen = Scan(), set()
    real_roots = [os.path.realpath(r) for r in roots]
    extra = []
    for p in extra_ignores:
        with open(p, encoding="utf-8", errors="replace") as f:
            extra.append(Ignore(f.readlines()))

    def inside(real: str) -> bool:
        return any(real == r or real.startswith(r.rstrip("/") + "/") for r in real_roots)

    def visit(root: str, prefix: str, rel: str, rules: list[Ignore]) -> None:
        folder = os.path.join(root, rel) if rel else root
        real = os.path.realpath(folder)
        if real in seen or not inside(real):
            return
        seen.add(real)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            out.errors.append(f"{folder}: {e.strerror}")
            return
        if any(e.name == IGNORE_FILE for e in entries):
            with open(os.path.join(folder, IGNORE_FILE), encoding="utf-8", errors="replace") as f:
                rules = [*rules, Ignore(f.readlines(), rel)]
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            try:
                is_dir = e.is_dir()
                ignored = [d for d in (r.decides(path, is_dir) for r in rules) if d is not None]
                if e.name.endswith("~") or (ignored and ignored[-1]) or e.name == IGNORE_FILE:
                    continue
                if is_dir:
                    if e.name not in CHECKOUT_DIRS:
                        visit(root, prefix, path, rules)
                    continue
                target = os.path.realpath(e.path) if e.is_symlink() else None
                if target and not inside(target):
                    continue
                st = e.stat()
                out.files.append((root, f"{prefix.rstrip('/')}/{path}", e.path, st.st_size, st.st_mtime, target))
            except OSError as err:
                out.errors.append(f"{e.path}: {err.strerror}")

    for root, prefix in roots.items():
        visit(root, prefix, "", extra)
    out.files.sort(key=lambda f: f[1])
    return out


def read_files(listed: DataFrame) -> DataFrame:
    """logical_path, content, content_hash, error of listed(logical_path, physical_path, size), read by the workers.

    The folders must be mounted on all workers.  A file that is over MOST_BYTES or cannot be
    read has no content, and an error that says why.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):  # a row a file: one content at a time is held
                content = digest = error = None
                try:
                    if r.size > MOST_BYTES:
                        error = f"larger than {MOST_BYTES} bytes"
                    else:
                        with open(r.physical_path, "rb") as f:
                            raw = f.read()
                        content, digest = raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest()
                except OSError as e:
                    error = e.strerror or type(e).__name__
                yield pd.DataFrame([(r.logical_path, content, digest, error)], columns=["logical_path", "content", "content_hash", "error"])

    return listed.select("logical_path", "physical_path", "size").mapInPandas(run, "logical_path string, content string, content_hash string, error string")


def read_tree(spark: SparkSession, root: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of all files below a folder of any store that Spark reads.

    files: path (below the root), size, mtime, content, content_hash.  errors: path, error,
    of files over *most* bytes, whose contents are never read, and of those that can't be.
    Spark's scans skip files without bytes, so these are in neither (``walk`` lists them).
    """
    most = MOST_BYTES if most is None else most
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    below = F.element_at(F.split(F.col("path"), re.escape(re.sub("^[a-z]+:/*", "/", root).rstrip("/") + "/"), 2), -1)
    listed = source.select(below.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))
    # The filter on the length reaches the source, which then does not open larger files.
    read = source.where(F.col("length") <= most).select(below.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("content_hash"))
    files = listed.join(read, "path")
    large = listed.where(F.col("size") > most).select("path", F.lit(f"larger than {most} bytes").alias("error"))
    lost = listed.where(F.col("size") <= most).join(read.select("path"), "path", "left_anti").select("path", F.lit("cannot be read").alias("error"))
    return files, large.unionByName(lost)


def newest(spark: SparkSession, roots: dict[str, str]) -> float | None:
    """The latest time, in seconds, of all files below the roots, of their folders and of checkout folders; None without any.

    Files are listed by Spark, whose scan knows their times without reading them; what
    lies inside a checkout folder does not count, but the folder itself does, as its time
    moves when a checkout comes or goes.  The workers stat each folder above a file once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))
    # A path as Spark shows it is a URI, without its scheme and percent codes a mounted path.
    path = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
    rows = files.select(path.alias("path"), F.unix_micros("_metadata.file_modification_time").alias("at"))
    kept = F.regexp_extract("path", rf"^(.*?/(?:{'|'.join(CHECKOUT_DIRS)}))/", 1)
    rows = rows.select(F.when(kept != "", kept).otherwise(F.col("path")).alias("path"), F.when(kept == "", F.col("at")).alias("at"), (kept != "").alias("container"))
    folder = F.when(F.col("container"), F.col("path")).otherwise(F.regexp_replace("path", "/[^/]*$", ""))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = rows.select(folder.alias("folder")).distinct().select(F.explode(above).alias("folder")).distinct()
    inside = [F.col("folder") == r.rstrip("/") for r in roots] + [F.col("folder").startswith(r.rstrip("/") + "/") for r in roots]

    def times(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for f in pdf["folder"]:
                try:
                    found.append(os.stat(f).st_mtime_ns // 1000)
                except OSError:
                    continue
            yield pd.DataFrame({"at": found}, dtype="int64")

    below = folders.where(reduce(lambda a, b: a | b, inside)).mapInPandas(times, "at long")
    latest = rows.select("at").unionByName(below).agg(F.max("at")).first()[0]
    return None if latest is None else latest / 1e6


def sample(content: Column, language: Column) -> Column:
    """Data files keep their first lines."""
    first = F.concat(F.array_join(F.slice(F.split(content, "\r?\n"), 1, SAMPLE_LINES), "\n"), F.lit("\n"))
    return F.when(language.isin(*SAMPLED) & (F.size(F.split(content, "\n")) > SAMPLE_LINES), first).otherwise(content)


def may_be_script(path: Column) -> Column:
    """Whether a file of that name is a script, or may be one by its first line."""
    return extension(F.substring_index(path, "/", -1)).isin("", *EXTENSIONS)


def classify(files: DataFrame) -> DataFrame:
    """files with language, and class: script, revision (a named copy beside its script, or of a known type), or skip."""
    name = F.substring_index("logical_path", "/", -1)
    shebang = language_of_shebang(F.substring_index("content", "\n", 1))
    ext = extension(name)
    named = files.withColumns({"ext": ext, "checkout": parse_checkout(name), "folder": F.regexp_replace("logical_path", "[^/]*$", "")})
    named = named.withColumn("of", F.concat("folder", "checkout.script"))
    beside = files.select(F.col("logical_path").alias("of"), F.lit(True).alias("sibling"))
    joined = named.join(beside, "of", "left")
    known = extension(F.col("checkout.script")).isin(*EXTENSIONS)
    is_revision = F.col("checkout").isNotNull() & (known | F.coalesce("sibling", F.lit(False)))
    language = F.when(F.col("ext") == "", shebang).otherwise(language_of_extension(F.col("ext")))
    is_script = F.when(F.col("ext") == "", shebang.isNotNull()).otherwise(F.col("ext").isin(*EXTENSIONS))
    kind = F.when(is_revision, "revision").when(is_script, "script").otherwise("skip")
    return joined.withColumns({"language": language, "class": kind}).withColumn("content", sample(F.col("content"), F.col("language"))).drop("of", "sibling", "folder", "ext")


def checkouts(paths: DataFrame, now: float, systems: dict[str, str] | None = None) -> DataFrame:
    """revisions of paths(root, rel, mtime): files directly inside DEVELOP and ARCHIVE folders at any depth.

    RB_<name> users in DEVELOP are rollbacks; *systems* names a root's operating system,
    else the folder above the root does.
    """
    pattern = r"^(?:(.*)/)?(DEVELOP|ARCHIVE)/(?:(.*)/)?([^/]+)$"
    name = F.regexp_extract("rel", pattern, 4)
    found = paths.where(F.col("rel").rlike(pattern)).withColumn("c", parse_checkout(name)).where(F.col("c").isNotNull() & ~name.startswith(".") & ~F.col("c.user").rlike(r"\.(org|merged)$"))
    back = (F.regexp_extract("rel", pattern, 2) == "DEVELOP") & F.col("c.user").rlike("^RB_.+")
    parts = F.filter(F.array(*[F.regexp_extract("rel", pattern, i) for i in (1, 3)]), lambda x: x != "")
    table = F.create_map(*[F.lit(x) for pair in (systems or {"": ""}).items() for x in pair])
    return found.select(
        F.concat_ws("/", F.lit(""), F.array_join(parts, "/"), F.col("c.script")).alias("logical_path"),
        F.concat_ws("/", "root", "rel").alias("physical_path"),
        F.when(back, "ROLLBACK").otherwise(F.regexp_extract("rel", pattern, 2)).alias("revision_type"),
        F.coalesce(table[F.col("root")], F.regexp_extract("root", r"([^/]+)/[^/]+/?$", 1)).alias("os_flavor"),
        F.when(back, F.substring("c.user", 4, 1 << 30)).otherwise(F.col("c.user")).alias("user"),
        F.col("c.timestamp").alias("timestamp"),
        F.greatest(F.lit(0.0), F.lit(now) - F.col("mtime")).alias("age_seconds"),
    ).withColumn("logical_path", F.regexp_replace("logical_path", "/+", "/"))


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """(paths, warning) of a manifest: one a line, trimmed, blank lines left out; none, and a warning, where it cannot be read."""
    try:
        rows = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
        rows.limit(1).collect()
    except (AnalysisException, PySparkException) as e:
        return spark.createDataFrame([], "path string"), f"the manifest {path} cannot be read, so nothing is compared with it: {type(e).__name__}"
    return rows, None
