"""Ingest operators over the adapted tables, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans import build, resolve
from cairn.plans.adapters import path_of, views, with_clause
from cairn.plans.catalog_queries import FC, FD, ORACLE, QUERIES, D, E, R, S, query
from cairn.sources import extract, mapping, scan, store
from cairn.sources.scratch import Scratch
from cairn.streaming.activity import run_to_end

_EXT = "CASE regexp_extract(logical_path, '\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'sh' THEN 'shell' WHEN 'txt' THEN 'text' ELSE 'unknown' END"
_SUFFIXES = "SELECT id, array_to_string(p[i:], '.') AS name, i FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT id, string_split(ltrim(replace(regexp_replace(logical_path, '\\.py$', ''), '/', '.'), '.'), '.') AS p FROM {}))"
_BARE = ", ".join(f"'{b}'" for b in resolve.BARE)
_MAP = f"(SELECT name, min(id) AS target FROM ({_SUFFIXES.format('scripts')}) WHERE name NOT IN ({_BARE}) GROUP BY name)"


@query("src3_language_of_extension", [S], f"SELECT id, {_EXT} AS language FROM scripts")
def _src3(s):
    return s.select("id", scan.language_of_extension(scan.extension(F.substring_index("logical_path", "/", -1))).alias("language"))


_LINE = "concat(CASE {i} % 5 WHEN 0 THEN '#!/bin/bash -e' WHEN 1 THEN '#!/usr/bin/env python3' WHEN 2 THEN '#! /usr/bin/python2.7' WHEN 3 THEN '#!/usr/bin/perl' ELSE 'echo' END)"


@query("src4_language_of_shebang", [S], "SELECT id, CASE id % 5 WHEN 0 THEN 'shell' WHEN 1 THEN 'python' WHEN 2 THEN 'python' END AS language FROM scripts")
def _src4(s):
    return s.select("id", scan.language_of_shebang(F.expr(_LINE.format(i="id"))).alias("language"))


@query("src6_checkout_names", [R], "SELECT id, concat('job_', cast(id % 50 AS varchar), '.sh') AS script, timestamp, revisions.\"user\" AS user FROM revisions WHERE revisions.\"user\" <> ''")
def _src6(r):
    name = F.concat(F.lit("job_"), (F.col("id") % 50).cast("string"), F.lit(".sh_"), F.col("timestamp"), F.lit("_"), F.col("user"))
    return r.where("user <> ''").select("id", scan.parse_checkout(name).alias("c")).select("id", "c.script", "c.timestamp", "c.user")


@query("src8_content_hash", [S], "SELECT id, sha256(content) AS content_hash FROM scripts")
def _src8(s):
    return s.select("id", F.sha2("content", 256).alias("content_hash"))


@query("src8_read_files", [S], ", f AS (SELECT id // 20 AS b, concat(string_agg(coalesce(content, ''), chr(10) ORDER BY id), chr(10)) AS text FROM scripts GROUP BY 1) SELECT concat('b=', cast(b AS varchar)) AS folder, cast(strlen(text) AS bigint) AS size, CASE WHEN strlen(text) <= 60000 THEN sha256(text) END AS content_hash, CASE WHEN strlen(text) > 60000 THEN 'larger than 60000 bytes' END AS error FROM f")
def _src8f(s):
    """Files written of the scripts' texts, twenty a file, and read again; those over a size are errors."""
    root = Scratch(s.sparkSession, "files").path("texts")
    rows = s.select(F.expr("id div 20").alias("b"), "id", F.coalesce("content", F.lit("")).alias("value"))
    rows.repartition("b").sortWithinPartitions("b", "id").select("b", "value").write.partitionBy("b").text(root)
    files, errors = scan.read_tree(s.sparkSession, root, 60_000)
    sizes = s.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_extract("path", "(b=[0-9]+)/[^/]*$", 1).alias("folder"), F.col("length").alias("size"))
    found = files.select("path", "content_hash", F.lit(None).cast("string").alias("error")).unionByName(errors.withColumn("content_hash", F.lit(None).cast("string")))
    return found.select(F.substring_index("path", "/", 1).alias("folder"), "content_hash", "error").join(sizes, "folder")


@query("src9_sampling", [S], "SELECT id, CASE WHEN language = 'text' AND len(string_split(content, chr(10))) > 20 THEN sha256(concat(array_to_string(string_split(content, chr(10))[1:20], chr(10)), chr(10))) ELSE sha256(content) END AS sampled FROM scripts")
def _src9(s):
    return s.select("id", F.sha2(scan.sample(F.col("content"), F.coalesce("language", F.lit(""))), 256).alias("sampled"))


@query("t15_module_map", [S], f"SELECT name, target FROM {_MAP}")
def _t15(s):
    return resolve.module_map(s)


@query("t16_import_resolution", [S, D], f", imp AS (SELECT id, concat('catalog.dir', cast(id % 20 AS varchar), '.doc_', cast((id // 10) % 400 AS varchar)) AS logical_path FROM dependencies WHERE kind = 'import'), c AS ({_SUFFIXES.format('imp')}) SELECT c.id, arg_min(m.target, c.i) AS target FROM c JOIN {_MAP} m USING (name) GROUP BY c.id")
def _t16(s, d):
    imports = d.where("kind = 'import'").withColumns({"depends_on_path": F.expr("concat('catalog.dir', cast(id % 20 as string), '.doc_', cast(id div 10 % 400 as string))"), "resolved_script_id": F.lit(None).cast("long")})
    return resolve.resolve_imports(imports, s)


@query("t17_reference_resolution", [S, D], ", r AS (SELECT DISTINCT d.script_id, concat('../..', substr(t.logical_path, 9)) AS ref, CASE WHEN d.script_id % 5 = 0 THEN '' ELSE '/catalog' END AS up FROM dependencies d JOIN scripts s ON s.id = d.script_id JOIN scripts t ON t.id = d.resolved_script_id) SELECT r.script_id, r.ref AS depends_on_path, t.id AS target FROM r JOIN scripts t ON t.logical_path = concat(r.up, substr(r.ref, 6)) WHERE t.id <> r.script_id")
def _t17(s, d):
    names = s.select(F.col("id").alias("resolved_script_id"), F.concat(F.lit("../.."), F.substring("logical_path", 9, 1000)).alias("depends_on_path"))
    # Pairs of ids are made distinct, and not names; what is found is distinct again.
    edges = d.where("resolved_script_id is not null").select("script_id", "resolved_script_id").distinct().join(names, "resolved_script_id")
    return resolve.resolve_references(edges, s)


_BOUND = "CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('doc_', cast(id % 300 AS varchar(20)), '.run_', cast(id % 7 AS varchar(20))) ELSE concat('dir', cast(id % 20 AS varchar(20)), '.doc_', cast(id % 90 AS varchar(20)), '.a.b') END"


@query("t19_call_resolution", [S, FD, FC], f", c AS (SELECT id, script_id, callee, {_BOUND} AS bound FROM function_calls), own AS (SELECT DISTINCT script_id, name FROM function_definitions), n AS (SELECT id, string_split(bound, '.') AS p FROM c WHERE bound IS NOT NULL), b AS (SELECT id, array_to_string(p[1:k], '.') AS name, k FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS k FROM n)), t AS (SELECT b.id, arg_max(m.target, b.k) AS target FROM b JOIN {_MAP} m USING (name) GROUP BY b.id) SELECT c.id, coalesce(c.bound, CASE WHEN own.name IS NOT NULL THEN c.callee END, '-') AS name, coalesce(CASE WHEN c.bound IS NULL AND own.name IS NOT NULL THEN c.script_id END, t.target, -1) AS script FROM c LEFT JOIN own ON own.script_id = c.script_id AND own.name = split_part(c.callee, '.', 1) LEFT JOIN t ON t.id = c.id")
def _t19(s, fd, fc):
    """Calls to scripts: by the longest known beginning of a bound name, else by a definition of the own script."""
    calls = fc.drop("resolved_target_script_id").withColumn("resolved_target_name", F.expr(_BOUND))
    found = resolve.resolve_calls(calls, fd, s)
    return found.select("id", F.coalesce("resolved_target_name", F.lit("-")).alias("name"), F.coalesce("resolved_target_script_id", F.lit(-1)).cast("long").alias("script"))


@query("t21_change_detection", [S], ", o AS (SELECT logical_path, size, mtime, content AS h FROM scripts WHERE id % 10 <> 0), n AS (SELECT logical_path, size, mtime + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN id % 14 = 0 THEN 'new' ELSE content END AS h FROM scripts WHERE id % 9 <> 0) SELECT coalesce(o.logical_path, n.logical_path) AS logical_path, CASE WHEN o.mtime IS NULL THEN 'added' WHEN n.mtime IS NULL THEN 'removed' WHEN (o.size IS NOT DISTINCT FROM n.size AND o.mtime = n.mtime) OR o.h = n.h THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.logical_path = n.logical_path")
def _t21(s):
    old = s.where("id % 10 <> 0").withColumn("content_hash", F.col("content"))
    new = s.where("id % 9 <> 0").withColumns({"mtime": F.col("mtime") + F.when(F.col("id") % 7 == 0, 1).otherwise(0), "content_hash": F.when(F.col("id") % 14 == 0, F.lit("new")).otherwise(F.col("content"))})
    return resolve.changes(old, new)


def _snapshot(s: DataFrame, second: bool) -> tuple[DataFrame, build.Reader]:
    """A listing of *s* and a reader of it.  The second differs in files, times and texts, and some files in it cannot be read."""
    own = s.where("id % 9 <> 0") if second else s.where("id % 10 <> 0")
    mtime = F.expr("mtime + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END") if second else F.col("mtime")
    listed = own.select("logical_path", "size", mtime.alias("mtime"), F.lit(None).cast("string").alias("symlink_target"))
    goes_to = F.expr(f"CASE WHEN id % 14 = 0 THEN {path_of('(id + 2)')} ELSE {path_of('(id + 1)')} END" if second else path_of("(id + 1)"))
    text = F.concat(F.lit("run "), goes_to, F.lit("\n"), F.col("content"))
    lost = (F.col("id") % 77 == 0) & F.lit(second)
    texts = own.select("logical_path", F.when(~lost, text).alias("content"), F.when(lost, "denied").alias("error")).withColumn("content_hash", F.sha2("content", 256))
    return listed, lambda wanted: texts.join(wanted.select("logical_path"), "logical_path", "left_semi")


@query("t21_incremental_build", [S], f""", l AS (SELECT id, logical_path, mtime, id % 10 <> 0 AS known, id % 9 <> 0 AS here FROM scripts),
h AS (SELECT *, CASE WHEN NOT here THEN 'removed' WHEN known AND id % 7 <> 0 THEN 'same' WHEN id % 77 = 0 THEN CASE WHEN known THEN 'kept' ELSE 'lost' END WHEN NOT known THEN 'added' WHEN id % 14 = 0 THEN 'changed' ELSE 'touched' END AS how FROM l WHERE known OR here)
SELECT h.logical_path, h.how, CASE WHEN h.how IN ('removed', 'lost') THEN NULL ELSE h.mtime + CASE WHEN h.id % 7 = 0 AND h.how <> 'kept' THEN 1 ELSE 0 END END AS mtime, t.logical_path AS target
FROM h LEFT JOIN h t ON t.how NOT IN ('removed', 'lost') AND t.id % 3 <> 2 AND t.id = h.id + CASE WHEN h.id % 14 = 0 AND h.how <> 'kept' THEN 2 ELSE 1 END AND h.how NOT IN ('removed', 'lost')""")
def _t21b(s):
    """Two builds of a catalog that changes between them: what became of each file, and the edges of the second build."""
    spark, keep = s.sparkSession, Scratch(s.sparkSession, "catalog")
    names = ("20240101T000000", "20240102T000000")
    made = build.increment(spark, *_snapshot(s, False), None, names[0], 0.0)
    store.publish(spark, keep.root, {n: made[n] for n in ("scripts", "facts")}, names[0])
    made = build.increment(spark, *_snapshot(s, True), store.open_catalog(spark, keep.root), names[1], 0.0)
    store.publish(spark, keep.root, {n: made[n] for n in ("scripts", "dependencies", "facts")}, names[1])
    now = store.open_catalog(spark, keep.root)
    scripts = now["scripts"].select("id", "logical_path", "mtime")
    edges = now["dependencies"].where("kind = 'referenced'").select(F.col("script_id").alias("id"), "resolved_script_id")
    target = scripts.select(F.col("id").alias("resolved_script_id"), F.col("logical_path").alias("target"))
    return made["changes"].drop("error").join(scripts, "logical_path", "left").join(edges, "id", "left").join(target, "resolved_script_id", "left").select("logical_path", "how", "mtime", "target")


@query("snk2_csv_lines", [S], "SELECT concat_ws(',', logical_path, CASE WHEN regexp_matches(coalesce(tags, ''), '[\",]') THEN concat('\"', replace(tags, '\"', '\"\"'), '\"') ELSE coalesce(tags, '') END, coalesce(owner, '')) AS value FROM scripts")
def _snk2(s):
    return store.csv_lines(s, ["path", "tags", "owner"])


#: Prefixes by the nations' keys; some lie below others, and two keys may share one.
_PREFIXES = "SELECT cast(n_nationkey AS bigint) AS position, concat('/catalog/dir', cast(n_nationkey % 13 AS varchar(20)), CASE WHEN n_nationkey % 3 = 0 THEN concat('/sub', cast(n_nationkey % 7 AS varchar(20))) ELSE '' END, CASE WHEN n_nationkey % 4 = 1 THEN '/' ELSE '' END) AS logical_prefix, concat('/mnt/v', cast(n_nationkey % 5 AS varchar(20)), CASE WHEN n_nationkey % 2 = 0 THEN '/x/' ELSE '' END) AS physical_prefix FROM {nation}"


def _mapping_sql(source: str, target: str, rows: str, column: str, out: str) -> str:
    return (
        f", m AS (SELECT position, rtrim({source}, '/') AS a, rtrim({target}, '/') AS b FROM ({_PREFIXES.format(nation='nation')})), p AS ({rows}), "
        f"t AS (SELECT p.id, arg_min(m.b || substr(p.{column}, len(m.a) + 1), m.position) AS x FROM p JOIN m ON p.{column} = m.a OR starts_with(p.{column}, m.a || '/') GROUP BY p.id) "
        f"SELECT p.id, p.{column}, coalesce(t.x, p.{column}) AS {out} FROM p LEFT JOIN t USING (id)"
    )


_MOUNTED = "SELECT id, concat('/mnt/v', cast(id % 6 AS varchar(20)), CASE WHEN id % 4 = 0 THEN '/x' ELSE '' END, CASE WHEN id % 11 = 0 THEN '' ELSE logical_path END) AS physical_path FROM {scripts}"


def _mapped(spark: SparkSession, sf_dir: str, back: bool) -> DataFrame:
    s = views(spark, sf_dir, S)[S]
    prefixes = spark.sql(_PREFIXES, nation=spark.read.parquet(f"{sf_dir}/nation.parquet"))
    if back:
        return mapping.to_logical(spark.sql(_MOUNTED, scripts=s), "physical_path", prefixes)
    return mapping.to_physical(s.select("id", "logical_path"), "logical_path", prefixes)


QUERIES["src13_to_physical"] = lambda spark, sf_dir: _mapped(spark, sf_dir, False)
ORACLE["src13_to_physical"] = with_clause(S) + _mapping_sql("logical_prefix", "physical_prefix", "SELECT id, logical_path FROM scripts", "logical_path", "physical_path")
QUERIES["src13_to_logical"] = lambda spark, sf_dir: _mapped(spark, sf_dir, True)
ORACLE["src13_to_logical"] = with_clause(S) + _mapping_sql("physical_prefix", "logical_prefix", _MOUNTED.format(scripts="scripts"), "physical_path", "logical_path")


@query("w8_system_warnings", [R], ", own AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN '/' ELSE concat('/vc/', event_type) END AS root FROM events), o AS (SELECT DISTINCT concat('/vc/', event_type, '/', cast(event_id % 3 AS varchar)) AS root FROM events WHERE event_id % 5 = 0 UNION SELECT '/vc/click') SELECT root, 'root_without_system' AS kind FROM own WHERE root = '/' AND EXISTS (SELECT 1 FROM revisions WHERE os_flavor = 'AIX') UNION ALL SELECT root, 'system_without_root' AS kind FROM o WHERE root NOT IN (SELECT root FROM own)")
def _w8(r):
    """Roots and overrides by the revisions' folders; checkouts of one system lose its name."""
    kind = F.concat(F.lit("/vc/"), F.split("physical_path", "/")[2])
    roots = r.select(F.when(F.col("id") % 2 == 0, "/").otherwise(kind).alias("root"))
    named = r.where("id % 5 = 0").select(F.concat(kind, F.lit("/"), (F.col("id") % 3).cast("string"), F.lit("/")).alias("root")).unionByName(r.select(F.lit("/vc/click").alias("root")))
    nameless = r.withColumn("os_flavor", F.when(F.col("os_flavor") == "AIX", "").otherwise(F.col("os_flavor")))
    return mapping.system_warnings(roots, named.withColumn("os", F.lit("linux")), nameless).select("root", "kind")


@query("snk3_json_lines", [S], "SELECT cast(json_object('path', logical_path, 'owner', owner, 'size', size, 'tags', tags) AS varchar) AS value FROM scripts")
def _snk3(s):
    return store.json_lines(s, ["path", "owner", "size", "tags"])


@query("p10_key_names", [S], "SELECT logical_path AS path, symlink_target AS symlink, language FROM scripts")
def _p10(s):
    return store.project(s, ["logical_path", "symlink_target", "lang", "path", "no such field"])


@query("snk1_published_catalog", [S, R], "SELECT '20240102T000000' AS build, 'scripts' AS name, count(*) AS n, sum(id)::BIGINT AS ids FROM scripts WHERE id % 3 <> 0 UNION ALL SELECT '20240102T000000', 'revisions', count(*), sum(id)::BIGINT FROM revisions UNION ALL SELECT '20240101T000000', 'scripts', count(*), sum(id)::BIGINT FROM scripts")
def _snk1(s, r):
    """Two builds published and opened again, the newest and the one before it."""
    spark, root = s.sparkSession, Scratch(s.sparkSession, "catalog").root
    store.publish(spark, root, {"scripts": s}, "20240101T000000", keep=2)
    store.publish(spark, root, {"scripts": s.where("id % 3 <> 0"), "revisions": r}, "20240102T000000", keep=2)
    old, new = store.previous_pair(spark, root)
    found = [(new, n, store.open_catalog(spark, root)[n]) for n in ("scripts", "revisions")] + [(old, "scripts", store.open_catalog(spark, root, old)["scripts"])]
    counted = [t.agg(F.lit(b).alias("build"), F.lit(n).alias("name"), F.count("*").alias("n"), F.sum("id").alias("ids")) for b, n, t in found]
    return reduce(DataFrame.unionByName, counted)


@query("snk4_published_vectors", [E], "SELECT logical_path, len(embedding)::BIGINT AS dim, 'b2' AS catalog FROM script_embeddings WHERE script_id % 2 = 0")
def _snk4(e):
    """Vectors published twice beside a catalog, and opened as they were published last."""
    spark, root = e.sparkSession, Scratch(e.sparkSession, "vectors").root
    store.publish_vectors(spark, root, e, "b1")
    store.publish_vectors(spark, root, e.where("script_id % 2 = 0"), "b2")
    state, vectors, catalog = store.open_vectors(spark, root)
    if state != "ok":
        raise store.CatalogError(f"vectors are {state}")
    return vectors.select("logical_path", F.size("embedding").cast("long").alias("dim"), F.lit(catalog).alias("catalog"))


_CHECKOUT = "concat(CASE WHEN id % 4 = 0 THEN '' ELSE concat('jobs', cast(id % 9 AS varchar(20)), '/') END, CASE WHEN id % 3 = 0 THEN 'ARCHIVE' WHEN id % 7 = 1 THEN 'other' ELSE 'DEVELOP' END, CASE WHEN id % 5 = 0 THEN '/deep' ELSE '' END, '/s', cast(id % 40 AS varchar(20)), '.sh_', timestamp, CASE WHEN id % 6 = 0 THEN '_RB_ab' WHEN id % 11 = 0 THEN '_kim.org' ELSE '_kim' END)"


@query("src7_checkout_scan", [R], f", p AS (SELECT id, {_CHECKOUT} AS rel FROM revisions) SELECT concat(CASE WHEN id % 4 = 0 THEN '' ELSE concat('/jobs', cast(id % 9 AS varchar)) END, CASE WHEN id % 5 = 0 THEN '/deep' ELSE '' END, '/s', cast(id % 40 AS varchar), '.sh') AS logical_path, concat('/w/aix/src/', rel) AS physical_path, CASE WHEN id % 3 = 0 THEN 'ARCHIVE' WHEN id % 6 = 0 THEN 'ROLLBACK' ELSE 'DEVELOP' END AS revision_type, 'aix' AS os_flavor, CASE WHEN id % 6 = 0 THEN 'RB_ab' ELSE 'kim' END AS user, cast(id % 100 AS double) AS age_seconds FROM p WHERE NOT (id % 3 <> 0 AND id % 7 = 1) AND NOT (id % 6 <> 0 AND id % 11 = 0)")
def _src7(r):
    """Paths of files in and beside checkout folders, as a listing has them."""
    paths = r.select(F.lit("/w/aix/src").alias("root"), F.expr(_CHECKOUT).alias("rel"), (1000.0 - F.col("id") % 100).cast("double").alias("mtime"))
    return scan.checkouts(paths, 1000.0).drop("timestamp")


@query("f_size_labels", [S], "SELECT id, CASE WHEN size >= 1073741824 THEN concat(printf('%.1f', size / 1073741824.0), ' GB') WHEN size >= 1048576 THEN concat(printf('%.1f', size / 1048576.0), ' MB') WHEN size >= 1024 THEN concat(printf('%.1f', size / 1024.0), ' KB') ELSE cast(size AS varchar) || ' B' END AS shown FROM (SELECT id, size * CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 9000 ELSE 1000000 END AS size FROM scripts)")
def _sizes(s):
    from cairn.functions.exprs import human_size

    size = F.col("size") * F.expr("CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 64 WHEN 2 THEN 9000 ELSE 1000000 END")  # every unit
    return s.select("id", human_size(size).alias("shown"))


def _t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-shaped references in every page and script text, by the extractor itself."""
    s = views(spark, sf_dir, S)[S]
    text = F.concat(F.lit("run "), F.col("logical_path"), F.lit(" x/a.sh/b.py.bak ..\\lib\\util.py; "), F.col("content"))
    facts = extract.extract(s.select("id", F.lit("json").alias("language"), text.alias("content")))
    return facts.select("id", F.array_join("refs", "|").alias("refs"))


QUERIES["t12_path_references"] = _t12
ORACLE["t12_path_references"] = with_clause(S) + "SELECT id, CASE WHEN id % 3 = 2 THEN '../lib/util.py' ELSE concat(logical_path, '|../lib/util.py') END AS refs FROM scripts"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkouts by day of the events as a stream, in which every event comes twice."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    kind = F.when(F.col("event_type").isin("click", "error"), "DEVELOP").otherwise("OTHER")

    def events() -> DataFrame:
        rows = spark.readStream.schema(schema).parquet(f"{path}*")
        return rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("physical_path"), kind.alias("revision_type"))

    return run_to_end(spark, events().unionByName(events()))


QUERIES["stream_activity_by_day"] = _feed
ORACLE["stream_activity_by_day"] = "SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS count FROM events WHERE event_type IN ('click', 'error') GROUP BY 1"
