"""The catalog's queries over the adapted tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import exprs as X
from cairn.functions import fts
from cairn.functions.grams import Grams
from cairn.operators import audit, diffing, graph, search, show, similarity, stats, status, warnings
from cairn.plans.adapters import path_of, views, with_clause
from cairn.sources.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
S, D, R, FD, FC, E = "scripts", "dependencies", "revisions", "function_definitions", "function_calls", "script_embeddings"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, relations: list[str], sql: str | None):
    """Register a function of its relations; *sql* follows the WITH clause that defines them."""
    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(*views(spark, sf_dir, *relations).values())
        if sql is not None:
            ORACLE[name] = with_clause(*relations) + sql
        return f

    return keep


def low(c: str) -> str:
    return f"translate({c}, {AZ})"


P9 = "/catalog/dir9/sub2/doc_9.py"  # a script that every data size has
P12 = "/catalog/dir12/sub5/doc_12.py"

# -- full text -------------------------------------------------------------------------
_TOK = "regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(terms: list[str], limit: int, filters: str = "TRUE") -> str:
    """terms: DuckDB lambda tests of (x, i, t)."""
    cols = ", ".join(f"{_TOK.format(c=c)} AS t{k}" for k, c in enumerate(fts.COLUMNS))
    d = " + ".join(f"len(t{k})" for k in range(5))
    f = ", ".join("(" + " + ".join(f"len(list_filter(t{k}, lambda x, i: {t.replace('TT', f't{k}')}))" for k in range(5)) + f") AS f{j}" for j, t in enumerate(terms))
    n = ", ".join(f"count(*) FILTER (WHERE f{j} > 0) AS n{j}" for j in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - n{j} + 0.5) / (n{j} + 0.5)), CASE WHEN ln((n - n{j} + 0.5) / (n{j} + 0.5)) > 0 THEN -1e9 ELSE 1e-6 END) * f{j} * 2.2 / (f{j} + 1.2 * (0.25 + 0.75 * d / avgdl))" for j in range(len(terms)))
    every = " AND ".join(f"f{j} > 0" for j in range(len(terms)))
    return f""", toks AS (SELECT id, {cols} FROM scripts), hits AS (SELECT id, {d} AS d, {f} FROM toks), st AS (SELECT count(*) AS n, avg(d) AS avgdl, {n} FROM hits)
SELECT s.id, s.logical_path, round(-({score}), 6) AS score FROM hits JOIN scripts s USING (id), st WHERE {every} AND ({filters}) ORDER BY -({score}), s.id LIMIT {limit}"""


def _shown(found: DataFrame) -> DataFrame:
    return found.select("id", "logical_path", F.round("score", 6).alias("score"))


@query("f1_fts_search", [S], _bm25_sql(["x = 'doc'", "starts_with(x, 'pur')"], 20, f"{low('language')} = 'python'"))
def _f1(s):
    return _shown(search.full_text(s, "doc pur*", 20, search.Filters(language="Python")))


@query("f1_fts_phrase", [S], _bm25_sql(["x = 'of' AND TT[i + 1] = 'en'", "x = 'deploy'"], 25, f"instr({low('owner')}, 'src1') > 0"))
def _f1p(s):
    return _shown(search.full_text(s, '"of EN" deploy', 25, search.Filters(owner="SRC1")))


@query("f1_fts_index", [S], _bm25_sql(["x = 'doc'", "x = 'job' AND starts_with(TT[i + 1], '1')"], 20))
def _f1i(s):
    """From an index that is stored and opened again."""
    path = Scratch(s.sparkSession, "fts").path("index")
    fts.store_index(s, path, block_ids=64)
    return _shown(search.full_text(s, 'doc "job 1"*', 20, index=fts.Index.open(s.sparkSession, path)))


@query("f1_fts_tag_filter", [S], _bm25_sql(["x = 'the'"], 15, "list_contains(list_transform(from_json(tags, '[\"VARCHAR\"]'), lambda t: lower(t)), 'prod')"))
def _f1t(s):
    return _shown(search.full_text(s, "the", 15, search.Filters(tag="PROD")))


@query("j1_fts_corpus_statistics", [S], f", toks AS (SELECT id, {', '.join(_TOK.format(c=c) + f' AS t{k}' for k, c in enumerate(fts.COLUMNS))} FROM scripts) SELECT id, cast(len(t0) + len(t1) + len(t2) + len(t3) + len(t4) AS bigint) AS d, cast(len(list_filter(t1, lambda x: x = 'the')) AS bigint) AS the FROM toks")
def _j1(s):
    arrays = s.select("id", *[X.tokens(F.col(c)).alias(c) for c in fts.COLUMNS])
    total = sum((F.size(c) for c in fts.COLUMNS), F.lit(0))
    return arrays.select("id", total.cast("long").alias("d"), F.size(F.filter("content", lambda x: x == "the")).cast("long").alias("the"))


@query("f3_path_search", [S], f"SELECT id, logical_path FROM scripts WHERE instr({low('logical_path')}, 'sub3/doc_1') > 0 ORDER BY logical_path LIMIT 30")
def _f3(s):
    return search.by_path(s, "SUB3/doc_1", 30).select("id", "logical_path")


@query("f4_regex_search", [S], "SELECT id, logical_path, length(content) AS n FROM scripts WHERE regexp_matches(logical_path, '1[0-9]+\\.py$') OR regexp_matches(coalesce(purpose, ''), 'job 4[2-5]$') ORDER BY logical_path LIMIT 40")
def _f4(s):
    return search.by_regex(s, r"1[0-9]+\.py$|job 4[2-5]$", 40).select("id", "logical_path", F.length("content").cast("long").alias("n"))


@query("f5_function_search", [S, FD], f"SELECT id, logical_path FROM scripts WHERE id IN (SELECT script_id FROM function_definitions WHERE {low('name')} LIKE '%run_3%') ORDER BY logical_path LIMIT 40")
def _f5(s, fd):
    return search.by_function(s, fd, "RUN_3", 40).select("id", "logical_path")


@query("f6_declared_search", [S, D], f"SELECT id, logical_path FROM scripts WHERE id IN (SELECT script_id FROM dependencies WHERE kind = 'inputfile' AND {low('depends_on_path')} LIKE '%data\\_1%' ESCAPE '\\') ORDER BY logical_path LIMIT 60")
def _f6(s, d):
    return search.by_declared(s, d, "data_1", 60, role="inputfile").select("id", "logical_path")


def _grams(s, fd, d):
    """Stored trigrams of the catalog's paths, names and declared files, opened again."""
    path = Scratch(s.sparkSession, "grams").path("postings")
    search.store_grams(path, s, fd, d)
    return Grams.open(s.sparkSession, path)


def _same_rows(name: str, of: str, f) -> None:
    """A query over stored trigrams, with the SQL of the plain search; their relations are all that the index takes."""
    QUERIES[name] = lambda spark, sf_dir: f(*views(spark, sf_dir, S, FD, D).values())
    ORACLE[name] = ORACLE[of]


_same_rows("f3_path_index", "f3_path_search", lambda s, fd, d: search.by_path(s, "SUB3/doc_1", 30, index=_grams(s, fd, d)).select("id", "logical_path"))
_same_rows("f5_function_index", "f5_function_search", lambda s, fd, d: search.by_function(s, fd, "RUN_3", 40, index=_grams(s, fd, d)).select("id", "logical_path"))
_same_rows("f6_declared_index", "f6_declared_search", lambda s, fd, d: search.by_declared(s, d, "data_1", 60, role="inputfile", index=_grams(s, fd, d)).select("id", "logical_path"))


@query("f7_list_page", [S], "SELECT id, logical_path FROM scripts WHERE id IN (SELECT id FROM scripts WHERE owner = 'src3') ORDER BY logical_path LIMIT 25 OFFSET 5")
def _f7(s):
    return search.listing(s.where("owner = 'src3'"), 25, 5).select("id", "logical_path")


def _tier_sql(q: str) -> str:
    base, stem = "lower(regexp_extract(logical_path, '[^/]*$'))", "regexp_replace(lower(regexp_extract(logical_path, '[^/]*$')), '\\.[^.]*$', '')"
    return f"CASE WHEN {stem} = '{q}' THEN 0 WHEN {base} = '{q}' THEN 1 WHEN starts_with({stem}, '{q}') THEN 2 WHEN contains({base}, '{q}') THEN 3 ELSE 4 END"


@query("f9_name_rerank", [S], f", ranked AS (SELECT *, row_number() OVER (ORDER BY size, id) AS rank FROM scripts WHERE size IS NOT NULL ORDER BY size, id LIMIT 200) SELECT id, row_number() OVER (ORDER BY {_tier_sql('doc_1')}, rank) AS place FROM ranked")
def _f9(s):
    from pyspark.sql import Window

    ranked = s.where("size is not null").orderBy("size", "id").limit(200)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy("size", "id")))
    return search.rerank(ranked, "doc_1").select("id", F.col("place").cast("long").alias("place"))


# Texts that name another script's path, so that the text half finds rows that the path half has not.
_NAMING = "SELECT * REPLACE (CASE WHEN id % 50 = 1 THEN concat('see doc_30.py, ', content) ELSE content END AS content) FROM scripts"


@query("f8_routed_search", [S], f", naming AS ({_NAMING})" + _bm25_sql(["x = 'doc' AND TT[i + 1] = '30' AND TT[i + 2] = 'py'"], 15).replace("FROM scripts", "FROM naming").replace("JOIN scripts", "JOIN naming").replace("SELECT s.id, s.logical_path, round", ", p AS (SELECT id, logical_path FROM naming WHERE instr(logical_path, 'doc_30.py') > 0 ORDER BY logical_path LIMIT 15), b AS (SELECT s.id, s.logical_path, round") + "), u AS (SELECT id, logical_path, 0 AS source, 0.0 AS score FROM p UNION ALL SELECT id, logical_path, 1, score FROM b WHERE id NOT IN (SELECT id FROM p)) SELECT id, logical_path, source FROM u ORDER BY source, score, id LIMIT 15")
def _f8(s):
    naming = s.withColumn("content", F.when(F.col("id") % 50 == 1, F.concat(F.lit("see doc_30.py, "), "content")).otherwise(F.col("content")))
    return search.text_search(naming, "doc_30.py", 15).select("id", "logical_path", F.col("source").cast("int").alias("source"))


@query("f10_symlink_groups", [S], ", t AS (SELECT DISTINCT symlink_target AS p FROM scripts WHERE symlink_target <> logical_path), r AS (SELECT logical_path, symlink_target FROM scripts WHERE logical_path NOT IN (SELECT p FROM t)) SELECT logical_path, 0 AS line, logical_path AS shown FROM r UNION ALL SELECT logical_path, 1, concat('↳ ', CASE WHEN regexp_replace(logical_path, '/[^/]*$', '') = regexp_replace(symlink_target, '/[^/]*$', '') THEN regexp_extract(symlink_target, '[^/]*$') ELSE symlink_target END) FROM r WHERE symlink_target IS NOT NULL")
def _f10(s):
    return search.symlink_groups(s)


# -- predicates and projections --------------------------------------------------------
@query("p1_language_filter", [S], f"SELECT id FROM scripts WHERE {low('language')} = 'shell'")
def _p1(s):
    return search.Filters(language="SHELL").apply(s).select("id")


@query("p2_owner_filter", [S], f"SELECT id FROM scripts WHERE instr({low('owner')}, 'rc1') > 0")
def _p2(s):
    return search.Filters(owner="RC1").apply(s).select("id")


@query("p3_tag_filter", [S], "SELECT id FROM scripts WHERE list_contains(list_transform(from_json(tags, '[\"VARCHAR\"]'), lambda t: lower(t)), 'prod')")
def _p3(s):
    return search.Filters(tag="prod").apply(s).select("id")


@query("p4_filters_before_limit", [S], "SELECT id FROM scripts WHERE language = 'python' AND instr(owner, 'src2') > 0 ORDER BY logical_path LIMIT 7")
def _p4(s):
    return search.listing(s, 7, 0, search.Filters("python", "src2")).select("id")


@query("p5_point_lookup", [S], f"SELECT id, logical_path, purpose FROM scripts WHERE logical_path = '{P9}'")
def _p5(s):
    return search.lookup(s, P9).select("id", "logical_path", "purpose")


@query("p6_one_level", [S], "SELECT id, logical_path FROM scripts WHERE starts_with(logical_path, '/catalog/dir10/') AND instr(substr(logical_path, 16), '/') = 0")
def _p6(s):
    return graph.scripts_in(s, "/catalog/dir10").select("id", "logical_path")


@query("p7_blank", [S], "SELECT id FROM scripts WHERE coalesce(trim(purpose, ' '), '') = ''")
def _p7(s):
    return s.where(X.blank(F.col("purpose"))).select("id")


@query("p9_projection", [S], "SELECT logical_path AS path, CASE WHEN coalesce(owner, '') = '' THEN '—' ELSE owner END AS owner, CASE WHEN size >= 1024 THEN 'large' ELSE 'small' END AS class, parse_path.dir FROM (SELECT *, regexp_replace(logical_path, '/[^/]*$', '') AS dir FROM scripts) AS parse_path")
def _p9(s):
    dash = F.when(F.coalesce("owner", F.lit("")) == "", "—").otherwise(F.col("owner"))
    return s.select(F.col("logical_path").alias("path"), dash.alias("owner"), F.when(F.col("size") >= 1024, "large").otherwise("small").alias("class"), X.parent_dir(F.col("logical_path")).alias("dir"))


# -- statistics ------------------------------------------------------------------------
@query("a1_total", [S], "SELECT count(*) AS total FROM scripts")
def _a1(s):
    return stats.total(s)


@query("a2_by_language", [S], "SELECT coalesce(language, 'unknown') AS language, c AS count FROM (SELECT language, count(*) AS c FROM scripts GROUP BY language)")
def _a2(s):
    return stats.by_label(s, "language")


@query("a2_by_owner", [S], "SELECT coalesce(owner, 'unknown') AS owner, c AS count FROM (SELECT owner, count(*) AS c FROM scripts GROUP BY owner)")
def _a2o(s):
    return stats.by_label(s, "owner")


@query("a3_most_depended_upon", [S, D], "SELECT logical_path, count(*) AS count FROM dependencies d JOIN scripts s ON s.id = d.resolved_script_id GROUP BY s.id, logical_path ORDER BY count DESC, logical_path LIMIT 10")
def _a3(s, d):
    return stats.most_depended_upon(s, d)


@query("a4_top_tags", [S], "SELECT tag, count(*) AS count FROM (SELECT unnest(from_json(tags, '[\"VARCHAR\"]')) AS tag FROM scripts) GROUP BY tag ORDER BY count DESC, tag LIMIT 10")
def _a4(s):
    return stats.top_tags(s)


@query("a5_most_functions", [S, FD], "SELECT logical_path, count(*) AS count FROM function_definitions f JOIN scripts s ON s.id = f.script_id GROUP BY s.id, logical_path ORDER BY count DESC, logical_path LIMIT 10")
def _a5(s, fd):
    return stats.most_functions(s, fd)


@query("a6_checkout_by_os", [R], "SELECT os_flavor, count(*) AS count FROM revisions WHERE revision_type = 'DEVELOP' GROUP BY os_flavor ORDER BY count DESC, os_flavor LIMIT 10")
def _a6(r):
    return stats.checkouts_by(r, "os_flavor")


@query("a7_active_users", [R], "SELECT user, count(*) AS count FROM (SELECT revisions.\"user\" AS user FROM revisions WHERE revision_type = 'DEVELOP' AND revisions.\"user\" <> '') GROUP BY user ORDER BY count DESC, user LIMIT 10")
def _a7(r):
    return stats.checkouts_by(r, "user")


def _bucket_sql(value: str, source: str, buckets: list) -> str:
    rows = ", ".join(f"({i}, '{b}')" for i, (b, _) in enumerate(buckets))
    case = "CASE " + " ".join(f"WHEN v < {top} THEN {i}" for i, (_, top) in enumerate(buckets) if top) + f" ELSE {len(buckets) - 1} END"
    return f", b(position, bucket) AS (VALUES {rows}), c AS (SELECT {case} AS position, count(*) AS n FROM (SELECT {value} AS v FROM {source}) WHERE v IS NOT NULL GROUP BY 1) SELECT b.position, bucket, coalesce(n, 0) AS count FROM b LEFT JOIN c USING (position)"


@query("a8_size_histogram", [S], _bucket_sql("size", "scripts", stats.SIZE_BUCKETS))
def _a8(s):
    return stats.size_histogram(s)


@query("a9_staleness_histogram", [R], _bucket_sql("age_seconds / 86400.0", "(SELECT * FROM revisions WHERE revision_type = 'DEVELOP')", stats.AGE_BUCKETS))
def _a9(r):
    return stats.staleness_histogram(r)


@query("a11_activity_by_day", [R], "SELECT substr(timestamp, 1, 8) AS day, count(*) AS count FROM revisions WHERE revision_type = 'DEVELOP' GROUP BY 1")
def _a11(r):
    return stats.activity_by_day(r)


@query("a19_busiest_day", [R], "SELECT day, count FROM (SELECT substr(timestamp, 1, 8) AS day, count(*) AS count FROM revisions WHERE revision_type = 'DEVELOP' GROUP BY 1) ORDER BY count DESC, day DESC LIMIT 1")
def _a19(r):
    return stats.busiest_day(stats.activity_by_day(r))


@query("a12_revision_stats", [R], "SELECT count(DISTINCT CASE WHEN revision_type = 'DEVELOP' THEN logical_path END) AS active_checkouts, count(DISTINCT CASE WHEN revision_type = 'ARCHIVE' THEN logical_path END) AS archive_scripts, count(DISTINCT CASE WHEN revision_type = 'WORKING' THEN logical_path END) AS working_scripts, count(CASE WHEN revision_type = 'DEVELOP' THEN 1 END) AS develop_files, count(CASE WHEN revision_type = 'ARCHIVE' THEN 1 END) AS archive_files, count(CASE WHEN revision_type = 'WORKING' THEN 1 END) AS working_files, (SELECT count(*) FROM (SELECT logical_path FROM revisions WHERE revision_type = 'DEVELOP' AND revisions.\"user\" <> '' GROUP BY logical_path HAVING count(DISTINCT revisions.\"user\") > 1)) AS multi_user_scripts FROM revisions")
def _a12(r):
    return stats.revision_stats(r)


@query("a13_having_max_age", [R], "SELECT logical_path, max(age_seconds) AS age FROM revisions WHERE revision_type = 'DEVELOP' GROUP BY logical_path HAVING max(age_seconds) >= 300 * 86400.0")
def _a13(r):
    return status.stale(r, 300)


@query("a14_multi_user", [R], "SELECT logical_path, count(DISTINCT revisions.\"user\") AS users FROM revisions WHERE revision_type = 'DEVELOP' GROUP BY logical_path HAVING count(DISTINCT revisions.\"user\") > 1")
def _a14(r):
    return status.multi_user(r)


_SUMMARY = "(SELECT logical_path, string_agg(DISTINCT u, ',' ORDER BY u) AS checkout_user, max(timestamp) AS checkout_timestamp, string_agg(DISTINCT os_flavor, ',' ORDER BY os_flavor) AS checkout_os, max(age_seconds) AS checkout_age_seconds FROM (SELECT *, revisions.\"user\" AS u FROM revisions WHERE revision_type = 'DEVELOP') GROUP BY logical_path)"


@query("a15_checkout_summary", [R], f"SELECT * FROM {_SUMMARY}")
def _a15(r):
    return status.summary(r)


@query("a18_contributors", [S], "SELECT id, logical_path, array_to_string(list_sort(list_distinct(list_filter([trim(owner, ' '), 'alice', 'src4'], lambda n: n <> ''))), ',') AS names FROM scripts")
def _a18(s):
    return stats.contributors(s, F.array(F.lit(" alice "), F.lit("src4"))).select("id", "logical_path", F.array_join("contributors", ",").alias("names"))


# -- graphs ----------------------------------------------------------------------------
@query("g1_related", [S, D], f", me AS (SELECT * FROM scripts WHERE logical_path = '{P9}'), n AS (SELECT unnest(from_json(related, '[\"VARCHAR\"]')) AS p FROM me UNION SELECT s.logical_path FROM dependencies d JOIN me ON d.script_id = me.id JOIN scripts s ON s.id = d.resolved_script_id UNION SELECT s.logical_path FROM dependencies d JOIN me ON d.resolved_script_id = me.id JOIN scripts s ON s.id = d.script_id) SELECT id, logical_path FROM scripts WHERE logical_path IN (SELECT p FROM n) AND logical_path <> '{P9}'")
def _g1(s, d):
    return graph.related(s, d, P9).select("id", "logical_path")


@query("g2_uses", [S, D], f"SELECT d.kind, coalesce(s.logical_path, d.depends_on_path) AS path, s.logical_path IS NOT NULL AS indexed FROM dependencies d LEFT JOIN scripts s ON s.id = d.resolved_script_id WHERE d.script_id = (SELECT id FROM scripts WHERE logical_path = '{P9}')")
def _g2(s, d):
    return graph.uses(s, d, P9)


@query("g2_used_by", [S, D], f"SELECT DISTINCT s.logical_path, d.kind FROM dependencies d JOIN scripts s ON s.id = d.script_id WHERE d.resolved_script_id = (SELECT id FROM scripts WHERE logical_path = '{P12}')")
def _g2u(s, d):
    return graph.used_by(s, d, P12)


@query("g3_reachable", [S, D], f""", walk AS (SELECT id, 0 AS depth FROM scripts WHERE logical_path = '{P9}'),
e AS (SELECT DISTINCT script_id AS a, resolved_script_id AS b FROM dependencies WHERE resolved_script_id IN (SELECT id FROM scripts)),
w1 AS (SELECT DISTINCT b AS id FROM e JOIN walk ON a = id), w2 AS (SELECT DISTINCT b AS id FROM e JOIN w1 ON a = id)
SELECT id, min(depth) AS depth FROM (SELECT id, depth FROM walk UNION ALL SELECT id, 1 FROM w1 UNION ALL SELECT id, 2 FROM w2) GROUP BY id""")
def _g3(s, d):
    return graph.reachable(s, d, P9, 2)


QUERIES["g3_tree"] = lambda spark, sf_dir: (lambda v: graph.tree(spark, v[S], v[D], P9, 3))(views(spark, sf_dir, S, D))


@query("g4_functions_in", [S, FD], f"SELECT name, kind, line FROM function_definitions WHERE script_id = (SELECT id FROM scripts WHERE logical_path = '{P9}')")
def _g4(s, fd):
    return graph.functions_in(s, fd, P9)


@query("g5_callers", [S, FD, FC], f"SELECT DISTINCT fd.name, s.logical_path, c.caller, c.line FROM function_definitions fd JOIN function_calls c ON c.resolved_target_script_id = fd.script_id AND (c.callee = fd.name OR lower(c.callee) LIKE '%.' || lower(fd.name)) JOIN scripts s ON s.id = c.script_id WHERE fd.script_id % 10 = 9 AND fd.script_id = (SELECT id FROM scripts WHERE logical_path = '{P9}')")
def _g5(s, fd, fc):
    return graph.callers(s, fd, fc, P9)


@query("j5_all_callers", [S, FD, FC], "SELECT fd.name, s.logical_path, c.caller, c.line, min(fd.line) AS at FROM function_definitions fd JOIN function_calls c ON c.resolved_target_script_id = fd.script_id AND (c.callee = fd.name OR lower(c.callee) LIKE '%.' || lower(fd.name)) JOIN scripts s ON s.id = c.script_id GROUP BY 1, 2, 3, 4")
def _j5(s, fd, fc):
    return graph.all_callers(s, fd, fc)


@query("g6_calls_from", [S, FC], f"SELECT c.caller, c.callee, c.line, s.logical_path AS target FROM function_calls c LEFT JOIN scripts s ON s.id = c.resolved_target_script_id WHERE c.script_id = (SELECT id FROM scripts WHERE logical_path = '{P12}')")
def _g6(s, fc):
    return graph.calls_from(s, fc, P12)


_ROLES = "('parentfile', 'childfile', 'inputfile', 'outputfile', 'paramfile')"


@query("g7_declared_by", [S, D], f"SELECT s.logical_path, d.kind FROM dependencies d JOIN scripts s ON s.id = d.script_id WHERE d.depends_on_path = '/ext/data_7.csv' AND d.kind IN {_ROLES}")
def _g7(s, d):
    return graph.declared_by(s, d, "/ext/data_7.csv")


@query("g8_shared_files", [S, D], f", m AS (SELECT DISTINCT depends_on_path, script_id AS me FROM dependencies WHERE kind IN {_ROLES} AND resolved_script_id IS NULL AND script_id = (SELECT id FROM scripts WHERE logical_path = '{P12}')) SELECT d.depends_on_path, s.logical_path, d.kind FROM dependencies d JOIN m ON m.depends_on_path = d.depends_on_path AND d.script_id <> m.me JOIN scripts s ON s.id = d.script_id WHERE d.kind IN {_ROLES}")
def _g8(s, d):
    return graph.shared_files(s, d, P12)


@query("g10_points_to", [S], "SELECT a.logical_path, a.symlink_target, b.id IS NOT NULL AS indexed FROM scripts a LEFT JOIN scripts b ON b.logical_path = a.symlink_target WHERE a.symlink_target IS NOT NULL")
def _g10(s):
    return graph.points_to(s)


@query("g12_detail", [S, D], f", me AS (SELECT * FROM scripts WHERE logical_path = '{P9}') SELECT DISTINCT 'uses' AS relation, coalesce(s.logical_path, d.depends_on_path) AS path FROM dependencies d JOIN me ON d.script_id = me.id LEFT JOIN scripts s ON s.id = d.resolved_script_id UNION SELECT 'used_by', s.logical_path FROM dependencies d JOIN me ON d.resolved_script_id = me.id JOIN scripts s ON s.id = d.script_id UNION SELECT 'symlink', symlink_target FROM me WHERE symlink_target IS NOT NULL UNION SELECT 'linked', logical_path FROM scripts WHERE symlink_target = '{P9}'")
def _g12(s, d):
    return graph.detail(s, d, P9)


@query("g13_siblings", [S], f"SELECT id, logical_path FROM scripts WHERE starts_with(logical_path, '/catalog/dir9/sub2/') AND logical_path <> '{P9}'")
def _g13(s):
    return graph.siblings(s, P9).select("id", "logical_path")


@query("g13_subdirs", [S], "SELECT DISTINCT split_part(substr(logical_path, 10), '/', 1) AS name FROM scripts WHERE starts_with(logical_path, '/catalog/') AND instr(substr(logical_path, 10), '/') > 0")
def _g13d(s):
    return graph.subdirs(s, "/catalog")


P29, P32 = "/catalog/dir9/sub1/doc_29.txt", "/catalog/dir12/sub4/doc_32.txt"  # a symlink and its target


@query("g9_declared_file", [S, D], f"SELECT 'declared_by' AS relation, s.logical_path AS path, d.kind FROM dependencies d JOIN scripts s ON s.id = d.script_id WHERE d.depends_on_path = '/ext/data_11.csv' AND d.kind IN {_ROLES}")
def _g9(s, d):
    return show.dependencies_of({"scripts": s, "dependencies": d}, "/ext/data_11.csv")


@query("g11_show", [S, D, FD], f"SELECT logical_path AS path, language, owner, size, (SELECT count(*) FROM dependencies WHERE script_id = s.id) AS uses, (SELECT count(*) FROM (SELECT DISTINCT script_id, kind FROM dependencies WHERE resolved_script_id = s.id AND script_id IN (SELECT id FROM scripts))) AS used_by, (SELECT count(*) FROM scripts WHERE symlink_target = '{P32}') AS linked_by, (SELECT count(*) FROM scripts WHERE starts_with(logical_path, '/catalog/dir12/sub4/') AND logical_path <> '{P32}') AS siblings, (SELECT count(*) FROM function_definitions WHERE script_id = s.id) AS functions FROM scripts s WHERE logical_path = '{P32}'")
def _g11(s, d, fd):
    counted = ("uses", "used_by", "linked_by", "siblings", "functions")
    row = show.show({"scripts": s, "dependencies": d, "function_definitions": fd}, P29, ("language", "owner", "size", *counted))
    return row.select("path", "language", "owner", "size", *[F.size(c).cast("long").alias(c) for c in counted])


# -- revisions -------------------------------------------------------------------------
def _json(*pairs: str) -> str:
    return "cast(json_object(" + ", ".join(f"'{p.split('.')[-1].split(' ')[-1]}', {p.split(' AS ')[0]}" for p in pairs) + ") AS varchar) AS value"


_LIKE = "c.callee = fd.name OR lower(c.callee) LIKE '%.' || lower(fd.name)"


@query(
    "g12_related_rows", [S, D, FD, FC],
    f", me AS (SELECT * FROM scripts WHERE logical_path = '{P32}'), cs AS (SELECT fd.name, s.logical_path, c.caller, c.line FROM me JOIN function_definitions fd ON fd.script_id = me.id JOIN function_calls c ON c.resolved_target_script_id = me.id AND ({_LIKE}) JOIN scripts s ON s.id = c.script_id GROUP BY ALL) "
    f"SELECT 'uses' AS field, {_json('d.kind', 'coalesce(s.logical_path, d.depends_on_path) AS path', '(s.id IS NOT NULL) AS indexed')} FROM dependencies d JOIN me ON d.script_id = me.id LEFT JOIN scripts s ON s.id = d.resolved_script_id "
    f"UNION ALL SELECT 'used_by', value FROM (SELECT DISTINCT {_json('s.logical_path', 'd.kind')} FROM dependencies d JOIN me ON d.resolved_script_id = me.id JOIN scripts s ON s.id = d.script_id) "
    f"UNION ALL SELECT 'siblings', {_json('logical_path')} FROM scripts WHERE starts_with(logical_path, '/catalog/dir12/sub4/') AND logical_path <> '{P32}' "
    f"UNION ALL SELECT 'linked_by', {_json('logical_path')} FROM scripts WHERE symlink_target = '{P32}' "
    f"UNION ALL SELECT 'functions', {_json('fd.name', 'fd.kind', 'fd.line')} FROM function_definitions fd JOIN me ON fd.script_id = me.id "
    f"UNION ALL SELECT 'call_sites', {_json('name', 'logical_path', 'caller', 'line')} FROM cs",
)
def _g12r(s, d, fd, fc):
    """Everything that belongs to a script, named by a symlink to it, each item a row."""
    return show.related_rows({"scripts": s, "dependencies": d, "function_definitions": fd, "function_calls": fc}, P29, ("uses", "used_by", "siblings", "linked_by", "functions", "call_sites"))


@query("r1_checkout_status", [S, R], f", f AS {_SUMMARY} SELECT s.logical_path, language, owner, purpose, vc_warnings, checkout_user, checkout_timestamp, checkout_os, checkout_age_seconds FROM scripts s LEFT JOIN f USING (logical_path) WHERE checkout_timestamp IS NOT NULL OR vc_warnings NOT IN ('', '[]') UNION ALL SELECT f.logical_path, NULL, NULL, NULL, '{status.ORPHAN_WARNING}', checkout_user, checkout_timestamp, checkout_os, checkout_age_seconds FROM f WHERE logical_path NOT IN (SELECT logical_path FROM scripts)")
def _r1(s, r):
    return status.checkout_status(s, r)


@query("r2_status_of_path", [S, R], f", f AS {_SUMMARY} SELECT s.logical_path, language, owner, purpose, vc_warnings, checkout_user, checkout_timestamp, checkout_os, checkout_age_seconds FROM scripts s LEFT JOIN f USING (logical_path) WHERE s.logical_path = '{P9}'")
def _r2(s, r):
    return status.checkout_status(s, r, P9)


@query("r3_orphans", [S, R], f", f AS {_SUMMARY} SELECT logical_path, checkout_user, checkout_timestamp FROM f WHERE logical_path NOT IN (SELECT logical_path FROM scripts)")
def _r3(s, r):
    return status.checkout_status(s, r).where(F.col("vc_warnings") == status.ORPHAN_WARNING).select("logical_path", "checkout_user", "checkout_timestamp")


@query("r4_revisions_of", [R], f"SELECT physical_path, revision_type, timestamp FROM revisions WHERE logical_path = '{P12}'")
def _r4(r):
    return status.revisions_of(r, P12).select("physical_path", "revision_type", "timestamp")


@query("o3_display_order", [R], "SELECT id, row_number() OVER (PARTITION BY logical_path ORDER BY CASE WHEN revision_type IN ('DEVELOP', '') THEN 0 WHEN revision_type = 'ROLLBACK' THEN 1 WHEN revision_type = 'WORKING' THEN 2 WHEN revision_type = 'ARCHIVE' THEN 3 ELSE 4 END, os_flavor, timestamp DESC, revisions.\"user\", physical_path) AS place FROM revisions")
def _o3(r):
    return status.display_order(r).select("id", F.col("place").cast("long").alias("place"))


@query("o7_newest_checkouts", [R], "SELECT logical_path, physical_path, revisions.\"user\" AS user, timestamp FROM revisions WHERE revision_type = 'DEVELOP' QUALIFY row_number() OVER (PARTITION BY logical_path ORDER BY timestamp DESC, physical_path DESC) = 1")
def _o7(r):
    return status.newest_checkouts(r)


@query("o8_select_revision", [R], f"SELECT id, physical_path FROM revisions WHERE logical_path = '{P12}' AND revision_type = 'ARCHIVE' ORDER BY os_flavor, timestamp DESC, revisions.\"user\", physical_path LIMIT 1")
def _o8(r):
    return status.select_revision(r, P12, kind="archive").select("id", "physical_path")


@query("j13_denormalise", [S, R], f", f AS {_SUMMARY} SELECT s.id, f.checkout_user, f.checkout_os FROM scripts s LEFT JOIN f USING (logical_path)")
def _j13(s, r):
    return status.denormalise(s, r).select("id", "checkout_user", "checkout_os")


# -- audit -----------------------------------------------------------------------------
_META = "coalesce(trim(json_extract_string(metadata_json, '$.{}'), ' '), '') = ''"


@query("u1_unowned", [S], f"SELECT logical_path FROM scripts WHERE {_META.format('techowner')} AND {_META.format('funcowner')}")
def _u1(s):
    return audit.unowned(s).select("logical_path")


@query("u2_no_purpose", [S], "SELECT logical_path FROM scripts WHERE coalesce(trim(purpose, ' '), '') = ''")
def _u2(s):
    return audit.no_purpose(s).select("logical_path")


def _class_sql(kind: str) -> str:
    std = ", ".join(f"'{x}'" for x in audit.STDLIB)
    return f""", names AS (SELECT unnest(list_append(list_filter(string_split(logical_path, '/')[:-2], lambda x: x <> ''), regexp_replace(regexp_extract(logical_path, '[^/]*$'), '\\.[^.]*$', ''))) AS top FROM scripts),
c AS (SELECT s.logical_path, d.depends_on_path AS n, split_part(d.depends_on_path, '.', 1) AS top, s.language FROM dependencies d JOIN scripts s ON s.id = d.script_id WHERE d.kind = 'import' AND d.resolved_script_id IS NULL)
SELECT logical_path, n AS target FROM c WHERE CASE WHEN language IS DISTINCT FROM 'python' OR starts_with(n, '.') OR contains(n, '/') OR top = '' THEN 'Local' WHEN top IN ({std}) THEN 'Stdlib' WHEN top IN (SELECT top FROM names) THEN 'Local' ELSE 'External' END = '{kind}'"""


@query("u3_broken_deps", [S, D], _class_sql("Local"))
def _u3(s, d):
    return audit.broken_deps(s, d).select("logical_path", F.expr("substring(detail, 13)").alias("target"))


@query("u4_external_deps", [S, D], _class_sql("External"))
def _u4(s, d):
    return audit.external_deps(s, d).select("logical_path", F.expr("substring(detail, 11)").alias("target"))


@query("u5_orphan_checkouts", [S, R], "SELECT DISTINCT logical_path FROM revisions WHERE revision_type = 'DEVELOP' AND logical_path NOT IN (SELECT logical_path FROM scripts)")
def _u5(s, r):
    return audit.orphan_checkouts(s, r).select("logical_path")


@query("u6_stale_checkouts", [R], "SELECT logical_path, concat(cast(round_even(max(age_seconds) / 86400.0, 0) AS bigint), ' days') AS detail FROM revisions WHERE revision_type = 'DEVELOP' GROUP BY logical_path HAVING max(age_seconds) >= 90 * 86400.0")
def _u6(r):
    return audit.stale_checkouts(r).select("logical_path", "detail")


@query("u7_dead_scripts", [S, D, R], "SELECT logical_path FROM scripts s WHERE NOT EXISTS (SELECT 1 FROM dependencies d WHERE d.resolved_script_id = s.id) AND NOT EXISTS (SELECT 1 FROM revisions r WHERE r.revision_type = 'DEVELOP' AND r.logical_path = s.logical_path) AND NOT EXISTS (SELECT 1 FROM scripts l WHERE l.symlink_target = s.logical_path)")
def _u7(s, d, r):
    return audit.dead_scripts(s, d, r).select("logical_path")


@query("u8_no_description", [S], f"SELECT logical_path FROM scripts WHERE {_META.format('brief')} AND {_META.format('docstring')}")
def _u8(s):
    return audit.no_description(s).select("logical_path")


@query("a10_findings_by_check", [S, D, R], None)
def _a10(s, d, r):
    return audit.findings_by_check(audit.audit({"scripts": s, "dependencies": d, "revisions": r}))


ORACLE["a10_findings_by_check"] = (
    "SELECT 'unowned' AS \"check\", count(*) AS count FROM (" + ORACLE["u1_unowned"] + ") HAVING count(*) > 0"
    + "".join(f" UNION ALL SELECT '{c}', count(*) FROM ({ORACLE[q]}) HAVING count(*) > 0" for c, q in (("no-purpose", "u2_no_purpose"), ("broken-deps", "u3_broken_deps"), ("orphan-checkouts", "u5_orphan_checkouts"), ("stale-checkouts", "u6_stale_checkouts"), ("dead-scripts", "u7_dead_scripts"), ("no-description", "u8_no_description")))
)


# -- JSON records ----------------------------------------------------------------------
_OWNED = "'path', {0}.logical_path, 'language', {0}.language, 'owner', {0}.owner, 'purpose', {0}.purpose"


@query("p11_dependency_records", [S, D], f"SELECT coalesce(t.logical_path, d.depends_on_path) AS logical_path, cast(json_object('path', coalesce(t.logical_path, d.depends_on_path), 'depends_on_path', d.depends_on_path, 'language', t.language, 'owner', t.owner, 'purpose', t.purpose, 'indexed', t.id IS NOT NULL, 'kind', d.kind) AS varchar) AS value FROM dependencies d JOIN scripts s ON s.id = d.script_id AND s.logical_path = '{P9}' LEFT JOIN scripts t ON t.id = d.resolved_script_id")
def _p11d(s, d):
    return graph.dependency_records(s, d, P9)


@query("p11_used_by_records", [S, D], f"SELECT DISTINCT s.logical_path, cast(json_object({_OWNED.format('s')}, 'kind', d.kind) AS varchar) AS value FROM dependencies d JOIN scripts s ON s.id = d.script_id JOIN scripts t ON t.id = d.resolved_script_id AND t.logical_path = '{P9}'")
def _p11u(s, d):
    return graph.used_by_records(s, d, P9)


@query("p11_sibling_records", [S], f"SELECT s.logical_path, cast(json_object({_OWNED.format('s')}) AS varchar) AS value FROM scripts s WHERE starts_with(s.logical_path, '/catalog/dir9/sub2/') AND s.logical_path <> '{P9}'")
def _p11s(s):
    return graph.sibling_records(s, P9)


@query("p11_declared_by_records", [S, D], f"SELECT s.logical_path, cast(json_object({_OWNED.format('s')}, 'role', d.kind) AS varchar) AS value FROM dependencies d JOIN scripts s ON s.id = d.script_id WHERE d.depends_on_path = '/ext/data_7.csv' AND d.kind IN {_ROLES}")
def _p11f(s, d):
    return graph.declared_by_records(s, d, "/ext/data_7.csv")


# -- labels ----------------------------------------------------------------------------
@query("l1_relative_age", [R], "SELECT id, concat(cast(round_even(CASE WHEN a < 3600 THEN a / 60 WHEN a < 86400 THEN a / 3600 ELSE a / 86400 END, 0) AS bigint), CASE WHEN a < 3600 THEN 'm ago' WHEN a < 86400 THEN 'h ago' ELSE 'd ago' END) AS shown FROM (SELECT id, greatest(age_seconds / CASE id % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 480 ELSE 20000 END, 0) AS a FROM revisions WHERE age_seconds IS NOT NULL)")
def _l1(r):
    age = F.col("age_seconds") / F.expr("CASE id % 4 WHEN 0 THEN -1 WHEN 1 THEN 1 WHEN 2 THEN 480 ELSE 20000 END")  # every unit, and ages below zero
    return r.where("age_seconds is not null").select("id", X.relative_age(age).alias("shown"))


@query("l2_kind_labels", [D], "SELECT id, CASE kind WHEN 'referenced' THEN 'ref' WHEN 'inputfile' THEN 'input' WHEN 'outputfile' THEN 'output' WHEN 'parentfile' THEN 'parent' WHEN 'paramfile' THEN 'param' ELSE kind END AS label FROM dependencies")
def _l2(d):
    return d.select("id", X.kind_label(F.col("kind")).alias("label"))


@query("l3_checkout_labels", [S, R], f", f AS {_SUMMARY} SELECT s.id, CASE WHEN coalesce(f.checkout_user, '') = '' THEN 'clean' ELSE concat('checked out by ', f.checkout_user, CASE WHEN coalesce(f.checkout_timestamp, '') = '' THEN '' ELSE concat(' since ', f.checkout_timestamp) END) END AS label FROM scripts s LEFT JOIN f USING (logical_path)")
def _l3(s, r):
    return status.denormalise(s, r).select("id", show.checkout_label().alias("label"))


# -- similarity ------------------------------------------------------------------------
_COS = "list_cosine_similarity(cast(a.embedding AS double[]), cast(b.embedding AS double[]))"


_NEAREST = "SELECT a.logical_path AS of, b.logical_path, round({0}, 6) AS score FROM script_embeddings a JOIN script_embeddings b ON a.script_id % 20 = 0 AND b.script_id <> a.script_id{1} QUALIFY row_number() OVER (PARTITION BY a.script_id ORDER BY {0} DESC, b.script_id) <= {2}"


@query("e1_nearest", [E], _NEAREST.format(_COS, "", 10))
def _e1(e):
    return similarity.nearest_of(e, e.where("script_id % 20 = 0"), 10).select("of", "logical_path", F.round("score", 6).alias("score"))


@query("e1_nearest_to_one", [E], f"SELECT b.logical_path, round({_COS}, 6) AS score FROM script_embeddings a JOIN script_embeddings b ON a.logical_path = '{P9}' AND b.script_id <> a.script_id ORDER BY {_COS} DESC, b.script_id LIMIT 10")
def _e1o(e):
    return similarity.nearest(e, P9, 10).select("logical_path", F.round("score", 6).alias("score"))


@query("e2_near_duplicates", [E], f"SELECT least(a.logical_path, b.logical_path) AS path_a, greatest(a.logical_path, b.logical_path) AS path_b, round({_COS}, 6) AS score FROM script_embeddings a JOIN script_embeddings b ON a.script_id < b.script_id WHERE {_COS} >= 0.45")
def _e2(e):
    return similarity.near_duplicates(e, 0.45).select("path_a", "path_b", F.round("score", 6).alias("score"))


@query("e3_outliers", [E], f"SELECT a.logical_path, round(max({_COS}), 6) AS score FROM script_embeddings a JOIN script_embeddings b ON a.script_id <> b.script_id GROUP BY a.script_id, a.logical_path HAVING max({_COS}) < 0.33")
def _e3(e):
    return similarity.outliers(e, 0.33).select("logical_path", F.round("score", 6).alias("score"))


def _vector_audit(s, d, r, e, check, **bound):
    return audit.audit({"scripts": s, "dependencies": d, "revisions": r, "script_embeddings": e}, [check], **bound)


@query("u9_near_duplicates", [S, D, R, E], f"SELECT 'near-duplicates' AS check, 'warn' AS severity, least(a.logical_path, b.logical_path) AS logical_path, concat('like ', greatest(a.logical_path, b.logical_path)) AS detail FROM script_embeddings a JOIN script_embeddings b ON a.script_id < b.script_id WHERE {_COS} >= 0.4")
def _u9(s, d, r, e):
    return _vector_audit(s, d, r, e, "near-duplicates", near=0.4)


@query("u10_outliers", [S, D, R, E], f"SELECT 'outliers' AS check, 'info' AS severity, a.logical_path, 'like no other script' AS detail FROM script_embeddings a JOIN script_embeddings b ON a.script_id <> b.script_id GROUP BY a.script_id, a.logical_path HAVING max({_COS}) < 0.35")
def _u10(s, d, r, e):
    return _vector_audit(s, d, r, e, "outliers", far=0.35)


@query("a17_severity_summary", [S, D, R], None)
def _a17(s, d, r):
    return stats.severity_summary(audit.audit({"scripts": s, "dependencies": d, "revisions": r}, audit.DEFAULT))


ORACLE["a17_severity_summary"] = "SELECT " + ", ".join(f"coalesce(sum(count) FILTER (WHERE \"check\" IN ({kinds})), 0)::BIGINT AS {name}" for name, kinds in (("errors", "'broken-deps'"), ("warnings", "'unowned', 'no-purpose', 'orphan-checkouts'"), ("infos", "'stale-checkouts', 'dead-scripts', 'no-description'"))) + f" FROM ({ORACLE['a10_findings_by_check']})"


@query("e7_reused_vectors", [S, E], "SELECT s.logical_path, CASE WHEN s.id % 3 <> 0 THEN coalesce(len(e.embedding), 0) ELSE 0 END AS dim FROM scripts s LEFT JOIN script_embeddings e ON e.logical_path = s.logical_path")
def _e7(s, e):
    """Texts of all scripts beside vectors of which a third are of other texts."""
    texts = similarity.embed_text(s, sampled=True)
    hashes = texts.select("logical_path", F.when(F.col("id") % 3 == 0, "old").otherwise(F.col("text_hash")).alias("text_hash"))
    previous = e.join(hashes, "logical_path").select("logical_path", "text_hash", "embedding", F.lit("m").alias("model"))
    again = similarity.reuse_vectors(texts, previous.unionByName(previous.withColumn("model", F.lit("other"))), "m")
    return again.select("logical_path", F.when(F.col("embedding").isNotNull(), F.size("embedding")).otherwise(0).cast("long").alias("dim"))


@query("e4_similar", [S, E], _NEAREST.format(_COS, " WHERE b.logical_path IN (SELECT logical_path FROM scripts WHERE symlink_target IS NULL)", 8))
def _e4(s, e):
    # Vectors outlive scripts that became symlinks.
    return similarity.similar_of(s.where("symlink_target is null"), e, e.where("script_id % 20 = 0"), 8).select("of", "logical_path", F.round("score", 6).alias("score"))


@query("e6_embed_text", [S], "SELECT id, sha256(concat(array_to_string(list_filter([logical_path, CASE WHEN coalesce(purpose, '') <> '' THEN purpose END, CASE WHEN tags <> '[]' THEN concat('tags: ', array_to_string(from_json(tags, '[\"VARCHAR\"]'), ', ')) END, CASE WHEN coalesce(owner, '') <> '' THEN concat('owner: ', owner) END], lambda x: x IS NOT NULL), chr(10)), chr(10), chr(10), substr(coalesce(content, ''), 1, 20000))) AS text_hash FROM scripts WHERE language IS NULL OR language NOT IN ('csv', 'text', 'lst')")
def _e6(s):
    return similarity.embed_text(s).select("id", "text_hash")


# -- warnings --------------------------------------------------------------------------
@query("w1_without_entry", [S, R], "SELECT logical_path, cast(count(*) AS varchar) AS n FROM revisions WHERE logical_path NOT IN (SELECT logical_path FROM scripts) GROUP BY logical_path")
def _w1(s, r):
    return warnings.without_entry(s, r).select("logical_path", F.col("details")["checkouts"].alias("n"))


@query("w2_timestamp_drift", [S, R], "SELECT s.logical_path FROM (SELECT id, logical_path, mtime + 4000000 AS mtime FROM scripts) s JOIN (SELECT logical_path, max(timestamp) AS t FROM revisions WHERE revision_type = 'DEVELOP' GROUP BY logical_path) r USING (logical_path) WHERE s.mtime > epoch(strptime(t, '%Y%m%d_%H%M'))")
def _w2(s, r):
    return warnings.timestamp_drift(s.withColumn("mtime", F.col("mtime") + 4000000), r).select("logical_path")


@query("w3_self_symlink", [S], "SELECT logical_path FROM scripts WHERE logical_path = symlink_target")
def _w3(s):
    return warnings.self_referential(s).select("logical_path")


_STEM = "regexp_replace(regexp_extract({}, '[^/]*$'), '\\.[^.]*$', '')"


@query("w4_symlink_name", [S], f"SELECT logical_path FROM (SELECT logical_path, {_STEM.format('logical_path')} AS a, {_STEM.format('symlink_target')} AS b FROM scripts WHERE symlink_target <> logical_path) WHERE NOT (starts_with(b, a) OR starts_with(a, b || '_') OR starts_with(a, b || '-'))")
def _w4(s):
    return warnings.name_mismatch(s).select("logical_path")


@query("w5_missing_archive", [R], "SELECT DISTINCT logical_path FROM revisions r WHERE revision_type = 'DEVELOP' AND NOT EXISTS (SELECT 1 FROM revisions a WHERE a.logical_path = r.logical_path AND a.revision_type = 'ARCHIVE')")
def _w5(r):
    return warnings.missing_archive(r).select("logical_path")


@query("w6_type_mismatch", [S], "SELECT logical_path FROM (SELECT *, CASE json_extract_string(metadata_json, '$.scripttype') WHEN 'py' THEN 'python' WHEN 'python' THEN 'python' WHEN 'bash' THEN 'shell' END AS t FROM scripts) WHERE t IS NOT NULL AND language IS NOT NULL AND t <> language")
def _w6(s):
    return warnings.type_mismatch(s).select("logical_path")


_KINDS = [("checkout_without_catalog_entry", "w1_without_entry"), ("timestamp_drift", "w2_timestamp_drift"), ("self_referential_symlink", "w3_self_symlink"), ("symlink_name_mismatch", "w4_symlink_name"), ("missing_archive_entries", "w5_missing_archive"), ("scripttype_language_mismatch", "w6_type_mismatch")]


def _all_warnings_sql() -> str:
    """Every warning's path, kind and message, from the queries of the single kinds."""
    whole, parts = with_clause(S, R), []
    for kind, name in _KINDS:
        own = next(ORACLE[name][len(w):] for w in (whole, with_clause(S), with_clause(R)) if ORACLE[name].startswith(w))
        parts.append(f"SELECT logical_path, '{kind}' AS kind, '{warnings.MESSAGES[kind].replace(chr(39), chr(39) * 2)}' AS message FROM ({own})")
    return whole + " UNION ALL ".join(parts)


@query("w_messages", [S, R], None)
def _w_all(s, r):
    return warnings.all_warnings(s.withColumn("mtime", F.col("mtime") + 4000000), r).select("logical_path", "kind", "message")


ORACLE["w_messages"] = _all_warnings_sql()


# A manifest that leaves out scripts and names some that are not there, at every size.
_MANIFEST = f"SELECT {path_of('(o_orderkey % (SELECT count(*) + 500 FROM {documents}))')} AS path FROM {{orders}}"
ORACLE["w7_registration"] = with_clause(S) + f", m AS (SELECT DISTINCT path FROM ({_MANIFEST.format(documents='documents', orders='orders')})) SELECT path AS logical_path, 'registered_with_vc_but_not_indexed' AS kind FROM m WHERE path NOT IN (SELECT logical_path FROM scripts) UNION ALL SELECT logical_path, 'not_registered_with_vc' FROM scripts WHERE logical_path NOT IN (SELECT path FROM m)"


def _w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = spark.sql(_MANIFEST, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "orders")})
    return warnings.registration(views(spark, sf_dir, S)[S], manifest).select("logical_path", "kind")


QUERIES["w7_registration"] = _w7


# -- differences -----------------------------------------------------------------------
def _snapshots(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    new = s.where("id % 29 <> 0").withColumn("owner", F.when(F.col("id") % 31 == 0, F.lit("moved")).otherwise(F.col("owner"))).withColumn("purpose", F.when(F.col("id") % 37 == 0, F.lit(None)).otherwise(F.col("purpose")))
    return s.where("id % 23 <> 0"), new


_SNAP = ", o AS (SELECT * FROM scripts WHERE id % 23 <> 0), n AS (SELECT id, logical_path, CASE WHEN id % 31 = 0 THEN 'moved' ELSE owner END AS owner, CASE WHEN id % 37 = 0 THEN NULL ELSE purpose END AS purpose FROM scripts WHERE id % 29 <> 0)"


@query("d2_catalog_diff", [S], _SNAP + " SELECT coalesce(o.logical_path, n.logical_path) AS logical_path, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change, CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL AND o.owner IS DISTINCT FROM n.owner THEN n.owner END AS new_owner FROM o FULL JOIN n ON o.logical_path = n.logical_path WHERE o.id IS NULL OR n.id IS NULL OR o.owner IS DISTINCT FROM n.owner OR o.purpose IS DISTINCT FROM n.purpose")
def _d2(s):
    old, new = _snapshots(s)
    return diffing.catalog_diff(old, new).select("logical_path", "change", F.col("changes")["owner"]["new"].alias("new_owner"))


@query("d2_dependency_delta", [S, D], ", o AS (SELECT DISTINCT script_id, depends_on_path FROM dependencies WHERE id % 5 <> 0), n AS (SELECT DISTINCT script_id, depends_on_path FROM dependencies WHERE id % 7 <> 0) SELECT s.logical_path, coalesce(string_agg(n.depends_on_path, '|' ORDER BY n.depends_on_path) FILTER (WHERE o.script_id IS NULL), '') AS added, coalesce(string_agg(o.depends_on_path, '|' ORDER BY o.depends_on_path) FILTER (WHERE n.script_id IS NULL), '') AS removed FROM o FULL JOIN n ON o.script_id = n.script_id AND o.depends_on_path = n.depends_on_path JOIN scripts s ON s.id = coalesce(o.script_id, n.script_id) WHERE o.script_id IS NULL OR n.script_id IS NULL GROUP BY s.logical_path")
def _d2d(s, d):
    delta = diffing.dependency_delta((s, d.where("id % 5 <> 0")), (s, d.where("id % 7 <> 0")))
    return delta.select("logical_path", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))


_BREAKS = "[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


@query("d1_against_checkouts", [S, R], f", f AS (SELECT logical_path, arg_max(physical_path, concat(timestamp, physical_path)) AS p FROM revisions WHERE revision_type = 'DEVELOP' GROUP BY logical_path), t AS (SELECT logical_path, regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '{_BREAKS}', chr(10), 'g') AS text FROM scripts WHERE content <> '' AND (language IS NULL OR language NOT IN ('csv', 'text', 'lst'))) SELECT t.logical_path, concat('catalog:', t.logical_path) AS old_label, p AS new_label, 'checkout' AS new_kind, cast(length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END AS int) AS at FROM t JOIN f USING (logical_path)")
def _d1b(s, r):
    """Every script against a newest checkout that adds a line at its end: one hunk, after the last line."""
    # Only newest checkouts are read, so only they get a text.
    read = status.newest_checkouts(r).select("logical_path", "physical_path")
    texts = read.join(s.select("logical_path", F.concat("content", F.lit("\nmore")).alias("content")), "logical_path")
    found = diffing.against_newest_checkouts(s, r, texts)
    return found.select("logical_path", "old_label", "new_label", "new_kind", (F.when(F.col("old_count") > 0, F.col("old_start") + F.col("old_count") - 1).otherwise(0)).alias("at"))


# Lines of a text: other line breaks are folded into \\n.  The last piece after a \\n, of k lines, becomes one line behind p others.
_D1_SQL = f""", t AS (SELECT logical_path, regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '{_BREAKS}', chr(10), 'g') AS text, content FROM scripts WHERE contains(content, chr(10))),
c AS (SELECT logical_path, text, regexp_extract(content, '[^\\n]*$') AS piece FROM t),
k AS (SELECT *, regexp_replace(piece, '{_BREAKS}', chr(10), 'g') AS folded FROM c),
n AS (SELECT logical_path, piece, len(string_split(text[:len(text) - len(folded) - 1], chr(10))) AS p, len(string_split(folded, chr(10))) - CASE WHEN folded = '' OR ends_with(folded, chr(10)) THEN 1 ELSE 0 END AS k FROM k)
SELECT logical_path, 0 AS hunk, cast(p - least(p, 3) + 1 AS int) AS old_start, cast(least(p, 3) + k AS int) AS old_count, cast(p - least(p, 3) + 1 AS int) AS new_start, cast(least(p, 3) + 1 AS int) AS new_count FROM n WHERE piece <> 'changed'"""


@query("d1_text_diff", [S], _D1_SQL)
def _d1(s):
    pairs = s.select("logical_path", F.col("content").alias("old"), F.regexp_replace("content", r"\n[^\n]*$", "\nchanged").alias("new"))
    return diffing.text_diff(pairs).select("logical_path", "hunk", "old_start", "old_count", "new_start", "new_count")
