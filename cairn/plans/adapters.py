"""The driver's tables as a catalog: one SQL text a relation, read the same by Spark and DuckDB.

``{name}`` stands for a table.  Paths depend on the id alone, so that any relation can
name any script; the number of scripts is counted, not assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "lineitem", "events", "part", "embeddings", "orders", "pages", "labels")


def path_of(i: str) -> str:
    """SQL of the path of script *i*."""
    return f"concat('/catalog/dir', cast({i} % 20 AS varchar(20)), CASE WHEN {i} % 5 = 0 THEN '' ELSE concat('/sub', cast({i} % 7 AS varchar(20))) END, '/doc_', cast({i} AS varchar(20)), CASE {i} % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.sh' ELSE '.txt' END)"


_N = "(SELECT count(*) FROM {documents})"

RELATIONS = {
    "scripts": f"""
SELECT doc_id AS id, {path_of('doc_id')} AS logical_path,
  CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'python' WHEN doc_id % 3 = 1 THEN 'shell' ELSE 'text' END AS language,
  CASE WHEN doc_id % 41 = 0 THEN NULL ELSE n_chars END AS size, cast(1700000000 + doc_id * 5000 AS double) AS mtime,
  text AS content, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 43 = 0 THEN '' ELSE source END AS owner,
  CASE WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 19 = 0 THEN '  ' WHEN doc_id % 23 = 0 THEN NULL ELSE concat('Purpose of ', lang, ' job ', cast(doc_id % 50 AS varchar(20))) END AS purpose,
  CASE doc_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '["deploy","prod"]' WHEN 2 THEN '["deploy"]' ELSE '["Prod","nightly"]' END AS tags,
  CASE WHEN doc_id % 9 = 0 THEN concat('["', {path_of('(doc_id + 1)')}, '","/catalog/none.py"]') ELSE '[]' END AS related,
  CASE WHEN doc_id % 29 = 0 THEN {path_of('(doc_id + 3)')} WHEN doc_id % 97 = 0 THEN {path_of('doc_id')} ELSE NULL END AS symlink_target,
  concat('{{{{"techowner":"', CASE WHEN doc_id % 2 = 0 THEN 'team' ELSE '' END, '","funcowner":"', CASE WHEN doc_id % 7 = 0 THEN 'ops' ELSE ' ' END, '","brief":"', CASE WHEN doc_id % 5 = 0 THEN 'b' ELSE '' END, '","scripttype":"', CASE doc_id % 6 WHEN 0 THEN 'py' WHEN 1 THEN 'bash' WHEN 2 THEN 'perl' ELSE 'python' END, '"}}}}') AS metadata_json,
  CASE WHEN doc_id % 37 = 0 THEN '[{{{{"kind":"timestamp_drift"}}}}]' ELSE '[]' END AS vc_warnings
FROM {{documents}}""".replace("{{{{", "{{").replace("}}}}", "}}"),
    "dependencies": f"""
SELECT min(l_orderkey * 10 + l_linenumber) AS id, script_id, depends_on_path, resolved_script_id, kind FROM (
  SELECT l_orderkey, l_linenumber, l_orderkey % {_N} AS script_id,
    CASE WHEN l_partkey % {_N} % 7 <> 0 THEN {path_of('(l_partkey % ' + _N + ')')}
         WHEN l_partkey % 5 = 0 THEN 'os.path' WHEN l_partkey % 4 = 0 THEN concat('vendor', cast(l_partkey % 50 AS varchar(20)), '.mod') WHEN l_partkey % 3 = 0 THEN 'tools/x.py'
         WHEN l_partkey % 13 = 0 THEN '.sibling' WHEN l_partkey % 11 = 0 THEN 'dir3.missing' ELSE concat('/ext/data_', cast(l_partkey % 30 AS varchar(20)), '.csv') END AS depends_on_path,
    CASE WHEN l_partkey % {_N} % 7 = 0 THEN NULL ELSE l_partkey % {_N} END AS resolved_script_id,
    CASE l_linenumber WHEN 1 THEN 'import' WHEN 2 THEN 'import' WHEN 3 THEN 'referenced' WHEN 4 THEN 'inputfile' WHEN 5 THEN 'outputfile' WHEN 6 THEN 'parentfile' ELSE 'paramfile' END AS kind
  FROM {{lineitem}}) AS edges
GROUP BY script_id, depends_on_path, resolved_script_id, kind""",
    "revisions": f"""
SELECT event_id AS id, {path_of('(event_id % (300 + ' + _N + '))')} AS logical_path, concat('/vc/', event_type, '/', cast(event_id AS varchar(20))) AS physical_path,
  CASE CASE WHEN event_id % (300 + {_N}) % 7 = 0 THEN 'view' ELSE event_type END WHEN 'click' THEN 'DEVELOP' WHEN 'error' THEN 'DEVELOP' WHEN 'view' THEN 'ARCHIVE' WHEN 'signup' THEN 'WORKING' ELSE 'ROLLBACK' END AS revision_type,
  CASE event_id % 3 WHEN 0 THEN 'LINUX' WHEN 1 THEN 'AIX' ELSE 'WIN' END AS os_flavor,
  CASE WHEN user_id % 13 = 0 THEN '' ELSE concat('u', cast(user_id % 40 AS varchar(20))) END AS user,
  replace(replace(replace(substring(cast(ts AS varchar(30)), 1, 16), '-', ''), ' ', '_'), ':', '') AS timestamp,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE cast(event_id % 500 AS double) * 86400.0 END AS age_seconds
FROM {{events}}""",
    "function_definitions": f"""
SELECT p_partkey AS id, p_partkey % {_N} AS script_id, concat('run_', cast(p_partkey % 90 AS varchar(20))) AS name,
  CASE WHEN p_size % 4 = 0 THEN 'class' ELSE 'function' END AS kind, p_size AS line FROM {{part}}""",
    "function_calls": f"""
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % {_N} AS script_id, CASE WHEN l_linenumber % 3 = 0 THEN '__module__' ELSE 'main' END AS caller,
  CASE l_linenumber % 4 WHEN 0 THEN concat('mod.run_', cast(l_partkey % 90 AS varchar(20))) WHEN 1 THEN concat('run_', cast(l_partkey % 90 AS varchar(20))) WHEN 2 THEN concat('m.runx', cast(l_partkey % 90 AS varchar(20))) ELSE 'print' END AS callee,
  cast(l_suppkey % 100 AS int) AS line, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % {_N} END AS resolved_target_script_id
FROM {{lineitem}}""",
    "script_embeddings": f"SELECT vec_id AS script_id, {path_of('vec_id')} AS logical_path, embedding FROM {{embeddings}}",
}


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named relations over one data directory."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if any(f"{{{t}}}" in RELATIONS[n] for n in names)}
    return {n: spark.sql(RELATIONS[n], **{t: df for t, df in tables.items() if f"{{{t}}}" in RELATIONS[n]}) for n in names}


def with_clause(*names: str) -> str:
    """The same relations for DuckDB, as the start of a query."""
    return "WITH " + ", ".join(f"{n} AS ({RELATIONS[n].format(**{t: t for t in TABLES})})" for n in names) + " "
