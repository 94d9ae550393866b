"""Tables of a catalog: fixed schemas and the version that readers require."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

VERSION = 14

_DDL = {
    "scripts": "id long, logical_path string, language string, size long, mtime double, content_hash string, content string, owner string, purpose string, tags string, entry_points string, related string, symlink_target string, metadata_json string, checkout_user string, checkout_timestamp string, checkout_os string, checkout_age_seconds double, vc_warnings string, indexed_at string",
    "dependencies": "id long, script_id long, depends_on_path string, resolved_script_id long, kind string",
    "revisions": "id long, logical_path string, physical_path string, revision_type string, os_flavor string, user string, timestamp string, age_seconds double",
    "function_definitions": "id long, script_id long, name string, kind string, line int, docstring string, decorators string",
    "function_calls": "id long, script_id long, caller string, callee string, line int, resolved_target_name string, resolved_target_script_id long",
    "index_metadata": "id int, build_timestamp string, schema_version long, manifest_fingerprint string",
    "script_embeddings": "script_id long, logical_path string, model string, dim long, embedding array<float>, text_hash string",
    "embedding_metadata": "id int, format_version long, catalog_build_timestamp string",
}
_TYPES = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "array<float>": ArrayType(FloatType())}
TABLES: dict[str, StructType] = {name: StructType([StructField(c, _TYPES[t]) for c, t in (x.split() for x in ddl.split(", "))]) for name, ddl in _DDL.items()}

def _structs(ddl: str) -> ArrayType:
    return ArrayType(StructType([StructField(c, _TYPES[t]) for c, t in (x.split() for x in ddl.split(", "))]))


#: What extraction found in a script, by path and as found: ids and resolved names are made anew by each build.
FACTS = StructType(
    [StructField(c, StringType()) for c in ("logical_path", "purpose", "owner", "related", "metadata_json")]
    + [StructField(c, ArrayType(StringType())) for c in ("imports", "refs", "yaml_refs")]
    + [
        StructField("declared", _structs("kind string, value string")),
        StructField("definitions", _structs("name string, kind string, line int, docstring string, decorators string")),
        StructField("calls", _structs("caller string, callee string, line int, target string")),
    ]
)
TABLES["facts"] = FACTS
#: Columns that identify a row; publishing checks them.
KEYS = {"scripts": ["logical_path"], "dependencies": ["script_id", "depends_on_path", "kind"], "revisions": ["physical_path"], "function_definitions": ["script_id", "kind", "name", "line"], "index_metadata": ["id"], "script_embeddings": ["script_id"], "facts": ["logical_path"]}
KINDS = ("import", "referenced", "parentfile", "childfile", "inputfile", "outputfile", "paramfile")
