"""Differences of two catalogs, and of two texts by lines."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.exprs import json_field
from cairn.operators.status import newest_checkouts

FIELDS = ["purpose", "techowner", "funcowner", "owner", "language", "tags", "entry_points", "related"]
CONTEXT = 3


def _fields(scripts: DataFrame) -> DataFrame:
    meta = ("techowner", "funcowner")
    have = [json_field(F.col("metadata_json"), f) if f in meta else F.col(f) if f in scripts.columns else F.lit(None).cast("string") for f in FIELDS]
    return scripts.select("logical_path", *[c.alias(f) for c, f in zip(have, FIELDS, strict=True)])


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """logical_path, change (added, removed, changed), changes: field to (old, new)."""
    a, b = _fields(old).withColumn("here", F.lit(True)), _fields(new).withColumn("here", F.lit(True))
    both = a.alias("a").join(b.alias("b"), "logical_path", "full_outer")
    pairs = F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.struct(F.lit(f).alias("key"), F.struct(F.col(f"a.{f}").alias("old"), F.col(f"b.{f}").alias("new")).alias("value"))) for f in FIELDS])
    change = F.when(F.col("a.here").isNull(), "added").when(F.col("b.here").isNull(), "removed").otherwise("changed")
    changed = F.when(change == "changed", F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull())))
    out = both.select("logical_path", change.alias("change"), changed.alias("changes"))
    return out.where((F.col("change") != "changed") | (F.size("changes") > 0))


def dependency_delta(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> DataFrame:
    """logical_path, added, removed: sorted paths that a script in both catalogs depends on in one only."""
    def sets(scripts: DataFrame, dependencies: DataFrame, name: str) -> DataFrame:
        own = dependencies.groupBy(F.col("script_id").alias("id")).agg(F.collect_set("depends_on_path").alias(name))
        return scripts.select("id", "logical_path").join(own, "id", "left").select("logical_path", F.coalesce(name, F.array().cast("array<string>")).alias(name))

    both = sets(*old, "was").join(sets(*new, "now"), "logical_path")
    out = both.select("logical_path", F.array_sort(F.array_except("now", "was")).alias("added"), F.array_sort(F.array_except("was", "now")).alias("removed"))
    return out.where((F.size("added") > 0) | (F.size("removed") > 0))


def hunks(old: str | None, new: str | None) -> list[dict]:
    """Hunks with CONTEXT lines around changes: 1-based starts (0 where a side has no line) and signed lines."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    out = []
    for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(CONTEXT):
        lines = []
        for op, i, j, k, m in group:
            if op == "equal":
                lines += [f" {x}" for x in a[i:j]]
            else:
                lines += [f"-{x}" for x in a[i:j]] + [f"+{x}" for x in b[k:m]]
        n_old, n_new = group[-1][2] - group[0][1], group[-1][4] - group[0][3]
        out.append({"old_start": group[0][1] + 1 if n_old else 0, "old_count": n_old, "new_start": group[0][3] + 1 if n_new else 0, "new_count": n_new, "lines": lines})
    return out


#: Characters of both texts that are compared at once; a longer pair is compared alone.
CHARS = 4 << 20


_HUNK = {"logical_path": "string", "hunk": "int", "old_start": "int", "old_count": "int", "new_start": "int", "new_count": "int", "lines": "array<string>", "no_newline": "boolean"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}


def diffed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hunks of batches of (logical_path, old, new, more strings ...); they leave as soon as CHARS of text are compared, however many pairs come at once."""
    for batch in batches:
        types = _HUNK | dict.fromkeys(batch.schema.names[3:], "string")
        rows, chars = [], 0
        for k in range(batch.num_rows):
            path, old, new, *more = (c[k].as_py() for c in batch.columns)
            bare = any(t and not t.endswith("\n") for t in (old, new))
            rows += [(path, i, h["old_start"], h["old_count"], h["new_start"], h["new_count"], h["lines"], bare, *more) for i, h in enumerate(hunks(old, new))]
            chars += len(old or "") + len(new or "")
            if rows and (chars >= CHARS or k + 1 == batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))
                rows, chars = [], 0


def text_diff(pairs: DataFrame, *more: str) -> DataFrame:
    """Hunks of pairs(logical_path, old, new), a row each, with whether a side lacks its last newline, and *more* columns (strings) of the pair."""
    types = _HUNK | dict.fromkeys(more, "string")
    return pairs.select("logical_path", "old", "new", *more).mapInArrow(diffed, ", ".join(f"{c} {t}" for c, t in types.items()))


def catalog_against(scripts: DataFrame, files: DataFrame, kind: str = "explicit") -> DataFrame:
    """Hunks of the catalog's text against files(logical_path, physical_path, content), with labels of both sides.

    kind names the new side: explicit, checkout or revision.  Sampled and empty scripts
    are left out here; ``comparable`` says why for a single one.
    """
    known = scripts.where("content is not null and content <> '' and (language is null or language not in ('csv', 'text', 'lst'))")
    both = known.select("logical_path", F.col("content").alias("old")).join(files.select("logical_path", "physical_path", F.col("content").alias("new")), "logical_path")
    labels = [F.concat(F.lit("catalog:"), "logical_path").alias("old_label"), F.col("physical_path").alias("new_label"), F.lit(kind).alias("new_kind")]
    return text_diff(both, "physical_path").select("*", *labels).drop("physical_path")


def against_newest_checkouts(scripts: DataFrame, revisions: DataFrame, contents: DataFrame) -> DataFrame:
    """Every script against its newest checkout; contents(physical_path, content) are the checkouts' texts."""
    newest = newest_checkouts(revisions).select("logical_path", "physical_path")
    return catalog_against(scripts, newest.join(contents.select("physical_path", "content"), "physical_path"), "checkout")


def against_revision(scripts: DataFrame, revision, contents: DataFrame) -> DataFrame:
    """A script against one revision's row; a checkout, or a revision of another kind."""
    kind = "checkout" if (revision.revision_type or "").upper() in ("", "DEVELOP") else "revision"
    own = contents.where(F.col("physical_path") == revision.physical_path)
    return catalog_against(scripts, own.select(F.lit(revision.logical_path).alias("logical_path"), "physical_path", "content"), kind)


def two_files(old: tuple[str, str], new: tuple[str, str]) -> str:
    """Unified text of two (name, text) pairs, without any catalog."""
    return render(old[0], new[0], hunks(old[1], new[1]))


def render(label_old: str, label_new: str, found: list[dict]) -> str:
    """Unified text of hunks."""
    if not found:
        return "(no differences)"
    out = [f"--- {label_old}", f"+++ {label_new}"]
    for h in found:
        out += [f"@@ -{h['old_start']},{h['old_count']} +{h['new_start']},{h['new_count']} @@", *h["lines"]]
    return "\n".join(out)


class DiffError(ValueError):
    """There is nothing to compare."""


def comparable(row) -> str:
    """The catalog's text of a script row, or why it can't be compared."""
    if row is None:
        raise DiffError("the script is not in the catalog")
    if row.language in ("csv", "text", "lst"):
        raise DiffError("the catalog holds only a sample of this file")
    if not row.content:
        raise DiffError("the catalog holds no text of this script")
    return row.content
