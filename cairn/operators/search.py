"""Search: ranked text, paths, patterns, functions, declared files, lists, routing and display order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import fts, grams
from cairn.functions.exprs import ascii_lower, basename, contains_folded, fold, json_list, like_literal, parent_dir, stem
from cairn.functions.grams import Grams, narrowed
from cairn.functions.querytext import ROLES, check_limit, check_role, java_regex, phrases
from cairn.sources.scratch import Scratch


@dataclass(frozen=True)
class Filters:
    """Metadata filters, which apply before any limit."""

    language: str | None = None
    owner: str | None = None
    tag: str | None = None

    def apply(self, scripts: DataFrame) -> DataFrame:
        if self.language is not None:
            scripts = scripts.where(ascii_lower(F.col("language")) == fold(self.language))
        if self.owner is not None:
            scripts = scripts.where(contains_folded(F.col("owner"), self.owner))
        if self.tag is not None:
            scripts = scripts.where(F.exists(json_list(F.col("tags")), lambda t: ascii_lower(t) == fold(self.tag)))
        return scripts


NONE = Filters()


def full_text(scripts: DataFrame, query: str, limit: int, filters: Filters = NONE, index: fts.Index | None = None) -> DataFrame:
    """Rows of the best *limit* scripts with their score and rank; ties go by id.

    Without an index, one pass over the texts counts the hits of every row.
    """
    check_limit(limit)
    wanted = phrases(query)
    if not wanted:
        return scripts.where("false").withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    keep = Scratch(scripts.sparkSession, "search")
    if index:
        best = fts.best_of_index(index, wanted, limit, keep, None if filters == NONE else filters.apply(scripts)).rows
    else:
        scored = fts.bm25(keep.put(fts.matches(scripts, wanted), "hits"), wanted)
        # Texts are read again for the few rows that stay, after ids and scores were cut to the limit.
        best = filters.apply(scripts).select("id").join(scored, "id").orderBy("score", "id").limit(limit)
    rank = best.withColumn("rank", F.row_number().over(Window.orderBy("score", "id")))  # at most `limit` rows
    return scripts.join(rank, "id")


def lookup(scripts: DataFrame, path: str) -> DataFrame:
    """The script at a path, literally."""
    return scripts.where(F.col("logical_path") == path)


def store_grams(path: str, scripts: DataFrame, definitions: DataFrame, dependencies: DataFrame) -> None:
    """Write the trigrams of paths, function names and declared files, which the searches for them take."""
    declared = dependencies.where(F.col("kind").isin(list(ROLES)))
    texts = {
        "path": scripts.select("id", F.col("logical_path").alias("text")),
        "function": definitions.select(F.col("script_id").alias("id"), F.col("name").alias("text")),
        "declared": declared.select(F.col("script_id").alias("id"), F.col("depends_on_path").alias("text")),
    }
    grams.store_grams(path, texts)


def by_path(scripts: DataFrame, needle: str, limit: int, filters: Filters = NONE, index: Grams | None = None) -> DataFrame:
    check_limit(limit)
    if index:
        scripts = narrowed(scripts, "id", index.candidates("path", fold(needle)))
    return filters.apply(scripts).where(contains_folded(F.col("logical_path"), needle)).orderBy("logical_path").limit(limit)


def by_regex(scripts: DataFrame, pattern: str, limit: int, filters: Filters = NONE) -> DataFrame:
    """Unanchored match on path or purpose; the content column joins after the limit."""
    check_limit(limit)
    java = java_regex(pattern)
    hit = F.col("logical_path").rlike(java) | F.coalesce("purpose", F.lit("")).rlike(java)
    ids = filters.apply(scripts).where(hit).select("id", "logical_path").orderBy("logical_path").limit(limit).select("id")
    return scripts.join(ids, "id", "left_semi").orderBy("logical_path")


def by_function(scripts: DataFrame, definitions: DataFrame, name: str, limit: int, filters: Filters = NONE, index: Grams | None = None) -> DataFrame:
    """Scripts that define a matching name; % and _ in the name are wildcards, and nothing escapes them."""
    check_limit(limit)
    if index:
        definitions = narrowed(definitions, "script_id", index.candidates("function", *re.split("[%_]", fold(name))))
    ids = definitions.where(ascii_lower(F.col("name")).like("%" + fold(name).replace("\\", "\\\\") + "%")).select(F.col("script_id").alias("id"))
    return filters.apply(scripts).join(ids, "id", "left_semi").orderBy("logical_path").limit(limit)


def by_declared(scripts: DataFrame, dependencies: DataFrame, needle: str, limit: int, role: str | None = None, filters: Filters = NONE, index: Grams | None = None) -> DataFrame:
    """Scripts that declare a matching file in a role; the needle is literal."""
    check_limit(limit)
    check_role(role, declares=True)
    if index:
        dependencies = narrowed(dependencies, "script_id", index.candidates("declared", fold(needle)))
    kinds = [role] if role else list(ROLES)
    hit = ascii_lower(F.col("depends_on_path")).like(f"%{like_literal(fold(needle))}%")
    ids = dependencies.where(F.col("kind").isin(kinds) & hit).select(F.col("script_id").alias("id"))
    return filters.apply(scripts).join(ids, "id", "left_semi").orderBy("logical_path").limit(limit)


def listing(scripts: DataFrame, limit: int, offset: int = 0, filters: Filters = NONE) -> DataFrame:
    check_limit(limit, offset)
    return filters.apply(scripts).orderBy("logical_path").offset(offset).limit(limit)


def name_tier(path: Column, query: str) -> Column:
    """0 the stem is the query, 1 the basename is, 2 the stem begins with it, 3 the basename has it, 4 else."""
    q = query.lower()
    base, own = F.lower(basename(path)), F.lower(stem(path))
    return F.when(own == q, 0).when(base == q, 1).when(own.startswith(q), 2).when(base.contains(q), 3).otherwise(4)


def rerank(found: DataFrame, query: str) -> DataFrame:
    """Full-text results by name relevance, ranks kept within a tier: column ``place``."""
    tier = name_tier(F.col("logical_path"), query)
    return found.withColumn("place", F.row_number().over(Window.orderBy(tier, "rank")))  # a limited result


def text_search(scripts: DataFrame, query: str, limit: int, filters: Filters = NONE) -> DataFrame:
    """A query like a path: path hits, then ranked hits not among them; any other: ranked and re-ranked."""
    if not any(c in query for c in "/\\."):
        return rerank(full_text(scripts, query, limit, filters), query)
    first = by_path(scripts, query.replace("\\", "/"), limit, filters)
    ranked = full_text(scripts, query, limit, filters)
    more = ranked.join(first.select("logical_path"), "logical_path", "left_anti")
    both = first.withColumns({"source": F.lit(0), "rank": F.lit(0)}).unionByName(more.drop("score").withColumn("source", F.lit(1)))
    placed = both.withColumn("place", F.row_number().over(Window.orderBy("source", "rank", "logical_path")))
    return placed.where(F.col("place") <= limit)


def route(catalog: dict[str, DataFrame], limit: int, text: str | None = None, regex: str | None = None, function: str | None = None, declares: str | None = None, role: str | None = None, filters: Filters = NONE) -> DataFrame:
    """Declared files before functions, patterns, text, and the plain list."""
    check_limit(limit)
    check_role(role, declares is not None)
    scripts = catalog["scripts"]
    if declares is not None:
        return by_declared(scripts, catalog["dependencies"], declares, limit, role, filters)
    if function is not None:
        return by_function(scripts, catalog["function_definitions"], function, limit, filters)
    if regex is not None:
        return by_regex(scripts, regex, limit, filters)
    return text_search(scripts, text, limit, filters) if text else listing(scripts, limit, 0, filters)


def symlink_groups(found: DataFrame) -> DataFrame:
    """logical_path, line, shown: each symlink followed by its target; rows that are such targets are left out."""
    targets = found.where("symlink_target is not null and symlink_target <> logical_path").select(F.col("symlink_target").alias("logical_path")).distinct()
    rows = found.select("logical_path", "symlink_target").join(targets, "logical_path", "left_anti")
    same = parent_dir(F.col("logical_path")).eqNullSafe(parent_dir(F.col("symlink_target")))
    arrow = F.concat(F.lit("↳ "), F.when(same, basename(F.col("symlink_target"))).otherwise(F.col("symlink_target")))
    lines = F.when(F.col("symlink_target").isNull(), F.array("logical_path")).otherwise(F.array(F.col("logical_path"), arrow))
    return rows.select("logical_path", F.posexplode(lines).alias("line", "shown"))
