"""Full-text ranking: phrases, prefixes and BM25 over columns, without or with a stored index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.exprs import LETTER, folded, tokens
from cairn.functions.querytext import Phrase
from cairn.sources.scratch import Scratch

COLUMNS = ("logical_path", "content", "owner", "purpose", "tags")
K1, B, FLOOR = 1.2, 0.75, 1e-6


def _pattern(p: Phrase) -> str:
    """Matches the first token of each place where the phrase stands in a text; places may overlap."""
    end = "" if p.prefix else f"(?!{LETTER})"
    first, *rest = p.tokens
    return f"(?<!{LETTER}){first}" + (f"(?=[^{LETTER[1:-1]}]+" + f"[^{LETTER[1:-1]}]+".join(rest) + f"{end})" if rest else end)


def _hits(text: Column, p: Phrase) -> Column:
    """How often the phrase stands in a folded text; the pattern runs only where its longest token occurs."""
    return F.when(F.contains(text, F.lit(max(p.tokens, key=len))), F.regexp_count(text, F.lit(_pattern(p)))).otherwise(0)


def matches(scripts: DataFrame, query: list[Phrase]) -> DataFrame:
    """id, d (tokens of the row), f0, f1 ... (hits of each phrase): every row of the corpus."""
    texts = [folded(F.col(c)) for c in COLUMNS]
    d = reduce(lambda a, b: a + b, [F.regexp_count(t, F.lit(f"{LETTER}+")) for t in texts])
    f = [reduce(lambda a, b: a + b, [_hits(t, p) for t in texts]).alias(f"f{k}") for k, p in enumerate(query)]
    return scripts.select("id", d.alias("d"), *f)


def _gain(f: Column | np.ndarray, d: Column | np.ndarray, avgdl: Column | float) -> Column | np.ndarray:
    """What f hits in a row of d tokens are worth, times the rarity of what was hit."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * d / avgdl))


def _rarity(n: Column, having: Column) -> Column:
    ratio = (n - having + 0.5) / (having + 0.5)
    return F.when(F.log(ratio) > 0, F.log(ratio)).otherwise(F.lit(FLOOR))


def bm25(counted: DataFrame, query: list[Phrase]) -> DataFrame:
    """id, score of the rows that have all phrases; lower is better.  Statistics are of all rows.

    *counted* is read twice, so it should be stored.
    """
    stats = counted.agg(F.count("*").alias("n"), F.avg("d").alias("avgdl"), *[F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"n{k}") for k in range(len(query))])
    both = counted.where(reduce(lambda a, b: a & b, [F.col(f"f{k}") > 0 for k in range(len(query))])).crossJoin(F.broadcast(stats))  # one row of statistics
    score = reduce(lambda s, k: s - _rarity(F.col("n"), F.col(f"n{k}")) * _gain(F.col(f"f{k}"), F.col("d"), F.col("avgdl")), range(len(query)), F.lit(0.0))
    return both.select("id", score.alias("score"))


# -- a stored index ----------------------------------------------------------------------
#: Ids of a block; blocks of the greatest bounds that are scored first; block numbers that go into a scan's filter.
BLOCK_IDS, SEED, MOST_NUMBERS = 4096, 8, 1000
#: Bytes of a row group of the postings: a query's terms should touch few others.
ROW_GROUP = 1 << 20


def store_index(scripts: DataFrame, path: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the full-text index of *scripts* below a folder.

    ``corpus(n, avgdl)``: rows, and their mean number of tokens.
    ``postings(term, block, n, top, entries)``, sorted by term and block: the rows of a
    block of ids that hold a term, how many they are, the most that the term is worth in
    any of them, and of each its id, d (tokens), f (hits) and places (see ``_parts``).

    Tokens never move one by one: a task turns its texts into the parts of postings, which
    are stored and dealt once, by ranges of terms.
    """
    spark = scripts.sparkSession
    # The empty term, which no text has, stands first in every row; a null ends a column, so that no phrase goes on in the next.
    words = F.concat(F.array(F.lit("")), *[x for c in COLUMNS for x in (tokens(F.col(c)), F.array(F.lit(None).cast("string")))])
    group_ids = block_ids * -(-BLOCK_IDS // block_ids)
    # Stored first, as finding the ranges reads them once more.
    parts = Scratch(spark, "fts").put(scripts.select("id", words.alias("words")).mapInArrow(_parts(group_ids), PARTS), "parts")
    corpus = parts.where("term = ''").select(F.explode("ds").alias("d")).agg(F.count("*").alias("n"), F.avg("d").alias("avgdl"))
    corpus.coalesce(1).write.parquet(f"{path}/corpus")
    avgdl = spark.read.parquet(f"{path}/corpus").first().avgdl or 1.0
    dealt = parts.where("term <> ''").repartitionByRange("term", "ids_from").sortWithinPartitions("term", "ids_from", F.element_at("ids", 1))
    dealt.mapInArrow(_postings(block_ids, avgdl), POSTINGS).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/postings")


PARTS = "term string, ids_from long, ids array<long>, ds array<int>, fs array<int>, places array<int>"
POSTINGS = "term string, block long, n long, top double, entries array<struct<id:long,d:long,f:long,places:array<int>>>"
#: Bytes of words that a task turns into parts at a time, about.
PART_BYTES = 32 << 20
Batches = Iterator[pa.RecordBatch]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    n = len(keys[0])
    return np.flatnonzero(np.append(np.ones(min(n, 1), bool), reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])))


def _list(starts: np.ndarray, values: np.ndarray | pa.Array) -> pa.Array:
    """Lists that begin at *starts* and hold all values."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _parts(group_ids: int) -> Callable[[Batches], Batches]:
    """(id, words) to the rows of some ids that hold a term: ids ascending, and of each d, f and the f places, one after another.

    A place counts the words of the row; columns are told apart by a null between them.
    """

    def part(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by("id").combine_chunks()
        ids, lists = rows["id"].to_numpy(), rows["words"].combine_chunks()
        size = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(ids)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        coded = lists.flatten().dictionary_encode()
        held = coded.is_valid().to_numpy(zero_copy_only=False)
        row, place = row[held], place[held].astype(np.int32)
        d = (np.bincount(row, minlength=len(ids)) - 1).astype(np.int32)
        key = coded.indices.drop_null().to_numpy().astype(np.int64) * len(ids) + row
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        entry = _starts(key)
        term, row = np.divmod(key[entry], len(ids))
        f = np.diff(np.append(entry, len(key))).astype(np.int32)
        group = ids[row] // group_ids
        first = _starts(term, group)
        columns = [coded.dictionary.take(pa.array(term[first])), pa.array(group[first] * group_ids), _list(first, ids[row]), _list(first, d[row]), _list(first, f), _list(entry[first], place)]
        return pa.RecordBatch.from_arrays(columns, ["term", "ids_from", "ids", "ds", "fs", "places"])

    def run(batches: Batches) -> Batches:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= PART_BYTES:
                yield part(pa.Table.from_batches(waiting))
                waiting, size = [], 0
        if sum(map(len, waiting)):
            yield part(pa.Table.from_batches(waiting))

    return run


def _postings(block_ids: int, avgdl: float) -> Callable[[Batches], Batches]:
    """Parts, sorted by term and ids, to postings; only the parts of one term and group of ids wait for a next batch."""

    def whole(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, d, f, places = (rows[c].combine_chunks() for c in ("ids", "ds", "fs", "places"))
        own = np.repeat(np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows)))), ids.value_lengths().to_numpy())
        ids, d, f, places = (x.flatten().to_numpy() for x in (ids, d, f, places))
        # Parts of other tasks may have ids in between.
        order = np.lexsort((ids, own))
        at = (np.cumsum(f) - f)[order]
        own, ids, d, f = own[order], ids[order], d[order].astype(np.int64), f[order].astype(np.int64)
        to = np.cumsum(f) - f
        places = places[np.repeat(at - to, f) + np.arange(len(places))]
        block = ids // block_ids
        first = _starts(own, block)
        entries = pa.StructArray.from_arrays([pa.array(ids), pa.array(d), pa.array(f), _list(to, places)], ["id", "d", "f", "places"])
        term = rows["term"].combine_chunks().take(pa.array(starts[own[first]]))
        top = np.maximum.reduceat(_gain(f, d, avgdl), first)
        return pa.RecordBatch.from_arrays([term, pa.array(block[first]), pa.array(np.diff(np.append(first, len(ids)))), pa.array(top), _list(first, entries)], ["term", "block", "n", "top", "entries"])

    def run(batches: Batches) -> Batches:
        waiting = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if waiting is None else pa.concat_tables([waiting, rows])
            if not len(rows):
                continue
            starts = _starts(rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["ids_from"].to_numpy())
            if len(starts) > 1:
                yield whole(rows.slice(0, starts[-1]), starts[:-1])
            waiting = rows.slice(starts[-1])
        if waiting is not None:
            yield whole(waiting, np.zeros(1, np.int64))

    return run


@dataclass(frozen=True)
class Index:
    """A stored index, opened."""

    postings: DataFrame
    n: int
    avgdl: float

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        corpus = spark.read.parquet(f"{path}/corpus").first()
        return Index(spark.read.parquet(f"{path}/postings"), corpus.n, corpus.avgdl or 1.0)

    def of(self, token: str, prefix: bool = False) -> DataFrame:
        """The postings of a term, or of all that begin with it; the scan reads few other row groups."""
        term = F.col("term")
        return self.postings.where((term >= token) & term.startswith(token) if prefix else term == token)


def _phrase_hits(index: Index, p: Phrase) -> DataFrame:
    """block, id, d, f of all rows with the phrase, from the places of its terms."""
    hits = None
    for j, t in enumerate(p.tokens):
        own = index.of(t, p.prefix and j == len(p.tokens) - 1)
        own = own.select("block", F.explode("entries").alias("e")).select("block", "e.id", "e.d", F.explode("e.places").alias("place"))
        own = own.select("block", "id", "d", (F.col("place") - j).alias("start"))
        hits = own if hits is None else hits.join(own, ["block", "id", "d", "start"], "left_semi")
    return hits.groupBy("block", "id", "d").agg(F.count("*").alias("f"))


@dataclass(frozen=True)
class Ranked:
    """The best rows of an index (id, score), and how many blocks of candidates there were, and were scored."""

    rows: DataFrame
    blocks: int
    scored: int


def best_of_index(index: Index, query: list[Phrase], limit: int, keep: Scratch, allowed: DataFrame | None = None) -> Ranked:
    """The best *limit* rows with all phrases, of *allowed* ids if given; the scores of ``bm25``.

    A block can hold a row no better than the sum of what its phrases are worth there at
    most.  The blocks of the greatest bounds are scored first; of the others only those
    whose bound reaches the score of the last row found so far.  Bounds of single terms
    stand in the postings, whose entries are then read only where they count; phrases and
    prefixes are matched whole, as their rarity is known only then.
    """
    spark = index.postings.sparkSession
    # A row may score a little above its block's bound where sums round differently.
    slack = 1e-9
    hits: list[DataFrame | None] = []
    bounds, rarity = None, []
    for k, p in enumerate(query):
        if len(p.tokens) == 1 and not p.prefix:
            hits.append(None)
            heads = index.of(p.tokens[0]).select("block", "n", "top")
        else:
            hits.append(keep.put(_phrase_hits(index, p), f"hits{k}"))
            heads = hits[k].groupBy("block").agg(F.count("*").alias("n"), F.max(_gain(F.col("f"), F.col("d"), F.lit(index.avgdl))).alias("top"))
        heads = keep.put(heads, f"heads{k}")
        having = heads.agg(F.sum("n")).first()[0] or 0
        rarity.append(_rarity(F.lit(index.n), F.lit(having)))
        own = heads.select("block", (rarity[k] * F.col("top")).alias(f"bound{k}"))
        bounds = own if bounds is None else bounds.join(own, "block")
    bound = reduce(lambda a, b: a + b, [F.col(f"bound{k}") for k in range(len(query))])
    blocks = keep.put(bounds.select("block", bound.alias("bound")), "blocks")

    def scored(some: DataFrame) -> DataFrame:
        numbers = [r.block for r in some.limit(MOST_NUMBERS + 1).collect()]
        near = F.col("block").isin(numbers) if len(numbers) <= MOST_NUMBERS else F.lit(True)
        rows = None
        for k, p in enumerate(query):
            if hits[k] is None:
                own = index.of(p.tokens[0]).where(near).join(some.select("block"), "block", "left_semi").select("block", F.explode("entries").alias("e")).select("block", "e.id", "e.d", F.col("e.f").alias(f"f{k}"))
            else:
                own = hits[k].where(near).join(some.select("block"), "block", "left_semi").withColumnRenamed("f", f"f{k}")
            rows = own if rows is None else rows.join(own, ["block", "id", "d"])
        score = reduce(lambda s, k: s - rarity[k] * _gain(F.col(f"f{k}"), F.col("d"), F.lit(index.avgdl)), range(len(query)), F.lit(0.0))
        rows = rows.select("id", score.alias("score"))
        return (rows if allowed is None else rows.join(allowed.select("id"), "id", "left_semi")).orderBy("score", "id").limit(limit)

    seeds = keep.put(blocks.orderBy(F.desc("bound"), "block").limit(SEED), "seeds")
    first = keep.put(scored(seeds), "first")
    have, last = first.agg(F.count("*"), F.max("score")).first()
    rest = blocks.join(seeds.select("block"), "block", "left_anti")
    total, others = blocks.count(), rest
    if have >= limit:
        others = rest.where(F.col("bound") >= -last - slack)
    others = keep.put(others, "others")
    found = others.count()
    rows = first.unionByName(scored(others)) if found else first
    return Ranked(rows.orderBy("score", "id").limit(limit), total, min(SEED, total) + found)
