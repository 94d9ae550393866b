"""Source divergence audit: how differently the sources of a language use its terms.

Terms are read at byte level: a lookup table over the concatenated UTF-8 buffers of many
texts marks the bytes of terms and lowers A-Z, and the marks' edges are the boundaries.
xxhash groups equal slices; every slice is compared byte by byte with its group's first,
and slices that differ from it get groups by their bytes.  Spark adds the counts up.  A
language keeps the terms of at least *min_docs* of its documents, and every (language,
source) gives each kept term p = 1 + floor(SCALE * (count + 5) / (total + 5 * kept)).
The divergence of two sources is the sum of abs(p - q) over all kept terms.  It is added
up over blocks of terms: a block's counts are one CSR matrix (sources by terms), a row is
spread out, and one ``reduceat`` gives its differences to all other rows.  All numbers are
integers; quotients are taken of decimals.

Scale: shuffled are counts, added up before.  A block holds about BLOCK of them, or as many
as there are pairs of sources, so that sums never outnumber counts; a task compares TILE
sources of a block with all others.  The number of pairs is the result's own.

Defined results: null text, language and source read as empty; every row is a document,
also where a doc_id repeats; a source without kept terms has p of count 0 for each; a
language without kept terms has divergences 0; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.store import Store, columns

SCALE, SMOOTH = 1_000_000_000, 5
#: Bytes of text tokenized at once, least counts of a block of terms, rows of a tile of sources.
CHUNK, BLOCK, TILE = 8 << 20, 1 << 15, 256
#: Bytes of terms: letters, and every byte of a non-ASCII character.
TERM = np.zeros(256, bool)
for _lo, _hi in ((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    TERM[_lo : _hi + 1] = True


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all terms in *data*; none crosses one of *offsets*."""
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """For each slice the number of its bytes' group, and the groups' bytes."""
    raw = data.tobytes()
    hashes = np.fromiter((digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    names = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
    # Every slice against its group's first: lengths, then bytes.
    lead, length = first[ids], ends - starts
    differs = length != length[lead]
    alike = np.flatnonzero(~differs & (lead != np.arange(len(starts))))
    if len(alike):
        size = length[alike]
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(starts[alike] - begin, size)
        unequal = data[at] != data[at + np.repeat(starts[lead[alike]] - starts[alike], size)]
        differs[alike] = np.logical_or.reduceat(unequal, begin)
    other: dict[bytes, int] = {}
    for i in np.flatnonzero(differs):
        term = raw[starts[i] : ends[i]]
        ids[i] = other.setdefault(term, len(names))
        if ids[i] == len(names):
            names.append(term)
    return ids, names


def _count(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    data, offsets = tv.buffers(table.column("text"))
    starts, ends = slices(data, offsets)
    folded = tv.ASCII_LOWER[data]
    ids, names = grouped(folded, starts, ends)
    langs, sources = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    pairs, of_row = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
    row = np.searchsorted(offsets, starts, side="right") - 1
    width = max(len(names), 1)
    # Per row and term, then per (language, source) and term.
    cells, n = np.unique(row * width + ids, return_counts=True)
    keys, at, docs = np.unique(of_row[cells // width] * width + cells % width, return_inverse=True, return_counts=True)
    total = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
    # A row without term for each (language, source), with its documents.
    group = np.append(keys // width, np.arange(len(pairs)))
    term = pa.array([*names, b""], pa.binary()).cast(pa.string()).take(pa.array(np.append(keys % width, np.full(len(pairs), len(names)))))
    lang = langs.dictionary.take(pa.array(pairs[group] // len(sources.dictionary)))
    source = sources.dictionary.take(pa.array(pairs[group] % len(sources.dictionary)))
    n, docs = np.append(total, np.zeros(len(pairs), np.int64)), np.append(docs, np.bincount(of_row, minlength=len(pairs)))
    return pa.RecordBatch.from_arrays([lang, source, term, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield _count(held)
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield _count(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents) of ``docs(lang, source, text)``; the empty term counts a group's documents."""
    texts = columns(docs, lang="string", source="string", text="string").na.fill("")
    parts = texts.mapInArrow(_tokenize, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column | str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kept)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(19,0))) div cast({total} + {SMOOTH} * {kept} as decimal(19,0))")


def pair_sums(row: np.ndarray, col: np.ndarray, p: np.ndarray, zero: np.ndarray, of: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum of abs(p[a] - p[b]) over all columns) for a of *of* and every row b > a of a CSR matrix.

    *row*, *col*, *p* are its entries, every column has one; *zero* is each row's value elsewhere.
    """
    order = np.argsort(row, kind="stable")
    row, col, p = row[order], col[order], p[order]
    width = int(col.max()) + 1 if len(col) else 0
    pointer = np.searchsorted(row, np.arange(len(zero) + 1))
    filled = np.flatnonzero(np.diff(pointer))
    rest, out = zero[row], []
    for a in of:
        mine, own = col[pointer[a] : pointer[a + 1]], p[pointer[a] : pointer[a + 1]]
        spread = np.full(width, zero[a])
        spread[mine] = own
        # Over all columns as if each other row had its zero value everywhere ...
        ranked = np.sort(own)
        upto = np.append(0, np.cumsum(ranked))
        below = np.searchsorted(ranked, zero)
        sums = (width - len(own)) * np.abs(zero - zero[a]) + zero * (2 * below - len(own)) + upto[-1] - 2 * upto[below]
        # ... and what its entries change.
        if len(filled):
            at = spread[col]
            sums[filled] += np.add.reduceat(np.abs(p - at) - np.abs(rest - at), pointer[filled])
        out.append(sums[a + 1 :])
    a = np.repeat(np.asarray(of), [len(s) for s in out])
    b = np.concatenate([np.arange(i + 1, len(zero)) for i in of]) if len(of) else a
    return a, b, np.concatenate(out) if out else a


def _block(cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block of terms, of one tile of sources with all."""
    sources = sources.sort_values("sid")
    sid, zero = sources["sid"].to_numpy(), sources["zero"].to_numpy()
    col = pd.factorize(cells["term"])[0]
    tile = int(sources["tile"].iloc[0])
    mine = np.flatnonzero(sid // TILE == tile)
    of = range(int(mine[0]), int(mine[-1]) + 1)
    a, b, value = pair_sums(np.searchsorted(sid, cells["sid"].to_numpy()), col, cells["p"].to_numpy(), zero, of)
    return pd.DataFrame({"lang": sources["lang"].iloc[0], "a": sid[a], "b": sid[b], "value": value})


def audit(spark: SparkSession, docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: each source's divergence from every other of its language, and its *top* overused terms."""
    store = Store(spark, "divergence")
    counts = store.put(term_counts(docs), "counts")
    terms = counts.where("term <> ''")
    kept = store.put(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n"), "kept")
    cells = store.put(terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("sid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = store.put(groups.withColumn("zero", F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(0)), "groups")
    scored = cells.join(groups.select("lang", "source", "sid", "total", "kept", "lang_total"), ["lang", "source"])
    scored = store.put(scored.select("lang", "source", "sid", "term", _share("n", "total", "kept").alias("p"), _share("lang_n", "lang_total", "kept").alias("q")), "scored")
    store.drop(counts, kept, cells)

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = scored.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    entries, widest = scored.count(), groups.agg(F.max("sid")).first()[0] or 0
    blocks, tiles = 1 + entries // max(BLOCK, widest * widest), 1 + widest // TILE
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = scored.select("lang", "sid", "term", "p", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    in_tile = groups.groupBy("lang").agg(F.max("sid").alias("last")).select("lang", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / TILE).cast("int"))).alias("tile"))
    right = groups.select("lang", "sid", "zero", block).join(in_tile, "lang")
    left = left.join(in_tile, ["lang", "tile"], "left_semi")
    key = ["lang", "block", "tile"]
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_block, "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other")), F.struct(F.col("b").alias("sid"), F.col("a").alias("other")))).alias("pair"), "value")
    name = groups.select("lang", "sid", "source")
    both = both.select("lang", "pair.sid", "pair.other", "value").join(name, ["lang", "sid"])
    both = both.join(name.select("lang", F.col("sid").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return both.unionByName(over)
