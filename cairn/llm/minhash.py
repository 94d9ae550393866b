"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard on full sets.

A document's set holds its distinct *k*-word shingles, as 64-bit hashes.  Two
permutations give the whole signature.  The first, a mixing of the shingle's bits, places
it on a circle of 2**64 places.  The second ranks places: by a table for the place's top
bits, then by the rest.  It is shifted by one step of the top bits for each coordinate,
so the coordinates of a shingle are one contiguous slice of the table, and a signature is
a column-wise minimum of slices.  A coordinate is the shingle found there, so sets of any
size agree only where they share it.  Equal bands propose candidates; a link needs
``100 * |A & B| >= threshold * |A | B|`` on the full sets.

Scale: equal sets collapse first; a bucket never gives all its pairs.  Each member is
compared with one bucket leader, the one that most of its buckets have, and components
join what was linked.  Buckets that still span several components are cut into cells of
bounded size, in which members outside the bucket's largest component meet the members
of other components on full sets; of these only links leave a task.  A few outsiders cost a
copy of each other member, however large the bucket.

Defined results: null and empty texts, or texts without words, have an empty set, link
with nothing and stay; rows that repeat a doc_id count as one document that holds all
their texts; a row without doc_id has no component and stays; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import textvec as tv
from cairn.llm.components import components
from cairn.llm.store import Store, columns

CIRCLE_BITS = 18
BANDS, ROWS = 40, 6  # misses a pair at 0.8 with probability (1 - 0.8**6)**40, about 5e-6
#: Shingles and members of one side of a cell; a bucket with more is cut into several.
CELL, MEMBERS = 1 << 20, 4096
_circle: list[np.ndarray] = []


def circle() -> tuple[np.ndarray, np.ndarray]:
    """All slices of the second permutation's table, row p with coordinates 0.. of place p; and its inverse."""
    if not _circle:
        perm = np.random.default_rng(20240611).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        k = BANDS * ROWS
        _circle.extend([np.lib.stride_tricks.sliding_window_view(np.concatenate([perm, perm[:k]]), k), np.argsort(perm)])
    return _circle[0], _circle[1]


def signature(members: np.ndarray) -> np.ndarray:
    """For each coordinate, the member of the sorted set that the shifted second permutation ranks lowest."""
    place = (members >> tv.U(64 - CIRCLE_BITS)).astype(np.int64)
    # Of members that share their top bits, the one with the lowest rest comes first in every coordinate.
    first = np.flatnonzero(np.diff(place, prepend=-1))
    place = place[first]
    (slices, inverse), out = circle(), None
    for i in range(0, len(place), 256):
        low = slices[place[i : i + 256]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    at = (inverse[out] - np.arange(BANDS * ROWS)) & ((1 << CIRCLE_BITS) - 1)
    return members[first[np.searchsorted(place, at)]]


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=tv.U) * tv.U(0xA24BAED4963EE407)
    for j in range(ROWS):
        key = tv.mix(key + parts[:, j])
    return key.view(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    data, offsets = tv.buffers(batch.column("text"))
    hashes, at = tv.word_hashes(data, offsets, tv.NOT_SPACE, tv.ASCII_LOWER)
    for i in range(batch.num_rows):
        yield tv.shingles(hashes[at[i] : at[i + 1]], k)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, bands = [], [], []
            for s in _sets(b, k):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "bands"])

    return run


def _full(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in _sets(b, k)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["node", "members"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: the class of every row of ``docs(doc_id, text)``."""
    store = Store(spark, "minhash")
    docs = columns(docs, doc_id="long", text="string")
    signed = store.put(docs.mapInArrow(_sign(k), "doc_id long, n_shingles long, key binary, bands array<long>"), "signed")
    # One node for each distinct set, named by the smallest doc_id that has it.
    known = signed.where("key is not null and doc_id is not null")
    classes = store.put(known.groupBy("key").agg(F.min("doc_id").alias("node")), "classes")
    named = signed.select("doc_id", "n_shingles", "key").join(classes, "key", "left")
    again = named.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("doc_id", "v")
    same_id = named.join(again, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    first = known.join(classes, "key").where("doc_id = node").select("node", F.col("n_shingles").alias("n"), "bands")
    comp = store.put(components(store, _links(store, docs, first, k, threshold).unionByName(same_id)), "comp")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    out = named.join(comp, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _links(store: Store, docs: DataFrame, first: DataFrame, k: int, threshold: int) -> DataFrame:
    """links(u, v) between nodes of first(node, n, bands); they connect every two nodes that exact links connect."""
    rows = first.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("n", "node").alias("m")).where("low <> high")
    active = store.put(rows.join(shared.select("bucket", "low", "m"), "bucket"), "buckets")
    candidates = active.select(F.col("node").alias("doc_id")).distinct()
    # Bucketed by node: comparisons move their few rows to the sets.
    sets = store.put_bucketed(docs.join(candidates, "doc_id", "left_semi").mapInArrow(_full(k), "node long, members array<long>"), "sets", "node")

    # Each node and the leader that most of its buckets have, of leaders of a size that can link.
    near = (F.col("n") * 100 >= F.col("m") * threshold) & (F.col("m") * 100 >= F.col("n") * threshold)
    met = active.where(near & (F.col("node") != F.col("low"))).groupBy(F.col("node").alias("v"))
    pairs = store.put(met.agg(F.mode("low", True).alias("u"), F.max("n").alias("n")), "pairs")
    found = store.put(_verified(pairs, sets, threshold), "links")

    # Buckets that still span several components: members outside the largest one meet all others.
    comp = store.put(components(store, found), "comp")
    tagged = active.join(comp, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("c"))
    cells = _placed(tagged).select(F.xxhash64("bucket", "x.i", "x.j").alias("cell"), "node", "c", "x.asks", "x.told").join(sets, "node")
    met = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(threshold), "u long, v long")
    links = store.put(found.unionByName(met.distinct()), "links")
    store.drop(sets, active, comp, found)
    return links


def _placed(tagged: DataFrame) -> DataFrame:
    """bucket, node, c, x(i, j, asks, told): the cells of tagged(bucket, node, n, c) in which members of buckets of several components meet.

    Members outside a bucket's largest component ask, all are told.  Askers are cut into
    groups and told members into parts of bounded size, by size and apart: cell (i, j) holds
    group i and part j.  So a told member is copied once for each group of askers.
    """
    sizes = tagged.groupBy("bucket", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    spans = sizes.groupBy("bucket").agg(F.max(F.struct("rows", "c", "total")).alias("x"), F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("total").alias("total")).where("parts > 1")
    pieces = lambda rows, total: F.greatest(F.ceil(total / CELL), F.ceil(rows / MEMBERS))
    groups = pieces(F.col("rows") - F.col("x.rows"), F.col("total") - F.col("x.total")).alias("groups")
    spans = spans.select("bucket", F.col("x.c").alias("main"), pieces(F.col("rows"), F.col("total")).alias("cut"), groups)
    open_ = tagged.join(spans, "bucket").withColumn("p", F.pmod(F.xxhash64("node"), F.col("cut"))).withColumn("g", F.pmod(F.xxhash64("node", F.lit(2)), F.col("groups")))
    outside, upto = F.col("c") != F.col("main"), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda i, j, asks, told: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), told.alias("told"))
    told = F.transform(upto(F.col("groups")), lambda x: place(x, F.col("p"), outside & (x == F.col("g")), F.lit(True)))
    asks = F.transform(F.filter(upto(F.col("cut")), lambda x: x != F.col("p")), lambda x: place(F.col("g"), x, F.lit(True), F.lit(False)))
    asks = F.when(outside, asks).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,asks:boolean,told:boolean>>"))
    return open_.select("bucket", "node", "c", F.explode(F.concat(told, asks)).alias("x"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """pairs(u, v, n), one u for many v: the links(u, v) among them, by their full sets."""
    # A leader that very many have is copied to several tasks.
    split = pairs.groupBy("u").agg(F.ceil(F.sum("n") / (4 * CELL)).alias("parts"))
    lead = split.join(sets, split.u == sets.node).select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("members").alias("a"))
    own = pairs.join(split, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("part")).join(sets.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    both = own.join(lead, ["u", "part"]).withColumn("i", F.size(F.array_intersect("a", "b")).cast("long"))
    return both.where(100 * F.col("i") >= threshold * (F.size("a") + F.size("b") - F.col("i"))).select("u", "v").distinct()


def _cells(threshold: int):
    """Rows sorted by cell: in each, links between members that ask and members of other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cell = t.column("cell").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]])
            node, comp, asks, told = (t.column(c).to_numpy(zero_copy_only=False) for c in ("node", "c", "asks", "told"))
            lists = t.column("members").combine_chunks()
            at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                x, y = meet(flat[at[a] : at[b]], at[a : b + 1] - at[a], comp[a:b], asks[a:b], told[a:b], threshold)
                u.append(node[a:b][x]), v.append(node[a:b][y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            # Whole cells are those before the batch's last one.
            cell = b.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))
            if not cut and held and held[-1].column("cell")[-1].as_py() != cell[0]:
                yield from out(pa.Table.from_batches(held))
                held = [b]
            elif cut:
                yield from out(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = [b.slice(cut)]
            else:
                held.append(b)
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def meet(flat: np.ndarray, at: np.ndarray, comp: np.ndarray, asks: np.ndarray, told: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(asking, told) members of different components whose sets link: one of each component for each that asks.

    Overlaps are a matrix product for the shingles that many members have, and counts over
    the lists of members for all others.
    """
    n = np.diff(at)
    m, out = len(n), ([], [])
    row = np.repeat(np.arange(m), n)
    _, key, count = np.unique(flat, return_inverse=True, return_counts=True)
    meets = count[key] > 1
    row, key = row[meets], key[meets]
    often = count > max(16, m // 8)
    column = np.cumsum(often) - 1
    dense = np.zeros((m, int(often.sum())), np.float32)
    many = often[key]
    dense[row[many], column[key[many]]] = 1
    row, key = row[~many], key[~many]
    order = np.argsort(key, kind="stable")
    lists, first = row[order], np.searchsorted(key[order], np.arange(len(count) + 1))
    begins = np.searchsorted(row, np.arange(m + 1))
    work = np.concatenate([[0], np.cumsum((first[key + 1] - first[key]))])[begins]
    who = np.flatnonzero(asks)
    a = 0
    while a < len(who):
        # As many askers as a bounded table and bounded lists allow.
        b = a + 1
        while b < len(who) and b - a < max(1, (1 << 21) // m) and work[who[b] + 1] - work[who[a]] < 1 << 21:
            b += 1
        part = who[a:b]
        overlap = (dense[part] @ dense.T).astype(np.int64)
        for r, x in enumerate(part) if len(key) else ():
            own = key[begins[x] : begins[x + 1]]
            size = first[own + 1] - first[own]
            if len(own):
                to = np.cumsum(size)
                overlap[r] += np.bincount(lists[np.repeat(first[own] - (to - size), size) + np.arange(to[-1])], minlength=m)
        link = (100 * overlap >= threshold * (n[part, None] + n[None] - overlap)) & (comp[part, None] != comp[None]) & told[None]
        i, j = np.nonzero(link)
        if len(i):
            _, one = np.unique(np.stack([i, comp[j]]), axis=1, return_index=True)
            out[0].append(part[i[one]]), out[1].append(j[one])
        a = b
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out[0]]), np.concatenate([none, *out[1]])
