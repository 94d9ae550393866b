"""Embedding near-duplicates by NN-descent, exact cosines, and block counts for dense spots.

Equal vectors collapse to one node.  Leaves of random hyperplane trees give every node a
first list of neighbours; then lists improve by joining neighbours of neighbours.  A
list that is full of links is saturated and is enlarged; one that stays saturated at the
largest size stands in a dense spot, and those nodes are compared with all nodes in
blocks, which only return counts and the links that join two components.

Trees are planted until they leave a pair at the threshold apart with a chance of MISS at
most, so links that no list leads to are found as well.  A sample compared with all nodes
audits the recall of the links outside dense spots; where it meets too few of them, likely
ends of links, whose best neighbours are near the threshold, are audited as well.  The
recall goes to the log.  While it is low, fresh trees are planted and the descent goes on;
only where it stays low after ROUNDS of them are all nodes compared in blocks.

Defined results: null, empty or zero vectors, and vectors that hold null or non-finite
components, link with nothing; vectors of different lengths never link; equal vectors
and rows that repeat a vec_id are vectors of their own and link if their cosine says so;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.components import components
from cairn.llm.store import Store, columns

K, K_MOST = 10, 40
#: Trees of a batch, vectors of a leaf, and the chance that no tree holds a pair at the threshold in one leaf.
TREES, LEAF, MISS = 3, 512, 1e-4
ROUNDS, STILL = 8, 0.01
#: Vectors of the audit: more are drawn while they have fewer links.  The recall it asks for, and vectors in a
#: block of the exact comparison.
AUDITS, LINKS, RECALL, BLOCK = (256, 2048, 8192), 300, 0.99, 4096
log = logging.getLogger(__name__)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, dim, unit = [], [], []
        for v in b.column("embedding").to_pylist():
            x = None if v is None or not v or any(c is None for c in v) else np.array(v, np.float64)
            if x is not None and np.isfinite(x).all() and (big := np.abs(x).max()) > 0:
                node.append(int.from_bytes(hashlib.blake2b((x + 0.0).tobytes(), digest_size=8).digest(), "little", signed=True))
                x = x / big
                unit.append(x / np.sqrt(x @ x))
                dim.append(len(x))
            else:
                node.append(None), unit.append(None), dim.append(None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(node, pa.int64()), pa.array(dim, pa.int32()), pa.array(unit, pa.list_(pa.float64()))], ["vec_id", "node", "dim", "vec"])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batches(bits: int, threshold: float) -> int:
    """Batches of trees that leave a pair at the threshold apart with probability MISS at most."""
    together = (1 - np.arccos(min(threshold, 1.0)) / np.pi) ** bits
    return 1 if together > 1 - MISS else int(np.ceil(np.log(MISS) / np.log1p(-together) / TREES))


def _leaves(dim: int, bits: int, batch: int):
    planes = np.random.default_rng(11 + batch).standard_normal((TREES, dim, max(bits, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("vec"))
                codes = [((m @ planes[t] > 0) @ (1 << np.arange(planes.shape[2]))) * (bits > 0) for t in range(TREES)]
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(np.stack(codes, 1).astype(np.int64).tolist(), pa.list_(pa.int64())), b.column("vec")], ["node", "codes", "vec"])

    return run


def _in_leaf(table: pa.Table, least: float) -> pa.Table:
    ids, m = table.column("node").to_numpy(), _matrix(table.column("vec"))
    u, v, s = [], [], []
    if len(ids) > 1:
        k = min(K, len(ids) - 1)
        for a in range(0, len(ids), 512):
            sims = m[a : a + 512] @ m.T
            sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(sims, near, 1).ravel()
            good = best >= least
            u.append(np.repeat(ids[a : a + 512], k)[good]), v.append(ids[near].ravel()[good]), s.append(best[good])
    return pa.table({"u": np.concatenate(u or [np.zeros(0, np.int64)]), "v": np.concatenate(v or [np.zeros(0, np.int64)]), "sim": np.concatenate(s or [np.zeros(0)])})


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot: pairs of its members, one of them new, that improve a member's list."""
    held: list[pa.RecordBatch] = []

    def pairs(t: pa.Table) -> pa.RecordBatch:
        p, ids, new, worst = (t.column(c).to_numpy() for c in ("p", "m", "new", "worst"))
        m, u, v, s = _matrix(t.column("vec")), [], [], []
        edges = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1, [len(p)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1 and new[a:b].any():
                sims = m[a:b] @ m[a:b].T
                good = (sims > worst[a:b, None]) & (new[a:b, None] | new[None, a:b])
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                u.append(ids[a + i]), v.append(ids[a + j]), s.append(sims[i, j])
        empty = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u or empty)), pa.array(np.concatenate(v or empty)), pa.array(np.concatenate(s or [np.zeros(0)]))], ["u", "v", "sim"])

    rows = 0
    for b in batches:
        p = b.column("p").to_numpy()
        # Rows up to the last change of pivot are whole groups.
        change = np.flatnonzero(p[1:] != p[:-1])
        cut = int(change[-1]) + 1 if len(change) else 0
        if not cut and held and len(p) and held[-1].column("p")[-1].as_py() != p[0] and rows >= 2048:
            yield pairs(pa.Table.from_batches(held))
            held, rows = [b], b.num_rows
        elif cut and rows + cut >= 2048:
            yield pairs(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held, rows = [b.slice(cut)], b.num_rows - cut
        elif b.num_rows:
            held.append(b)
            rows += b.num_rows
    if held:
        yield pairs(pa.Table.from_batches(held))


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors(vec_id, embedding)``."""
    store = Store(spark, "vectors")
    raw = columns(vectors, vec_id="long", embedding="array<double>")
    rows = store.put(raw.mapInArrow(_unit, "vec_id long, node long, dim int, vec array<double>"), "unit")
    # Equal vectors are one node, whose vector any of its rows has.
    nodes = store.put(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("times"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "nodes")
    counts, edges = None, None
    for dim, n in sorted(tuple(r) for r in nodes.groupBy("dim").count().collect()):
        c, e = _descend(store, nodes.where(F.col("dim") == dim).select("node", "times", "vec"), dim, n, threshold)
        counts, edges = (c, e) if counts is None else (counts.unionByName(c), edges.unionByName(e))
    if counts is None:
        return raw.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    comp = store.put(components(store, edges), "comp")
    ids = rows.select("vec_id", "node")
    linked = ids.join(counts, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = linked.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("low"))
    out = linked.join(low, "component", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _top(found: DataFrame, caps: DataFrame | None) -> DataFrame:
    """The best of each list, once each: u, v, sim, new."""
    once = found.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v")))
    if caps is None:
        return ranked.where(F.col("r") <= K).drop("r")
    return ranked.where(F.col("r") <= K_MOST).join(caps, "u", "left").where(F.col("r") <= F.coalesce("cap", F.lit(K))).drop("r", "cap")


def _descend(store: Store, nodes: DataFrame, dim: int, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) of all nodes and edges(u, v) that join what exact links join."""
    true = _audit(nodes, n, threshold)
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    # The first trees give every node a list; the others, as many as the planes ask for, only links.
    batches = _batches(bits, threshold)
    found = [_planted(store, nodes, dim, bits, b, threshold if b else -2.0) for b in range(batches)]
    lists = store.put(_top(reduce(DataFrame.unionByName, found).withColumn("new", F.lit(True)), None), "lists")
    store.drop(*found)
    caps: DataFrame | None = None
    for turn in range(ROUNDS):
        lists, caps, changed = _round(store, nodes, lists, caps, threshold)
        if changed > STILL * n * K and turn + 1 < ROUNDS:
            continue
        recall = _recall(true, lists, caps, threshold) if true else 0.0
        if not recall:
            # Too few links were drawn to judge by: ask where links are likely.
            found, wanted = _share((true or {}) | _likely(nodes, lists, n, threshold), lists, caps, threshold)
            recall = found / wanted if wanted else 1.0
        log.info("recall %.4f of audited links outside dense spots, %d vectors, round %d", recall, n, turn + 1)
        if recall >= RECALL:
            break
        # The lists have come to rest without some links: other leaves lead to them.
        more = _planted(store, nodes, dim, bits, batches + turn, threshold)
        planted = store.put(_top(lists.unionByName(more.withColumn("new", F.lit(True))), caps), "lists")
        store.drop(lists, more)
        lists = planted
    else:
        # The audit was never content: every node is compared with all.
        return _finish(store, nodes, lists, nodes.select("node"), n, threshold)
    return _finish(store, nodes, lists, _saturated(lists, caps, threshold), n, threshold)


def _planted(store: Store, nodes: DataFrame, dim: int, bits: int, batch: int, least: float) -> DataFrame:
    """The nearest within the leaves of a batch of trees, from a cosine of *least* on."""
    coded = nodes.select("node", "vec").mapInArrow(_leaves(dim, bits, batch), "node long, codes array<long>, vec array<double>").select("node", "vec", F.posexplode("codes").alias("tree", "code"))
    # Dense leaves are dealt to several groups of bounded size; the descent finds what lies across.
    full = coded.groupBy("tree", "code").count().select("tree", "code", F.ceil(F.col("count") / (2 * LEAF)).alias("parts"))
    dealt = coded.join(full, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))
    return store.put(dealt.groupBy("tree", "code", "part").applyInArrow(lambda t: _in_leaf(t, least), "u long, v long, sim double"), "leaves")


def _round(store: Store, nodes: DataFrame, lists: DataFrame, caps: DataFrame | None, threshold: float) -> tuple[DataFrame, DataFrame, int]:
    ends = lists.groupBy("u").agg(F.count("*").alias("c"), F.min("sim").alias("low"))
    cap = F.lit(K) if caps is None else F.coalesce("cap", F.lit(K))
    ends = ends if caps is None else ends.join(caps, "u", "left")
    # A list full of links is saturated: twice the room.
    sized = ends.select("u", "low", "c", F.when((F.col("c") >= cap) & (F.col("low") >= threshold), F.least(cap * 2, F.lit(K_MOST))).otherwise(cap).alias("cap"))
    sized = store.put(sized, "sizes")
    caps = sized.where(F.col("cap") > K).select("u", "cap")
    worst = sized.select(F.col("u").alias("m"), F.when(F.col("c") < F.col("cap"), F.lit(-2.0)).otherwise(F.col("low")).alias("worst"))
    ahead = lists.select(F.col("u").alias("p"), F.col("v").alias("m"), "new")
    back = lists.select(F.col("v").alias("p"), F.col("u").alias("m"), "new").withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("new"), F.xxhash64("m", "p"))))
    # Entries beyond the reverse neighbours of this round stay new and come up in a later one.
    back = store.put(back, "back")
    cut = back.where((F.col("r") > K) & F.col("new")).select(F.col("m").alias("u"), F.col("p").alias("v"), F.lit(True).alias("waits"))
    back = back.where(F.col("r") <= K).drop("r")
    members = ahead.unionByName(back).groupBy("p", "m").agg(F.max("new").alias("new"))
    members = members.join(nodes.select(F.col("node").alias("m"), "vec").join(worst, "m", "left"), "m").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))
    found = members.repartition("p").sortWithinPartitions("p").mapInArrow(_local_join, "u long, v long, sim double").withColumn("new", F.lit(True))
    kept = lists.join(cut, ["u", "v"], "left").select("u", "v", "sim", F.coalesce("waits", F.lit(False)).alias("new"))
    after = store.put(_top(kept.unionByName(found), caps), "lists")
    store.drop(lists)
    return after, caps, after.where("new").count()


def _both(lists: DataFrame, threshold: float) -> DataFrame:
    near = lists.where(F.col("sim") >= threshold).select("u", "v")
    return near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def _saturated(lists: DataFrame, caps: DataFrame, threshold: float) -> DataFrame:
    """Nodes whose lists, whatever their room, are full of links."""
    ends = lists.groupBy("u").agg(F.count("*").alias("c"), F.min("sim").alias("low")).join(caps, "u", "left")
    return ends.where((F.col("c") >= F.coalesce("cap", F.lit(K))) & (F.col("low") >= threshold)).select(F.col("u").alias("node"))


def _counted(nodes: DataFrame, tried: DataFrame, threshold: float) -> dict[int, int]:
    """Links of a bounded sample of vectors, by a full comparison."""
    rows = tried.select("node", "vec").toArrow()
    if not rows.num_rows:
        return {}
    ids, m = rows.column("node").to_numpy(), _matrix(rows.column("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                total += ((m @ _matrix(b.column("vec")).T >= threshold) & (ids[:, None] != b.column("node").to_numpy()[None])).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["u", "c"])

    return {r.u: r.c for r in nodes.select("node", "vec").mapInArrow(run, "u long, c long").groupBy("u").agg(F.sum("c").alias("c")).collect()}


def _drawn(nodes: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """About *size* vectors, twice as many at most, by a hash."""
    return nodes.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, n // size))) == 0).limit(2 * size)


def _audit(nodes: DataFrame, n: int, threshold: float) -> dict[int, int] | None:
    """Links of a sample, by a full comparison; None if the largest sample has too few of them."""
    for size in AUDITS:
        true = _counted(nodes, _drawn(nodes, n, size, 5), threshold)
        if sum(true.values()) >= LINKS:
            return true
        if size >= n:
            break
    return None


def _likely(nodes: DataFrame, lists: DataFrame, n: int, threshold: float) -> dict[int, int]:
    """Links of vectors whose best neighbours are nearest to the threshold, and of as many others."""
    best = lists.groupBy("u").agg(F.max("sim").alias("sim")).orderBy(F.abs(F.col("sim") - threshold), "u").limit(AUDITS[1])
    ends = nodes.join(best.select(F.col("u").alias("node")), "node", "left_semi").select("node", "vec")
    return _counted(nodes, ends, threshold) | _counted(nodes, _drawn(nodes, n, AUDITS[1], 7), threshold)


def _share(true: dict[int, int], lists: DataFrame, caps: DataFrame, threshold: float) -> tuple[int, int]:
    """Of the audited links, those that lists hold, and all; saturated vectors are compared exactly anyway."""
    ids = lists.sparkSession.createDataFrame([(int(i),) for i in true], "u long")
    spared = {r.node for r in _saturated(lists, caps, threshold).join(ids.withColumnRenamed("u", "node"), "node", "left_semi").collect()}
    have = {r.u: r["count"] for r in _both(lists, threshold).join(ids, "u", "left_semi").groupBy("u").count().collect()}
    left = {u: c for u, c in true.items() if u not in spared}
    return sum(min(c, have.get(u, 0)) for u, c in left.items()), sum(left.values())


def _recall(true: dict[int, int], lists: DataFrame, caps: DataFrame, threshold: float) -> float:
    """The share of the audited links that lists hold; 0 if too few are left to judge by."""
    found, wanted = _share(true, lists, caps, threshold)
    return found / wanted if wanted >= LINKS else 0.0


def _finish(store: Store, nodes: DataFrame, lists: DataFrame, unproven: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Link counts and edges from the lists, and for *unproven* nodes from a comparison with all."""
    edges = store.put(_both(lists, threshold), "edges")
    dense = store.put(unproven, "dense")
    n_dense = dense.count()
    times = nodes.select(F.col("node").alias("v"), "times")
    own = nodes.select("node", (F.col("times") - 1).alias("own"))
    counted = edges.join(times, "v").groupBy("u").agg(F.sum("times").alias("others")).withColumnRenamed("u", "node")
    if n_dense:
        comp = store.put(components(store, edges), "comp")
        tagged = store.put(nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")), "tagged")
        n_r, n_q = -(-n // BLOCK), -(-n_dense // BLOCK)
        q = tagged.join(dense, "node", "left_semi").withColumn("qb", F.pmod(F.xxhash64("node"), F.lit(n_q))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_r - 1).cast("long"))))
        r = tagged.withColumn("rb", F.pmod(F.xxhash64("node"), F.lit(n_r))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
        r = r.toDF(*r.columns)  # columns of its own: both sides come from one table
        blocks = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(lambda a, b: _block(a, b, threshold), "u long, v long, c long")
        blocks = store.put(blocks, "blocks")
        exact = blocks.where("v is null").groupBy("u").agg(F.sum("c").alias("others")).withColumnRenamed("u", "node")
        counted = counted.join(dense, "node", "left_anti").unionByName(exact)
        edges = edges.unionByName(blocks.where("v is not null").select("u", "v"))
    counts = own.join(counted, "node", "left").select("node", (F.col("own") + F.coalesce("others", F.lit(0))).alias("n_links"))
    return counts, edges


def _block(q: pa.Table, r: pa.Table, threshold: float) -> pa.Table:
    """Link counts of one block's vectors with another's, and one link for each two components that meet."""
    out_u, out_v, out_c = [], [], []
    if q.num_rows and r.num_rows:
        ids, m, own = q.column("node").to_numpy(), _matrix(q.column("vec")), q.column("component").to_numpy()
        rid, rm, times, other = r.column("node").to_numpy(), _matrix(r.column("vec")), r.column("times").to_numpy(), r.column("component").to_numpy()
        met = set()
        for a in range(0, len(ids), 512):
            near = m[a : a + 512] @ rm.T >= threshold
            near &= ids[a : a + 512, None] != rid[None]
            out_u += ids[a : a + 512].tolist()
            out_v += [None] * len(near)
            out_c += (near @ times).tolist()
            i, j = np.nonzero(near & (own[a : a + 512, None] != other[None]))
            for x, y in zip((i + a).tolist(), j.tolist(), strict=True):
                pair = (own[x], other[y])
                if pair not in met:
                    met.add(pair)
                    out_u.append(int(ids[x])), out_v.append(int(rid[y])), out_c.append(0)
    return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64()), "c": pa.array(out_c, pa.int64())})
