"""Embedding similarity: nearest, near-duplicates and outliers by cosine.

Vectors are normalised once.  Pairs are found in blocks: each task holds two blocks and
multiplies them, and only pairs or maxima leave it.  For near-duplicates and outliers the
blocks are rings around pivots, and the triangle inequality leaves out those that are too
far from a vector.  There a task holds two groups of blocks, so that a vector is copied
once a group and not once a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.scratch import Scratch

BLOCK = 2048
F32_MIN = float(np.finfo(np.float32).min)


def unit(v: Column) -> Column:
    """The vector over its norm; zero or non-finite norms give zeros."""
    x = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    scale = F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), norm)
    # The lambda over one struct binds the norm, which is thus computed once a vector.
    return F.get(F.transform(F.array(F.struct(x.alias("x"), scale.alias("n"))), lambda s: F.transform(s["x"], lambda e: F.coalesce(e / s["n"], F.lit(0.0)))), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    """Score of two unit vectors; different or zero lengths give the least score."""
    same = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)).otherwise(F.lit(F32_MIN))


def nearest(vectors: DataFrame, path: str, limit: int) -> DataFrame:
    """logical_path and score of the best others; empty if the path has no vector."""
    me = vectors.where(F.col("logical_path") == path).select(F.col("script_id").alias("me"), unit(F.col("embedding")).alias("mine")).limit(1)
    rows = vectors.select("script_id", "logical_path", unit(F.col("embedding")).alias("own"))
    scored = rows.crossJoin(F.broadcast(me)).where("script_id <> me")  # one row
    return scored.select("script_id", "logical_path", dot(F.col("own"), F.col("mine")).alias("score")).orderBy(F.desc("score"), "script_id").limit(limit).select("logical_path", "score")


def similar(scripts: DataFrame, vectors: DataFrame, path: str, limit: int) -> DataFrame:
    """As nearest, without scripts that are no longer in the catalog (left out before the limit)."""
    keep = scripts.select("logical_path")
    return nearest(vectors.join(keep, "logical_path", "left_semi"), path, limit)


def nearest_of(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """of, logical_path, score, place: the best others of every vector of *queries*, by blocks of both."""
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if a.num_rows and b.num_rows:
            s, ia, ib = _scores(a, b), a.column("script_id").to_numpy(), b.column("script_id").to_numpy()
            s[ia[:, None] == ib[None]] = -np.inf
            of, path = a.column("logical_path").to_pylist(), b.column("logical_path").to_pylist()
            for x in range(len(ia)):
                for y in np.lexsort((ib, -s[x]))[:limit].tolist():
                    if s[x, y] > -np.inf:
                        for to, value in zip(out, (int(ia[x]), of[x], int(ib[y]), path[y], float(s[x, y])), strict=True):
                            to.append(value)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("me", "of", "script_id", "logical_path", "score"), out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()), strict=True)})

    best = _grid(vectors, False, run, "me long, of string, script_id long, logical_path string, score double", queries)
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("me").orderBy(F.desc("score"), "script_id")))
    return placed.where(F.col("place") <= limit).select("of", "logical_path", "score", "place")


def similar_of(scripts: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """As nearest_of, without scripts that are no longer in the catalog."""
    return nearest_of(vectors.join(scripts.select("logical_path"), "logical_path", "left_semi"), queries, limit)


class NoVectors(LookupError):
    """Nothing can be compared."""


def similar_checked(scripts: DataFrame, opened: tuple[str, DataFrame | None, str | None], path: str, limit: int, build: str | None = None) -> tuple[DataFrame, list[str]]:
    """As similar, of vectors as ``store.open_vectors`` gives them, with notes on what they do not cover.

    An unknown script, vectors that are missing or cannot be used, and a script without a
    vector are errors.
    """
    state, vectors, made_for = opened
    if scripts.where(F.col("logical_path") == path).isEmpty():
        raise NoVectors(f"script '{path}' not found in catalog")
    if state != "ok":
        raise NoVectors({"absent": "no vectors are published beside the catalog", "newer": "the vectors are of a newer format"}.get(state, "the vectors cannot be read"))
    if vectors.where(F.col("logical_path") == path).isEmpty():
        raise NoVectors(f"'{path}' has no vector: it was added or renamed after they were made")
    have, all_ = vectors.count(), scripts.count()
    notes = [provenance_note(made_for, build), f"vectors cover {have} of {all_} scripts" if have < all_ else None]
    return similar(scripts, vectors, path, limit), [n for n in notes if n]


def provenance_note(sidecar_build: str | None, catalog_build: str | None) -> str | None:
    if sidecar_build and catalog_build and sidecar_build != catalog_build:
        return f"embeddings were made for build {sidecar_build}, the catalog is {catalog_build}"
    return None


def _grid(vectors: DataFrame, upper: bool, run, schema: str, queries: DataFrame | None = None) -> DataFrame:
    """run(a, b) for block pairs: each unordered pair once, or every ordered pair; a of *queries* if given."""
    n = max(1, -(-vectors.count() // BLOCK))
    m = n if queries is None else max(1, -(-queries.count() // BLOCK))

    def blocks(of: DataFrame, k: int) -> DataFrame:
        return of.select("script_id", "logical_path", unit(F.col("embedding")).alias("vec")).withColumn("block", F.pmod(F.xxhash64("script_id"), F.lit(k)))

    low = F.lit(0).cast("long")
    a = blocks(vectors if queries is None else queries, m).withColumn("i", F.col("block"))
    a = a.withColumn("j", F.explode(F.sequence(F.col("i") if upper else low, F.lit(n - 1).cast("long"))))
    b = blocks(vectors, n).withColumn("j", F.col("block"))
    b = b.withColumn("i", F.explode(F.sequence(low, F.col("j") if upper else F.lit(m - 1).cast("long"))))
    b = b.toDF(*b.columns)
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(run, schema)


def _scores(a: pa.Table, b: pa.Table) -> np.ndarray:
    """All scores of two blocks; vectors of other lengths get the least score."""
    out = np.full((a.num_rows, b.num_rows), F32_MIN)
    right = {m.shape[1]: (rows, m) for rows, m in _matrices(b.column("vec"))}
    for rows, m in _matrices(a.column("vec")):
        if m.shape[1] in right:
            others, n = right[m.shape[1]]
            out[np.ix_(rows, others)] = m @ n.T
    return out


# -- pairs, where blocks that cannot match are left out ------------------------------------
#: Directions that vectors are gathered around at most, and rings around one of them.
PIVOTS, RINGS = 1024, 64
#: Groups that blocks are dealt out by, and blocks of a group at most: a task holds two groups.
GROUPS, MOST_BLOCKS = 32, 16
#: Angles are compared with this much to spare, as they are rounded.
SLACK = 1e-6


@dataclass(frozen=True)
class Rings:
    """Cells of vectors: a cell holds those whose angles from one pivot lie in [low, high], in *parts* blocks.

    The last cell holds vectors without direction, or of another length than the pivots: no bound holds for it.
    """

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(vectors @ self.pivots.T, -1, 1))

    def least(self, angles: np.ndarray) -> np.ndarray:
        """For vectors with these angles from the pivots, the least angle to anything in each cell: by the triangle inequality."""
        bound = np.zeros((len(angles), len(self.pivot)))
        known = self.pivot >= 0
        own = angles[:, self.pivot[known]]
        bound[:, known] = np.maximum(0, np.maximum(own - self.high[known], self.low[known] - own))
        return bound

    @property
    def first(self) -> np.ndarray:
        """Each cell's first block."""
        return np.cumsum(self.parts) - self.parts


def _matrices(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a list array."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    at = vectors.offsets.to_numpy()
    sizes, flat = np.diff(at), vectors.values.to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[at[rows][:, None] + np.arange(d)]))
    return out


def _directed(rings_of: np.ndarray, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors that have a direction and the pivots' length."""
    for rows, matrix in _matrices(vectors):
        if len(rings_of) and matrix.shape[1] == rings_of.shape[1]:
            some = matrix.any(axis=1)
            yield rows[some], matrix[some]


def gathered(vectors: DataFrame, keep: Scratch) -> tuple[DataFrame, Rings]:
    """units(script_id, logical_path, vec, h, cell) and their cells, of about BLOCK vectors each or split into such blocks.

    Pivots are at most PIVOTS vectors, drawn by a hash of the id; rings lie between
    quantiles of the angles from a pivot.  Both only shape the blocks: any choice is exact.
    """
    h = F.pmod(F.xxhash64("script_id"), F.lit(1 << 31)).alias("h")
    n = vectors.count()
    most = min(PIVOTS, -(-max(n, 1) // BLOCK))
    drawn = vectors.select("script_id", h, unit(F.col("embedding")).alias("vec")).where("exists(vec, x -> x <> 0)").orderBy("h", "script_id").limit(most).select("vec").collect()
    sizes = [len(r.vec) for r in drawn]
    pivots = np.array([r.vec for r in drawn if len(r.vec) == max(set(sizes), key=sizes.count)]) if drawn else np.zeros((0, 0))
    units = vectors.select("script_id", "logical_path", unit(F.col("embedding")).alias("vec"), h)
    whole = Rings(pivots, *[np.zeros(0, np.int64)] * 4)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, angle = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for rows, matrix in _directed(pivots, b.column("vec")):
                angles = whole.angles(matrix)
                pivot[rows] = angles.argmin(axis=1)
                angle[rows] = angles.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(angle)], [*b.schema.names, "pivot", "angle"])

    vec = "script_id long, logical_path string, vec array<double>, h long"
    near = keep.put(units.mapInArrow(nearest, f"{vec}, pivot int, angle double"), "near")
    steps = [k / RINGS for k in range(1, RINGS)]
    edges = {}
    for r in [] if most == 1 else near.where("pivot >= 0").groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("angle", steps, 10_000).alias("at")).collect():  # a row a pivot
        m = min(RINGS, -(-r.n // BLOCK))
        edges[r.pivot] = sorted({r["at"][k * RINGS // m - 1] for k in range(1, m)})
    ring = F.lit(0)
    if edges:
        cuts = F.create_map(*[F.lit(x) for p, e in edges.items() for x in (p, F.array(*map(F.lit, e)).cast("array<double>"))])
        ring = F.coalesce(F.aggregate(cuts[F.col("pivot")], F.lit(0), lambda k, e: k + (F.col("angle") > e).cast("int")), F.lit(0))
    near = near.withColumn("ring", ring)
    cells = sorted(tuple(r) for r in near.groupBy("pivot", "ring").agg(F.min("angle"), F.max("angle"), F.count("*")).collect())  # at most PIVOTS * RINGS, and one
    cells = [c for c in cells if c[0] >= 0] + ([c for c in cells if c[0] < 0] or [(-1, 0, 0.0, 0.0, 0)])
    pivot, _, low, high, size = (np.array(x) for x in zip(*cells))
    rings = Rings(pivots, pivot.astype(np.int64), low, high, np.maximum(1, -(-size // BLOCK)).astype(np.int64))
    number = near.sparkSession.createDataFrame([(c[0], c[1], i) for i, c in enumerate(cells)], "pivot int, ring int, cell int")
    return near.join(number, ["pivot", "ring"]).select("script_id", "logical_path", "vec", "h", "cell"), rings


def _grouping(rings: Rings) -> int:
    """Blocks of a group: vectors are copied once a group, so that at most GROUPS copies of one are made while a group has room."""
    return int(min(MOST_BLOCKS, max(1, -(-int(rings.parts.sum()) // GROUPS))))


def _asking(units: DataFrame, rings: Rings, asked: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], upper: bool) -> DataFrame:
    """i, j, script_id, logical_path, vec, own, blocks: each vector, of block own in group i, once for every group j that holds blocks it has to be compared with.

    asked(least angles by cell, batch) says which cells; *upper* leaves out blocks before the vector's own.
    """
    size = _grouping(rings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_of = np.repeat(np.arange(len(rings.parts)), rings.parts)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                bound = np.zeros((b.num_rows, len(rings.parts)))
                for rows, matrix in _directed(rings.pivots, b.column("vec")):
                    bound[rows] = rings.least(rings.angles(matrix))
                own = _own_blocks(b, rings)
                row, block = np.nonzero(asked(bound, b)[:, cell_of])
                kept = block >= own[row] if upper else np.ones(len(row), bool)
                row, block = row[kept], block[kept]
                # Runs of the same row and group: rows come in order, and blocks in order within them.
                first = np.flatnonzero(np.diff(row, prepend=-1).astype(bool) | np.diff(block // size, prepend=-1).astype(bool))
                ends = np.append(first[1:], len(row))
                for c in range(0, len(first), 4096):
                    f, e = first[c : c + 4096], ends[c : c + 4096]
                    at = pa.array(row[f])
                    blocks = pa.ListArray.from_arrays(pa.array(np.append(f, e[-1]) - f[0], pa.int32()), pa.array(block[f[0] : e[-1]], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(own[row[f]] // size), pa.array(block[f] // size), *[b.column(x).take(at) for x in ("script_id", "logical_path", "vec")], pa.array(own[row[f]]), blocks], ["i", "j", "script_id", "logical_path", "vec", "own", "blocks"])

    return units.mapInArrow(run, "i long, j long, script_id long, logical_path string, vec array<double>, own long, blocks array<long>")


def _own_blocks(b: pa.RecordBatch, rings: Rings) -> np.ndarray:
    cell = b.column("cell").to_numpy()
    return rings.first[cell] + b.column("h").to_numpy() % rings.parts[cell]


def _compared(asks: DataFrame, units: DataFrame, rings: Rings, run, schema: str) -> DataFrame:
    """run(askers, members of one block) for each block, with all that ask for it, at most BLOCK at once; pairs of groups are dealt out."""
    size, most = _grouping(rings), BLOCK
    table = units.sparkSession.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(rings.first, rings.parts))], "cell int, first long, parts long")
    members = units.join(table, "cell").withColumn("block", F.col("first") + F.col("h") % F.col("parts")).withColumn("j", F.floor(F.col("block") / size))
    members = members.join(asks.select("i", "j").distinct(), "j").select("i", "j", "script_id", "logical_path", "vec", "block")
    members = members.toDF(*members.columns)  # columns of its own, apart from those of asks

    def tiles(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            lists = a.column("blocks").combine_chunks()
            asker, wanted = np.repeat(np.arange(a.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            block = b.column("block").to_numpy()
            for k in np.unique(block):
                rows, mine = asker[wanted == k], b.take(pa.array(np.flatnonzero(block == k)))
                for c in range(0, len(rows), most):
                    out.append(run(a.take(pa.array(rows[c : c + most])), mine))
        return pa.concat_tables(out) if out else run(a.slice(0, 0), b.slice(0, 0))

    return asks.groupBy("i", "j").cogroup(members.groupBy("i", "j")).applyInArrow(tiles, schema)


def _angle(threshold: float) -> float:
    return float(np.arccos(np.clip(threshold, -1, 1))) + SLACK


def near_duplicates(vectors: DataFrame, threshold: float) -> DataFrame:
    """path_a <= path_b, score of every pair at or above the threshold, once.

    A vector is compared with a block only where the triangle inequality allows a match.
    """
    keep = Scratch(vectors.sparkSession, "pairs")
    units, rings = gathered(vectors, keep)
    within = _angle(threshold)
    asks = keep.put(_asking(units, rings, lambda bound, _: bound <= within, True), "asks")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        pa_, pb, s = [], [], []
        if a.num_rows and b.num_rows:
            near = _scores(a, b)
            ia, ib = a.column("script_id").to_numpy(), b.column("script_id").to_numpy()
            same = a.column("own").to_numpy()[:, None] == b.column("block").to_numpy()[None]
            i, j = np.nonzero((near >= threshold) & np.where(same, ia[:, None] < ib[None], ia[:, None] != ib[None]))
            names_a, names_b = a.column("logical_path").to_pylist(), b.column("logical_path").to_pylist()
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = sorted((names_a[x], names_b[y]))
                pa_.append(p), pb.append(q), s.append(float(near[x, y]))
        return pa.table({"path_a": pa.array(pa_, pa.string()), "path_b": pa.array(pb, pa.string()), "score": pa.array(s, pa.float64())})

    return _compared(asks, units, rings, run, "path_a string, path_b string, score double").orderBy(F.desc("score"), "path_a", "path_b")


def left_out(vectors: DataFrame, threshold: float) -> float:
    """The share of comparisons of a vector with a block that near_duplicates leaves out."""
    units, rings = gathered(vectors, Scratch(vectors.sparkSession, "pairs"))
    within = _angle(threshold)

    def comparisons(angle: float) -> int:
        return _asking(units, rings, lambda bound, _: bound <= angle, True).agg(F.sum(F.size("blocks"))).first()[0] or 0

    return 1 - comparisons(within) / max(comparisons(np.pi), 1)


def outliers(vectors: DataFrame, threshold: float) -> DataFrame:
    """logical_path, score of scripts whose best match is below the threshold; fewer than two rows: none.

    A vector meets its own block first, then blocks that may hold a match; one with a match
    asks no further.  Only those without go on to all blocks that may hold a better score.
    """
    keep = Scratch(vectors.sparkSession, "outliers")
    units, rings = gathered(vectors, keep)
    within = _angle(threshold)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"script_id": pa.array([], pa.int64()), "best": pa.array([], pa.float64())})
        s = _scores(a, b)
        s[a.column("script_id").to_numpy()[:, None] == b.column("script_id").to_numpy()[None]] = -np.inf
        return pa.table({"script_id": a.column("script_id"), "best": pa.array(s.max(axis=1))})

    def own_cell(bound: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return np.arange(bound.shape[1])[None] == b.column("cell").to_numpy()[:, None]

    def may_match(bound: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        return (bound <= within) & ~own_cell(bound, b)

    def may_be_better(bound: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        best = np.clip(b.column("best").to_numpy(), -1, 1)
        return (bound <= np.arccos(best)[:, None] + SLACK) & ~own_cell(bound, b) & ~(bound <= within)

    none = F.lit(float("-inf"))
    open_ = units.withColumn("best", none)
    for step, asked in (("own", own_cell), ("match", may_match), ("rest", may_be_better)):
        asks = keep.put(_asking(open_, rings, asked, False), f"{step}-asks")
        best = _compared(asks, units, rings, run, "script_id long, best double").groupBy("script_id").agg(F.max("best").alias("found"))
        rows = open_.join(best, "script_id", "left").withColumn("best", F.greatest("best", F.coalesce("found", none))).drop("found")
        open_ = keep.put(rows.where(F.col("best") < threshold), step)
        if rings.parts.sum() == 1:
            break  # nothing else to ask
    return open_.where(F.col("best") > float("-inf")).select("logical_path", F.col("best").alias("score")).orderBy("score", "logical_path")


def embed_text(scripts: DataFrame, sampled: bool = False, chars: int = 20_000) -> DataFrame:
    """id, logical_path, text, text_hash: what a model reads of a script; data files are left out by default."""
    tags = F.array_join(F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")), ", ")
    head = [(F.col("logical_path"), ""), (F.col("purpose"), ""), (tags, "tags: "), (F.col("owner"), "owner: ")]
    lines = F.filter(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)) for c, label in head]), lambda x: x.isNotNull())
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), F.substring(F.coalesce("content", F.lit("")), 1, chars))
    rows = scripts if sampled else scripts.where("language is null or language not in ('csv', 'text', 'lst')")
    return rows.select("id", "logical_path", text.alias("text"), F.sha2(text, 256).alias("text_hash"))


def reuse_vectors(texts: DataFrame, previous: DataFrame, model: str) -> DataFrame:
    """texts with the embedding that the same model gave the same path and text, null where it must be made."""
    old = previous.where(F.col("model") == model).select("logical_path", "text_hash", "embedding").dropDuplicates(["logical_path", "text_hash"])
    return texts.join(old, ["logical_path", "text_hash"], "left")
