"""Document fingerprints: one-permutation MinHash, densified, low-order bits packed.

A text's set holds its distinct *k*-word shingles (five by default) as 64-bit hashes, A-Z
lower-cased.  Each shingle is hashed once: the hash's top bits choose one of BINS bins and
the least hash of a bin is its value.  Optimal densification gives an empty bin the value
of the first non-empty bin in an order of its own, which is the same for all texts.  Of
each value, hashed again with its bin, only the BITS lowest bits are kept; they are packed
and written in base64.  Two fingerprints agree in a bin with probability C + (1 - C) J for
sets of similarity J, where C = 2**-BITS is chance, so ``likeness`` takes C away again.
Its standard error is at most 0.024 (at J = 0.5).

Scale: a fingerprint needs its own text alone, in memory that grows with the batch.
Texts meet those that follow them by ranges of doc_id (``by_ranges``).

Defined results: null, empty and wordless texts have the empty fingerprint, which is like
itself (1) and unlike all others (0); fewer words than *k* are one shingle; equal texts
have equal fingerprints; other columns are the caller's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from cairn.llm import textvec as tv
from cairn.llm.store import columns, session

LOG_BINS, BITS = 9, 4
BINS = 1 << LOG_BINS
#: Bins of an order looked at in one step.
STEP = 16
_orders: list[np.ndarray] = []


def orders() -> np.ndarray:
    """Row b: the order in which the empty bin b asks the others."""
    if not _orders:
        places = tv.mix(np.arange(1, BINS * BINS + 1, dtype=tv.U) * tv.U(0xD1342543DE82EF95))
        _orders.append(np.argsort(places.reshape(BINS, BINS), axis=1, kind="stable"))
    return _orders[0]


def densified(filled: np.ndarray) -> np.ndarray:
    """For each bin the bin whose value it takes: itself, or the first filled one in its order."""
    source = np.arange(BINS)
    open_ = np.flatnonzero(~filled)
    for a in range(0, BINS, STEP):
        if not len(open_):
            break
        asked = orders()[open_, a : a + STEP]
        hit = filled[asked]
        source[open_] = asked[np.arange(len(open_)), hit.argmax(axis=1)]
        open_ = open_[~hit.any(axis=1)]
    return source


def codes(members: np.ndarray) -> np.ndarray:
    """The BITS lowest bits of each bin of a sorted, non-empty set of hashes."""
    bins = (members >> tv.U(64 - LOG_BINS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # the set is sorted: the least of each bin
    value, filled = np.zeros(BINS, tv.U), np.zeros(BINS, bool)
    value[bins[first]], filled[bins[first]] = members[first], True
    # Hashed with the bin that shows it, a value that fills many bins agrees by chance in few of them.
    shown = tv.mix(value[densified(filled)] + np.arange(1, BINS + 1, dtype=tv.U) * tv.U(0x9E3779B97F4A7C15))
    return (shown & tv.U((1 << BITS) - 1)).astype(np.uint8)


def pack(values: np.ndarray) -> str:
    return base64.b64encode(((values[0::2] << 4) | values[1::2]).tobytes()).decode()


def fingerprints(texts: pa.Array, k: int = 5) -> pa.Array:
    data, offsets = tv.buffers(texts)
    hashes, at = tv.word_hashes(data, offsets, tv.NOT_SPACE, tv.ASCII_LOWER)
    sets = (tv.shingles(hashes[at[i] : at[i + 1]], k) for i in range(len(texts)))
    return pa.array([pack(codes(s)) if len(s) else "" for s in sets], pa.string())


def likenesses(a: pa.Array, b: pa.Array) -> pa.Array:
    """Estimated similarities, without the share that agrees by chance; null beside null."""
    out, chance = [], 2.0**-BITS
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        if not x or not y:
            out.append(None if x is None or y is None else float(x == y))
            continue
        differ = np.frombuffer(base64.b64decode(x), np.uint8) ^ np.frombuffer(base64.b64decode(y), np.uint8)
        agree = (np.count_nonzero(differ & 0xF0 == 0) + np.count_nonzero(differ & 0x0F == 0)) / BINS
        out.append(max(0.0, (agree - chance) / (1 - chance)))
    return pa.array(out, pa.float64())


def fingerprint(text: Column, k: int = 5) -> Column:
    """The fingerprint of a text column."""

    @F.arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return fingerprints(texts, k)

    return run(text)


@F.arrow_udf(DoubleType())
def likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    """Estimated similarity (0 to 1) of the sets behind two fingerprints."""
    return likenesses(a, b)


def by_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """``docs(doc_id, text)`` in order by doc_id within partitions: range, behind, doc_id, text.

    Ties go by text, rows without doc_id come first.  Rows are dealt by ranges of doc_id
    between its quantiles.  The rows at a range's lower bound go to the range before as
    well, where they stand behind its own rows (those of the first range behind the last
    one's), so the row that follows any row is in its range.  No row is met in a single
    task; texts are moved once.  Rows of one doc_id share a range.
    """
    at = F.coalesce("doc_id", F.lit(-(1 << 63)))
    steps = [i / ranges for i in range(ranges)]
    low, cuts = docs.select(at.alias("at")).agg(F.min("at"), F.percentile_approx("at", steps, 10 * ranges)).first()
    bounds = sorted({low, *cuts}) if low is not None else [0]

    @F.arrow_udf(IntegerType())
    def range_of(places: pa.Array) -> pa.Array:
        own, places = np.asarray(bounds, np.int64), places.to_numpy()
        found = np.searchsorted(own, places, side="right") - 1
        # Below zero: at the bound, so also behind the range before.
        return pa.array(np.where(own[found] == places, -1 - found, found), pa.int32())

    n, at_bound = F.lit(len(bounds)), F.col("found") < 0
    own = F.when(at_bound, -1 - F.col("found")).otherwise(F.col("found"))
    place = lambda r, behind: F.struct(r.cast("int").alias("range"), F.lit(behind).alias("behind"))
    places = F.when(at_bound, F.array(place(own, False), place((own + n - 1) % n, True))).otherwise(F.array(place(own, False)))
    dealt = docs.withColumn("at", at).withColumn("found", range_of("at")).select("doc_id", "text", F.explode(places).alias("place"))
    dealt = dealt.select("place.range", "place.behind", "doc_id", "text").repartition("range")
    return dealt.sortWithinPartitions("range", "behind", F.asc_nulls_first("doc_id"), "text")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a range beside the row that follows, which is there: a range ends with a row that stands behind."""
    held: list[tuple] = []
    for batch in batches:
        prints = fingerprints(batch.column("text")).to_pylist()
        rows = held + list(zip(batch.column("behind").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), prints))
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[0]]
        held = rows[-1:]
        sizes = [len(a[2]) for a, _ in pairs]
        edited = pa.array([a[2][: n - n // 4] + b[2][: n // 4] for (a, b), n in zip(pairs, sizes)], pa.string())
        own, after = (pa.array([p[i][3] for p in pairs], pa.string()) for i in (0, 1))
        new = fingerprints(edited)
        columns_ = [pa.array([a[1] for a, _ in pairs], pa.int64()), pa.array(sizes, pa.int64()), edited, own, new, likenesses(own, new), likenesses(own, after)]
        yield pa.RecordBatch.from_arrays(columns_, ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_likeness(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each text beside one that ends with the beginning of the next document: fingerprints of both, and how alike they and the next document's are.

    doc_id, n_chars, edited (the last quarter of the code points replaced by as many of the
    next document's first, or all), fingerprint, edited_fingerprint, near_edited, near_next.
    The last document is followed by the first.
    """
    session(spark)
    docs = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    rows = by_ranges(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.mapInArrow(_edit, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
