"""Near-duplicate documents: MinHash bands find candidates, odd sketches screen them, full sets decide.

1. One pass over the texts gives each document its number of distinct shingles, a fingerprint of the
   set, band keys of its MinHash samples and an odd sketch: the samples folded into a bitmap by parity.
2. Documents with the same set form one class; from here on only the smallest id of a class is used.
3. Each class meets one centre in every band bucket it is in (a star, not all pairs): the class that
   shares most buckets with others, which in a group of near copies is the text they come from.
   Pairs that pass the screen are confirmed on the full sets, and groups are formed.
4. Only classes that share a bucket but are not yet in one group are compared with each other, screened
   inside the join and confirmed on full sets. Pairs inside one group need no check, because the result
   only says which documents are connected.

The screen has three tests: sizes too far apart; the parity bitmap of the full sets, whose differing
bits are a lower bound of the shingles that differ (both lose nothing); and the estimate from the odd
sketch of the samples, rejected under 0.5, which happens to a pair at similarity 0.8 with a probability
of 1.0e-10. With 32 bands of 4 samples, such a pair shares no bucket with a probability of 4.7e-8; it is
missed with at most the sum, 4.8e-8. No bucket, group or number of partners is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import components, stored
from .words import mix, pieces, shingles, window_hash, window_sums, words_of

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: Longs of the parity bitmap of the full set.
PARITY_WORDS = 16
SCREEN = 0.5

SKETCH = [f"s{k}" for k in range(SKETCH_WORDS)] + [f"f{k}" for k in range(PARITY_WORDS)]

_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, one after the other, and where each row's begin."""
    w = words_of(batch, lower=True)
    h = w.hashes()
    grams, sums = shingles(h, size), window_sums(h)
    out, ends = [], np.zeros(w.n_docs + 1, np.int64)
    for i in range(w.n_docs):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= size:
            g = np.sort(grams[a:b - size + 1])
            g = g[np.concatenate(([True], g[1:] != g[:-1]))]
        elif b > a:
            g = window_hash(sums, np.array([a]), np.array([b]))
        else:
            g = grams[:0]
        out.append(g)
        ends[i + 1] = ends[i] + len(g)
    return np.concatenate(out) if out else grams[:0], ends


def minhashes(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Samples (rows x SAMPLES); no row may be empty."""
    out = np.empty((len(ends) - 1, SAMPLES), np.uint64)
    work = np.empty_like(values)
    for k in range(SAMPLES):
        np.bitwise_xor(values, _XOR[k], out=work)
        np.multiply(work, _ODD[k], out=work)
        out[:, k] = np.minimum.reduceat(work, ends[:-1])
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (rows x SKETCH_WORDS): every sample flips one bit."""
    return parities(mix(samples ^ _ODD).ravel(), np.arange(len(samples) + 1) * SAMPLES, SKETCH_WORDS)


def parities(values: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows x words): every value flips the bit that its hash names."""
    n, bits = len(ends) - 1, 64 * words
    at = np.repeat(np.arange(n) * bits, np.diff(ends)) + (values % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(at, minlength=n * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(samples), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + samples[:, k::ROWS])
    return keys


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                values, ends = shingle_sets(part, size)
                n = np.diff(ends)
                full = np.flatnonzero(n)
                prints = np.zeros((len(n), 2), np.uint64)
                keys, sketch = np.zeros((len(n), BANDS), np.uint64), np.zeros((len(n), SKETCH_WORDS + PARITY_WORDS), np.uint64)
                if len(full):
                    at = np.append(ends[full], ends[-1])
                    samples = minhashes(values, at)
                    keys[full], sketch[full, :SKETCH_WORDS] = band_keys(samples), odd_sketch(samples)
                    sketch[full, SKETCH_WORDS:] = parities(values, at, PARITY_WORDS)
                    for k, other in enumerate((mix(values), mix(values ^ np.uint64(0x5BF03635)))):
                        prints[full, k] = np.add.reduceat(other, at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), _longs(prints[:, 0]), _longs(prints[:, 1]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), _longs(keys.ravel())),
                     *(_longs(sketch[:, k]) for k in range(sketch.shape[1]))],
                    names=["id", "n", "p1", "p2", "bands", *SKETCH])

    kinds = "id long, n long, p1 long, p2 long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(work, kinds)


def passes(left: str, right: str, percent: int) -> Column:
    """Screen of a pair by sizes, parity of the full sets and the estimate from the odd sketches."""
    x, y = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    differ = lambda mark, words: sum((F.bit_count(x(f"{mark}{k}").bitwiseXOR(y(f"{mark}{k}"))) for k in range(words)), F.lit(0))
    left_over = F.greatest(F.lit(1e-9), 1 - 2 * differ("s", SKETCH_WORDS) / F.lit(float(SKETCH_BITS)))
    similarity = 1 + F.lit(SKETCH_BITS / (4 * SAMPLES)) * F.log(left_over)
    return (
        (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n")))
        # similarity s means that (1 - s) / (1 + s) of both sizes differ
        & ((100 + percent) * differ("f", PARITY_WORDS) <= (100 - percent) * (x("n") + y("n")))
        & (similarity >= SCREEN)
    )


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, shingles): sorted distinct shingle hashes, packed, of the documents named."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                values, ends = shingle_sets(part, size)
                blobs = [values[ends[i]:ends[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["id", "shingles"])

    return (
        docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.hint("merge"), "id", "left_semi")
        .mapInArrow(work, "id long, shingles binary")
    )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select([0, 1]).filter(pa.array(good))

    return (
        pairs.select("a", "b")
        .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y").mapInArrow(work, "a long, b long")
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    A document's set holds the shingles of ``size`` words of its lower-cased (A-Z) text; with fewer
    words, the whole sequence. Documents are linked from ``percent`` % of intersection by union on.
    Null, empty and blank texts have no shingles and are linked with nothing. Rows without a doc_id
    take no part: component_id null, kept true. Rows that repeat a doc_id count as one document
    with the first set found, and are returned as often as they occur. Further columns are ignored.
    """
    sig = stored(signatures(docs, size), "signatures")
    live = sig.where("n > 0 and id is not null")
    # written, so that the join has two plain sides and adaptive execution can split a hot class
    classes = stored(live.groupBy("p1", "p2", "n").agg(F.min("id").alias("rep")), "class_keys")
    member = stored(live.join(classes, ["p1", "p2", "n"]).select("id", "rep", "n", "bands", *SKETCH), "classes")
    reps = member.where("id = rep").drop("id")

    rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    bucket = stored(rows.join(shared, "key"), "buckets")
    weight = bucket.groupBy("rep").agg(F.sum("m").alias("weight"))
    sketches = reps.select("rep", "n", *SKETCH).dropDuplicates(["rep"]).join(weight.select("rep"), "rep", "left_semi")
    centre = (
        bucket.select("key", "rep").join(weight, "rep").groupBy("key").agg(F.min(F.struct(-F.col("weight"), "rep")).alias("t"))
        .select("key", F.col("t.rep").alias("centre"))
    )
    star = bucket.join(centre, "key").where("rep <> centre").select("rep", "centre").distinct()
    star = (
        star.join(sketches.alias("x"), "rep").join(sketches.withColumnRenamed("rep", "centre").alias("y"), "centre")
        .where(passes("x", "y", percent)).select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    )
    sets = stored(full_sets(docs, weight.select(F.col("rep").alias("id")), size), "sets").dropDuplicates(["id"])
    links = stored(confirmed(star, sets, percent), "links")
    group = components(links)

    placed = (
        bucket.join(group.withColumnRenamed("id", "rep"), "rep", "left")
        .select("key", "rep", F.coalesce("component", "rep").alias("g"))
    )
    mixed = placed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key")
    side = stored(placed.join(mixed, "key").join(sketches, "rep"), "sides")
    x, y = side.alias("x"), side.alias("y")
    apart = (
        x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.g") < F.col("y.g")) & passes("x", "y", percent))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    )
    more = confirmed(stored(apart, "apart"), sets, percent)
    group = components(stored(links.union(more), "links"))

    found = (
        member.select("id", "rep").distinct().join(group.withColumnRenamed("id", "rep"), "rep", "left")
        .groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
        .where("component <> id")
    )
    return (
        sig.select("id", "n").join(found, "id", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
