"""Exact top-k search by inner product over a bit-sliced index.

Vectors are whole numbers. A block of rows is stored as bit slices: one bitmap over the rows for every
bit of every component, shifted to be non-negative. The scores of all rows for one query are added up
with bitmap arithmetic: each set bit of a query component sends the slices of that component to a
column of equal weight, and full adders reduce the columns to one bitmap each, the slices of the score.
The k best rows are then picked from the most significant slice downward, keeping those that are surely
in and those still tied; ties at the boundary go to the smaller ids. Every block gives its k best rows
for every query and the blocks are merged by a window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block; both sides are dealt out by hash.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 15, 256
SCALE = 1024


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as floor(scale * x). Rows without id, vector or with a component that is
    null or not finite are left out."""
    x = F.col("x")
    good = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.col("vec_id").isNotNull()
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
        .where(F.coalesce(good, F.lit(False)) & (F.size("x") > 0))
        .select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))
    )


class Slices:
    """Bit slices of a block of whole-number vectors (rows x dimensions)."""

    def __init__(self, vectors: np.ndarray):
        self.rows, self.dims = vectors.shape
        self.low = vectors.min(0)
        shifted = (vectors - self.low).astype(np.uint64)
        self.depth = max(1, int(shifted.max()).bit_length())
        words = -(-self.rows // 64)
        self.width = words
        self.bits = np.zeros((self.dims, self.depth, words), np.uint64)
        for b in range(self.depth):
            plane = np.zeros((self.dims, words * 64), np.uint8)
            plane[:, :self.rows] = ((shifted >> np.uint64(b)) & np.uint64(1)).T
            self.bits[:, b] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)
        self.every = np.zeros(words * 64, np.uint8)
        self.every[:self.rows] = 1
        self.every = np.packbits(self.every, bitorder="little").view(np.uint64)

    def _sum(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the sum of weight * shifted component; weights >= 0."""
        columns: list[list] = []
        for d in np.flatnonzero(weights):
            w, at = int(weights[d]), 0
            while w:
                if w & 1:
                    while len(columns) < at + self.depth:
                        columns.append([])
                    for b in range(self.depth):
                        columns[at + b].append(self.bits[d, b])
                w >>= 1
                at += 1
        out, k = [], 0
        half, carry = np.empty(self.width, np.uint64), np.empty(self.width, np.uint64)
        while k < len(columns):
            todo = columns[k]
            if len(columns) == k + 1 and len(todo) > 1:
                columns.append([])
            while len(todo) > 2:                 # full adder: three bits become one here and one above
                a, b, c = todo.pop(), todo.pop(), todo.pop()
                np.bitwise_xor(a, b, out=half)
                total = half ^ c
                np.bitwise_and(half, c, out=half)
                np.bitwise_and(a, b, out=carry)
                columns[k + 1].append(half | carry)
                todo.append(total)
            if len(todo) == 2:
                a, b = todo
                columns[k + 1].append(a & b)
                todo = [a ^ b]
            out.append(todo[0] if todo else np.zeros(self.width, np.uint64))
            k += 1
        return out

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, least significant first, and what is to be added to each score."""
        plus, minus = self._sum(np.maximum(query, 0)), self._sum(np.maximum(-query, 0))
        # plus - minus = plus + not(minus) + 1 - 2^depth
        depth = max(len(plus), len(minus), 1)
        zero = np.zeros(self.width, np.uint64)
        carry, out = ~zero, []
        for k in range(depth):
            a = plus[k] if k < len(plus) else zero
            b = ~minus[k] if k < len(minus) else ~zero
            half = a ^ b
            out.append(half ^ carry)
            carry = (a & b) | (half & carry)
        out.append(carry)
        return out, int((query * self.low).sum()) - (1 << depth)

    def top(self, query: np.ndarray, k: int, without: slice = slice(0, 0)) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best scores with ties at the boundary resolved by row, and their scores."""
        slices, base = self.scores(query)
        maybe = self.every.copy()
        for row in range(without.start, without.stop):
            maybe[row >> 6] &= ~np.uint64(1 << (row & 63))
        sure = np.zeros_like(maybe)
        for s in reversed(slices):
            found = sure | (maybe & s)
            n = int(np.bitwise_count(found).sum())
            if n > k:
                maybe &= s
            elif n < k:
                sure, maybe = found, maybe & ~s
            else:
                sure, maybe = found, np.zeros_like(maybe)
                break
        rows = self._rows(sure)
        rest = self._rows(maybe)[:k - len(rows)]
        rows = np.concatenate([rows, rest])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        score = np.full(len(rows), base, np.int64)
        for j, s in enumerate(slices):
            score += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << j
        return rows, score

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), count=self.rows, bitorder="little"))


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = table.column("v").combine_chunks()
    return table.column("vec_id").to_numpy(), v.values.to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 1), np.int64)


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best others for each row whose id is divisible by ``every``.

    Scores are inner products of floor(scale * component); ties go to the smaller vec_id. Vectors of
    different lengths are not compared. Rows that repeat an id are candidates each, never for their own id;
    as a query an id stands for the smallest of its vectors. With fewer than k others all are returned;
    an empty table gives no rows. Scores must fit in 64 bits. Further columns are ignored.
    """
    data = quantised(vectors, scale).withColumn("n", F.size("v"))
    counts = {r.n: (r.rows, r.asked) for r in data.groupBy("n").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).collect()}
    kinds = "query_id long, rank int, vec_id long, score long"
    out = data.sparkSession.createDataFrame([], kinds)
    for n, (rows, asked) in sorted(counts.items()):
        if asked:
            out = out.union(_one_length(data.where(F.col("n") == n).select("vec_id", "v"), k, every, rows, asked))
    return out


def _one_length(data: DataFrame, k: int, every: int, rows: int, asked: int) -> DataFrame:
    row_blocks, query_blocks = -(-rows // BLOCK_ROWS), -(-asked // BLOCK_QUERIES)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    side = data.select("vec_id", "v", deal(row_blocks, 1).alias("r"), numbers(query_blocks).alias("q"))
    asks = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", numbers(row_blocks).alias("r"), deal(query_blocks, 2).alias("q"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("vec_id")
        ids, v = _vectors(left)
        query_ids, queries = _vectors(right)
        found = []
        if len(ids):
            index = Slices(v)
            for q, x in zip(query_ids, queries):
                own = slice(int(np.searchsorted(ids, q)), int(np.searchsorted(ids, q, "right")))
                got, score = index.top(x, k, own)
                found.append((np.full(len(got), q), ids[got], score))
        cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols)))

    best = (
        side.groupBy("r", "q").cogroup(asks.groupBy("r", "q"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
