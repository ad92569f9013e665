"""Substring deduplication by level-wise doubling: 5-word windows, then 10, then 20.

A window of ``length`` words can only be repeated if its halves are, and theirs. Every window has one
anchor, the five-word window inside it with the smallest hash, so equal windows have equal anchors
and only anchors (about one word in eight) have to be counted.

1. Level 5. One pass cuts each text into runs: consecutive windows with the same anchor. A run is
   keyed by its anchor and by all its words. Repeats inside one piece of input are settled there, so a
   hot passage sends one row per piece. Of equal runs all but the first are removed as a whole.
   A run stays a candidate if its anchor also occurs in another context.
2. Level 10. Candidate windows are extended to ten words around the anchor; what is not repeated goes.
3. Level 20. The survivors are compared in full; all but the first of equal windows are removed.

The texts are shuffled once, by doc_id. Documents with undecided windows carry their text, packed, to
the last step; all others are finished there. Hashes are 64 bits each and are compared in pairs
(anchor and run; ten words and window).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored
from .words import Words, ints, mix, pieces, shingles, window_hash, window_sums, words_of

LENGTH, BASE = 20, 5
#: An anchor in over one of so many sampled documents is dealt out by run instead of by anchor.
HEAVY_ONE_IN, SAMPLE_ONE_IN = 200, 32


def anchors(w: Words, h: np.ndarray, length: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of a piece and the position of each one's anchor (leftmost on ties)."""
    grams = shingles(h, base)
    span = length - base + 1
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at, done = grams, np.arange(len(grams)), 1
    while done < span:
        step = min(done, span - done)
        lower = least[step:] < least[:len(least) - step]
        at = np.where(lower, at[step:], at[:len(at) - step])
        least = np.minimum(least[step:], least[:len(least) - step])
        done += step
    start = np.flatnonzero(w.doc[length - 1:] == w.doc[:len(w.doc) - length + 1])
    return start, at[start]


def runs(w: Words, h: np.ndarray, length: int, base: int):
    """First window, number of windows, anchor hash and content hash of each run of a piece."""
    start, at = anchors(w, h, length, base)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    s, p = start[first], at[first]
    sums = window_sums(h)
    anchor = window_hash(sums, p, p + base)
    whole = mix(window_hash(sums, s, s + n - 1 + length) + (p - s).astype(np.uint64))
    return s, n, anchor, whole


def _again(key: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for every entry whose key has an entry that is earlier by (doc, start)."""
    order = np.lexsort((start, doc, key))
    if not len(order):
        return np.zeros(0, bool)
    k = key[order]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1])), np.arange(len(k)), 0))
    first = order[head]
    out = np.zeros(len(key), bool)
    out[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _heavy_anchors(docs: DataFrame, length: int, base: int) -> np.ndarray:
    """Anchors found in many sampled documents: fewer than 200 x anchors per document. They only
    decide how rows are dealt out; results do not depend on the sample."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = words_of(part)
                s, _, anchor, _ = runs(w, w.hashes(), length, base)
                pair = np.unique(np.stack([w.doc[s].astype(np.uint64), anchor], 1), axis=0)
                key, n = np.unique(pair[:, 1], return_counts=True)
                yield pa.RecordBatch.from_arrays([_longs(key), pa.array(n)], names=["anchor", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_ONE_IN)) == 0).select("doc_id", "text")
    size = sample.count()
    found = sample.mapInArrow(work, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") > max(20, size // HEAVY_ONE_IN)).select("anchor").collect()
    return np.sort(np.array([r.anchor for r in rows], np.int64).view(np.uint64))


def _run_rows(docs: DataFrame, length: int, base: int, heavy: np.ndarray) -> DataFrame:
    """deal, whole: keys; doc; at: start and count packed; state: 0 open, 1 settled here, 2 heavy."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                w = words_of(part)
                s, n, anchor, whole = runs(w, w.hashes(), length, base)
                if not len(s):
                    continue
                ids = ints(part, "doc_id").astype(np.int64)[w.doc[s]]
                s = s - w.first[w.doc[s]]
                again = _again(whole, ids, s)
                state = again.astype(np.int8)
                if len(heavy):
                    place = np.minimum(np.searchsorted(heavy, anchor), len(heavy) - 1)
                    state[(heavy[place] == anchor) & ~again] = 2
                deal = np.where(state == 0, anchor, mix(anchor ^ whole ^ np.where(again, mix(ids.view(np.uint64) + s.astype(np.uint64)), 0)))
                yield pa.RecordBatch.from_arrays(
                    [_longs(deal), _longs(whole), pa.array(ids), pa.array(s * 64 + n), pa.array(state)],
                    names=["deal", "whole", "doc_id", "at", "state"])

    return docs.mapInArrow(work, "deal long, whole long, doc_id long, at long, state byte")


def _ranges_to_mask(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, lo, 1)
    np.add.at(steps, hi, -1)
    return np.cumsum(steps[:-1]) > 0


def _finish(text: bytes, start: np.ndarray, end: np.ndarray, gone: np.ndarray) -> tuple[int, int, str, bytes]:
    """Number of words, number removed, digest and bytes of the kept words joined by one space."""
    if not gone.any():
        kept = b" ".join(text.split())
    else:
        keep = np.flatnonzero(~gone)
        kept = b" ".join([text[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())])
    return len(start), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept


_RESULT = "n_words long, n_removed long, kept_sha256 string, kept string"


def _first_look(listed: DataFrame, length: int, base: int, with_text: bool) -> DataFrame:
    """Finish what is decided; for the rest give the open windows (starts, ten-word and full hashes)."""
    half = length // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in pieces(batch):
                w = words_of(part)
                h, sums = w.hashes(), None
                ids = part.column(0).to_pylist()
                gone_lists, open_lists = part.column(2), part.column(3)
                rows, opened = [], []
                for i in range(part.num_rows):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    gone, cut = np.zeros(b - a, bool), gone_lists[i]
                    if cut.is_valid and len(cut.values):
                        at = cut.values.to_numpy()
                        gone = _ranges_to_mask(b - a, at // 64, at // 64 + at % 64 - 1 + length)
                    if open_lists[i].is_valid and len(open_lists[i].values):
                        at = open_lists[i].values.to_numpy()
                        n = at % 64
                        s = np.repeat(at // 64, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                        opened.append((i, s + a))
                    rows.append(gone)
                left, tens, full = {}, {}, {}
                if opened:
                    sums = window_sums(h)
                    s = np.concatenate([x for _, x in opened])
                    row = np.repeat([i for i, _ in opened], [len(x) for _, x in opened])
                    every, where = anchors(w, h, length, base)
                    p = where[np.searchsorted(every, s)]
                    ten = np.where(p - s <= length - half, p, p + base - half)
                    h10 = mix(window_hash(sums, ten, ten + half) + (ten - p).astype(np.uint64))
                    h20 = window_hash(sums, s, s + length)
                    key = np.array([x if x is not None else 0 for x in ids], np.int64)[row]
                    again = _again(h20, key, s - w.first[row])
                    to = 0
                    for i, x in opened:
                        mine, to = np.arange(to, to + len(x)), to + len(x)
                        for t in (s[mine[again[mine]]] - w.first[i]).tolist():
                            rows[i][t:t + length] = True
                        # a window whose words are all gone must still be known as an earlier occurrence
                        mine = mine[~again[mine]]
                        left[i], tens[i], full[i] = s[mine] - w.first[i], h10[mine], h20[mine]
                out = []
                raw = w.raw.tobytes()
                for i in range(part.num_rows):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    lo, hi = int(w.offsets[i]), int(w.offsets[i + 1])
                    if i in left and len(left[i]):
                        out.append((ids[i], None, None, None, None, pack(raw[lo:hi]), np.packbits(rows[i]).tobytes(),
                                    left[i].astype(np.int32), tens[i].view(np.int64), full[i].view(np.int64)))
                    else:
                        n, k, sha, kept = _finish(raw[lo:hi], w.start[a:b] - lo, w.end[a:b] - lo, rows[i])
                        out.append((ids[i], n, k, sha, kept.decode() if with_text else None, None, None, None, None, None))
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(),
                         pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[
                    "doc_id", "n_words", "n_removed", "kept_sha256", "kept", "packed", "mask", "starts", "tens", "fulls"])

    return listed.mapInArrow(
        work, f"doc_id long, {_RESULT}, packed binary, mask binary, starts array<int>, tens array<long>, fulls array<long>")


def _last_look(pending: DataFrame, length: int, with_text: bool) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = unpack(batch.column(1)[i].as_py())
                w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                gone = np.unpackbits(np.frombuffer(batch.column(2)[i].as_py(), np.uint8), count=len(w.start)).astype(bool)
                if batch.column(3)[i].is_valid:
                    s = batch.column(3)[i].values.to_numpy().astype(np.int64)
                    gone |= _ranges_to_mask(len(gone), s, s + length)
                n, k, sha, kept = _finish(text, w.start, w.end, gone)
                out.append((batch.column(0)[i].as_py(), n, k, sha, kept.decode() if with_text else None))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return pending.mapInArrow(work, f"doc_id long, {_RESULT}")


def substring_dedup(docs: DataFrame, length: int = LENGTH, base: int = BASE, with_text: bool = True) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256[, kept]), one for each document.

    A word is removed if a window of ``length`` words that covers it also starts earlier: in a smaller
    doc_id, or earlier in the same document. Windows are judged on the input. ``kept`` joins the words
    that stay by one space. Null, empty and short texts have no windows and lose nothing. Texts of any
    length are handled whole. Rows without a doc_id are compared with nothing and returned unchanged;
    rows that repeat a doc_id must repeat the text, and each loses the same words. Further columns are
    ignored. ``length`` must be four times ``base``.
    """
    if length != 4 * base:
        raise ValueError("length must be four times base: the levels are base, twice and four times base")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where(F.col("doc_id").isNotNull())
    found = _run_rows(known, length, base, _heavy_anchors(known, length, base))
    by_deal, by_run = Window.partitionBy("deal"), Window.partitionBy("deal", "whole").orderBy("doc_id", "at")
    judged = (
        found.withColumn("lo", F.min("whole").over(by_deal)).withColumn("hi", F.max("whole").over(by_deal))
        .withColumn("turn", F.rank().over(by_run))
        .withColumn("gone", (F.col("state") == 1) | (F.col("turn") > 1))
        .where("gone or state = 2 or lo <> hi")
    )
    lists = judged.groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("gone"), F.col("at"))).alias("cut"), F.collect_set(F.when(~F.col("gone"), F.col("at"))).alias("open"))
    first = stored(_first_look(docs.join(lists, "doc_id", "left").select("doc_id", "text", "cut", "open"), length, base, with_text), "windows")

    windows = (
        first.where("packed is not null").select("doc_id", F.inline(F.arrays_zip("starts", "tens", "fulls")))
        .toDF("doc_id", "start", "ten", "full")
    )
    tens = windows.groupBy("ten").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ten")
    alive = windows.join(tens, "ten")
    repeats = alive.withColumn("turn", F.rank().over(Window.partitionBy("ten", "full").orderBy("doc_id", "start"))).where("turn > 1")
    cuts = repeats.groupBy("doc_id").agg(F.collect_set("start").alias("cut"))
    pending = first.where("packed is not null").select("doc_id", "packed", "mask").join(cuts, "doc_id", "left")
    done = first.where("packed is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
    out = done.union(_last_look(pending, length, with_text))
    return out if with_text else out.drop("kept")
