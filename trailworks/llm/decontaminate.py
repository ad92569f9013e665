"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of lower-cased (A-Z) words. A document holds an item if a window of it
is within k word edits of the item (insertion, deletion, replacement), one for every five of its n
words. Such a window has n - k to n + k words; on demand only windows of n words count.

1. Which windows are looked at: a window within k edits of an item of n words shares at least
   n - q + 1 - k q of its q-word shingles, so starts whose next n + k words (or as many as the
   document has) share fewer are passed over. That bound loses nothing.
2. Each remaining window, and each item, is embedded: a random walk reads the words one by one,
   writes the current one and moves on or stays by a random bit of the word, 2 (n - k) steps in all,
   which both texts normally fill. Few edits give few differing steps. A sample of the steps is the
   bucket key; ``WALKS`` independent walks with ``SAMPLES`` samples each are drawn. The samples of a walk
   are ``GAP`` steps apart: near enough to lie between the same two edits, and words enough that
   frequent ones do not fill a bucket.
3. Windows that share a bucket with an item are checked by the exact edit distance, with a free end.

Items of more than ``LONG`` words have thousands of windows around a match, nearly alike. Of their windows
in a row every k/8-th is embedded, which shifts a match by a sixteenth of the allowed edits, and one
alignment with both ends free checks all of them.

Items are handed to the tasks in blocks of bounded size; a document is in one task as a whole, so
nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, pieces, shingles, words_of

#: One edit for so many words of an item.
WORDS_PER_EDIT = 5
WALKS, SAMPLES, GAP = 128, 3, 3
#: Items of more words are looked for with fewer windows and one alignment for many.
LONG = 256
#: Most bytes of items handed to the tasks at once; larger benchmarks take several passes.
BLOCK_BYTES = 16 << 20
#: Windows, and words of windows, worked on at once.
_WINDOWS, _WORDS = 1 << 11, 1 << 18
#: Walks times windows embedded at once.
_CELLS = 1 << 18
_PAD, _FRONT = np.uint64(0x7F4A7C15F39CC060), np.uint64(0x94D049BB133111EB)


def allowed(n: int) -> int:
    return n // WORDS_PER_EDIT


def shingle_rule(n: int) -> tuple[int, int]:
    """Size of the shingles for an item of n words, and how many a window must share."""
    for q in (3, 2, 1):
        if (need := n - q + 1 - allowed(n) * q) >= 1:
            return q, need
    return 1, 1


def walks(windows: np.ndarray, n: int) -> np.ndarray:
    """Bucket keys (WALKS x rows) of items of n words, or of windows for them (rows x words, padded)."""
    some = max(1, _CELLS // WALKS)
    return np.concatenate([_walks(windows[lo:lo + some], n) for lo in range(0, len(windows), some)], axis=1)


def _walks(windows: np.ndarray, n: int) -> np.ndarray:
    rows, width = windows.shape
    rng = np.random.default_rng(n)
    inside = 2 * (n - allowed(n))       # a walk takes about two steps a word; later ones read padding
    first = rng.integers(0, max(1, inside - GAP * (SAMPLES - 1)), WALKS)
    due = defaultdict(list)
    for r, step in enumerate(first.tolist()):
        for k in range(SAMPLES):
            due[step + GAP * k].append((r, k))
    words = np.concatenate([windows, np.full((rows, 1), _PAD)], axis=1).ravel()
    base = np.arange(rows) * (width + 1)
    own = np.arange(WALKS, dtype=np.uint64)
    at, seen = np.zeros((WALKS, rows), np.int64), np.empty((WALKS, SAMPLES, rows), np.uint64)
    for step in range(max(due) + 1):
        now = words[at + base]
        for r, k in due.get(step, ()):
            seen[r, k] = now[r]
        # a random bit of the word for each walk and step; the padding stays
        bit = mix(now ^ mix((own << np.uint64(40)) + np.uint64(step))[:, None]) >> np.uint64(63)
        at += np.where(now == _PAD, np.uint64(0), bit).view(np.int64)
    keys = np.broadcast_to(own[:, None], (WALKS, rows))
    for k in range(SAMPLES):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + seen[:, k])
    return keys


def edit_distances(x: np.ndarray, y: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of any first ``least`` or more words of each row of x to the same row of y, and how many words.

    Of equally good numbers of words the smallest is given, so the padding of a row is never among them.
    """
    rows, n = y.shape
    last = np.broadcast_to(np.arange(n + 1), (rows, n + 1)).astype(np.int32)
    order = np.arange(n + 1, dtype=np.int32)
    best, size = np.full(rows, np.iinfo(np.int32).max, np.int32), np.zeros(rows, np.int64)
    for i in range(x.shape[1]):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(last[:, :-1] + (y != x[:, i:i + 1]), last[:, 1:] + 1)
        last = np.minimum.accumulate(now - order, axis=1) + order       # insertions run along the row
        if i + 1 >= least:
            better = last[:, -1] < best
            best[better], size[better] = last[better, -1], i + 1
    return best, size


def best_window(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(edits, first word, words) of the window of ``text`` nearest to ``item``, the first and shortest on ties.

    One alignment with both ends of the text free. A cell is edits and start in one number, so the smaller
    number is the better cell; a row of cells is one array operation.
    """
    edit, order = np.int64(1 << 32), np.arange(len(text) + 1, dtype=np.int64)
    last = order.copy()
    for word in item:
        now = last + edit
        now[1:] = np.minimum(now[1:], last[:-1] + np.where(text == word, np.int64(0), edit))
        last = np.minimum.accumulate(now - order * edit) + order * edit       # insertions run along the text
    end = int(last.argmin())
    edits, start = divmod(int(last[end]), 1 << 32)
    return edits, start, end - start


@dataclass
class Size:
    """All items of one number of words."""

    n: int
    slack: int
    q: int
    need: int
    words: np.ndarray
    ids: np.ndarray
    shingles: np.ndarray
    buckets: list

    def bucket_pairs(self, windows: np.ndarray) -> np.ndarray:
        """window * items + item of all pairs that share a bucket."""
        left, right = [], []
        for mine, (keys, order) in zip(walks(windows, self.n), self.buckets):
            a, b = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            hit = np.flatnonzero(b > a)
            count = (b - a)[hit]
            left.append(np.repeat(hit, count))
            right.append(order[np.repeat(a[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)])
        return np.unique(np.concatenate(left) * len(self.ids) + np.concatenate(right))

    @property
    def together(self) -> int:
        """Windows worked on at once."""
        return max(1, min(_WINDOWS, _WORDS // (self.n + self.slack)))

    def matches(self, windows: np.ndarray, real: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(window, item, edits, words) of all pairs in one bucket within the allowed edits, counted in ``real``."""
        pairs = self.bucket_pairs(windows)
        for at in range(0, len(pairs), self.together):
            x, y = np.divmod(pairs[at:at + self.together], len(self.ids))
            d, size = edit_distances(real[x], self.words[y], self.n - self.slack)
            good = d <= allowed(self.n)
            yield from zip(x[good].tolist(), self.ids[y[good]].tolist(), d[good].tolist(), size[good].tolist())


class Items:
    """The benchmark side: items by size, their shingles and their buckets."""

    def __init__(self, rows: list[tuple[int, str]], any_size: bool):
        batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.string())], names=["text"])
        w = words_of(batch, lower=True)
        h = w.hashes()
        by_size = defaultdict(list)
        for k, (item, _) in enumerate(rows):
            if w.counts[k]:
                by_size[int(w.counts[k])].append((item, h[w.first[k]:w.first[k + 1]]))
        self.sizes = []
        for n, members in sorted(by_size.items()):
            q, need = shingle_rule(n)
            words = np.stack([x for _, x in members])
            own = [np.unique(shingles(x, q)) for x in words]
            made = np.unique(np.concatenate(own))
            # distinct shingles are counted; an item that repeats some may share fewer
            need = max(1, need - max(n - q + 1 - len(x) for x in own))
            buckets = []
            for keys in walks(words, n):
                order = np.argsort(keys, kind="stable")
                buckets.append((keys[order], order))
            self.sizes.append(Size(n, allowed(n) if any_size else 0, q, need, words, np.array([i for i, _ in members], np.int64), made, buckets))
        # shingle -> the sizes that have it, as one sorted table for each shingle size
        self.tables = {}
        for q in {s.q for s in self.sizes}:
            own = [(s, k) for k, s in enumerate(self.sizes) if s.q == q]
            key = np.concatenate([s.shingles for s, _ in own])
            of = np.concatenate([np.full(len(s.shingles), k) for s, k in own])
            order = np.argsort(key, kind="stable")
            known = np.zeros(1 << 20, bool)
            known[key >> np.uint64(44)] = True
            self.tables[q] = (key[order], of[order], known)

    def find(self, batch: pa.RecordBatch) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) -> (edits, first word, words) of the best window, the first on ties."""
        w = words_of(batch, lower=True)
        h = w.hashes()
        hits: dict[int, np.ndarray] = {}
        self.grams: dict[int, np.ndarray] = {}
        for q, (key, of, known) in self.tables.items():
            grams = self.grams[q] = shingles(h, q)
            at = np.flatnonzero(known[grams >> np.uint64(44)])
            at = at[w.doc[at] == w.doc[at + q - 1]]
            a, b = np.searchsorted(key, grams[at], "left"), np.searchsorted(key, grams[at], "right")
            count = b - a
            pos = np.repeat(at, count)
            size = of[np.repeat(a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            for k in np.unique(size):
                hits[int(k)] = pos[size == k]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, pos in hits.items():
            s = self.sizes[k]
            start = self._starts(w, pos, s) if len(pos) >= s.need else pos[:0]
            if not len(start):
                continue
            if s.slack and s.n > LONG:
                self._find_long(w, h, start, s, found)
                continue
            # a match that lacks the item's first words may begin its document: there windows with as many words put before
            # it are walked too, as in the middle of a document by the windows that begin earlier
            row = w.doc[start]
            lead = row[start == w.first[row]]
            start = np.concatenate([start, (w.first[lead][:, None] - np.arange(1, s.slack + 1)).ravel()])
            row = np.concatenate([row, np.repeat(lead, s.slack)])
            for lo in range(0, len(start), s.together):
                some, of = start[lo:lo + s.together], row[lo:lo + s.together]
                first, end = w.first[of], w.first[of + 1]
                real = self._cut(h, np.maximum(some, first), first, end, s)
                for x, item, d, size in s.matches(self._cut(h, some, first, end, s), real):
                    best = (d, max(int(some[x] - first[x]), 0), size)
                    if found.get((int(of[x]), item), best) >= best:
                        found[int(of[x]), item] = best
        return found

    def _find_long(self, w, h: np.ndarray, start: np.ndarray, s: Size, found: dict) -> None:
        """Items of many words: starts in a row are sampled for the buckets and aligned together."""
        step = max(1, s.slack // 8)
        row = w.doc[start]
        cut = np.flatnonzero((np.diff(start) > step) | (np.diff(row) != 0)) + 1
        for run in np.split(start, cut):
            # a run is taken in parts as long as an item, so that an alignment is bounded by the item
            for lo in range(0, len(run), s.n):
                part = run[lo:lo + s.n]
                of = int(w.doc[part[0]])
                first, end = int(w.first[of]), int(w.first[of + 1])
                some = np.unique(np.append(part[::step], part[-1]))
                if part[0] == first:
                    some = np.concatenate([first - np.arange(step, s.slack + 1, step), some])
                items = set()
                for at in range(0, len(some), s.together):
                    windows = self._cut(h, some[at:at + s.together], np.full(1, first), np.full(1, end), s)
                    items |= set((s.bucket_pairs(windows) % len(s.ids)).tolist())
                text = h[part[0]:min(end, int(part[-1]) + s.n + s.slack)]
                for k in sorted(items):
                    edits, at, size = best_window(text, s.words[k])
                    best = (edits, int(part[0]) - first + at, size)
                    if edits <= allowed(s.n) and size >= s.n - s.slack and found.get((of, int(s.ids[k])), best) >= best:
                        found[of, int(s.ids[k])] = best

    @staticmethod
    def _cut(h: np.ndarray, start: np.ndarray, first: np.ndarray, end: np.ndarray, s: Size) -> np.ndarray:
        """Windows of s.n + s.slack words from each start, filled up outside of their documents."""
        at = start[:, None] + np.arange(s.n + s.slack)
        windows = np.where(at < end[:, None], h[np.clip(at, 0, len(h) - 1)], _PAD)
        return np.where(at < first[:, None], _FRONT, windows)

    def _starts(self, w, pos: np.ndarray, s: Size) -> np.ndarray:
        """Starts of windows of s.n + s.slack words that hold s.need distinct shingles of items of size s.n.

        Windows end with their document; s.n - s.slack words at least must be left.
        """
        pos = np.sort(pos)
        gram = self.grams[s.q][pos]
        order = np.lexsort((pos, gram))
        last = np.full(len(pos), -1)
        same = gram[order][1:] == gram[order][:-1]
        last[order[1:][same]] = pos[order[:-1][same]]
        # a hit is the first of its kind in the windows that start after the one before it
        begin = np.maximum(np.maximum(last + 1, pos - (s.n + s.slack - s.q)), w.first[w.doc[pos]])
        edge = np.concatenate([begin, pos + 1])
        step = np.concatenate([np.ones(len(pos), np.int64), np.full(len(pos), -1)])
        order = np.argsort(edge, kind="stable")
        edge, held = edge[order], np.cumsum(step[order])
        enough = np.flatnonzero((held[:-1] >= s.need) & (edge[1:] > edge[:-1]))
        n = edge[enough + 1] - edge[enough]
        start = np.repeat(edge[enough], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return start[start + s.n - s.slack <= w.first[w.doc[start] + 1]]


_LAST: list = []


def _items(spread, any_size: bool) -> Items:
    """The items of a broadcast, made once in a worker process."""
    key = (any_size, spread.value)
    if not _LAST or _LAST[0] != key:
        _LAST[:] = [key, Items(spread.value, any_size)]
    return _LAST[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, any_size: bool = False) -> DataFrame:
    """Rows (doc_id, item_id, edits, first_word, n_words): the best window of each item in each document.

    Edits count words; ``first_word`` counts from 0. Null, empty and blank texts and items match
    nothing, as do rows with a null item_id. With ``any_size`` windows of k words less to k words more
    than the item are looked at, for k allowed edits, also where a document is shorter than the item;
    else only windows of just the item's size. Rows without a doc_id are searched and returned with a null; rows that repeat a
    doc_id are searched each and give one row for each item. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, item_id long, edits int, first_word long, n_words int"
    found = [_one_block(docs, rows, kinds, any_size) for rows in _blocks(benchmark, block_bytes)]
    if len(found) == 1:
        return found[0]
    out = docs.sparkSession.createDataFrame([], kinds)
    for some in found:
        out = out.union(some)
    best = F.min(F.struct("edits", "first_word", "n_words"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("t")).select("doc_id", "item_id", "t.*")


def without_items(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, any_size: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item. Nothing is shuffled."""
    kinds = docs.schema
    for rows in _blocks(benchmark, block_bytes):
        spread = docs.sparkSession.sparkContext.broadcast(rows)

        def work(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            items = _items(spread, any_size)
            for batch in batches:
                for part in pieces(batch):
                    keep = np.ones(part.num_rows, bool)
                    keep[[row for row, _ in items.find(part)]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(work, kinds)
    return docs


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``, split by hash."""
    rows = benchmark.where("item_id is not null and length(trim(text)) > 0").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes)
    for block in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield sorted((r[0], r[1]) for r in some.collect())


def _one_block(docs: DataFrame, rows: list[tuple[int, str]], kinds: str, any_size: bool) -> DataFrame:
    spread = docs.sparkSession.sparkContext.broadcast(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(spread, any_size)
        for batch in batches:
            for part in pieces(batch):
                found = sorted(items.find(part).items())
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r] for (r, _), _ in found], pa.int64()), pa.array([i for (_, i), _ in found], pa.int64()),
                    pa.array([t[0] for _, t in found], pa.int32()), pa.array([t[1] for _, t in found], pa.int64()),
                    pa.array([t[2] for _, t in found], pa.int32())], names=["doc_id", "item_id", "edits", "first_word", "n_words"])

    return docs.mapInArrow(work, kinds)
