"""Words of whole Arrow columns of text, as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. All functions work on the
concatenated bytes of many texts at once, so no Python code runs per row or per word.
Hashes are 64 bits: a polynomial in a random table of the bytes, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; the work arrays take about 60 bytes for each. A longer text is one piece.
PIECE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_WORD_BASE = 0xD1B54A32D192ED03


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i up to n, at least; a worker keeps the longest tables asked for."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        log_size, made = max(12, int(n).bit_length()), []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1 << log_size, np.uint64)
            for k in range(log_size):       # p[2^k : 2^(k+1)] = p[:2^k] * b^(2^k)
                p[1 << k: 2 << k] = p[:1 << k] * _U(pow(b, 1 << k, 1 << 64))
            made.append(p)
        _POWERS[base] = made[0], made[1]
    return _POWERS[base]


class Words:
    """The words of a piece of a text column.

    data: bytes; start, end: of each word; doc: row in the piece; first: index of each row's
    first word, with the number of words at the end; h: 64-bit hash of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.n_docs = len(offsets) - 1
        self.raw, self.offsets = data, offsets
        data = _LOWER[data] if lower else data
        self.data = data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(_SPACE[data], out=inside[1:-1])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        here, before, after = inside[1:-1], inside[:-2], inside[2:]
        self.start = np.flatnonzero(here & (~before | edge[:-1]))
        self.end = np.flatnonzero(here & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        p, q = powers(_BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * p[:n], out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * q[self.start]
        return mix(h + (self.end - self.start).astype(np.uint64))

    def total(self, of_byte: np.ndarray) -> np.ndarray:
        """Sum over each word of a small number per byte value."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(of_byte[self.raw], out=sums[1:])
        return sums[self.end] - sums[self.start]


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive entries of ``h``; one entry fewer per step of size."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for k in range(1, size):
        g = g * _U(_WORD_BASE) + h[k:k + n]
    return mix(g)


def window_sums(h: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``window_hash`` takes the hash of any range of words."""
    p, _ = powers(_WORD_BASE, len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * p[:len(h)], out=sums[1:])
    return sums


def window_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, q = powers(_WORD_BASE, len(sums))
    return mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    _, ends, data = col.buffers()
    if len(col) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(ends, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets * 0
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def words_of(batch: pa.RecordBatch, text: str = "text", lower: bool = False) -> Words:
    return Words(*column_bytes(batch.column(batch.schema.get_field_index(text))), lower=lower)


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.to_numpy(zero_copy_only=False)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Texts as Python strings; null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
