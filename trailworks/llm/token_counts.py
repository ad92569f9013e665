"""Token counts by byte-pair merging with a heap and a linked list; no token ids are made.

A text is cut at the special strings of the tokenizer and then into pre-tokens by its own pattern.
Each pre-token is counted alone: its bytes form a doubly linked list, a heap holds the adjacent pairs
that have a rank, the lowest rank (leftmost on ties) is popped and merged again and again. The count
is the number of bytes less the number of merges, n log n for a pre-token of any length. Counts of
pre-tokens are remembered by the worker, within a bound.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces, texts_of

LIMIT = 512
#: Most pre-tokens remembered by a worker, and the longest one that is.
MEMORY, MEMORY_LENGTH = 400_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes.

    Bytes that print stand for themselves, the others take the code points from 256 on in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairCounter:
    """Counts the tokens of texts for a byte-level vocabulary file of the tokenizers library."""

    #: The pre-token pattern of byte-level vocabularies (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    #: Below U+0250 and in general punctuation, all Unicode versions agree on the classes of the pattern.
    SETTLED = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or pre["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        alphabet = byte_alphabet()
        token_bytes = lambda t: bytes(alphabet[c] for c in t)
        self.symbol = {token_bytes(t): i for t, i in model["vocab"].items()}
        self.single = [self.symbol[bytes([b])] for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: (left, right) as one integer -> (rank, merged symbol)
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = token_bytes(a), token_bytes(b)
            self.ranks[self.symbol[a] << 32 | self.symbol[b]] = (rank, self.symbol[a + b])
        self.split = regex.compile(self.PATTERN).findall
        self.library = Tokenizer.from_file(path).pre_tokenizer
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens must match as they stand")
        names = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.alphabet = alphabet
        self.known: dict[str, int] = {}

    def merges(self, symbols: list[int]) -> int:
        """Number of merges that byte-pair encoding makes."""
        n, ranks = len(symbols), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] << 32 | symbols[i + 1]
            found = ranks.get(pair)
            if found:
                heap.append((found[0], i, pair, found[1]))
        if not heap:
            return 0
        heapify(heap)
        made = 0
        while heap:
            _, i, pair, merged = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] << 32 | symbols[j] != pair:      # one side has changed since
                continue
            made += 1
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get(pair := merged << 32 | symbols[k])
                if found:
                    heappush(heap, (found[0], i, pair, found[1]))
            k = before[i]
            if k >= 0:
                found = ranks.get(pair := symbols[k] << 32 | merged)
                if found:
                    heappush(heap, (found[0], k, pair, found[1]))
        return made

    def count_piece(self, piece: str) -> int:
        """Tokens of one pre-token."""
        raw = piece.encode()
        single = self.single
        return len(raw) - (self.merges([single[b] for b in raw]) if len(raw) > 1 else 0)

    def _missing(self, words: list[str]) -> int:
        known, total = self.known, 0
        for w in words:
            n = known.get(w)
            if n is None:
                n = self.count_piece(w)
                if len(w) <= MEMORY_LENGTH:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[w] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        if self.SETTLED.fullmatch(text):
            words = self.split(text)
            try:
                return sum(map(self.known.__getitem__, words))
            except KeyError:
                return self._missing(words)
        # the library's own pattern engine decides on rarer characters; its pieces come as stand-ins
        alphabet = self.alphabet
        total = 0
        for piece, _ in self.library.pre_tokenize_str(text):
            total += self._missing([bytes(alphabet[c] for c in piece).decode()])
        return total

    def count(self, text: str) -> int:
        """Tokens of a text; special strings inside are one token each."""
        if not self.special or not self.special.search(text):
            return self._plain(text) if text else 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


@lru_cache(maxsize=2)
def counter(path: str) -> PairCounter:
    """One counter per worker process and file."""
    return PairCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of ``docs``.

    Null and empty texts have 0 bytes and tokens. Whole texts are counted, however long. Rows are
    worked on alone, so repeated rows and null ids are returned as they are; further columns are
    ignored. ``path`` must be readable on every executor, as tokenizer files that are installed are.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            for part in pieces(batch):
                texts = texts_of(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"])

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(work, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
