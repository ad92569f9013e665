"""SentencePiece models: offset-preserving normalisation, byte-pair encoding and decoding.

The model file is read here. Normalisation looks up the longest prefix of the remaining text in the
compiled character map (a double-array trie) and records for every normalised byte the source byte it
comes from; that alignment projects each piece back to a span of the original bytes. Segments between
word boundaries, across which no piece of the vocabulary reaches, are encoded once and remembered by
the worker, within a bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from struct import pack, unpack, unpack_from

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces, texts_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Most segments remembered by a worker, and the longest one that is.
MEMORY, MEMORY_LENGTH = 400_000, 48
#: Segments of up to so many characters are merged by scanning a list.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_SHORT, _NEVER = 40, float("inf")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at:at + n]
            at += n


class CharacterMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes):
        size = unpack_from("<I", blob)[0] if blob else 0
        self.units = unpack(f"<{size // 4}I", blob[4:4 + size]) if blob else ()
        self.texts = blob[4 + size:]
        self.first = {b for b in range(256) if self._step(self._root(), b) is not None} if blob else set()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _root(self) -> int:
        return self._offset(self.units[0])

    def _step(self, at: int, byte: int) -> int | None:
        at ^= byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, raw: bytes, start: int) -> tuple[bytes, int] | None:
        """Replacement and source length of the longest key at ``start``."""
        if raw[start] not in self.first:
            return None
        found, node, at = None, self._root(), start
        while at < len(raw) and (place := self._step(node, raw[at])) is not None:
            at += 1
            unit = self.units[place]
            node = place ^ self._offset(unit)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, at - start)
        if not found:
            return None
        value, n = found
        return self.texts[value:self.texts.index(b"\0", value)], n


class PieceModel:
    """A byte-pair model file of the sentencepiece library."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._read(f.read())

    @classmethod
    def of_bytes(cls, raw: bytes) -> PieceModel:
        model = cls.__new__(cls)
        model._read(raw)
        return model

    def _read(self, raw: bytes) -> None:
        self.piece, self.score, self.kind = [], [], []
        trainer, normal = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                own = dict(_fields(value))
                self.piece.append(own[1].decode())
                self.score.append(unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kind.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        self.map = CharacterMap(normal.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        self.byte_pair = trainer.get(3, 1) == 2
        self.fallback = bool(trainer.get(35, 0))
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.bos = next((i for i, p in enumerate(self.piece) if p == trainer.get(46, b"<s>").decode()), -1)
        self.eos = next((i for i, p in enumerate(self.piece) if p == trainer.get(47, b"</s>").decode()), -1)
        self.unk = next((i for i, k in enumerate(self.kind) if k == UNKNOWN), 0)
        self.id = {p: i for i, p in enumerate(self.piece) if self.kind[i] in (NORMAL, USER, UNUSED)}
        self.cost = {p: -self.score[i] for p, i in self.id.items()}
        self.size = [len(p.encode()) for p in self.piece]
        self.unused = {p for p, i in self.id.items() if self.kind[i] == UNUSED}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.kind[i] == BYTE}
        self.byte_of = {i: b for b, i in self.byte.items()}
        fixed = sorted((p for p, i in self.id.items() if self.kind[i] == USER), key=len, reverse=True)
        self.fixed = re.compile("|".join(map(re.escape, fixed))) if fixed else None
        reaching = any(SPACE in p.lstrip(SPACE) for p in self.id)
        # where no piece joins letters to anything else, segments also end between the two
        bodies = [p.lstrip(SPACE) for p in self.id]
        apart = all(re.fullmatch(f"[{_LETTERS}]*|[^{_LETTERS}]*", b) for b in bodies)
        pattern = f"{SPACE}*[{_LETTERS}]+|{SPACE}*[^{SPACE}{_LETTERS}]+|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.segments = None if reaching or fixed else re.compile(pattern).findall
        self.plain = not self.map.units and not self.squeeze and self.escape and not self.suffix and not fixed
        self.joined = [p.replace(SPACE, " ").encode() if k in (NORMAL, USER, UNUSED) else bytes([self.byte_of[i]]) if k == BYTE
                       else self.unknown_text.encode() if k == UNKNOWN else b"\xff" for i, (p, k) in enumerate(zip(self.piece, self.kind))]
        self.known: dict[str, bytes] = {}
        self.is_byte = np.array([k == BYTE for k in self.kind])
        self.byte_at = np.array([self.byte_of.get(i, 0) for i in range(len(self.piece))], np.int64)
        self.width = np.array([0 if k == BYTE else n for n, k in zip(self.size, self.kind)], np.int64)

    # -- normalisation --------------------------------------------------------------------------

    def _prefix(self, raw: bytes, at: int, text_at: dict[int, int] | None) -> tuple[bytes, int]:
        if text_at and (n := text_at.get(at)):
            return raw[at:at + n], n
        if self.map.units and (found := self.map.longest(raw, at)):
            return found
        lead = raw[at]
        n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
        return raw[at:at + n], n

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each of them, and for the end, the source byte it comes from."""
        raw = text.encode("utf-8", "replace")
        marks = None
        if self.fixed:
            marks = {len(text[:m.start()].encode()): len(m[0].encode()) for m in self.fixed.finditer(text)}
        out, source, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(raw):
                made, n = self._prefix(raw, at, marks)
                if made != b" ":
                    break
                at += n
        if at >= len(raw):
            return b"", [at]
        space = SPACE.encode() if self.escape else b" "

        def add(piece: bytes) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        if self.prefix and not self.suffix:
            add(space)
        after_space = self.squeeze
        while at < len(raw):
            made, n = self._prefix(raw, at, marks)
            if after_space:
                made = made.lstrip(b" ")
            if made:
                for b in made:
                    add(space if b == 32 else bytes([b]))
                after_space = made.endswith(b" ")
            at += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(space):
                at = source[len(out) - len(space)]
                del out[-len(space):], source[-len(space):]
        if self.prefix and self.suffix:
            add(space)
        source.append(at)
        return bytes(out), source

    # -- encoding -------------------------------------------------------------------------------

    def _merged_short(self, symbols: list[str]) -> list[str]:
        """The same for a few symbols: the costs of all adjacent pairs are kept in a list and scanned."""
        find = self.cost.get
        costs = [find(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        while costs:
            least = min(costs)
            if least == _NEVER:
                break
            i = costs.index(least)
            both = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del costs[i]
            if i < len(costs):
                costs[i] = find(both + symbols[i + 1], _NEVER)
            if i:
                costs[i - 1] = find(symbols[i - 1] + both, _NEVER)
        return symbols

    def _merged(self, symbols: list[str], frozen: set[int]) -> list[str]:
        """Byte-pair merges, best score first and leftmost on ties; frozen symbols take no part."""
        n, find, cost = len(symbols), self.cost.get, None
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap, halves = [], {}
        for i in range(n - 1):
            both = symbols[i] + symbols[i + 1]
            cost = find(both)
            if cost is not None and not (frozen and (i in frozen or i + 1 in frozen)):
                heap.append((cost, i, both))
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = after[i]
            if j >= n or not symbols[i] or symbols[i] + symbols[j] != both:      # one side has changed since
                continue
            if both in self.unused:
                halves[both] = (symbols[i], symbols[j])
            symbols[i], symbols[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                more = both + symbols[k]
                cost = find(more)
                if cost is not None and not (frozen and k in frozen):
                    heappush(heap, (cost, i, more))
            k = before[i]
            if k >= 0:
                more = symbols[k] + both
                cost = find(more)
                if cost is not None and not (frozen and k in frozen):
                    heappush(heap, (cost, k, more))

        def split(p: str) -> list[str]:       # unused pieces fall apart again
            return [p] if p not in halves else [y for x in halves[p] for y in split(x)]

        return [y for x in symbols if x for y in (split(x) if halves else (x,))]

    def _encode_segment(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and normalised byte lengths of a stretch of normalised text."""
        symbols, frozen = [], set()
        at = 0
        for m in (self.fixed.finditer(text) if self.fixed else ()):
            symbols += text[at:m.start()]
            frozen.add(len(symbols))
            symbols.append(m[0])
            at = m.end()
        symbols += text[at:]
        if len(symbols) <= _SHORT and not frozen and not self.unused:
            merged = self._merged_short(symbols)
        else:
            merged = self._merged(symbols, frozen)
        out, sizes = [], []
        for p in merged:
            k = self.id.get(p)
            if k is not None:
                out.append(k)
                sizes.append(self.size[k])
                continue
            raw = p.encode()
            if self.fallback:
                out += [self.byte[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            elif out and out[-1] == self.unk:
                sizes[-1] += len(raw)
            else:
                out.append(self.unk)
                sizes.append(len(raw))
        return out, sizes

    def _packed(self, segment: str) -> bytes:
        ids, _ = self._encode_segment(segment)
        return pack(f"<{len(ids)}I", *ids)

    def _remember(self, segments: list[str]) -> list[bytes]:
        known, every = self.known, set(segments)
        if len(known) + len(every) > MEMORY:
            known.clear()
        fresh = {s: self._packed(s) for s in every.difference(known)}
        known.update(fresh)
        out = list(map(known.__getitem__, segments))
        for s in fresh:
            if len(s) > MEMORY_LENGTH:
                del known[s]
        return out

    def _sizes(self, ids: np.ndarray) -> np.ndarray:
        """Normalised byte lengths of ids made with byte fallback: a character's bytes count at its last."""
        out = self.width[ids]
        at = np.flatnonzero(self.is_byte[ids])
        if len(at):
            b = self.byte_at[ids[at]]
            lead = (b < 128) | (b >= 192)
            n = 1 + (b >= 192) + (b >= 224) + (b >= 240)
            out[at[lead] + n[lead] - 1] = n[lead]
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids without begin and end, and the source byte span of each piece.

        The bytes of a character that the vocabulary lacks are pieces of their own: the last spans the
        character, those before are empty spans at its start.
        """
        if not self.byte_pair:
            raise ValueError("only byte-pair models are supported")
        if self.plain:
            normal, source = (SPACE if self.prefix else "") + text.replace(" ", SPACE) if text else "", None
        else:
            raw, source = self.normalise(text)
            normal = raw.decode("utf-8", "replace")
        if self.segments and self.fallback:
            parts = self.segments(normal)
            try:
                got = list(map(self.known.__getitem__, parts))
            except KeyError:
                got = self._remember(parts)
            ids = np.frombuffer(b"".join(got), "<u4")
            sizes = self._sizes(ids)
        else:
            a, b = self._encode_segment(normal)
            ids, sizes = np.array(a, "<u4"), np.array(b, np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        if source is not None:
            source = np.array(source, np.int64)
            return ids, source[begins], source[ends]
        # identity map: a space is written in three bytes, and the prefix has no source
        written = np.frombuffer(normal.encode(), np.uint8)
        marks = np.zeros(len(written) + 1, np.int64)
        if len(written) > 2:
            lead = (written[:-2] == 0xE2) & (written[1:-1] == 0x96) & (written[2:] == 0x81)
            at = np.flatnonzero(lead)
            raw = np.frombuffer(text.encode(), np.uint8)
            # marks that stand for a space shrink to one byte; a mark of the text itself keeps three
            if len(at) and self.prefix:
                marks[at[0] + 3] = 3
                at = at[1:]
            if SPACE in text:
                chars = [c for c in text if c in (" ", SPACE)]
                at = at[np.array([c == " " for c in chars], bool)]
            marks[at + 3] += 2
            place = np.arange(len(written) + 1) - np.cumsum(marks)
            return ids, np.clip(place[begins], 0, len(raw)), np.clip(place[ends], 0, len(raw))
        return ids, begins, ends

    # -- decoding -------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8; begin and end ids give nothing."""
        every = ids.tolist()
        while every and self.kind[every[-1]] == CONTROL:
            every.pop()
        lead = next((k for k, i in enumerate(every) if self.kind[i] != CONTROL), None)
        if lead is None:
            return b""
        every = every[lead:]
        first = every[0]
        strips = self.prefix or self.squeeze
        if not (self.squeeze or self.kind[first] != NORMAL or (strips and not self.piece[first].startswith(SPACE))):
            joined = b"".join(map(self.joined.__getitem__, every))
            joined = joined[1:] if strips else joined
            # bytes that make no text, or a begin or end id between them (0xff), are sorted out below
            try:
                joined.isascii() or joined.decode()
                return joined
            except UnicodeDecodeError:
                pass
        out, run, at_start, seen = bytearray(), bytearray(), strips, False

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.extend(run[at:at + n].decode().encode())
                        if len(run[at:at + n]) == n:
                            break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.extend("�".encode())
                    n = 1
                at += n
            run.clear()

        for i in every:
            kind = self.kind[i]
            if kind == BYTE:
                run.append(self.byte_of[i])
                continue
            flush()
            if seen or out:
                at_start = False
            seen = False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.extend(self.unknown_text.encode())
                continue
            piece = self.piece[i]
            if at_start and piece.startswith(SPACE):
                piece, seen = piece[1:], not self.squeeze
            out.extend(piece.replace(SPACE, " ").encode())
        flush()
        return bytes(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    return PieceModel(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids, begins, ends): ids without begin and end, and the source byte span of each.

    Null and empty texts have no ids. Texts are encoded whole. Rows are worked on alone, so repeated
    rows and null ids are returned as they are; further columns are ignored.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for part in pieces(batch):
                got = [own.encode(t) for t in texts_of(part)]
                ends = pa.array(np.cumsum([0, *(len(g[0]) for g in got)]).astype(np.int32))
                cols = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([g[k] for g in got]).astype(t)))
                        for k, t in enumerate((np.int32, np.int64, np.int64))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "ids", "begins", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids), one for each row of ``docs``: what a model is trained on.

    ``ids`` hold the begin and end ids, and ``n_tokens`` counts all of them. See ``encoded`` for odd rows.
    """
    own = model(path)
    ids = F.concat(F.array(F.lit(int(own.bos))), "ids", F.array(F.lit(int(own.eos))))
    return encoded(docs, path).select("doc_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, text) from (doc_id, ids); null ids give an empty text."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = [own.decode(np.array(x if x is not None else [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256), one for each row of ``docs``.

    Ids include begin and end. The digests are of the ids, of the decoded text and of the spans
    (begin, end of each piece but begin and end, unsigned 32 bits, little-endian).
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        bos, eos = np.array([own.bos], "<u4"), np.array([own.eos], "<u4")
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for part in pieces(batch):
                out = []
                for text in texts_of(part):
                    ids, begin, end = own.encode(text)
                    ids = np.concatenate([bos, ids, eos])
                    out.append((len(ids), digest(ids.tobytes()), digest(own.decode(ids)), digest(np.stack([begin, end], 1).astype("<u4").tobytes())))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
