"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

Words that hold a digit or an at sign are the nodes of a graph, one for each document. Neighbouring
words are joined by chain edges, and each word is joined to the previous occurrence of the same or a
similar word (same digits, or same letters without punctuation), however far back. Loopy message
passing over chain and skip edges makes repeated entities agree. The weights are learned from a
bounded sample of documents by pseudo-likelihood; the labels to learn are the matches of the patterns,
which are never features. A word that the field labels with high probability outside all pattern
matches becomes an added span.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces, texts_of, words_of

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: Most documents used for training: those with the smallest hashed ids among the ones with digits or at signs.
MAX_TRAINING_ROWS = 2000
#: Most nodes used for training.
MAX_TRAINING_NODES = 30_000
CERTAIN = 0.95
DIM = 1 << 13
#: Rounds of message passing besides four for each edge of the longest path of the graph; convergence ends them before.
ROUNDS = 15
#: Messages that are computed at once.
_MESSAGES = 1 << 15

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pattern_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns, by kind and start, in code points."""
    out: list[Span] = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# -- the graph ----------------------------------------------------------------------------------

_MARK = np.zeros(256, np.int64)
_MARK[48:58] = 1
_MARK[ord("@")] = 1


@dataclass
class Graph:
    """Nodes of many documents. Edges (from, to) are directed forward."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


@lru_cache(maxsize=1 << 16)
def _code(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=4).digest(), "little") % DIM


def _size(n: int) -> int:
    return next((k for k, top in enumerate((0, 1, 2, 3, 4, 7, 11, 15, 19)) if n <= top), 9)


_LETTERS = str.maketrans("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz", "0" * 10 + "A" * 26 + "a" * 25)
_REPEATED = re.compile(r"(.)\1+")
_NUMBER = re.compile("[0-9]+")


def _features(word: str, before: str, after: str) -> list[int]:
    digits, dots, dashes = (sum(map(word.count, s)) for s in ("0123456789", ".", "-"))
    letters = sum(c.isalpha() for c in word)
    shape = _REPEATED.sub(r"\1", word.translate(_LETTERS))[:24]
    return [_code(k, v) for k, v in enumerate((
        None, shape, shape[:3], shape[-3:], (_size(digits), _size(letters)), (dots, _size(digits)), (dashes, _size(digits)), "@" in word,
        ("@" in word, "." in word.partition("@")[2]), word[:1] if not word[:1].isalnum() else "", word[-1:] if not word[-1:].isalnum() else "",
        _NUMBER.sub("0", before.lower())[:16], _NUMBER.sub("0", after.lower())[:16],
        (bool(_DIGIT.search(before)), bool(_DIGIT.search(after)), before[:1] == "+")))]


def _same(word: str) -> str | None:
    """What makes two words similar: their digits if there are many, else their letters and digits."""
    digits = "".join(c for c in word if "0" <= c <= "9")
    if len(digits) >= 7:
        return digits
    bare = "".join(c for c in word.lower() if c.isalnum())
    return bare if len(bare) >= 6 else None


def graph(part: pa.RecordBatch) -> Graph:
    """The graph of a piece with columns doc_id and text."""
    w = words_of(part)
    nodes = np.flatnonzero(w.total(_MARK) > 0)
    places = np.cumsum(np.concatenate(([0], (w.raw & 0xC0) != 0x80)))     # code points before each byte
    base = places[w.offsets[w.doc[nodes]]] if len(nodes) else places[:0]
    raw = w.raw.tobytes()
    word = lambda k: raw[w.start[k]:w.end[k]].decode("utf-8", "replace")
    made, skip = array("H"), array("q")
    last: dict[tuple[int, str], int] = {}
    for number, k in enumerate(nodes.tolist()):
        row, own = int(w.doc[k]), word(k)
        before = word(k - 1) if k > w.first[row] else ""
        after = word(k + 1) if k + 1 < w.first[row + 1] else ""
        made.extend(_features(own, before, after))
        key = _same(own)
        if key is not None:
            if (row, key) in last:
                skip.extend((last[row, key], number))
            last[row, key] = number
    step = np.flatnonzero((np.diff(nodes) == 1) & (np.diff(w.doc[nodes]) == 0))
    return Graph(w.doc[nodes], places[w.start[nodes]] - base, places[w.end[nodes]] - base,
                 np.array(made).reshape(len(nodes), -1) if made else np.zeros((0, 1), np.uint16),
                 np.stack([step, step + 1], 1), np.array(skip, np.int64).reshape(-1, 2))


def _longest(edges: np.ndarray, nodes: int) -> int:
    """Edges of the longest path; each edge leads to a later node."""
    depth = [0] * nodes
    for a, b in edges[np.argsort(edges[:, 1], kind="stable")].tolist():
        depth[b] = max(depth[b], depth[a] + 1)
    return max(depth, default=0)


@dataclass
class Field:
    """Weights of the random field: features x labels, and label pairs of chain and skip edges."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        """Label probabilities of all nodes by loopy sum-product with damping."""
        own = np.zeros((len(g.row), LABELS))
        for k in range(g.features.shape[1] if len(g.row) else 0):
            own += self.unary[g.features[:, k]]
        edges = np.concatenate([g.chain, g.skip])
        if len(edges):
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
            # runs of messages with one pair table: chain and skip edges forward, then backward
            ends = np.cumsum([0, len(g.chain), len(g.skip), len(g.chain), len(g.skip)])
            parts = [(at, min(at + _MESSAGES, to), table) for table, start, to in zip((self.chain, self.skip, self.chain.T, self.skip.T), ends, ends[1:])
                     for at in range(start, to, _MESSAGES)]
            sent = np.zeros((len(source), LABELS))
            for _ in range(ROUNDS + 4 * _longest(edges, len(own))):
                belief = own.copy()
                np.add.at(belief, target, sent)
                new = np.empty_like(sent)
                for at, to, table in parts:
                    x = (belief[source[at:to]] - sent[back[at:to]])[:, :, None] + table
                    top = x.max(1)
                    new[at:to] = top + np.log(np.exp(x - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - sent).max()
                sent = 0.5 * sent + 0.5 * new
                if moved < 1e-5:
                    break
            own = own.copy()
            np.add.at(own, target, sent)
        own -= own.max(1, keepdims=True) if len(own) else 0
        p = np.exp(own)
        return p / p.sum(1, keepdims=True)


def learn(graphs: list[tuple[Graph, np.ndarray]], steps: int = 120, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Pseudo-likelihood: each node is predicted from its features and its neighbours' labels."""
    offset, chain, skip, features, labels = 0, [], [], [], []
    for g, y in graphs:
        if not len(y) or offset >= MAX_TRAINING_NODES:
            continue
        chain.append(g.chain + offset)
        skip.append(g.skip + offset)
        features.append(g.features)
        labels.append(y)
        offset += len(y)
    weights = [np.zeros((DIM, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    if not offset:
        weights[0][:, 0] = 1.0
        return Field(*weights)
    f, y = np.concatenate(features), np.concatenate(labels)
    c, s = np.concatenate(chain), np.concatenate(skip)
    gold = np.eye(LABELS)[y]
    used, at = np.unique(f, return_inverse=True)
    at = at.reshape(f.shape)
    unary = np.zeros((len(used), LABELS))
    sums = [np.full(x.shape, 1e-6) for x in (unary, *weights[1:])]
    for _ in range(steps):
        score = unary[at].sum(1)
        np.add.at(score, c[:, 1], weights[1][y[c[:, 0]]])
        np.add.at(score, c[:, 0], weights[1].T[y[c[:, 1]]])
        np.add.at(score, s[:, 1], weights[2][y[s[:, 0]]])
        np.add.at(score, s[:, 0], weights[2][y[s[:, 1]]])
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        wrong = (gold - p / p.sum(1, keepdims=True)) / len(y)
        grad = np.stack([np.bincount(at.ravel(), np.repeat(wrong[:, k], f.shape[1]), len(used)) for k in range(LABELS)], 1)
        pairs = gold[c[:, 0]].T @ wrong[c[:, 1]] + wrong[c[:, 0]].T @ gold[c[:, 1]]
        both = gold[s[:, 0]].T @ wrong[s[:, 1]] + gold[s[:, 1]].T @ wrong[s[:, 0]]
        for w, g, n in zip((unary, weights[1], weights[2]), (grad, pairs, both + both.T), sums):
            g = g - decay * w
            n += g * g
            w += rate * g / np.sqrt(n)
    weights[0][used] = unary
    return Field(*weights)


def _labels(g: Graph, spans: list[list[Span]]) -> np.ndarray:
    out = np.zeros(len(g.row), np.int64)
    for row in np.unique(g.row):
        mine = np.flatnonzero(g.row == row)
        for kind, a, b in spans[row]:
            out[mine[(g.start[mine] < b) & (g.end[mine] > a)]] = kind + 1
    return out


def train(docs: DataFrame, limit: int = MAX_TRAINING_ROWS) -> Field:
    """The field learned from at most ``limit`` documents that hold a digit or an at sign.

    Documents are chosen by their hashed ids; graphs are made where the texts are, and only the graphs
    (features, labels, edges) of the sample go to the one task that learns.
    """
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                g = graph(row)
                y = _labels(g, [pattern_spans(texts_of(row)[0])])
                out.append([row.column(0)[0].as_py(), *(x.ravel().tolist() for x in (g.features, y, g.chain, g.skip))])
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in cols[1:])],
                                             names=["ord", "features", "labels", "chain", "skip"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(tuple(r.values()) for b in batches for r in b.to_pylist())
        graphs = []
        for _, features, y, chain, skip in rows:
            y = np.array(y, np.int64)
            none = np.zeros(len(y), np.int64)
            graphs.append((Graph(none, none, none, np.array(features, np.int64).reshape(len(y), -1) if len(y) else np.zeros((0, 1), np.int64),
                                 np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)), y))
        field = learn(graphs)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([field.unary.ravel(), field.chain.ravel(), field.skip.ravel()]).tobytes()], pa.binary())], names=["w"])

    docs = docs.select("doc_id", "text").where("doc_id is not null")
    chosen = (
        docs.where(F.col("text").rlike("[0-9@]")).select("doc_id").distinct().withColumn("ord", F.xxhash64("doc_id"))
        .orderBy("ord", "doc_id").limit(limit)
    )
    made = docs.join(F.broadcast(chosen), "doc_id").select("ord", "text").mapInArrow(
        prepare, "ord long, features array<long>, labels array<long>, chain array<long>, skip array<long>")
    found = made.repartition(1).mapInArrow(work, "w binary").first()
    flat = np.frombuffer(found.w) if found else np.zeros(DIM * LABELS + 2 * LABELS ** 2)
    a, b = DIM * LABELS, DIM * LABELS + LABELS ** 2
    return Field(flat[:a].reshape(DIM, LABELS), flat[a:b].reshape(LABELS, LABELS), flat[b:].reshape(LABELS, LABELS))


def added_spans(text: str, words: list[tuple[int, int, int]], base: list[Span]) -> list[Span]:
    """Spans of labelled words (kind, start, end) outside the pattern matches; neighbours of one kind join."""
    out: list[Span] = []
    for kind, a, b in words:
        lead, tail = _trim(text[a:b])
        a, b = a + lead, b - tail
        if a >= b or any(a < y and b > x for _, x, y in base):
            continue
        if out and out[-1][0] == kind and kind == 3 and text[out[-1][2]:a].strip(" ().-") == "" and a - out[-1][2] <= 3:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return out


def _trim(word: str) -> tuple[int, int]:
    """How many characters of a word's ends are not part of an entity."""
    keep = [k for k, c in enumerate(word) if c.isalnum() or c in "+("]
    if not keep:
        return len(word), 0
    last = max((k for k, c in enumerate(word) if c.isalnum()), default=keep[0])
    return keep[0], len(word) - 1 - last


def found_spans(part: pa.RecordBatch, field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and added spans of each row of a piece."""
    texts = texts_of(part)
    base = [pattern_spans(t) for t in texts]
    g = graph(part)
    p = field.marginals(g)
    best = p.argmax(1)
    take = np.flatnonzero((best > 0) & (p.max(1) >= CERTAIN)) if len(best) else best
    words: dict[int, list[Span]] = {}
    for k in take.tolist():
        words.setdefault(int(g.row[k]), []).append((int(best[k]) - 1, int(g.start[k]), int(g.end[k])))
    return [(b, added_spans(texts[i], words[i], b) if i in words else []) for i, b in enumerate(base)]


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of ``docs``.

    Counts and digest are of the pattern matches; ``spans`` lists all spans (kind:start:end, by kind,
    then start; code points, end exclusive). Null and empty texts have none. Rows are worked on alone,
    so repeated rows and null ids are returned as they are; further columns are ignored.
    """
    field = field or train(docs)
    spread = docs.sparkSession.sparkContext.broadcast(field)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = found_spans(part, spread.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))),
                     pa.array([hashlib.sha256(_written(b).encode()).hexdigest() for b, _ in found], pa.string()),
                     pa.array([_written(b + more) for b, more in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; overlapping spans are
    joined under the kind that starts first. Null texts stay null; other columns are kept."""
    field = field or train(docs)
    spread = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index("text")

    def replace(text: str, spans: list[Span]) -> str:
        out, done = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
            if a >= done:
                out += [text[done:a], f"[{KINDS[kind].upper()}]"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = found_spans(part, spread.value)
                texts = [t if t is None else replace(t, b + more) if b or more else t
                         for t, (b, more) in zip(part.column(place).to_pylist(), found)]
                yield part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))

    return docs.mapInArrow(work, docs.schema)
