"""Near duplicates, repeated substrings and benchmark passages against brute force."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from samples import clashing, edited, frame, lowered, prose, words

from trailworks.llm.decontaminate import Items, allowed, best_window, contaminated, walks, without_items
from trailworks.llm.near_dedup import BANDS, ROWS, SAMPLES, SCREEN, SKETCH_BITS, near_duplicates
from trailworks.llm.substring_dedup import substring_dedup


def awkward(rng):
    base, other = prose(rng, 80), prose(rng, 40)
    texts = [None, "", " \n\t ", "one", "one", "One", "a b c", base, base, base.upper(), "é " * 30, prose(rng, 5000)]
    texts += [edited(rng, base, s) for s in (0.01, 0.02, 0.05, 0.1, 0.2) for _ in range(12)]
    texts += [prose(rng, 30) + " " + other + " " + prose(rng, 30) for _ in range(10)]
    texts += ["the the the " * 30, "the the the " * 40, prose(rng, 19), other, other + " x", "y " + other]
    return texts


def sets(text, size):
    w = words(lowered(text))
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_groups(rows, size):
    s = {i: sets(t, size) for i, t in rows}
    group = {i: i for i in s}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return {i: (len(s[i]), top(i), top(i) == i) for i in s}


def test_near_duplicates_match_all_pairs(spark):
    texts = awkward(random.Random(1))
    docs = clashing(frame(spark, texts))
    for size in (4, 5):
        got = {r[0]: tuple(r)[1:] for r in near_duplicates(docs, size).collect()}
        assert got == brute_groups(list(enumerate(texts)), size)


def test_near_duplicates_of_odd_rows(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    text = prose(random.Random(2), 30)
    got = sorted(near_duplicates(frame(spark, [(None, text), (3, text), (3, text), (5, text)]), 5).collect(), key=str)
    assert [tuple(r) for r in got] == [(3, 26, 3, True), (3, 26, 3, True), (5, 26, 3, False), (None, 26, None, True)]


def brute_removal(rows, length=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            if key in seen:
                gone[k:k + length] = [True] * length
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substrings_match_a_plain_scan(spark):
    rng = random.Random(3)
    texts = awkward(rng)
    passage = prose(rng, 25)
    texts += [prose(rng, rng.randrange(40)) + " " + passage + " " + prose(rng, rng.randrange(40)) for _ in range(40)]
    texts += [passage * 3, (passage + " ") * 3, "z " * 200, "z " * 19, "z " * 20, "z " * 21]
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(clashing(frame(spark, texts).repartition(5))).collect()}
    assert got == brute_removal(list(enumerate(texts)))


def test_substrings_of_odd_rows(spark):
    assert substring_dedup(frame(spark, [])).count() == 0
    text = prose(random.Random(4), 30)
    got = sorted(tuple(r)[:3] for r in substring_dedup(frame(spark, [(3, text), (3, text), (5, text)])).collect())
    assert got == [(3, 30, 0), (3, 30, 0), (5, 30, 30)]
    assert [tuple(r)[1:3] for r in substring_dedup(frame(spark, [(None, text), (None, text)])).collect()] == [(30, 0)] * 2


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def brute_windows(rows, items):
    out = {}
    for d, t in rows:
        w = words(lowered(t))
        for i, x in items:
            a = words(lowered(x))
            if a:
                found = [(e, s, len(a)) for s in range(len(w) - len(a) + 1) if (e := distance(w[s:s + len(a)], a)) <= allowed(len(a))]
                if found:
                    out[d, i] = min(found)
    return out


def test_benchmark_passages(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, n)) for k, n in enumerate((1, 2, 3, 5, 8, 12, 20, 20, 36, 50))] + [(50, ""), (51, None), (None, "a b c")]
    texts = [None, "", "short", items[8][1], items[8][1].upper(), "the " * 300]
    for _, x in items[:10]:
        texts += [prose(rng, 30) + " " + edited(rng, x, s) + " " + prose(rng, 20) for s in (0, 0.02, 0.05, 0.1, 0.15)]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    docs = clashing(frame(spark, texts))
    want = brute_windows(rows, [(i, x) for i, x in items if i is not None])
    for block in (1 << 20, 300):
        got = {(r.doc_id, r.item_id): (r.edits, r.first_word, r.n_words) for r in contaminated(docs, bench, block).collect()}
        assert set(got) <= set(want)
        # the embedding is random: recall over edited passages is held to 0.95, exact copies to 1
        assert len(got) >= 0.95 * len(want)
        assert all(k in got for k, v in want.items() if v[0] == 0)
        assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    clean = without_items(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in got}
    assert contaminated(frame(spark, []), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_no_item_matches_unrelated_text(spark):
    rng = random.Random(6)
    bench = spark.createDataFrame([(k, prose(rng, 30)) for k in range(20)], "item_id long, text string")
    assert contaminated(frame(spark, [prose(rng, 200) for _ in range(50)]), bench).count() == 0
    assert Counter(r.doc_id for r in without_items(frame(spark, ["x", "x"]), bench).collect()) == {0: 1, 1: 1}


def brute_any_size(text, item):
    """The best window of n - k to n + k words: (edits, first word, words), or None."""
    w, a = words(lowered(text)), words(lowered(item))
    k, best = allowed(len(a)), None
    for s in range(len(w)):
        last = list(range(len(a) + 1))
        for i, x in enumerate(w[s:s + len(a) + k], 1):
            now = [i]
            for j, y in enumerate(a, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
            if i >= len(a) - k and last[-1] <= k and (best is None or (last[-1], s, i) < best):
                best = (last[-1], s, i)
    return best


def one_kind(rng, text, k, kind):
    w = text.split()
    for at in sorted(rng.sample(range(len(w)), k), reverse=True):
        w[at:at + 1] = {"deleted": [], "inserted": [w[at], prose(rng, 1)], "replaced": [prose(rng, 1)]}[kind]
    return " ".join(w)


def test_passages_with_more_or_fewer_words_than_the_item(spark, tmp_path):
    import corpus_pipeline
    from trailworks.llm.queries import QUERIES

    rng = random.Random(7)
    items = [(k, prose(rng, n, 4000)) for k, n in enumerate((5, 9, 15, 20, 30, 30, 40, 50, 59, 100))]
    texts = []
    for _, x in items:
        n = len(x.split())
        texts += [" ".join(x.split()[allowed(n):]), " ".join(x.split()[:-allowed(n)])]      # whole documents, shorter than the item
        for kind in ("deleted", "inserted", "replaced"):
            for k in (1, allowed(n), allowed(n) + 1):
                passage = one_kind(rng, x, k, kind)
                texts += [passage, prose(rng, 30, 4000) + " " + passage + " " + prose(rng, 20, 4000)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(d, i): b for d, t in enumerate(texts) for i, x in items if (b := brute_any_size(t, x))}
    got = {(r.doc_id, r.item_id): (r.edits, r.first_word, r.n_words) for r in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()}
    assert len(want) > 130 and set(got) <= set(want)
    assert len(got) >= 0.98 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    left = corpus_pipeline.drop_contaminated(spark, frame(spark, texts), str(tmp_path)).collect()
    assert {r.doc_id for r in left} == set(range(len(texts))) - {d for d, _ in got}


def test_buckets_keep_unrelated_texts_apart():
    rng = np.random.default_rng(8)
    for n in (15, 20, 36, 50, 60, 100):
        k = allowed(n)
        items = rng.integers(0, 1 << 62, (200, n)).astype(np.uint64)
        other = rng.integers(0, 1 << 62, (200, n + k)).astype(np.uint64)
        near = other.copy()
        for row, item in zip(near, items):      # all the allowed edits, each a deletion
            row[:n - k] = np.delete(item, rng.choice(n, k, replace=False))
        keys = walks(items, n)
        assert (keys == walks(other, n)).any(0).mean() < 0.02
        assert (keys == walks(near, n)).any(0).mean() >= 0.95


def test_buckets_keep_passages_of_the_documents_apart():
    """Frequent words do not fill the buckets, and passages with all the allowed edits share one with their item."""
    texts = [w for (t,) in duckdb.sql("SELECT lower(text) FROM '/root/testdata/sf0.01/documents.parquet' WHERE lang = 'en'").fetchall() if t and len(w := t.split()) > 200]
    code = lambda w: np.array([zlib.crc32(x.encode()) for x in w], np.uint64)
    rng = np.random.default_rng(2)
    for n in (10, 16, 20, 23, 36, 60, 100):
        k = allowed(n)
        items = np.stack([code(texts[i][20:20 + n]) for i in rng.choice(len(texts), 300)])
        other = np.stack([code(texts[i][60:60 + n + k]) for i in rng.choice(len(texts), 300)])
        keys = walks(items, n)
        assert (keys == walks(other, n)).any(0).mean() < 0.05, n
        for kind in ("deleted", "inserted", "replaced"):
            near = other.copy()
            for row, item in zip(near, items):
                at = np.sort(rng.choice(n, k, replace=False))
                new = rng.integers(1 << 40, 1 << 62, k).astype(np.uint64)
                made = np.delete(item, at) if kind == "deleted" else np.insert(item, at, new) if kind == "inserted" else item.copy()
                if kind == "replaced":
                    made[at] = new
                row[:len(made)] = made
            assert (keys == walks(near, n)).any(0).mean() >= 0.95, (n, kind)


def test_best_window_equals_trying_every_window():
    rng = random.Random(11)
    for _ in range(300):
        text, item = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, n))], np.uint64) for n in (30, 9))
        every = [(distance(text[a:b].tolist(), item.tolist()), a, b - a) for a in range(len(text) + 1) for b in range(a, len(text) + 1)]
        assert best_window(text, item) == min(every)


def test_long_items_take_seconds(spark):
    rng = random.Random(12)
    sizes = (257, 400, 700, 1500, 5000)
    items = [(k, prose(rng, n, 4000)) for k, n in enumerate(sizes)]
    texts, want = [prose(rng, 12_000, 4000)], set()
    for k, x in items:
        n = len(x.split())
        for kind in ("deleted", "inserted", "replaced"):
            for edits in (0, allowed(n) // 3, allowed(n)):
                want.add((len(texts), k))
                texts.append(prose(rng, 40, 4000) + " " + one_kind(rng, x, edits, kind) + " " + prose(rng, 700, 4000))
        want |= {(len(texts), k), (len(texts) + 1, k)}
        texts += [" ".join(x.split()[allowed(n):]), " ".join(x.split()[:-allowed(n)])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    start = time.process_time()
    found = Items(items, True).find(batch)
    assert time.process_time() - start < 120        # 56 documents, 11 of them with 5,000 words of an item
    assert set(found) <= want and len(found) >= 0.98 * len(want)
    for (row, k), (edits, first, size) in found.items():
        assert edits <= allowed(sizes[k]) and first + size <= len(texts[row].split())
    got = {(r.doc_id, r.item_id) for r in contaminated(frame(spark, texts[:14]), spark.createDataFrame(items, "item_id long, text string"), any_size=True).collect()}
    assert got == {x for x in found if x[0] < 14}


def test_the_screen_misses_fewer_pairs_than_the_bands():
    bits, similar = np.arange(SKETCH_BITS + 1), 0.8
    estimate = 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * bits / SKETCH_BITS))
    odd, missed = (bits == 0).astype(float), 0.0
    for differ in range(SAMPLES + 1):       # samples that differ; each flips two random bits of the difference
        missed += math.comb(SAMPLES, differ) * (1 - similar) ** differ * similar ** (SAMPLES - differ) * odd[estimate < SCREEN].sum()
        for _ in range(2):
            odd = np.append(0, (odd * (SKETCH_BITS - bits) / SKETCH_BITS)[:-1]) + np.append((odd * bits / SKETCH_BITS)[1:], 0)
    assert missed < 0.01 * (1 - similar ** ROWS) ** (BANDS)
