"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

from samples import clashing, frame, lowered

from trailworks.llm.spelling import near_pairs, spelling_variants, word_counts


def plain_counts(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            out[run[:k] + run[k + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_rows(counts):
    names, form, out = sorted(counts), {}, []
    partners = {w: [v for v in names if v != w and near(w, v)] for w in names}
    for w in names:
        best = min(partners[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    for w in names:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(partners[w]), counts[form[w]] if form[w] else None))
    return out


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice(["th", "tion", "ble", "é", "an", "ß", "÷", "Ö"]) for _ in range(rng.randrange(3, 7))) for _ in range(60)]
    for w in list(words):
        for _ in range(4):
            k = rng.randrange(len(w) + 1)
            words.append(rng.choice([w[:k] + "x" + w[k:], w[:k] + w[k + 1:], w[:k] + "ÿ" + w[k + 1:], "".join(rng.sample(w, len(w)))]))
    docs = [(None, None), (1, ""), (2, "short words only"), (None, "nothing nothing"), (3, "z" * 50_000 + " " + "z" * 50_000 + " " + "z" * 49_999 + "y")]
    docs += [(4, "repeated rows repeated")] * 3
    for k in range(250):
        docs.append((10 + k, " ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, [1 / (1 + i) ** 1.5 for i in range(len(words))], k=40))))
    return docs + [(5, "z" * 49_999 + "y")]


def test_counts_and_variants_equal_all_pairs(spark):
    docs = corpus()
    df = clashing(frame(spark, docs))
    counts = plain_counts(docs)
    assert {r.word: r.n for r in word_counts(df).collect()} == counts
    got = sorted(tuple(r) for r in spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == sorted(plain_rows(counts))
    assert any(r[1] and r[1] != r[2] for r in got) and any(r[4] > 1 for r in got)


def test_signatures_lose_no_pair(spark):
    """Every pair of short words over few letters, where all kinds of edits, doubled letters and boundaries occur."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randrange(1, 9))) for _ in range(500)} | {"a", "", "aaaaaaaaaaaa", "aaaaaaaaaaaaa"})
    got = {tuple(sorted((r.a, r.b))) for r in near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_chains_of_forms_are_followed_to_the_end(spark):
    steps = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx", "abcdwzyx"]
    ids = [next(k for k in range(100 * i, 100 * i + 99) if zlib.crc32(f"{k}:{w}".encode()) % 31) for i, w in enumerate(steps)]
    docs = [(k, " ".join([w] * 2 * 10 ** i)) for i, (k, w) in enumerate(zip(ids, steps, strict=True))]
    counts = plain_counts(docs)
    rows = {r.word: r for r in spelling_variants(frame(spark, docs)).collect()}
    assert {w: r.root for w, r in rows.items()} == {r[0]: r[2] for r in plain_rows(counts)}
    assert rows["abcdefgh"].form == "abcdefgx" and rows["abcdefgh"].root == "abcdwzyx"


def test_tables_without_words(spark):
    assert spelling_variants(frame(spark, [])).count() == 0
    assert spelling_variants(frame(spark, [None, "", "a b c", "1234567 1234567"])).count() == 0
