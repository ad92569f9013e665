"""Spelling variants: words one edit apart, found through PartEnum signatures of their letters.

The letters of a word are a binary vector with one dimension for each (letter, k-th occurrence). One
inserted, deleted or replaced code point changes at most two dimensions. The dimensions are dealt to
``PARTS`` parts, so near words agree in all but two parts: each choice of ``PARTS - 2`` parts, with the
word's projection on them, is a signature, and near words share at least one.

Letters alone say little where many words are made of the same syllables, so a signature also holds where
the edit may lie: with words cut into ``SEGMENTS`` segments, one edit leaves all but one of them as they
are, and what stands before and after that segment is part of the key. A word is cut as a word of its own
length and as one of a length less by one, to meet longer and shorter partners. Signatures are hashed and
equi-joined, and the pairs verified by their edit distance, so nothing is lost and nothing wrong is kept.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

PARTS, SEGMENTS = 4, 3
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One in so many runs loses a code point.
MISTAKES = 31
#: A form occurs so many times as often as its variant.
RATIO = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, mistakes: int = MISTAKES, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of ``least_length`` or more code points and their occurrences, ``least_count`` or more.

    Words are runs of A-Z, a-z and U+00C0-U+00FF with A-Z lower-cased. If the CRC-32 of ``<doc_id>:<word>``
    can be divided by ``mistakes`` the word loses the code point at that number modulo its length. Null texts
    have no words, a null doc_id is written as nothing, and rows that repeat count each.
    """
    # a run is one match from its first letter on, so shorter runs, which give no word, need not be taken out
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    d = d.select("id", F.translate("run", _UPPER, _LOWER).alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    d = d.select(F.when(F.col("h") % mistakes == 0, less).otherwise(F.col("run")).alias("word"))
    return d.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _parts(word: Column, parts: int) -> list[Column]:
    """The word's vector projected on each part, as text: letters with the number of their dimensions there.

    The k-th occurrence of a letter goes to part (crc32(letter) + k) mod ``parts``, so the number of
    occurrences 1 to c in a part follows from c.
    """
    letters = F.transform(F.array_sort(F.array_distinct(F.split(word, ""))), lambda c: F.struct(
        c.alias("c"), (F.length(word) - F.length(F.replace(word, c, F.lit("")))).alias("n"), (F.crc32(c) % parts).cast("int").alias("h")))

    def part(q: int) -> Column:
        first = lambda x: F.pmod(F.lit(q) - x["h"] - 1, F.lit(parts)) + 1  # noqa: E731   the first occurrence there
        held = lambda x: F.floor((x["n"] - first(x) + parts) / parts)
        # a letter without a dimension in the part must leave no trace there
        return F.array_join(F.transform("letters", lambda x: F.when(held(x) > 0, F.concat(x["c"], held(x).cast("string")))), "")

    return [letters, *(part(q) for q in range(parts))]


def signatures(words: DataFrame, parts: int = PARTS, segments: int = SEGMENTS) -> DataFrame:
    """Adds (key, longer) to (word, n): one row for each signature.

    ``longer`` is 0 for a word cut by its own length and 1 for one cut by a length less by one; near words
    share a key that is not ``longer`` for both.
    """
    letters, *projected = _parts(F.col("word"), parts)
    # few bytes of words give many signatures: deal them to as many tasks as a shuffle has
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = words.repartition(tasks, "word").withColumn("letters", letters)
    d = d.select("word", "n", *(p.alias(f"p{q}") for q, p in enumerate(projected)))
    m = F.length("word")
    keys = []
    for longer in (0, 1):
        size = m - longer
        for s in range(segments):
            before, after = F.floor(size * s / segments).cast("int"), (size - F.floor(size * (s + 1) / segments)).cast("int")
            ends = [F.substring("word", F.lit(1), before), F.substring("word", m - after + 1, after)]
            for chosen in combinations(range(parts), parts - 2):
                which = F.lit(s * 1000 + sum(1 << q for q in chosen))
                keys.append(F.struct(F.xxhash64(which, size, *ends, *(F.col(f"p{q}") for q in chosen)).alias("key"), F.lit(longer).alias("longer")))
    return d.select("word", "n", F.inline(F.array(*keys)))


def near_pairs(words: DataFrame, parts: int = PARTS, segments: int = SEGMENTS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words one edit apart, once, from rows (word, n) of distinct words."""
    keys = signatures(words, parts, segments)
    # a word gives many rows, which size estimates do not see: never broadcast them
    a, b = keys.alias("a"), keys.hint("merge").alias("b")
    # conditions on both sides together, so that both sides read the same shuffle
    same = (
        (F.col("a.key") == F.col("b.key")) & (F.col("a.longer") + F.col("b.longer") < 2)
        & (F.struct("a.longer", "a.word") < F.struct("b.longer", "b.word"))
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    return a.join(b, same).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()


def forms(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n) for each row (word, n) of distinct words.

    ``n_near`` counts the near words. ``form`` is the one of largest n (ties: the smallest word) if that is
    ``ratio`` times n or more.
    """
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("form")).alias("near")),
                                         F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("m"), F.col("a").alias("form")).alias("near")))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    d = words.join(best, "word", "left")
    good = -F.col("near.m") >= ratio * F.col("n")
    return d.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near.form")).alias("form"),
                    F.when(good, -F.col("near.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: what following the forms ends in.

    A form occurs more often than its word, so chains end. Each round doubles the steps taken.
    """
    at = stored(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = at.join(ahead, F.col("root") == F.col("_word"), "left")
        at = stored(moved.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each word of ``docs`` (doc_id, text).

    ``root`` is the word itself if it has no form. An empty table, or one of null or empty texts, has no
    words; further columns are ignored; for nulls and repeated rows see ``word_counts``.
    """
    words = stored(word_counts(docs), "words")
    found = stored(forms(words), "forms")
    last = roots(found).withColumnRenamed("word", "_word")
    return found.join(last, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
