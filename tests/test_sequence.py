"""Chunked sequence helpers against plain Python, with chunks of a few rows."""

import random

from pyspark.sql import functions as F

from trailworks.functions import sequence as S
from trailworks.operators.overlap import candidate_pairs


def _rows(seed, n=400):
    r = random.Random(seed)
    out, used = [], set()
    for _ in range(n):
        k, i = r.choice("aab"), r.randrange(1, 900)
        if (k, i) not in used:
            used.add((k, i))
            out.append((k, i, r.randrange(5)))
    return out


def test_running_sum_numbering_and_neighbours(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "k string, i long, v int")
    chunk = F.floor(F.col("i") / 7)
    got = {(r.k, r.i): r.s for r in S.running_sum(df, ["k"], "i", F.col("v"), "s", chunk).collect()}
    excl = {(r.k, r.i): r.s for r in S.running_sum(df, ["k"], "i", F.col("v"), "s", chunk, inclusive=False).collect()}
    num = {(r.k, r.i): r.n for r in S.numbered(df, ["k"], ["i"], "n", chunk).collect()}
    assert num == {(r.k, r.i): r.n for r in S.numbered(df, ["k"], ["i"], "n", chunk, many=True).collect()}
    prev = {(r.k, r.i): r.p for r in S.neighbour(df, ["k"], "i", F.col("v"), "p", chunk).collect()}
    nxt = {(r.k, r.i): r.p for r in S.neighbour(df, ["k"], "i", F.col("v"), "p", chunk, following=True).collect()}
    near = {(r.k, r.i): r.p for r in S.following_within(df, ["k"], "i", F.col("v"), "p", 3, size=7).collect()}
    want_near = {}
    for key in "ab":
        seq = sorted((i, v) for k, i, v in rows if k == key)
        total = 0
        for pos, (i, v) in enumerate(seq):
            assert excl[key, i] == total
            total += v
            assert got[key, i] == total and num[key, i] == pos + 1
            assert prev[key, i] == (seq[pos - 1][1] if pos else None)
            assert nxt[key, i] == (seq[pos + 1][1] if pos + 1 < len(seq) else None)
            if pos + 1 < len(seq) and seq[pos + 1][0] - i <= 3:
                want_near[key, i] = seq[pos + 1][1]
    assert near == want_near


def test_chunk_numbers_take_null_keys_and_orders(spark):
    r = random.Random(4)
    rows = [(k, i, r.choice(["x", "y", None])) for k in ("a", None) for i in (None, -20, -3, *range(60))] + [("b", 2, "x"), (None, 200, "x")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, v string")
    for size in (7, 1000):      # with later chunks and without
        d = S.chunk_numbers(df.withColumn("c", S.first_chunk_zero("i", size)), ["k"], "i", "c", {"n": [], "m": ["v"]})
        assert dict(d.dtypes) == {"k": "string", "i": "bigint", "v": "string", "n": "int", "m": "int"}
        got = {(x.k, x.i, x.v): (x.n, x.m) for x in d.collect()}
        assert len(got) == len(rows)
        for key in ("a", "b", None):
            seq = sorted(((i, v) for k, i, v in rows if k == key), key=lambda x: -99 if x[0] is None else x[0])
            for pos, (i, v) in enumerate(seq):
                assert got[key, i, v] == (pos + 1, sum(x[1] == v for x in seq[:pos + 1]))


def test_candidate_pairs_keep_every_pair_that_shares_enough(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    left = {i: r.sample(words, r.randrange(2, 9)) for i in range(60)}
    right = {i: r.sample(words, r.randrange(2, 9)) for i in range(60)}
    l = spark.createDataFrame([(i, t) for i, t in left.items()], "a int, tokens array<string>")
    rt = spark.createDataFrame([(i, w) for i, t in right.items() for w in t], "b int, token string")
    need = F.ceil(F.size("tokens") * 0.6).cast("int")
    got = {(x.a, x.b) for x in candidate_pairs(l, ["a"], need, rt, ["b"]).collect()}
    for a, t in left.items():
        for b, u in right.items():
            if len(set(t) & set(u)) >= -(-len(t) * 6 // 10):
                assert (a, b) in got


def test_no_piece_holds_many_chunks_of_a_hot_key(spark):
    """One key with a chunk for each row: its chunk rows are spread, and only one row a piece meets the key's window."""
    df = spark.range(4000).selectExpr("'hot' AS k", "id AS i")
    got = S.numbered(df, ["k"], ["i"], "n", F.col("i"), many=True)
    assert got.where("n <> i + 1").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")        # small pieces would be joined
    try:
        totals = df.select("k", F.col("i").alias("_chunk"), F.lit(1).alias("_total"))
        per_piece = totals.repartitionByRange("k", "_chunk").groupBy(F.spark_partition_id()).count()
        assert per_piece.agg(F.max("count")).first()[0] < 4000 / 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
