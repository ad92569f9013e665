"""The stored index against searching the records anew; vector blocks against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from trailworks.operators import retrieval as RT
from trailworks.operators import search_index as IX
from trailworks.session import shared_folder

RECORD, QUERY = "record_id long, text string", "query_id long, query string"


def texts(rng, n, first=0):
    words = [f"word{i}" for i in range(60)] + ["common"] * 30
    return [(first + k, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 8, 20, 60])))) for k in range(n)]


def rows(df):
    return sorted((r.query_id, r.record_id, r["rank"], round(r.score, 6), round(r.lexical_score, 6), round(r.lexical_coverage, 6)) for r in df.collect())


def queries(spark, rng):
    asked = [(k, " ".join(rng.choices([f"word{i}" for i in range(65)] + ["common", "the", "absent"], k=rng.randrange(1, 12)))) for k in range(40)]
    return spark.createDataFrame(asked + [(100, ""), (101, None), (102, "the of"), (103, "common common common")], QUERY)


def test_index_equals_searching_the_records(spark, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 5)
    rng = random.Random(1)
    held = texts(rng, 300) + [(1000, None), (1001, ""), (1002, "word1 word2"), (1003, "word1 word2")]
    index = IX.create_index(spark, shared_folder(spark, "index"), buckets=4)
    q = queries(spark, rng)
    assert IX.lexical_search(index, q).count() == 0
    IX.add_records(index, spark.createDataFrame(held, RECORD))
    for limit in (1, 3, 10, 500):
        want = rows(RT.scored_matches(spark.createDataFrame(held, RECORD), q, limit))
        assert rows(IX.lexical_search(index, q, limit)) == want and want


def test_changed_index_equals_one_built_anew(spark, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 7)
    rng = random.Random(2)
    index = IX.create_index(spark, shared_folder(spark, "index"), buckets=4)
    live, q = {}, queries(spark, rng)
    for step in range(3):
        new = texts(rng, 80, first=40 * step)        # half of the ids are there already
        IX.add_records(index, spark.createDataFrame(new + new[:5] + [(None, "word1")], RECORD))
        live.update(new)
        gone = rng.sample(sorted(live), 25) + [9999]
        IX.remove_records(index, spark.createDataFrame([(g,) for g in gone + gone[:3]], "record_id long"))
        live = {k: v for k, v in live.items() if k not in gone}
        reopened = IX.open_index(spark, index.folder)
        assert rows(IX.lexical_search(reopened, q, 5)) == rows(RT.scored_matches(spark.createDataFrame(sorted(live.items()), RECORD), q, 5))
    assert index.commits().agg(F.sum("n")).first()[0] == len(live)
    # an addition that failed before its commit is not seen and may be run again
    version = index.next_version()
    index.write(spark.createDataFrame([(5000, 1, 3)], "record_id long, block long, dl long"), "records", version)
    assert index.snapshot().table("records").where("record_id = 5000").count() == 0 and index.next_version() == version + 1


def test_blocks_that_can_not_reach_the_best_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 4)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    long = [(k, " ".join(rng.choices(words, k=200) + ["alpha", "beta"])) for k in range(200)]
    index = IX.create_index(spark, shared_folder(spark, "index"), buckets=4)
    IX.add_records(index, spark.createDataFrame(long + [(1000 + k, "alpha beta gamma") for k in range(12)], RECORD))
    read = []
    plain = IX.shortlist
    monkeypatch.setattr(IX, "shortlist", lambda i, w, b: (read.append(b.count()), plain(i, w, b))[1])
    got = IX.lexical_search(index, spark.createDataFrame([(1, "alpha beta gamma")], QUERY), 3)
    assert [r.record_id for r in got.collect()] == [1000, 1001, 1002]
    assert read[0] == 3 and read[1] < 5      # of more than 40 blocks


def cosines(a, b):
    a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    return a @ b.T


def test_clustered_vectors_meet_few_blocks_and_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    records = np.concatenate([c + 0.15 * rng.normal(size=(40, 24)) for c in centres])
    asked = np.concatenate([c + 0.15 * rng.normal(size=(15, 24)) for c in centres])
    r = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(records)], "record_id long, r_vec array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, q_vec array<double>")
    want = cosines(asked, records)
    for floor in (0.38, 0.9):
        got = {(x.query_id, x.record_id): x.semantic for x in RT.similar_pairs(q, r, floor, pivots=12, size=20).collect()}
        assert set(got) == set(zip(*(a.tolist() for a in np.nonzero(want >= floor)), strict=True))
        assert all(abs(want[k] - v) < 1e-9 for k, v in got.items())
    vec = lambda d, i, v: d.select(F.col(i).alias("id"), F.col(v).alias("vec"))
    pivots = RT._pivots(RT._clean(vec(r, "record_id", "r_vec")), 12)
    a, b = RT.vector_blocks(vec(q, "query_id", "q_vec"), pivots, 20), RT.vector_blocks(vec(r, "record_id", "r_vec"), pivots, 20)
    every = a.select("pivot", "chunk").distinct().count() * b.select("pivot", "chunk").distinct().count()
    assert RT.block_pairs(a, b, pivots, 0.9).count() < every / 3


def test_odd_vectors_have_no_pairs(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    r = spark.createDataFrame([(k, v) for k, v in enumerate(odd + [[1.0, 0.0], [1.0, 0.0], [-1.0, 0.0]])], "record_id long, r_vec array<double>")
    q = spark.createDataFrame([(k, v) for k, v in enumerate(odd + [[2.0, 0.0]])], "query_id long, q_vec array<double>")
    assert {(x.query_id, x.record_id) for x in RT.similar_pairs(q, r, 0.38).collect()} == {(6, 6), (7, 7), (7, 8)}
    assert RT.similar_pairs(q, r.limit(0), 0.38).count() == 0
    assert RT.similar_pairs(q.where("query_id = 1"), r, 0.38).count() == 0


def test_text_ids_empty_changes_and_vectors(spark):
    index = IX.create_index(spark, shared_folder(spark, "index"), "string", buckets=4)
    record = "record_id string, text string"
    IX.add_records(index, spark.createDataFrame([], record))
    IX.remove_records(index, spark.createDataFrame([("none",)], "record_id string"))
    q = spark.createDataFrame([(1, "timezone meeting schedule", [0.0, 1.0]), (2, "prepare a candidate employment document", [0.0, 1.0])], "query_id int, query string, q_vec array<double>")
    assert IX.lexical_search(index, q).count() == 0
    rows = [("schedule", "Validate timezone constraints and persist the corrected meeting schedule.", [1.0, 0.0]), ("offer", "Inspect every document part and remove all template markers.", [0.0, 1.0]), ("plain", "", None)]
    records = spark.createDataFrame(rows, "record_id string, text string, r_vec array<double>")
    near = RT.similar_pairs(q, records, 0.38)
    assert IX.hybrid_search(IX.create_index(spark, shared_folder(spark, "index"), "string"), q, records, near).count() == 0
    IX.add_records(index, records)
    assert [(r.query_id, r.record_id) for r in IX.lexical_search(index, q).collect()] == [(1, "schedule")]
    got = {(r.query_id, r.record_id): (r.match_mode, round(r.semantic_score, 6)) for r in IX.hybrid_search(index, q, records, near).collect()}
    want = {(r.query_id, r.record_id): (r.match_mode, round(r.semantic_score, 6)) for r in RT.scored_matches(records, q).collect()}
    assert got == want == {(1, "schedule"): ("lexical_exact", 0.0), (1, "offer"): ("hybrid", 1.0), (2, "offer"): ("hybrid", 1.0)}


def test_postings_are_bucketed_and_ordered_without_comparing_text(spark):
    rng = random.Random(5)
    index = IX.create_index(spark, shared_folder(spark, "index"), buckets=2)
    IX.add_records(index, spark.createDataFrame([(k, " ".join(f"word{rng.randrange(40)}" for _ in range(60))) for k in range(300)], RECORD))
    plan = spark.sql(f"DESCRIBE EXTENDED {index.postings_name}").collect()
    assert not any(r.col_name == "Sort Columns" and "token" in r.data_type for r in plan)
    rows = index._raw("postings").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), IX._together().alias("place")).collect()
    for file in {r.file for r in rows}:
        places = [r.place for r in sorted(rows, key=lambda r: r.at) if r.file == file]
        assert places == sorted(places)
