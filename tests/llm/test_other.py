"""Quality, sharding, top-k search, connected groups and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from samples import clashing, edited, frame, prose

import corpus_pipeline
from trailworks.llm.quality import Ftrl, accepted, held_out, quality_scores, train, training_rows
from trailworks.llm.sharding import fisher_yates, shard_report, shuffled, write_shards
from trailworks.llm.tables import components, stored
from trailworks.llm.topk import Slices, exact_top_k

SF = "/root/testdata/sf0.01"


def junk(rng, n):
    return " ".join(w.upper() + "!!" for w in prose(rng, n).split())


def labelled(spark, n=600):
    rng = random.Random(1)
    texts = [junk(rng, 60) if k % 3 == 0 else prose(rng, 60) for k in range(n)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(n)], "doc_id long, quality int, toxic int")
    return frame(spark, texts), labels


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = quality_scores(clashing(docs), clashing(labels)).collect()
    assert len(rows) == 600
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r.predicted == int(r.doc_id % 3 != 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.doc_id for r in accepted(docs, labels).collect()} == {r.doc_id for r in rows if r.predicted}


def test_quality_on_the_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_never_learns_from_held_out_rows(spark):
    docs, labels = labelled(spark, 200)
    flipped = labels.withColumn("quality", held_out().cast("int") * (1 - labels.quality) + (~held_out()).cast("int") * labels.quality)
    assert np.array_equal(train(docs, labels), train(docs, flipped))
    assert training_rows(docs, labels, 7).count() == 7


def test_quality_of_odd_rows(spark):
    docs, labels = labelled(spark, 60)
    odd = docs.union(frame(spark, [(None, None), (900, ""), (900, ""), (901, "w " * 30_000)]))
    rows = quality_scores(odd, labels.union(spark.createDataFrame([(None, None, None), (5, None, None)], labels.schema))).collect()
    assert len(rows) == 64
    assert len({r.score for r in rows if r.doc_id == 900 or r.doc_id is None}) == 1
    assert {r.score for r in quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_ftrl_leaves_unused_weights_at_zero():
    model = Ftrl(dim=16)
    for _ in range(50):
        model.update(np.array([1, 2]), np.array([1.0, 0.5]), 1)
        model.update(np.array([3]), np.array([1.0]), 0)
    w = model.weights()
    assert w[1] > 0 > w[3] and not w[4:16].any()


def test_shards_follow_the_law(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "a", "é" * 10] + [prose(rng, rng.randrange(50)) for _ in range(995)]
    docs = clashing(frame(spark, texts))
    rows = shard_report(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1000))
    assert Counter(r.shard for r in rows) == {k: 25 for k in range(40)}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    slots = {k: sorted(r.slot for r in rows if r.shard == k) for k in range(40)}
    assert all(s == list(range(25)) for s in slots.values())
    again = shard_report(docs.repartition(7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


@pytest.mark.parametrize("n", [0, 1, 5, 39, 41, 103])
def test_shards_of_small_tables(spark, n):
    rows = shuffled(frame(spark, ["x"] * n).select("doc_id", "text"), ["doc_id"], 40, bucket_rows=10).collect()
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and all(0 <= s < 40 for s in sizes) and (not n or max(sizes.values()) - min(sizes.get(k, 0) for k in range(40)) <= 1)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(c)) for s, c in sizes.items())


def test_repeated_rows_and_null_ids_are_kept(spark):
    docs = frame(spark, [(None, None), (None, None), (1, "a"), (1, "a"), (1, "b")])
    assert Counter((r.doc_id, r.text_crc32) for r in shard_report(docs).collect()) == {(None, 0): 2, (1, zlib.crc32(b"a")): 2, (1, zlib.crc32(b"b")): 1}


def test_shuffle_is_fair_and_written_whole(spark, tmp_path):
    places = Counter(tuple(fisher_yates(3, [k])) for k in range(3000))
    assert len(places) == 6 and min(places.values()) > 400
    docs = frame(spark, [prose(random.Random(k), 5) for k in range(200)])
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {50}


def test_the_report_is_read_from_shards_of_whole_documents(spark, tmp_path, monkeypatch):
    from trailworks.llm import sharding

    monkeypatch.setattr(sharding, "shared_path", lambda spark, name: f"{tmp_path}/{name}", raising=False)
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 4000)      # some twenty buckets
    docs = frame(spark, [None, ""] + [prose(random.Random(k), 100) for k in range(150)])
    report = sharding.shard_report(docs).collect()
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(repr, map(tuple, back.select(docs.columns).collect()))) == sorted(map(repr, map(tuple, docs.collect())))
    text = {(r.shard, r.slot): (r.doc_id, r.text) for r in back.collect()}
    assert len(text) == len(report) == 152
    for r in report:
        doc_id, raw = text[r.shard, r.slot]
        assert (r.doc_id, r["size"], r.text_crc32) == (doc_id, len((raw or "").encode()) + 16, zlib.crc32((raw or "").encode()))


def brute_top(rows, k, every):
    out = {}
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    for q, x in good:
        if q % every == 0:
            score = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(score[:k])]
    return out


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[7][1]) for k in range(30)] + [(400 + k, [0.0] * 6) for k in range(20)]
    odd = [(900, None), (1000, [float("nan")] * 6), (1100, [None] * 6), (1200, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (1300, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as v", "3 as n", "4 as r", "5 as q")
    for k, every in ((10, 100), (3, 7), (500, 100)):
        got = {}
        for r in exact_top_k(table, k, every).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert got == brute_top(rows, k, every)
    assert exact_top_k(table.limit(0)).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(4)
    v = rng.integers(-1500, 1500, (130, 9))
    index = Slices(v)
    for q in [*rng.integers(-1500, 1500, (5, 9)), np.zeros(9, np.int64)]:
        rows, score = index.top(q, 130)
        assert sorted(rows.tolist()) == list(range(130))
        assert np.array_equal(score, v[rows] @ q)


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(100)] + [(200, 205), (205, 200), (300, 300), (210, 205)]
    random.Random(1).shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(101)}, 200: 200, 205: 200, 210: 200}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        kept[name] = {r.doc_id for r in after.select("doc_id").collect()}
        before = after
    assert kept["quality"] > kept["near_duplicates"] > kept["decontamination"] == kept["personal_data"]
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {r.doc_id: library.encode(r.text or "", add_bos=True, add_eos=True) for r in before.collect()}
    assert {r.doc_id: r.ids for r in last.collect()} == want
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids) for r in rows} == {k: (len(v), v) for k, v in want.items()}


def test_pipeline_on_odd_rows(spark):
    rng = random.Random(9)
    text = prose(rng, 60)
    docs = frame(spark, [None, "", text, text, edited(rng, text, 0.01), (None, "call +1 (555) 222-3333 or a@b.cd")]).selectExpr("*", "1 as id", "'q' as rep")
    out = docs
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {0: None, 1: "", 2: text, None: "call [PHONE] or [EMAIL]"}


def test_pipeline_keeps_one_of_repeated_rows(spark):
    rng = random.Random(10)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a)] * 50 + [(2, a)] * 3 + [(3, b), (3, b), (3, c), (4, None), (4, None), (5, ""), (5, ""), (None, a), (None, a)]
    out = corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), SF).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(1, a), (3, b), (3, c), (4, ""), (5, ""), (0, a), (0, a)])


def test_pipeline_on_empty_tables_and_clashing_names(spark):
    for docs in (frame(spark, []), clashing(spark.read.parquet(f"{SF}/documents.parquet"))):
        out = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, out, SF), "stage")
            assert out.columns == (docs.columns if name != "encoding" else ["doc_id", "n_tokens", "ids"])
        assert out.isEmpty() == docs.isEmpty()
