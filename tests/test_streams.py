"""The bucketed store and the stateful join of calls and results."""

import json
import random

from trailworks.streaming import jobs as ST
from trailworks.streaming.store import apply_batch, read_store, versions

ROW = "id string, v int"


def newest(old, new):
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def files(path):
    return {str(p.relative_to(path)) for p in path.glob("version=*/bucket=*/*.parquet")}


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    store, frame = str(tmp_path), lambda rows: spark.createDataFrame(rows, ROW)
    apply_batch(store, 0, frame([(f"k{i}", i) for i in range(500)] + [(None, -1)]), "id", newest, buckets=32)
    first = files(tmp_path)
    assert len({f.split("/")[1] for f in first}) == 32
    apply_batch(store, 1, frame([("k1", 100), ("new", 5)]), "id", newest, buckets=32)
    written = files(tmp_path) - first
    assert len({f.split("/")[1] for f in written}) <= 2 and all(f.startswith("version=1/") for f in written)
    got = {r.id: r.v for r in read_store(spark, store).collect()}
    assert len(got) == 502 and got["k1"] == 100 and got["new"] == 5 and got["k2"] == 2 and got[None] == -1
    assert {r.id: r.v for r in read_store(spark, store, 0).collect()}["k1"] == 1
    # the same batch again, after a failure: the same version
    apply_batch(store, 1, frame([("k1", 100), ("new", 5)]), "id", newest, buckets=32)
    assert {r.id: r.v for r in read_store(spark, store).collect()} == got
    apply_batch(store, 2, frame([]), "id", newest, buckets=32)
    assert read_store(spark, store).count() == 502


def test_old_versions_go_after_the_retention(spark, tmp_path):
    store = str(tmp_path)
    for v in range(6):
        apply_batch(store, v, spark.createDataFrame([(f"k{i}", v) for i in range(v, 40, 6)] + [("always", v)], ROW), "id", newest, buckets=4, retain=2)
    assert versions(spark, f"{store}/log") == [4, 5]
    got = {r.id: r.v for r in read_store(spark, store).collect()}
    assert got == {**{f"k{i}": i % 6 for i in range(40)}, "always": 5}
    assert {r.id: r.v for r in read_store(spark, store, 4).collect()}["always"] == 4
    assert versions(spark, store) == [v for v in range(6) if v >= 4 or any(f.startswith(f"version={v}/") for f in files(tmp_path))]
    apply_batch(f"{store}/empty", 0, spark.createDataFrame([], ROW), "id", newest)
    assert read_store(spark, f"{store}/empty").columns == ["id", "v"] and read_store(spark, f"{store}/empty").count() == 0


def plain_calls(lines):
    """The rule line by line: a result goes back to the nearest call with its id, later results replace it."""
    steps = []
    for trial, no, value in sorted(set(lines)):
        e = json.loads(value)
        for block, b in enumerate(e["message"]["content"]):
            if b["type"] == "tool_use":
                steps.append([trial, b["id"], no, block, "", None, False])
            elif b["type"] == "tool_result":
                for s in reversed(steps):
                    if s[0] == trial and s[1] == b["tool_use_id"]:
                        s[4:] = [b["content"][:2000], b["is_error"], True]
                        break
    return sorted(map(tuple, steps))


def test_streamed_calls_follow_the_rule_in_any_order_of_arrival(spark, tmp_path):
    rng = random.Random(6)
    lines = []
    for trial in ("a", "b", "c"):
        for no in range(60):
            blocks = []
            for _ in range(rng.randrange(1, 3)):
                key = f"t{rng.randrange(6)}"
                blocks.append({"type": "tool_use", "id": key, "name": "Bash", "input": {"command": f"run {no}"}} if rng.random() < 0.5 else
                              {"type": "tool_result", "tool_use_id": key, "content": f"out {no}" + "x" * rng.choice([0, 3000]), "is_error": rng.random() < 0.3})
            # a line holds calls or results
            kind = blocks[0]["type"]
            blocks = [b for b in blocks if b["type"] == kind]
            lines.append((trial, no, json.dumps({"type": "assistant" if kind == "tool_use" else "user", "message": {"content": blocks}})))
    parts = [[], [], []]
    for line in lines:
        for k in rng.sample(range(3), rng.choice([1, 1, 2])):        # some arrive twice
            parts[k].append(line)
    parts.append([("end", 0, json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "x", "content": ""}]}}))])
    schema = "trial_path string, line_no long, value string, arrived long"
    for k, part in enumerate(parts):
        rows = spark.createDataFrame([(*x, 1_700_000_000 + (k if k < 3 else 10**6)) for x in part], schema).selectExpr("trial_path", "line_no", "value", "timestamp_seconds(arrived) AS arrived")
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ST.ingest_calls(stream, str(tmp_path / "store"), str(tmp_path / "ck"), "1 hour", 4).awaitTermination()
        got = read_store(spark, str(tmp_path / "store"))
        if k == 2:
            assert got.where("not answered").count() == 0      # still waited for
    got = [(r.trial_path, r.tool_use_id, r.line_no, r.block, r.result_text, r.is_error, r.answered) for r in got.collect()]
    assert sorted(got) == plain_calls(lines)
    assert {r[6] for r in got} == {True, False}


def test_ids_share_a_state_but_not_their_wait(spark, tmp_path):
    schema, start = "trial_path string, line_no long, value string, arrived long", 1_700_000_000

    def arrive(rows, groups=1, name="one"):
        folder = tmp_path / name
        d = spark.createDataFrame([(t, no, json.dumps({"type": kind, "message": {"content": [b]}}), start + at) for t, no, kind, b, at in rows], schema)
        d = d.selectExpr("trial_path", "line_no", "value", "timestamp_seconds(arrived) AS arrived")
        d.write.mode("append").parquet(str(folder / "in"))
        q = ST.ingest_calls(spark.readStream.schema(d.schema).parquet(str(folder / "in")), str(folder / "store"), str(folder / "ck"), "1 hour", 2, groups)
        q.awaitTermination()
        return {(r.trial_path, r.tool_use_id): (r.answered, r.result_text) for r in read_store(spark, str(folder / "store")).collect()}, q.recentProgress[-1].stateOperators[0].numRowsTotal

    call = lambda key: {"type": "tool_use", "id": key, "name": "Bash", "input": {}}
    said = lambda key, text: {"type": "tool_result", "tool_use_id": key, "content": text}
    assert arrive([("a", 0, "assistant", call("x"), 0), (None, 0, "assistant", call("x"), 0), (None, 1, "user", said("x", "nowhere"), 0)])[0] == {(None, "x"): (True, "nowhere")}
    got, _ = arrive([("a", 1, "assistant", call("y"), 7201)])
    assert got == {(None, "x"): (True, "nowhere"), ("a", "x"): (False, "")}       # y is still waited for
    got, states = arrive([("a", 2, "user", said("y", "in time"), 7202), ("a", 3, "user", said("x", "late"), 0)])
    assert got == {(None, "x"): (True, "nowhere"), ("a", "x"): (False, ""), ("a", "y"): (True, "in time")} and states == 1
    # many ids pay for few states
    got, states = arrive([("b", i, "assistant", call(f"k{i}"), 0) for i in range(100)] + [("b", 100 + i, "user", said(f"k{i}", f"r{i}"), 0) for i in range(100)], 4, "many")
    assert got == {("b", f"k{i}"): (True, f"r{i}") for i in range(100)} and states <= 4
