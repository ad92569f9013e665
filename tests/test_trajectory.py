"""Step logs: spans, segments, sampling, retries and files."""

import collections
import json
import random
import re

from pyspark.sql import functions as F

from trailworks.functions import text as T
from trailworks.operators import retry as R
from trailworks.operators import sampling as SA
from trailworks.operators import trajectory as TR
from trailworks.sources import trajectories as S

STEP = ("task_family string, task_name string, attempt_number int, step_idx long, source string, message string, "
        "tool_name string, args map<string,string>, result_text string, is_error boolean")


def _call(task, n, i, command, error=""):
    return ("f", task, n, i, "agent", "", "Bash", {"command": command}, error or "ok", bool(error) or None)


def _reference_spans(calls):
    """Sequential rule: failures pile up until a success that is no look-around command."""
    spans, pending = [], []
    for i, cmd, err in calls:
        if err:
            pending.append((i, cmd, err))
        elif pending and cmd.split()[0] not in ("ls", "cd", "cat"):
            spans.append((pending, (i, cmd)))
            pending = []
    if pending:
        spans.append((pending, None))
    return spans


def test_failure_spans_match_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr("trailworks.functions.sequence.STEP_CHUNK", 4096)
    r = random.Random(5)
    rows, want = [], {}
    for t in range(25):
        calls = []
        for i in range(1, r.randrange(2, 40)):
            cmd = r.choice(["ls -l", "cat a.txt", "python run.py 1", "python run.py 22", "make all", "cd x"])
            err = r.choice(["", "", "No such file", "schema mismatch error:", "KeyError", "timeout error:"])
            calls.append((i, cmd, err))
            rows.append(_call(f"t{t}", 1, i, cmd, err))
        for fails, winner in _reference_spans(calls):
            shapes = {(re.sub(r"\b\d+(?:\.\d+)?\b", "<num>", c), e) for _, c, e in fails}
            want[(f"t{t}", fails[0][0])] = (
                len(fails), len(shapes), winner[0] if winner else fails[-1][0], winner is not None,
                winner is not None and winner[1] in {c for _, c, _ in fails})
    d = TR.failure_spans(TR.tool_calls(spark.createDataFrame(rows, STEP)))
    got = {(x.task_name, x.first_step): (x.failures, x.distinct_failures, x.last_step, x.resolved, x.winner_was_tried) for x in d.collect()}
    assert got == want


def test_thinking_segments_join_text_and_cross_message_markers(spark):
    def think(i, text, source="agent"):
        return ("f", "t", 1, i, source, text, None, None, "", None)

    rows = [think(1, "Let me"), think(2, "ignored", "user"), think(3, "try"), _call("t", 1, 4, "ls"), think(5, "all good"), think(6, "x" * 3000),
            _call("t", 1, 7, "ls"), think(8, ""), think(9, "q", "user")]
    got = {x.start_step: x for x in TR.thinking_segments(spark.createDataFrame(rows, STEP)).collect()}
    assert got[1].text == "Let me try" and got[1].end_step == 3 and got[1].suggests_retry
    assert got[5].end_step == 6 and len(got[5].text) == 2000 and not got[5].suggests_retry
    assert got[8].text == "" and got[8].end_step == 9


def test_evidence_sampling_matches_positions(spark):
    r = random.Random(9)
    rows = []
    for t in range(12):
        n = r.randrange(5, 90)
        rows += [(f"t{t}", i, r.choice(["read", "write"]) if t % 3 else "write", r.choice(["ok", "Error: x"]) if t % 2 else "ok") for i in range(1, n + 1)]
    budget, head, tail = 20, 3, 5
    got = {}
    for x in SA.select_steps(spark.createDataFrame(rows, "task string, step long, action string, code string"), ["task"], budget, head, tail).collect():
        got.setdefault(x.task, set()).add(x.step - 1)
    for t in {x[0] for x in rows}:
        steps = [x for x in rows if x[0] == t]
        n = len(steps)
        ends = set(range(min(head, n))) | set(range(max(0, n - tail), n))
        keep = set(range(n))
        if n > budget:
            keep = ends | {i for i, s in enumerate(steps) if s[2] == "write" or "error" in s[3].lower()}
            room = budget - len(keep)
            free = [i for i in range(n) if i not in keep]
            keep |= {free[(s + 1) * len(free) // (room + 1)] for s in range(max(room, 0)) if free}
            if len(keep) > budget:
                rest, room = sorted(keep - ends), budget - len(ends)
                keep = ends | {rest[(s + 1) * len(rest) // (room + 1)] for s in range(room)}
        assert got[t] == keep, t


def _chain(spark):
    rows = [("f", "task-a", n, i, "agent", "", "Bash", {"command": c}, "ok", False)
            for n, cmds in ((1, ["python edit.py input.xlsx"]), (2, ["python edit.py input.xlsx", "python validate.py output.xlsx"]),
                            (3, ["python edit.py input.xlsx", "python validate.py output.xlsx", "python repair.py output.xlsx"]))
            for i, c in enumerate(cmds, 1)]
    attempts = spark.createDataFrame([
        ("f", "task-a", 1, False, "ROOT CAUSE: first method failed"), ("f", "task-a", 2, False, "ROOT CAUSE: second method found the missing check"),
        ("f", "task-a", 3, True, "")], "task_family string, task_name string, attempt_number int, verifier_passed boolean, reflection string")
    return spark.createDataFrame(rows, STEP), attempts


def test_only_the_immediate_retry_validates_a_reflection(spark):
    steps, attempts = _chain(spark)
    links = R.retry_links(attempts)
    got = {x.attempt_number: x for x in R.retry_transitions(TR.normalized_events(TR.tool_calls(steps)), links).collect()}
    assert got[1].retry_outcome == "failure" and any("validate.py" in o for o in got[1].added_operations)
    assert got[2].retry_outcome == "success" and any("repair.py" in o for o in got[2].added_operations)
    assert len(got[1].retained_operations) == 1 and got[2].removed_operations == []
    episode = R.retry_episodes(attempts, links).collect()
    assert len(episode) == 3 and all(x.final_success for x in episode)


def test_reflection_fields_stop_at_the_next_heading(spark):
    text = "FAILURE OBSERVABLE: sum\n is off\nROOT CAUSE: password=abc in /srv/a/b.csv\nexpected 3 got 4\nCAUSAL STEP(S): s1\nMISSING: none"
    row = spark.createDataFrame([(text,)], "t string").select(T.reflection_fields(F.col("t")).alias("f"), T.memory_fields(F.col("t")).alias("m")).first()
    assert row.f.observable == "sum is off" and row.f.causal_steps == "s1" and row.f.missing == "none" and row.f.corrective == ""
    assert row.m.rationale == "[redacted credential] in [redacted path] [redacted expected-value comparison]"
    assert row.m.lesson.startswith("Validate the causal step")


def test_retrieval_tokens_add_cjk_bigrams(spark):
    got = spark.createDataFrame([("The 数据 Straße 表 x",)], "t string").select(T.retrieval_tokens(F.col("t")).alias("t")).first().t
    assert got == ["数", "据", "stra", "e", "表", "x", "数据", "据表"] or got == ["数", "据", "strasse", "表", "x", "数据", "据表"]


def test_staged_and_direct_trials_load(spark, tmp_path):
    task = tmp_path / "task-a"
    steps = [{"source": "agent", "message": "", "extra": {"tool_use_name": "Bash", "raw_arguments": {"command": "ls"},
              "tool_result_metadata": {"tool_use_result": {"stdout": "a", "stderr": "b"}}}}]
    for n in (1, 2):
        folder = task / "attempts" / f"attempt_{n:02d}"
        (folder / "agent").mkdir(parents=True)
        if n == 1:
            (folder / "agent" / "trajectory.json").write_text(json.dumps({"steps": steps}))
            (folder / "reflection_attempt_02.md").write_text(" second \n")
            (folder / "reflection_attempt_01.md").write_text("first")
            (folder / "reflection_attempt_99.md").write_text("not listed")
    (task / "attempt_manifest.json").write_text(json.dumps({"task_name": "task-a", "attempts": [
        {"number": 1, "success": False, "reflection_files": ["reflection_attempt_02.md", "reflection_attempt_01.md"]},
        {"number": 2, "success": False, "exception_info": "lost"}, {"number": 3, "success": True}]}))
    log = tmp_path / "direct" / "agent"
    log.mkdir(parents=True)
    lines = [
        "noise", {"type": "assistant", "message": {"content": [{"type": "text", "text": "hello"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "pwd"}}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "early", "is_error": False}]}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": "late", "is_error": True}]}},
        {"type": "user", "message": {"content": "thanks"}}]
    (log / "claude-code.txt").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    (tmp_path / "direct" / "result.json").write_text(json.dumps({"task_name": "d", "trial_name": "x", "verifier_result": {"rewards": {"reward": 1}}}))
    attempts, rows = S.load_trials(spark, str(tmp_path), "fam")
    a = {(x.task_name, x.attempt_number): x for x in attempts.collect()}
    assert set(a) == {("task-a", 1), ("direct", 1)}
    assert a["task-a", 1].reflection == "first\n\nsecond" and a["task-a", 1].reflection_files == ["reflection_attempt_01.md", "reflection_attempt_02.md"]
    assert a["direct", 1].verifier_passed and not a["task-a", 1].verifier_passed
    s = {(x.task_name, x.step_idx): x for x in rows.collect()}
    assert s["task-a", 1].result_text == "a\nb"
    assert s["direct", 1].message == "hello" and s["direct", 2].result_text == "late" and s["direct", 2].is_error and s["direct", 3].message == "thanks"
    missing = S.missing_trajectories(spark, str(tmp_path)).collect()
    assert [(x.task_name, x.attempt_number, x.exception_info) for x in missing] == [("task-a", 2, "lost")]
    res = S.collect_results(spark, str(tmp_path)).collect()
    assert len(res) == 1 and res[0].success and res[0].task_name == "d"
    lines = S.log_files(spark, str(tmp_path))
    compact = [(x.step, x.action, x.code) for x in S.compact_stream(lines).orderBy("step").collect()]
    assert [c[1] for c in compact] == ["assistant_text", "Bash", "tool_result", "tool_result_error"]
    assert json.loads(compact[1][2]) == {"function_name": "Bash", "arguments": {"command": "pwd"}}


def test_operations_of_both_sides_are_made_once(spark):
    rng = random.Random(6)
    commands = [f"python run_{k}.py --n {k}" for k in range(6)]
    rows = [("f", f"t{t}", n, i, "run", rng.random() < 0.7, rng.choice(commands)) for t in range(4) for n in range(1, 5) for i in range(rng.choice([3, 70]))]
    events = spark.createDataFrame(rows, "task_family string, task_name string, attempt_number int, step_idx int, signature_token string, success boolean, raw_text string")
    links = spark.createDataFrame([("f", f"t{t}", n, rng.choice(["success", "failure"]) if n < 4 else "missing") for t in range(3) for n in (1, 3, 4)],
                                  "task_family string, task_name string, attempt_number int, retry_outcome string")
    d = R.retry_changes(events, links)
    # the patterns have run before; the plan that meets the two sides does not repeat them
    assert "regexp_replace" not in d._jdf.queryExecution().optimizedPlan().toString().lower()

    made = {(r.task_name, r.attempt_number, r.pos): r.operation for r in R.operations(events).collect()}
    asked = {(r.task_name, r.attempt_number) for r in links.collect() if r.retry_outcome != "missing"}
    want = []
    for task, n in asked:
        sides = []
        for m in (n, n + 1):
            seen, side = {}, {}
            for pos in range(1, 61):
                if op := made.get((task, m, pos)):
                    seen[op] = seen.get(op, 0) + 1
                    side[op, seen[op]] = pos
            sides.append(side)
        for change, keys in (("retained", sides[0].keys() & sides[1].keys()), ("removed", sides[0].keys() - sides[1].keys()), ("added", sides[1].keys() - sides[0].keys())):
            at = sorted((sides[1].get(k, sides[0].get(k)), k[0]) for k in keys)
            want += [(task, n, change, rank, op) for rank, (_, op) in enumerate(at[:30], 1)]
    assert sorted((r.task_name, r.attempt_number, r.change, r["rank"], r.operation) for r in d.collect()) == sorted(want)


def test_changes_of_long_attempts_are_all_found(spark):
    rng = random.Random(8)
    shape = "task_family string, task_name string, attempt_number int, step_idx int, signature_token string, success boolean, raw_text string"
    # more than one chunk of steps, an operation that is most of an attempt, and steps without a token
    sides = {(t, n): [rng.choice(["read:*.csv"] * 100 + [f"run:{k}" for k in range(40)]) for _ in range(size)]
             for (t, n), size in {("a", 1): 9000, ("a", 2): 5000, ("b", 1): 61, ("b", 2): 200, ("b", 3): 3}.items()}
    sides["b", 1][60] = sides["b", 2][199] = None
    rows = [("f", t, n, i, token, True, "") for (t, n), tokens in sides.items() for i, token in enumerate(tokens)]
    rng.shuffle(rows)
    links = spark.createDataFrame([("f", "a", 1, "failure"), ("f", "b", 1, "success"), ("f", "b", 2, "failure"), ("f", "b", 3, "missing")],
                                  "task_family string, task_name string, attempt_number int, retry_outcome string")
    d = R.retry_changes(spark.createDataFrame(rows, shape), links, max_operations=None, max_changes=None)
    want = []
    for task, n in (("a", 1), ("b", 1), ("b", 2)):
        found = {"retained": [], "added": [], "removed": []}
        for own, other, is_retry in ((n, n + 1, False), (n + 1, n, True)):
            left = collections.Counter(x for x in sides[task, other] if x is not None)
            for token in sides[task, own]:
                met = left[token] > 0
                left[token] -= met
                if is_retry or not met:
                    found["retained" if met else "added" if is_retry else "removed"].append(token)
        want += [(task, n, change, rank, token and f"{token} [succeeded]") for change, tokens in found.items() for rank, token in enumerate(tokens, 1)]
    assert sorted((r.task_name, r.attempt_number, r.change, r["rank"], str(r.operation)) for r in d.collect()) == sorted((*x[:4], str(x[4])) for x in want)
    assert max(x[3] for x in want) > 4096 and dict(d.dtypes)["rank"] == "int"


def test_trial_files_are_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    from trailworks.sources import files as FI

    def put(path, data):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)

    step = {"source": "agent", "message": "é"}
    put("a/x/agent/trajectory.json", json.dumps({"steps": [step]}, ensure_ascii=False).encode("utf-16"))
    put("b/agent/trajectory.json", b"\xef\xbb\xbf" + json.dumps([{"steps": [step]}, {"steps": [step, step]}]).encode())
    put("c/agent/trajectory.json", b"{broken")
    put("d/agent/trajectory.json", b" \n")
    put("_e/agent/trajectory.json", json.dumps({"steps": [step]}).encode())
    put("f/agent/.trajectory.json", json.dumps({"steps": [step]}).encode())
    put("g+%20 h/agent/trajectory.json", json.dumps({"steps": [step]}).encode())
    put("l/agent/claude-code.txt", b"one\r\ntwo\n\nfour\r")
    put("m/sessions/agent.log", b"".join(b"line %d\n" % i for i in range(1000)) + b"last")
    put("n/sessions/agent.log", b"")
    put("claude-code.txt", b"no trial")
    root = str(tmp_path)
    found = S.step_files(spark, root)
    assert found.inputFiles() == [] and S.log_files(spark, root).inputFiles() == []      # no list on the driver
    got = sorted((r.trial_path.removeprefix(root), r.step_idx or 0, r.message) for r in found.collect())
    assert got == [("/a/x", 1, "é"), ("/b", 1, "é"), ("/b", 1, "é"), ("/b", 2, "é"), ("/c", 0, ""), ("/g+%20 h", 1, "é")]
    monkeypatch.setattr(FI, "PIECE", 64)        # workers are forked with the value of the module; pieces are tested here
    with (tmp_path / "m/sessions/agent.log").open("rb") as f:
        pieces = list(FI._pieces(f, False))
    assert len(pieces) > 100 and all(p.endswith(b"\n") for p in pieces[:-1]) and b"".join(pieces) == (tmp_path / "m/sessions/agent.log").read_bytes()
    cut = [(str(tmp_path / "m/sessions/agent.log"), "agent.log", i, bytearray(p)) for i, p in enumerate(pieces)]
    cut = spark.createDataFrame(cut, "path string, name string, piece int, content binary")
    for lines in (S.log_files(spark, root).unionByName(S.log_files(spark, root, cut).withColumn("trial_path", F.lit(root + "/cut"))),):
        by = {}
        for r in lines.collect():
            by.setdefault(r.trial_path.removeprefix(root), []).append((r.line_no, r.value))
    assert sorted(by["/l"]) == [(1, "one"), (2, "two"), (3, ""), (4, "four")] and set(by) == {"/l", "/m", "/cut"}
    assert sorted(by["/m"]) == sorted(by["/cut"]) == [*((i + 1, f"line {i}") for i in range(1000)), (1001, "last")]
