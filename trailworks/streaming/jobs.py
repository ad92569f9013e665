"""Structured Streaming jobs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memory import last_per_id, merge_store
from ..sources.trajectories import log_lines
from .store import BUCKETS, RETAIN, apply_batch

STATE_GROUPS = 1024     # states that the ids of a stream are dealt to


def read_log_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """ST1 source: new log files as lines (trial_path, arrived, line_no, value). A file is read whole, so its
    lines keep their numbers."""
    files = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    return files.select(
        F.regexp_replace("_metadata.file_path", r"/(agent|sessions)/[^/]+$", "").alias("trial_path"),
        F.col("_metadata.file_modification_time").alias("arrived"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))


def call_events(lines: DataFrame) -> DataFrame:
    """Calls and results of a line stream: (trial_path, tool_use_id, arrived, line_no, block, is_call, name, body, wrong)."""
    d = log_lines(lines)
    blocks = d.filter("is_list").select("trial_path", "arrived", F.col("line_no").cast("long").alias("line_no"), F.col("e.type").alias("kind"), F.posexplode("blocks").alias("block", "b"))
    call = (F.col("kind") == "assistant") & (F.col("b.type") == "tool_use")
    nested = blocks.filter(call | ((F.col("kind") == "user") & (F.col("b.type") == "tool_result"))).select(
        "trial_path", F.when(call, F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("tool_use_id"), "arrived", "line_no", "block", call.alias("is_call"),
        F.when(call, F.coalesce("b.name", F.lit(""))).alias("name"),
        F.when(call, F.to_json("b.input")).otherwise(F.substring(F.coalesce("b.content", F.lit("")), 1, 2000)).alias("body"),
        F.coalesce("b.is_error", F.lit(False)).alias("wrong"))
    plain = d.filter(F.col("e.type") == "tool_result").select(
        "trial_path", F.col("e.tool_use_id").alias("tool_use_id"), "arrived", F.col("line_no").cast("long").alias("line_no"), F.lit(0).alias("block"), F.lit(False).alias("is_call"),
        F.lit(None).cast("string").alias("name"), F.substring("body", 1, 2000).alias("body"), F.coalesce("e.is_error", F.lit(False)).alias("wrong"))
    return nested.unionByName(plain).filter(F.length("tool_use_id") > 0)


def owners(events: list[list]) -> dict[tuple[int, int], list]:
    """Each call's place and the last result that belongs to it, or None. ``events``: [line, block, is_call, ...].

    A result belongs to the nearest call before it; results before the first call belong to none.
    """
    found: dict[tuple[int, int], list] = {}
    last = None
    for e in sorted(events, key=lambda e: (e[0], e[1])):
        if e[2]:
            last = (e[0], e[1])
            found[last] = [e, None]
        elif last:
            found[last][1] = e
    return found


_CALLS = ("trial_path string, tool_use_id string, line_no long, block int, tool_name string, args_json string, result_text string, "
          "is_error boolean, answered boolean")


def joined_calls(lines: DataFrame, wait: str = "1 hour", groups: int = STATE_GROUPS) -> DataFrame:
    """ST1: calls with their result, in update mode: a row for each call whose answer is new or has changed.

    The events of a (trial, tool id) are state until ``wait`` after the last of them arrived. A line that is
    delivered twice counts once, and lines may come in any order while they are waited for. When the wait
    is over, calls without a result leave unanswered, and later lines of the id are late and dropped.

    Ids are dealt by hash to at most ``groups`` groups, each with one state, so that a micro-batch pays for a group
    and not for each id. ``groups`` must stay the same for a checkpoint.
    """
    spark = lines.sparkSession
    wait_ms = int(spark.sql(f"SELECT CAST(INTERVAL {wait} AS INTERVAL SECOND)").first()[0].total_seconds() * 1000)

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, held, touched = state.getCurrentWatermarkMs(), {}, set()
        for trial, tool, events, told, until in json.loads(state.get[0]) if state.exists else ():
            held[trial, tool] = ({(e[0], e[1], e[2]): e for e in events}, told, until)
        for d in () if state.hasTimedOut else batches:
            for r in d.itertuples(index=False):
                key = (r.trial_path, r.tool_use_id)
                events, told, until = held.get(key, ({}, {}, 0))
                e = [int(r.line_no), int(r.block), bool(r.is_call), r.name, r.body, bool(r.wrong)]
                events.setdefault((e[0], e[1], e[2]), e)
                held[key] = (events, told, max(until, int(r.arrived.timestamp() * 1000) + wait_ms))
                touched.add(key)
        out, kept = [], []
        for key, (events, told, until) in held.items():
            over = key not in touched and until < now
            if over or key in touched:
                found = owners(list(events.values()))
                answers = {f"{at[0]}:{at[1]}": [result[0], result[1]] for at, (_, result) in found.items() if result}
                for at, (call, result) in found.items():
                    k = f"{at[0]}:{at[1]}"
                    if result is None if over else k in answers and told.get(k) != answers[k]:
                        out.append((*key, at[0], at[1], call[3], call[4], result[4] if result else "", bool(result[5]) if result else None, result is not None))
                told = answers
            if not over:
                kept.append((*key, list(events.values()), told, until))
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max(min(k[-1] for k in kept), now + 1))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _CALLS.split(", ")])

    events = call_events(lines).withWatermark("arrived", wait)
    calls = events.withColumn("state_group", F.pmod(F.xxhash64("trial_path", "tool_use_id"), F.lit(groups))).groupBy("state_group").applyInPandasWithState(
        step, _CALLS, "held string", "update", GroupStateTimeout.EventTimeTimeout)
    return calls.withColumn("args", F.from_json("args_json", "map<string,string>")).drop("args_json")


def ingest_calls(lines: DataFrame, store: str, checkpoint: str, wait: str = "1 hour", buckets: int = BUCKETS, groups: int = STATE_GROUPS) -> StreamingQuery:
    """ST1 sink: keep the last row of each call in a store (see ``store.read_store``) until the files present are done."""
    place = F.concat_ws(":", "trial_path", "tool_use_id", F.col("line_no").cast("string"), F.col("block").cast("string"))

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("call_id"), "call_id", "left_anti").unionByName(new)

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch_id, batch.withColumn("call_id", place), "call_id", merge, buckets)

    return joined_calls(lines, wait, groups).writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream(records: DataFrame, store: str, checkpoint: str, promoted: str, buckets: int = BUCKETS, retain: int = RETAIN) -> StreamingQuery:
    """ST2: upsert each micro-batch into a versioned store of ``buckets`` buckets.

    Micro-batch ``v`` gives version ``v`` and rewrites only the buckets of its ids; content ids make the merge
    idempotent, so a lost executor or driver only repeats work. ``records``: memory_id, ..., pos.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch_id, last_per_id(batch, "pos"), "memory_id", lambda old, new: merge_store(old, new, promoted), buckets, retain)

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_support(members: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """ST2: distinct qualifying tasks per cluster so far.

    Every micro-batch appends its new distinct (cluster, task) pairs; support is their count.
    """
    spark = members.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        pairs = batch.filter(F.col("evidence_label").isin("verified_success", "unresolved_failure")).select(
            "capability_id", "task_name").distinct()
        if batch_id > 0:
            earlier = spark.read.parquet(out).filter(F.col("batch") < batch_id)
            pairs = pairs.join(earlier, ["capability_id", "task_name"], "left_anti")
        pairs.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return members.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
