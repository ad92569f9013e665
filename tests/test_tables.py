"""Delimited and nested readers, sinks and log clean-up."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailworks.sources import tables as TB
from trailworks.sources import trajectories as S


def test_delimited_text_is_cast_explicitly(spark, tmp_path):
    (tmp_path / "info.tsv").write_text("CUSIP\tVALUE\nab1\t1,200.5\ncd2\tbad\n")
    d = TB.read_delimited(spark, str(tmp_path / "info.tsv"), ["CUSIP", "VALUE"], "\t", numeric=("VALUE",), upper=("CUSIP",))
    assert [(r.CUSIP, r.VALUE) for r in d.orderBy("CUSIP").collect()] == [("AB1", 1200.5), ("CD2", None)]
    assert TB.check_headers(d, ["CUSIP", "VALUE"]) is d
    with pytest.raises(ValueError):
        TB.check_headers(d, ["VALUE"])


def test_nested_export_is_flattened_level_by_level(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"exports": [{"bucket": "b", "clusters": [{"name": "c", "records": [{"key": 1}, {"key": 2}]}, {"name": "d", "records": []}]}]}))
    rec = T.ArrayType(T.StructType([T.StructField("key", T.IntegerType())]))
    clusters = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("records", rec)]))
    schema = T.StructType([T.StructField("exports", T.ArrayType(T.StructType([T.StructField("bucket", T.StringType()), T.StructField("clusters", clusters)])))])
    d = TB.read_nested(spark, str(tmp_path / "x.json"), schema, ["exports", "clusters", "records"])
    assert sorted((r.bucket, r.name, r.key) for r in d.collect()) == [("b", "c", 1), ("b", "c", 2)]


def test_sinks_partition_append_and_report(spark, tmp_path):
    d = spark.createDataFrame([("f", 1, "a"), ("g", 2, "b")], "task_family string, batch int, v string")
    TB.write_partitioned(d, str(tmp_path / "p"), ["task_family", "batch"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.filter("task_family = 'g'").select("v").first().v == "b"
    for _ in range(2):
        TB.append_log(d, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    TB.write_report(d, d.groupBy("task_family").count(), str(tmp_path / "r"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "r" / "candidate_audit_csv")).count() == 2
    assert spark.read.json(str(tmp_path / "r" / "audit_summary_json")).count() == 2


def test_plain_logs_lose_terminal_noise_and_come_in_chunks(spark):
    noise = ["\x1b[31mred\x1b[0m", "   ", '[1.5, "o", "x"]', "#" * 25, "=" * 30 + " 50%", "#" * 20 + " 10% done", "ok\r"]
    rows = [("a", i, v) for i, v in enumerate(noise + [f"line {i}" for i in range(30)])]
    got = S.compact_log(spark.createDataFrame(rows, "source string, line_no long, value string")).orderBy("chunk").collect()
    assert [r.lines for r in got] == [25, 7]
    assert got[0].text.split("\n")[:3] == ["red", "ok", "line 0"]


def test_verifier_feedback_shapes(spark):
    from trailworks.functions import feedback as FB
    payloads = ['{"parser_results":[{"name":"a","passed":true},"failed"]}', '{"error":"boom"}', "{}", None]
    d = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, p string").select("i", FB.feedback(F.col("p")).alias("e")).orderBy("i")
    got = [[(e.name, e.status) for e in r.e] for r in d.collect()]
    assert got == [[("a", "passed"), ("1", "failed")], [("verifier_error", "failed")], [], []]
