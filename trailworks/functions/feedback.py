"""Verifier feedback and outcome normalization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import non_empty, strip

# Status words, bounds.
PASSED_WORDS = ("pass", "passed", "success", "resolved", "true")
FAILED_WORDS = ("fail", "failed", "error", "false", "call_failed")
MAX_ITEMS, MAX_MESSAGE = 25, 1500
ENTRY = "array<struct<name:string,status:string,message:string>>"
TEST = "array<struct<name:string,status:string,raw_status:string,message:string,trace:string>>"


def bounded(text: Column, limit: int = MAX_MESSAGE) -> Column:
    v = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.substring(v, 1, limit), F.lit("… [truncated]")))


def status_word(status: Column) -> Column:
    v = F.lower(F.coalesce(non_empty(status), F.lit("failed")))
    return F.when(v.isin(*PASSED_WORDS), "passed").when(v.isin(*FAILED_WORDS), "failed").otherwise(v)


def _entry(name: Column, status: Column, message: Column) -> Column:
    return F.struct(F.coalesce(non_empty(name), F.lit("verifier")).alias("name"), status_word(status).alias("status"),
                    bounded(message).alias("message"))


def _field(obj: Column, *names: str) -> Column:
    return F.coalesce(*[non_empty(F.get_json_object(obj, f"$.{n}")) for n in names])


def feedback(payload: Column) -> Column:
    """Entries of tests, parser results and errors; a reward or the raw payload if there are none."""
    top = F.from_json(payload, "map<string,string>")
    empty = F.array().cast(ENTRY)
    raw_tests = F.coalesce(top["tests"], F.get_json_object(top["results"], "$.tests"))
    tests = F.transform(F.from_json(raw_tests, TEST), lambda t: _entry(
        t["name"], F.coalesce(non_empty(t["status"]), t["raw_status"]),
        F.array_join(F.filter(F.array(t["message"], t["trace"]), lambda x: F.length(x) > 0), "\n")))
    parser = top["parser_results"]

    def parsed(name: Column, value: Column) -> Column:
        nested = value.startswith("{")
        return F.when(nested, _entry(F.coalesce(_field(value, "name"), name), _field(value, "status", "passed"),
                                     _field(value, "message", "error"))).otherwise(_entry(name, value, F.lit("")))

    by_name = F.transform(F.array_sort(F.map_entries(F.from_json(parser, "map<string,string>"))), lambda e: parsed(e["key"], e["value"]))
    by_pos = F.transform(F.from_json(parser, "array<string>"), lambda v, i: parsed(i.cast("string"), v))
    results = F.when(parser.startswith("{"), by_name).when(parser.startswith("["), by_pos)
    error = F.when(F.length(top["error"]) > 0, F.array(_entry(F.lit("verifier_error"), F.lit("failed"), top["error"])))
    found = F.concat(*[F.coalesce(x, empty) for x in (tests, results, error)])
    reward = F.coalesce(F.get_json_object(top["rewards"], "$.reward"), top["reward"]).try_cast("double")
    fallback = F.array(F.when(reward.isNotNull(), _entry(F.lit("reward"), F.when(reward >= 1, "passed").otherwise("failed"), F.lit("")))
                       .otherwise(_entry(F.lit("verifier_payload"), F.lit("unknown"), payload)))
    empty_payload = payload.isNull() | (F.coalesce(F.size(F.map_keys(top)), F.lit(0)) == 0) & payload.startswith("{")
    return F.when(empty_payload, empty).otherwise(F.slice(F.when(F.size(found) > 0, found).otherwise(fallback), 1, MAX_ITEMS)).cast(ENTRY)


def merge_sidecar(verifier: Column, sidecar: Column) -> Column:
    """P25: diagnostics of the sidecar file over the result's own payload."""
    kind = "map<string,string>"
    both = F.map_concat(F.map_filter(F.from_json(verifier, kind), lambda k, _: ~F.map_contains_key(F.from_json(sidecar, kind), k)),
                        F.from_json(sidecar, kind))
    # Values are JSON text or plain strings; objects and lists keep their text.
    parts = F.transform(F.map_entries(both), lambda e: F.concat(
        F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"),
        F.when(e["value"].rlike(r"^[\[{]"), e["value"]).otherwise(F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2))))
    return F.when(sidecar.isNull(), verifier).when(verifier.isNull(), sidecar).otherwise(
        F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def failed_names(entries: Column) -> Column:
    """P25: names of entries that did not pass."""
    return F.transform(F.filter(entries, lambda e: ~e["status"].isin("passed", "success")), lambda e: e["name"])


def digest(entries: Column) -> Column:
    """P25: names and states only."""
    return F.transform(F.slice(entries, 1, MAX_ITEMS), lambda e: F.struct(e["name"].alias("name"), e["status"].alias("status")))
