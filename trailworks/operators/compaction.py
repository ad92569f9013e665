"""Near-duplicate list items inside one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T

LINE_END = r"\r\n|[\n\r]"
FENCE = r"(?U)^\s*```"


def list_items(documents: DataFrame) -> DataFrame:
    """The lines that may be dropped or reworded: doc_id, kind, at, mark, body, tokens.

    List items of a known kind, long enough, outside fences and without table cells. A line is inside
    a fence if an odd number of fence lines came before it.
    """
    lines = F.split("text", LINE_END)
    fences = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(FENCE), i)), lambda i: i.isNotNull())
    d = documents.select("doc_id", lines.alias("lines"), fences.alias("fences"))
    d = d.select("doc_id", "fences", F.posexplode("lines").alias("at", "line")).filter(
        F.col("line").rlike(X.LIST_ITEM) & ~F.contains("line", F.lit("|")) & ~F.col("line").rlike(FENCE))
    d = d.filter(F.size(F.filter("fences", lambda i: i < F.col("at"))) % 2 == 0)
    body = F.regexp_extract("line", X.LIST_ITEM, 2)
    d = d.select("doc_id", "at", F.regexp_extract("line", X.LIST_ITEM, 1).alias("mark"), body.alias("body")).filter(
        F.length("body") >= X.COMPACTION_MIN_CHARS)
    return d.withColumn("kind", T.instruction_kind(F.col("body"))).filter(F.col("kind").isNotNull()).withColumn(
        "tokens", T.compaction_tokens(F.col("body")))


def _similar(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return (shared >= X.AUDIT_MIN_SHARED) & (
        shared / F.greatest(F.lit(1), F.least(F.size(a), F.size(b))) >= X.NEAR_DUPLICATE_OVERLAP)


def _survivors(items: Column) -> Column:
    """Fold the items of one document and kind in their order into survivors (at, mark, body, tokens).

    An item joins the first survivor it resembles; the wording with more tokens is kept at the place
    and with the mark of the survivor.
    """
    kind = "array<struct<at:int,mark:string,body:string,tokens:array<string>>>"

    def place(kept: Column, item: Column) -> Column:
        twin = F.array_position(F.transform(kept, lambda k: _similar(k["tokens"], item["tokens"])), True)
        richer = F.transform(kept, lambda k, i: F.when(
            (i == twin - 1) & (F.size(item["tokens"]) > F.size(k["tokens"])),
            F.struct(k["at"].alias("at"), k["mark"].alias("mark"), item["body"].alias("body"), item["tokens"].alias("tokens"))).otherwise(k))
        return F.when(twin == 0, F.concat(kept, F.array(item))).otherwise(richer).cast(kind)

    return F.aggregate(items, F.array().cast(kind), place)


def compact_lists(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text, ...) with near-duplicate list items removed; ``removed`` counts them.

    Only items of one kind can resemble each other, so each document and kind is folded alone, and
    only where there are two items or more. All other lines stay where they are.
    """
    groups = list_items(documents).groupBy("doc_id", "kind").agg(
        F.array_sort(F.collect_list(F.struct("at", "mark", "body", "tokens"))).alias("items")).filter(F.size("items") > 1)
    folded = groups.select("doc_id", "items", _survivors(F.col("items")).alias("kept"))
    edits = folded.groupBy("doc_id").agg(
        F.flatten(F.collect_list(F.transform("items", lambda x: x["at"]))).alias("seen"),
        F.flatten(F.collect_list(F.transform("kept", lambda x: F.struct(x["at"].alias("at"), F.concat(x["mark"], x["body"]).alias("line"))))).alias("kept"),
    ).withColumnRenamed("doc_id", "_doc")
    d = documents.join(edits, documents["doc_id"] == F.col("_doc"), "left").drop("_doc")
    wording = F.map_from_entries("kept")
    gone = lambda i: F.array_contains("seen", i) & ~F.map_contains_key(wording, i)
    original = F.split("text", LINE_END)
    numbered = F.transform(original, lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    left = F.transform(F.filter(numbered, lambda x: ~gone(x["at"])), lambda x: F.coalesce(_reworded(x, wording), x["line"]))
    return (
        d.withColumn("removed", F.coalesce(F.size("seen") - F.size("kept"), F.lit(0)))
        .withColumn("text", F.when(F.col("seen").isNull(), F.array_join(original, "\n")).otherwise(F.array_join(left, "\n")))
        .drop("seen", "kept")
    )


def _reworded(line: Column, wording: Column) -> Column:
    """The kept wording of a line; unchanged items keep their own spacing."""
    new = F.element_at(wording, line["at"])
    return F.when(new != F.concat(F.regexp_extract(line["line"], X.LIST_ITEM, 1), F.regexp_extract(line["line"], X.LIST_ITEM, 2)), new)
