"""URL filter: rules of host and path, found through hashed host-suffix and path-prefix expressions.

A rule (host, path, verdict) fits a URL whose host is the rule's host or a subdomain of it and whose path
starts with the rule's path. A URL is expanded into the expressions, host suffix then path prefix, that a
rule that fits could be: suffixes with as many labels, prefixes with as many code points, as any rule has.
Expressions meet rules in an equi-join on the first 32 bits of their digests; the whole digest then
confirms the rule, and the longest rule that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES_SCHEMA = "host string, path string, verdict string"
#: The rules of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Hex digits of a digest that are joined on.
PREFIX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def rule_table(rules: DataFrame) -> DataFrame:
    """(rule, verdict, labels, size, prefix, digest): rules as they are joined.

    A-Z of the host is lower-cased. Rules with a null column, an empty host, or a verdict other than allow or
    block are ignored; of rules that repeat host and path a block wins.
    """
    host = F.translate("host", _UPPER, _LOWER)
    ok = (F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block")
    d = rules.where(ok).groupBy(host.alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    digest = F.sha2(F.concat("host", "path").cast("binary"), 256)
    return d.select(F.concat("host", "path").alias("rule"), "verdict", _labels(F.col("host")).alias("labels"),
                    F.length("path").alias("size"), F.substring(digest, 1, PREFIX).alias("prefix"), digest.alias("digest"))


def expressions(urls: DataFrame, labels: list[int], sizes: list[int]) -> DataFrame:
    """Adds (prefix, digest) to (host, path, ...): one row for each expression that a rule of these sizes could be."""
    host, path = F.col("host"), F.col("path")
    suffixes = [F.when(_labels(host) >= k, F.substring_index(host, ".", -k)) for k in labels]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sizes]
    pair = F.array(*(F.concat(s, p) for s in suffixes for p in prefixes))
    d = urls.select("*", F.explode(F.array_compact(pair)).alias("_expression"))
    d = d.withColumn("digest", F.sha2(F.col("_expression").cast("binary"), 256)).drop("_expression")
    return d.withColumn("prefix", F.substring("digest", 1, PREFIX))


def judged(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rows of ``urls`` (page_id, url) as (page_id, host, path, rule, verdict).

    ``rule`` is the fitting rule of most code points (host and path together; ties: the longer host), as
    text, and ``verdict`` its verdict; without one they are null and ``default``. A null url, or one without
    ``://``, has an empty host and path. Rows that repeat are judged alike and all returned; other columns
    are ignored. The driver reads two short lists from the rules: the numbers of labels and of code points
    that occur, each at most as long as the longest rule.
    """
    rules = rule_table(rules)
    seen = rules.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("size")).alias("sizes")).first()
    pages = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    none = pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if not seen["labels"]:
        return none
    found = (
        expressions(pages.where("host <> ''"), seen["labels"], seen["sizes"]).withColumnsRenamed({"prefix": "_prefix", "digest": "_digest"})
        .join(rules, F.col("_prefix") == F.col("prefix")).where("_digest = digest")
    )
    # the longest rule as one value that has a maximum; equal rows have equal answers, so they may meet
    rank = F.struct(F.length("rule").alias("n"), (F.length("rule") - F.col("size")).alias("host"), "rule", "verdict")
    best = found.groupBy("page_id", "host", "path").agg(F.max(rank).alias("best")).select(
        F.col("page_id").alias("_page"), F.col("host").alias("_host"), F.col("path").alias("_path"), "best.rule", "best.verdict")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path"))
    hit = pages.where("host <> ''").join(best, same, "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    # without a host no rule fits; such rows may be many and equal, and stay out of the join
    return hit.unionByName(none.where("host = ''"))


def contract_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), RULES_SCHEMA)
