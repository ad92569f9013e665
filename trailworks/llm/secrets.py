"""Secret scan with a trigram index, in DataFrame functions only.

Each rule's pattern is read once on the driver and gives a Boolean query: an OR of literal branches,
each an AND of the trigrams that every match of the branch must hold (in lower case). The index holds
the postings (trigram, doc_id) of the trigrams that any query asks for. Intersecting the postings gives
the candidate documents of a rule, which are then matched in full. Rules without mandatory trigrams
(long runs of a character class) are matched against every document.

Spans count code points. They come from the lengths of what lies between the matches, so no code
outside Spark's functions touches a text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose ``group`` is shorter than ``least`` code points are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds, in the order of their listing.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # runs under 24 characters would be dropped, and a run is always one match, so the length may stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
)
#: Public formats of keys, added to the base kinds.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)
#: A character class of up to so many characters is tried one by one; a wider one ends a literal.
CLASS_SIZE = 8
_BLOCK = 64


def _branches(parsed) -> list[tuple[str, ...]]:
    """Alternatives of a parsed pattern, each the literals it must hold; '' marks a break."""
    out: list[list[str]] = [[""]]

    def append(options: list[str]) -> None:
        nonlocal out
        out = [b[:-1] + [b[-1] + o] for b in out for o in options]

    def cut() -> None:
        for b in out:
            b.append("")

    def join(inner: list[tuple[str, ...]]) -> None:
        nonlocal out
        out = [b[:-1] + [b[-1] + i[0], *i[1:]] for b in out for i in inner]

    for op, arg in parsed:
        if op is sre.LITERAL:
            append([chr(arg).lower()])
        elif op is sre.IN and not any(o is sre.NEGATE or o is sre.CATEGORY for o, _ in arg):
            chars = {chr(c).lower() for o, a in arg for c in ((a,) if o is sre.LITERAL else range(a[0], min(a[1], a[0] + 99) + 1))}
            append(sorted(chars)) if len(chars) <= CLASS_SIZE else cut()
        elif op is sre.SUBPATTERN:
            join(_branches(arg[-1]))
        elif op is sre.BRANCH:
            join([x for part in arg[1] for x in _branches(part)])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, part = arg
            if (least, most) == (0, 1) and len(part) == 1 and part[0][0] is sre.LITERAL:
                join([("",), (chr(part[0][1]).lower(),)])
            else:
                if least:
                    inner = _branches(part)
                    join([(*i, "") for i in inner])
                cut()
        else:
            cut()
    return [tuple(b) for b in out]


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """OR of ANDs of trigrams that a match must hold; empty if some branch has none."""
    found = []
    for branch in _branches(sre_parser.parse(pattern)):
        grams = frozenset(x[k:k + 3] for x in branch for k in range(len(x) - 2))
        if not grams:
            return []
        found.append(grams)
    # a branch that asks for more than another one adds nothing
    return sorted({g for g in found if not any(o < g for o in found)}, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the given trigrams over lower-cased texts: rows (trigram, doc_id)."""
    low = F.lower("text")
    held = F.filter(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)), lambda t: t.isNotNull())
    return (
        docs.where("doc_id is not null and text is not null").select("doc_id", low.alias("low"))
        .select("doc_id", F.explode(held).alias("trigram"))
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (doc_id, rules): numbers of the indexed rules whose trigram query a document meets."""
    branches = [(k, b, g) for k, r in enumerate(rules) for b, grams in enumerate(trigram_query(r.pattern)) for g in sorted(grams)]
    if not branches:
        return docs.sparkSession.createDataFrame([], "doc_id long, rules array<int>")
    asked = docs.sparkSession.createDataFrame(
        [(k, b, g, sum(1 for x in branches if x[:2] == (k, b))) for k, b, g in branches], "rule int, branch int, trigram string, need int")
    index = postings(docs, sorted({g for _, _, g in branches})).distinct()
    return (
        index.join(F.broadcast(asked), "trigram")
        .groupBy("doc_id", "rule", "branch").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).where("n = need")
        .groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))
    )


def spans(rule: Rule, number: int, text: str) -> Column:
    """array<struct<start, number, end>> of the matches of a rule that are long enough."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(F.col(text), rule.pattern, -1)
    sized = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n")))
    sized = F.zip_with(sized, group, lambda s, g: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), F.length(g).alias("kept")))
    add = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x["gap"] + x["n"])

    def placed(a: Column) -> Column:
        # sums of whole blocks first, then inside a block: linear in the matches, but for a small factor
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")),
                             lambda b: add(F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK))))
        start = F.aggregate(blocks, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))

        def one(x: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            at = F.get(start, b) + add(F.slice(a, b * _BLOCK + 1, i % _BLOCK)) + x["gap"]
            return F.struct(at.alias("start"), F.lit(number).alias("number"), (at + x["n"]).alias("end"), x["kept"].alias("kept"))

        return F.filter(F.transform(a, one), lambda s: s["kept"] >= rule.least)

    return F.transform(placed(sized), lambda s: F.struct(s["start"], s["number"], s["end"]))


def _written(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(kinds, s["number"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Rows (doc_id, text, found), found an array<struct<start, number, end>> sorted by start, then rule.

    Matches of a rule are leftmost and do not overlap; starts and ends count code points, the end is
    exclusive. Null and empty texts have none. Documents without a doc_id are not indexed and matched
    by every rule; rows that repeat a doc_id are candidates together and matched each. Further columns
    are ignored.
    """
    docs = docs.select("doc_id", "text")
    meets = candidates(docs, rules).withColumnRenamed("rules", "_rules").withColumnRenamed("doc_id", "_id")
    joined = docs.join(meets, docs["doc_id"] == meets["_id"], "left").drop("_id")
    none = F.array().cast("array<struct<start:int,number:int,end:int>>")
    parts = []
    for k, r in enumerate(rules):
        look = F.col("text").rlike(r.pattern)
        if trigram_query(r.pattern):
            look = (F.col("doc_id").isNull() | F.array_contains("_rules", k)) & look
        parts.append(F.when(look, spans(r, k, "text")).otherwise(none))
    return joined.withColumn("found", F.array_sort(F.concat(*parts))).drop("_rules")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one for each row of ``docs``."""
    found = find_secrets(docs, rules)
    base = F.filter("found", lambda s: s["number"].isin([k for k, r in enumerate(rules) if r.base]))
    count = lambda k: F.size(F.filter("found", lambda s: s["number"] == k)).cast("long")
    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base]
    return found.select("doc_id", *counts, F.sha2(_written(base, rules).cast("binary"), 256).alias("base_sha256"), _written(F.col("found"), rules).alias("spans"))
