"""Claim screening."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.lists import squeeze, strip
from ...functions.sequence import first_rows
from ...session import cut_lineage
from .holdings import is_stock

# Words shortened before names are compared.
NAME_WORDS = (
    ("limited", "ltd"), ("corporation", "corp"), ("company", "co"), ("incorporated", "inc"),
    ("mechanical", "mechanic"), ("operations", "ops"), ("electrics", "electric"),
)
CUTOFF = 85.0
#: Names of a block when all are compared; the other side has four times as many.
NAME_BLOCK = 512
#: The most tasks that pairs of blocks are dealt to.
NAME_TASKS = 1024
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def normal_name(text: Column) -> Column:
    v = strip(F.lower(F.coalesce(text, F.lit(""))))
    for a, b in NAME_WORDS:
        v = F.replace(v, F.lit(a), F.lit(b))
    return strip(squeeze(F.regexp_replace(v, r"[^a-z0-9]+", " ")))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one row of the table per letter as bits of a number."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _letter_pairs(name: str) -> list[str]:
    """Letter pairs of each padded word, in any word order."""
    return [x[i:i + 2] for x in (f" {w} " for w in name.split(" ")) for i in range(len(x) - 1)]


def _bags(left: list[list[str]], right: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of bags as rows of ones, copies numbered: the product of two rows is what the bags share."""
    place: dict[tuple[str, int], int] = {}

    def columns(bag: list[str]) -> list[int]:
        copies: dict[str, int] = {}
        out = []
        for x in bag:
            k = copies[x] = copies.get(x, 0) + 1
            out.append(place.setdefault((x, k), len(place)))
        return out

    sides = [[columns(bag) for bag in side] for side in (left, right)]
    rows = []
    for side in sides:
        m = np.zeros((len(side), len(place)), np.float32)
        for i, at in enumerate(side):
            m[i, at] = 1
        rows.append(m)
    return rows[0], rows[1]


def _name_blocks(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """norm, l, r and candidate, l, r: every block (l) of the one side meets every block (r) of the other.

    Names are short and comparing them is not, so the pairs of blocks are dealt by their number, not by their size.
    """
    nl, nr = max(1, -(-left.count() // NAME_BLOCK)), max(1, -(-right.count() // (4 * NAME_BLOCK)))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(nl * nr, NAME_TASKS)
    return (left.select("norm", number("norm", nl).alias("l"), every(nr).alias("r")).repartition(tasks, "l", "r"),
            right.select("candidate", every(nl).alias("l"), number("candidate", nr).alias("r")).repartition(tasks, "l", "r"))


def alias_index(labels: DataFrame) -> DataFrame:
    """First key per normalized label. ``labels``: label, key, pos."""
    d = labels.withColumn("norm", normal_name(F.col("label"))).filter(F.length("norm") > 0)
    return d.groupBy("norm").agg(F.min_by("key", "pos").alias("key"))


def lost_pairs(cutoff: float) -> float:
    """Most letter pairs a name of n letters can lose to a partner at the cutoff, divided by n.

    With L common letters, n - L are deleted and lose two pairs each, and m - L are inserted and lose
    one. L is at least c (n + m) / 2. Above two thirds the shortest partner is the worst case.
    """
    c = cutoff / 100.0
    other = c / (2 - c) if c > 2 / 3 else (2 - c) / max(c, 1e-9)
    return (2 - 1.5 * c) + (1 - 1.5 * c) * other


def near_names(asked: DataFrame, index: DataFrame, cutoff: float) -> DataFrame:
    """norm, candidate, plain, sorted: all pairs with either similarity at the cutoff or above.

    Distinct names meet in blocks. The letters and the letter pairs that two names share, counted for a
    whole block by one product, bound their common letters in either word order, so only pairs that both
    bounds let through are compared. A join on letter pairs would meet nearly as many pairs one by one,
    because half of a name's pairs may differ and none of them is rare. The cutoff must leave a common one.
    """
    if lost_pairs(cutoff) >= 1:
        raise ValueError("no letter pair is sure to be shared at this cutoff; use nearest_names")
    left, right = _name_blocks(asked.select("norm").distinct(), index.select(F.col("norm").alias("candidate")).distinct())

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ours, theirs = a["norm"].tolist(), b["candidate"].tolist()
        if not ours or not theirs:
            return pd.DataFrame({"norm": [], "candidate": [], "plain": [], "sorted": []})
        sizes = np.add.outer(np.array([len(x) for x in ours]), np.array([len(x) for x in theirs]))
        least = np.ceil(cutoff * sizes / 200.0 - 1e-9)      # common letters of a pair at the cutoff
        x, y = _bags([list(n) for n in ours], [list(n) for n in theirs])
        open_ = (x @ y.T >= least) & (sizes > 0)
        # each letter that is not common costs the name that has it two pairs, the other name one
        x, y = _bags([_letter_pairs(n) for n in ours], [_letter_pairs(n) for n in theirs])
        open_ &= x @ y.T >= 3 * least + 1 - sizes
        turned = [" ".join(sorted(n.split(" "))) for n in ours], [" ".join(sorted(n.split(" "))) for n in theirs]
        rows = []
        for i, j in zip(*np.nonzero(open_)):
            size = sizes[i, j]
            plain, by_words = 200.0 * _lcs(ours[i], theirs[j]) / size, 200.0 * _lcs(turned[0][i], turned[1][j]) / size
            if plain >= cutoff or by_words >= cutoff:
                rows.append((ours[i], theirs[j], plain, by_words))
        return pd.DataFrame(rows, columns=["norm", "candidate", "plain", "sorted"])

    return left.groupBy("l", "r").cogroup(right.groupBy("l", "r")).applyInPandas(
        compare, "norm string, candidate string, plain double, sorted double")


def nearest_names(asked: DataFrame, index: DataFrame) -> DataFrame:
    """norm, candidate, plain, sorted: per name its best partner by each similarity, at any similarity.

    Distinct names meet distinct names in blocks. Inside a block the common letters bound the
    similarity from above, so partners are tried from the highest bound down until it falls below
    the best one found. Ties go to the smaller candidate.
    """
    left, right = _name_blocks(asked.select("norm").distinct(), index.select(F.col("norm").alias("candidate")).distinct())

    def letters(names: pd.Series) -> np.ndarray:
        return np.array([[x.count(c) for c in LETTERS] for x in names], np.int16).reshape(len(names), len(LETTERS))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("candidate")
        names, turned = b["candidate"].tolist(), [" ".join(sorted(x.split())) for x in b["candidate"]]
        size, count = np.array([len(x) for x in names]), letters(b["candidate"])
        rows = []
        for norm, own in zip(a["norm"], letters(a["norm"])):
            bound = 200.0 * np.minimum(own, count).sum(1) / np.maximum(1, size + len(norm))
            order = np.argsort(-bound, kind="stable")
            for kind, text, other in ((0, norm, names), (1, " ".join(sorted(norm.split())), turned)):
                best, at = -1.0, None
                for k in order:
                    if bound[k] < best:
                        break
                    score = 200.0 * _lcs(text, other[k]) / max(1, len(text) + len(other[k]))
                    if score > best or score == best and names[k] < names[at]:
                        best, at = score, k
                if at is not None:
                    rows.append((norm, names[at], kind, best))
        return pd.DataFrame(rows, columns=["norm", "candidate", "kind", "score"])

    found = left.groupBy("l", "r").cogroup(right.groupBy("l", "r")).applyInPandas(
        compare, "norm string, candidate string, kind int, score double")
    best = found.groupBy("norm", "kind").agg(F.min(F.struct(-F.col("score"), "candidate")).alias("b"))
    score = -F.col("b.col1")
    return best.select("norm", F.col("b.candidate").alias("candidate"), F.when(F.col("kind") == 0, score).alias("plain"),
                       F.when(F.col("kind") == 1, score).alias("sorted"))


def match_names(names: DataFrame, index: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Key per distinct name: exact, else the best common-letter ratio, else with sorted words.

    ``names``: name. The ratio is twice the longest common subsequence over both lengths, in percent.
    No pair at the cutoff is missed, whatever the cutoff. Ties go to the smaller label.
    """
    d = names.select("name").distinct().withColumn("norm", normal_name(F.col("name"))).filter(F.length("norm") > 0)
    exact = d.join(index, "norm").select("name", "key", F.lit("exact").alias("method"), F.lit(100.0).alias("score"))
    open_ = d.join(index.select("norm"), "norm", "left_anti")
    scored = near_names(open_, index, cutoff) if lost_pairs(cutoff) < 1 else nearest_names(open_, index)
    step = F.when(F.col("plain") >= cutoff, 1).when(F.col("sorted") >= cutoff, 2)
    ranked = scored.withColumn("step", step).filter(F.col("step").isNotNull()).withColumn(
        "score", F.when(F.col("step") == 1, F.col("plain")).otherwise(F.col("sorted")))
    best = ranked.groupBy("norm").agg(F.min(F.struct("step", -F.col("score"), "candidate")).alias("b"))
    fuzzy = open_.join(best, "norm").join(index.select(F.col("norm").alias("candidate"), "key"),
                                          F.col("b.candidate") == F.col("candidate")).select(
        "name", "key", F.when(F.col("b.step") == 1, "ratio").otherwise("sorted").alias("method"), (-F.col("b.col2")).alias("score"))
    return exact.unionByName(fuzzy)


def best_names(names: DataFrame, index: DataFrame) -> DataFrame:
    """T4: name, key, score: the best label for every distinct name, however far off.

    The score is the larger of the two ratios. Names with a partner at the cutoff are settled by the
    join; only those left over meet the labels in blocks.
    """
    d = names.select("name").distinct().withColumn("norm", normal_name(F.col("name")))
    exact = d.join(index, "norm").select("name", "norm", F.col("norm").alias("candidate"), F.lit(100.0).alias("score"))
    open_ = cut_lineage(d.join(index.select("norm"), "norm", "left_anti"))
    close = near_names(open_.filter(F.length("norm") > 0), index, CUTOFF)
    far = nearest_names(open_.join(close.select("norm"), "norm", "left_anti"), index)
    scored = close.unionByName(far).withColumn("score", F.greatest("plain", "sorted"))
    best = scored.groupBy("norm").agg(F.min(F.struct(-F.col("score"), "candidate")).alias("b"))
    rest = open_.join(best, "norm").select("name", "norm", F.col("b.candidate").alias("candidate"), (-F.col("b.col1")).alias("score"))
    return exact.unionByName(rest).join(index.select(F.col("norm").alias("candidate"), "key"), "candidate").select("name", "key", "score")


def resolve_entity(queries: DataFrame, filings: DataFrame) -> DataFrame:
    """T4: best matching filer name per query, rows that are no amendment first.

    ``queries``: query. ``filings``: filing, manager, is_amendment, pos.
    """
    idx = filings.select(F.col("manager").alias("label"), F.col("manager").alias("key"), "pos")
    best = best_names(queries.select(F.col("query").alias("name")), alias_index(idx))
    rows = first_rows(filings, ["manager"], [F.coalesce("is_amendment", F.lit("N")) != "N", "pos"])
    return best.join(rows, best["key"] == rows["manager"]).select(F.col("name").alias("query"), "manager", "filing", "score")


def resolve_issuer(queries: DataFrame, holdings: DataFrame) -> DataFrame:
    """T4: best matching issuer per query among stock classes, one row per security (the first).

    ``queries``: query. ``holdings``: security, issuer, class, pos.
    """
    stocks = holdings.filter(is_stock("class"))
    stocks = first_rows(stocks, ["security"], ["pos"]).withColumn("issuer", F.lower(F.coalesce("issuer", F.lit(""))))
    first = first_rows(stocks, ["issuer"], ["pos"])
    idx = first.select(F.col("issuer").alias("label"), F.col("issuer").alias("key"), "pos")
    best = best_names(queries.select(F.col("query").alias("name")), alias_index(idx))
    return best.join(first, best["key"] == first["issuer"]).select(F.col("name").alias("query"), "security", "issuer", "class", "score")


def screen(claims: DataFrame, parties: DataFrame, references: DataFrame, tolerance: float = 0.01,
           party="Party", reference="Reference", owner="Owner") -> DataFrame:
    """The first failing rule of each claim; clean claims are dropped.

    ``claims``: ..., party_key (nullable), account, ref, amount. ``parties``: party_key, p_account.
    ``references``: ref, r_amount, r_owner.
    """
    d = claims.join(parties, "party_key", "left").join(references, "ref", "left")
    reason = (
        F.when(F.col("party_key").isNull() | F.col("p_account").isNull(), f"Unknown {party}")
        .when(~F.col("account").eqNullSafe(F.col("p_account")), "Account Mismatch")
        .when(F.col("r_owner").isNull(), f"Invalid {reference}")
        .when(F.abs(F.col("amount") - F.col("r_amount")) > tolerance, "Amount Mismatch")
        .when(F.col("r_owner") != F.col("party_key"), f"{owner} Mismatch"))
    return d.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(*claims.columns, "reason")


def overlay_revisions(base: DataFrame, revisions: DataFrame, key: str, columns: dict[str, str], approved: Column,
                      revision: str, pos: str) -> DataFrame:
    """Highest approved and complete revision replaces the base values of known keys.

    ``columns`` maps base column to revision column. Equal revisions: the first row counts.
    """
    complete = approved
    for c in columns.values():
        complete = complete & F.col(c).isNotNull() & (F.length(F.col(c).cast("string")) > 0)
    best = revisions.filter(complete).groupBy(key).agg(
        F.max_by(F.struct(*columns.values()), F.struct(F.col(revision), -F.col(pos))).alias("rev"))
    rest = [c for c in base.columns if c not in columns]
    return base.join(best, key, "left").select(
        *rest, *[F.coalesce(F.col(f"rev.{r}").cast(base.schema[c].dataType), F.col(c)).alias(c) for c, r in columns.items()],
        F.col("rev").isNotNull().alias("revised"))


def latest_packets(packets: DataFrame, ref: str, revision: str, page: str) -> DataFrame:
    """Highest revision, then highest page, per reference."""
    return first_rows(packets, [ref], [F.desc(revision), F.desc(page)])


def crosswalk(rows: DataFrame, mapping: DataFrame, details: DataFrame, code: str, internal: str) -> DataFrame:
    """External code to internal code to details; unknown codes stay with nulls."""
    return rows.join(mapping, code, "left").join(details, internal, "left")
