"""Merkle manifest of a dataset: a tree of digests for each group, and one over the groups.

A row's leaf is the digest of its columns. The leaves of a group, in order, are the first level of its
tree; every ``fanout`` consecutive nodes of a level become one node of the next, until one is left, the
group's subroot. The subroots, ordered by group, are the leaves of the tree that ends in the root.

Levels are built with windows. A node of level l stays on the row of its first leaf, so a sibling k slots
away is k * fanout^l rows away: fixed-offset ``lag`` and ``lead`` columns, masked by the node's slot in its
run and the length of the run, are its left and right siblings, and the row of a run's first child hashes
the parent. Windows run inside blocks of consecutive leaves (fanout^3 of them for 16), which hold whole
runs for several levels, so a group may hold any share of the rows; the block's nodes are the leaves of
the next stage. Siblings found further up come down by a join on the block, one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import ordered_numbers
from .tables import stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: A window sees at most so many leaves.
_BLOCK = 4096
_PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(columns: dict[str, Column] | tuple[str, ...] = COLUMNS) -> Column:
    """Digest of a row: each value as ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    values = columns.values() if isinstance(columns, dict) else [F.col(c) for c in columns]
    text = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings up to the root give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _levels(fanout: int) -> int:
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    levels = 1
    while fanout ** (levels + 1) <= _BLOCK:
        levels += 1
    return levels


def _climb(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds ``path`` (siblings inside the block), and ``top`` and ``left_over`` on the first row of a block.

    ``nodes``: (tree, i, n, h) and further columns; i counts from 0 to n - 1 inside a tree. ``top`` is the
    node above the block, ``left_over`` the number of nodes of the tree at its level.
    """
    levels = _levels(fanout)
    block = fanout ** levels
    row = Window.partitionBy("tree", "_block").orderBy("i")
    d = nodes.withColumn("_block", F.floor(F.col("i") / block)).withColumn("_n0", F.col("n")).withColumn("_h0", F.col("h"))
    for level in range(levels):
        stride, h, n = fanout ** level, F.col(f"_h{level}"), F.col(f"_n{level}")
        index = F.floor(F.col("i") / stride)
        slot = index % fanout
        run = F.least(F.lit(fanout), n - (index - slot))
        left = F.concat_ws("", *(F.when(slot >= k, F.lag(h, k * stride).over(row)) for k in range(fanout - 1, 0, -1)))
        right = F.concat_ws("", *(F.when(slot + k < run, F.lead(h, k * stride).over(row)) for k in range(1, fanout)))
        d = d.withColumn(f"_s{level}", F.when((F.col("i") % stride == 0) & (n > 1), F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(n > 1, digest(h, F.col(f"_s{level}.right"))).otherwise(h)
        d = d.withColumn(f"_h{level + 1}", F.when(F.col("i") % (stride * fanout) == 0, parent))
        d = d.withColumn(f"_n{level + 1}", F.when(n > 1, F.ceil(n / fanout)).otherwise(n))
    # a node's siblings hold for all leaves below it: the rows up to the next node of its level
    so_far = row.rowsBetween(Window.unboundedPreceding, 0)
    steps = [F.last(f"_s{level}", ignorenulls=True).over(so_far) for level in range(levels)]
    d = d.withColumn("path", F.filter(F.array(*steps), lambda s: s.isNotNull()).cast(_PATH))
    names = [c for level in range(levels) for c in (f"_s{level}", f"_h{level}", f"_n{level}")]
    return d.withColumnsRenamed({f"_h{levels}": "top", f"_n{levels}": "left_over"}).drop(*names)


def _stages(nodes: DataFrame, largest: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The climbs from the leaves to the last node of each tree, and those nodes (tree, i, n, h)."""
    block = fanout ** _levels(fanout)
    climbs = []
    while True:
        climbs.append(_climb(nodes, fanout))
        tops = climbs[-1].where(F.col("i") % block == 0).select("tree", F.col("_block").alias("i"), F.col("left_over").alias("n"), F.col("top").alias("h"))
        nodes = stored(tops, "manifest-tops")
        if largest <= block:
            return climbs, nodes
        largest = -(-largest // block)


def _down(climbs: list[DataFrame], above: DataFrame, carry: list[str]) -> DataFrame:
    """Whole paths: ``above`` (tree, i, path, carry) are the paths of the last nodes."""
    for rows in reversed(climbs):
        upper = above.select(F.col("tree").alias("_tree"), F.col("i").alias("_at"), F.col("path").alias("_path"), *carry)
        joined = rows.join(upper, (F.col("tree") == F.col("_tree")) & (F.col("_block") == F.col("_at")))
        above = joined.withColumn("path", F.concat("path", "_path")).drop("_tree", "_at", "_path", "_block", "top", "left_over")
    return above


def _placed(rows: DataFrame, order: list[str], fanout: int) -> tuple[DataFrame, int]:
    """Adds i and n to (tree, h, ...), and the largest n."""
    block = fanout ** _levels(fanout)
    at = ordered_numbers(rows, ["tree"], order, "_number").withColumn("i", F.col("_number") - 1).drop("_number")
    at = at.withColumn("_home", F.floor(F.col("i") / block))
    homes = at.groupBy("tree", "_home").agg(F.count(F.lit(1)).alias("_in"))
    sizes = homes.groupBy("tree").agg(F.sum("_in").alias("n"))
    # the size of a tree is brought to its blocks first, so that a large tree is no hot key of its leaves
    homes = stored(homes.join(sizes, "tree").select("tree", "_home", "n"), "manifest-blocks")
    return at.join(homes, ["tree", "_home"]).drop("_home"), homes.agg(F.max("n")).first()[0] or 0


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id",
                    fanout: int = FANOUT, keep: dict[str, Column] | None = None) -> DataFrame:
    """Rows (order, leaf, subroot, root, path) and the columns of ``keep``, one for each row of ``docs``.

    ``path`` is an array of (left, right), the siblings at each level from the leaf to the root as joined
    hex digests; ``folded(leaf, path)`` gives the root. ``keep`` names further columns computed from a row.
    Groups are ordered bytewise, null first and apart from the empty text; rows of a group ascend by
    ``order``, null first, and rows that tie by leaf, so equal rows give equal trees in any order. An empty
    table has no rows and no root. Other columns are ignored.
    """
    keep = keep or {}
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(F.col(order).alias("_order"), tree.alias("tree"), leaf_digest(columns).alias("h"),
                         *(c.alias(f"_keep{k}") for k, c in enumerate(keep.values())))
    nodes, largest = _placed(stored(leaves, "manifest-leaves"), ["_order", "h"], fanout)
    climbs, tops = _stages(nodes, largest, fanout)
    groups, count = _placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("_group"), "h"), ["_group"], fanout)
    upper, last = _stages(groups, count, fanout)
    root = last.select("h").first()
    whole = last.select("tree", "i", F.array().cast(_PATH).alias("path"))
    above = _down(upper, whole, []).select(F.col("_group").alias("tree"), F.lit(0).cast("long").alias("i"), "path", F.col("h").alias("subroot"))
    return _down(climbs, above, ["subroot"]).select(
        F.col("_order").alias(order), F.col("h").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path",
        *(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)))


def tamper_report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents.

    The text of rows whose doc_id, as decimal text, has a CRC-32 divisible by 5 is tampered with (A-Z
    lower-cased) before the root is folded anew from its leaf and the manifest's siblings. Rows without a
    doc_id are left as they are; so are null texts.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    seen = {c: F.col(c) for c in COLUMNS} | {"text": F.translate("text", upper, lower)}
    # only rows that are tampered with are hashed a second time
    rows = merkle_manifest(docs, keep={"seen": F.when(picked, leaf_digest(seen))})
    root = folded(F.coalesce("seen", "leaf"), F.col("path"))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
