"""The manifest against a tree built row by row."""

import hashlib
import zlib

import pytest
from samples import SCHEMA, clashing, lowered

from trailworks.llm import manifest
from trailworks.llm.manifest import folded, merkle_manifest, tamper_report

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def climb(nodes, fanout):
    """Paths of (left, right) of each node, and the top."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i - i % fanout
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fanout])))
        nodes = [H(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return paths, nodes[0]


def plain(rows, fanout=16):
    """(doc_id, leaf, subroot, root, path) for each row, in the manifest's order."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        order = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((order, *climb([leaf(r) for r in order], fanout)))
    above, root = climb([t[2] for t in trees], fanout)
    return [(r[0], leaf(r), top, root, path + up) for (order, paths, top), up in zip(trees, above, strict=True) for r, path in zip(order, paths, strict=True)]


def sample():
    rows = [(None, None, None, None, None), (None, "x", None, None, 1), (7, "", "", "", 0), (7, "", "", "", 0), (8, "Ünïcode 😀 ABC", "de", "ß", 14), (9, "y" * 300_000, "en", "a", None)]
    rows += [(100 + k, f"Text {k}", "en", "hot", k) for k in range(300)]        # one source holds most rows
    rows += [(1000 + k, None if k % 7 == 0 else f"T{k}", None, f"s{k % 40}", None) for k in range(60)]
    rows += [(100, "Text 0", "en", "hot", 0)] * 40 + [(-5, "same id", "en", "hot", 1), (-5, "another text", "en", "hot", 2)]
    return rows


def key(r):
    return repr([r[0], r[1], r[4]])


def test_manifest_equals_a_plain_tree(spark):
    rows = sample()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in merkle_manifest(clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("fanout", [2, 3])
def test_trees_of_many_blocks(spark, monkeypatch, fanout):
    monkeypatch.setattr(manifest, "_BLOCK", 9)      # blocks of 8 or 9 leaves, so several stages
    rows = sample()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, fanout), key=key)


def test_report_finds_what_was_tampered_with(spark):
    rows = sample()
    got = tamper_report(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    want = []
    for (doc_id, own, top, root, path) in plain(rows):
        row = next(r for r in rows if r[0] == doc_id and leaf(r) == own)
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and row[1] is not None:
            row = (row[0], lowered(row[1]), *row[2:])
        h = leaf(row)
        for left, right in path:
            h = H(left, h, right)
        want.append((doc_id, own, top, root, H(*(left + right for left, right in path)), h, h == root))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.verified for r in got} == {True, False}


def test_single_row_and_empty_table(spark):
    one = merkle_manifest(spark.createDataFrame([(1, "a", None, "s", 1)], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root and one.path == []
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tamper_report(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_any_change_moves_the_root(spark):
    rows = [(k, f"t{k}", "en", f"s{k % 3}", k) for k in range(50)]
    docs = merkle_manifest(spark.createDataFrame(rows, SCHEMA))
    root = docs.first().root
    assert docs.where(folded(docs["leaf"], docs["path"]) != docs["root"]).count() == 0
    for changed in (rows[:-1], rows[:20] + [(20, "t2O", "en", "s2", 20)] + rows[21:], rows + [(50, None, None, None, None)]):
        assert merkle_manifest(spark.createDataFrame(changed, SCHEMA)).first().root != root
