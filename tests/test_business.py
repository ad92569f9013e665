"""Business operators that SQL does not check: folds, statistics, names, list compaction, packets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailworks.operators import compaction as CP
from trailworks.operators.tabular import carryover, packets, quality, screening, series


def _days(start, demand, quiet, rate):
    if max(0.0, start) > 0.01:
        return next((n for n in (5, 6) if start + demand - rate * n <= 0), 6)
    return 4 if demand <= quiet else 5


@pytest.mark.parametrize("rounded", [True, False])
def test_backlog_fold(spark, rounded):
    r = random.Random(2)
    rows = [(p, w, round(r.uniform(20, 190), 2), 260.0) for p in "abc" for w in range(5, 30)]
    d = carryover.plan_days(spark.createDataFrame(rows, "plan string, week int, demand double, initial double"), ["plan"], 23.31, 112.0, 10.0, rounded)
    got = {(x.plan, x.week): (x.days, x.end_queue) for x in d.collect()}
    cut = (lambda v: round(v, 2)) if rounded else (lambda v: v)
    for p in "abc":
        start = None
        for _, w, demand, initial in [x for x in rows if x[0] == p]:
            demand = cut(demand)
            start = cut(initial - demand) if start is None else start
            n = _days(start, demand, 112.0, 23.31)
            start = cut(start + demand - cut(23.31 * n))
            assert got[p, w][0] == n and got[p, w][1] == pytest.approx(start, abs=1e-6)


def test_detrended_correlation(spark):
    r = np.random.default_rng(1)
    a, b = np.cumsum(r.normal(size=12)) + 20, np.cumsum(r.normal(size=12)) + 30
    rows = [("x", int(y), float(a[y]), float(b[y])) for y in range(12)] + [("short", 1, 1.0, 2.0)]
    got = {x.k: x for x in series.cycle_correlation(spark.createDataFrame(rows, "k string, year int, a double, b double"), ["k"]).collect()}
    d = np.zeros((10, 12))
    for i in range(10):
        d[i, i:i + 3] = [1, -2, 1]
    m = np.eye(12) + 100 * d.T @ d
    want = np.corrcoef(a - np.linalg.solve(m, a), b - np.linalg.solve(m, b))[0, 1]
    assert got["x"].correlation == pytest.approx(want) and got["short"].correlation is None


def test_distribution_tails():
    assert quality._t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)      # table value
    assert quality._t_quantile(0.05, 10) == pytest.approx(2.228138852, abs=1e-6)
    assert quality._f_tail(3.325834530, 2, 20) == pytest.approx(0.0566, abs=2e-3)
    assert quality._f_tail(4.0, 1, 7) == pytest.approx(quality._t_tail(2.0, 7), abs=1e-12)


def test_name_matching_finds_every_close_name(spark):
    r = random.Random(6)
    words = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf"]
    labels = [" ".join(r.sample(words, 3)) for _ in range(40)]
    names = []
    for x in labels:
        chars = list(x)
        for _ in range(r.randrange(0, 4)):
            chars[r.randrange(len(chars))] = r.choice("abcxyz")
        names.append("".join(chars))
        names.append(" ".join(reversed(x.split())))
    lab = spark.createDataFrame([(x, i, i) for i, x in enumerate(labels)], "label string, key int, pos int")
    got = {x.name: x for x in screening.match_names(spark.createDataFrame([(n,) for n in names], "name string"), screening.alias_index(lab)).collect()}

    def common(a, b):
        row = [0] * (len(b) + 1)
        for ca in a:
            now = [0]
            for j, cb in enumerate(b, 1):
                now.append(max(row[j], now[-1], row[j - 1] + (ca == cb)))
            row = now
        return row[-1]

    ratio = lambda a, b: 200 * common(a, b) / (len(a) + len(b))
    order = lambda a: " ".join(sorted(a.split()))
    for n in set(names):
        n2 = " ".join(n.split())
        if n2 in labels:
            assert got[n].method == "exact"
            continue
        plain = max(ratio(n2, x) for x in labels)
        turned = max(ratio(order(n2), order(x)) for x in labels)
        if plain >= 85:
            assert got[n].method == "ratio" and got[n].score == pytest.approx(plain)
        elif turned >= 85:
            assert got[n].method == "sorted" and got[n].score == pytest.approx(turned)
        else:
            assert n not in got


def test_near_names_meet_in_blocks(spark):
    """All pairs at the cutoff, without a join that meets names by their common letter pairs."""
    r = random.Random(7)
    words = ["red", "old", "bolt", "ring", "brand", "12", "7", "small", "economy"]
    sides = [sorted({" ".join(r.choices(words, k=4)) for _ in range(150)}) for _ in range(2)]
    left, right = (spark.createDataFrame([(x,) for x in side], "norm string") for side in sides)
    d = screening.near_names(left, right, 85.0)
    assert "Join" not in d._jdf.queryExecution().executedPlan().toString()
    turned = lambda x: " ".join(sorted(x.split()))
    want = {}
    for a in sides[0]:
        for b in sides[1]:
            both = [200 * screening._lcs(f(a), f(b)) / (len(a) + len(b)) for f in (str, turned)]
            if max(both) >= 85:
                want[a, b] = both
    got = {(x.norm, x.candidate): [x.plain, x.sorted] for x in d.collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_list_compaction_keeps_the_fuller_wording(spark):
    text = ("# T\n- Verify every total before the final report\n```\n- Verify every total before the final report\n```\n1. verify every total before the final report is signed\n"
            "- | Verify every total before the final report\n- Verify it\n- Plan the inventory of all known sources")
    row = CP.compact_lists(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert row.removed == 1
    assert row.text.split("\n")[1] == "- verify every total before the final report is signed"
    assert "1. verify" not in row.text and row.text.count("\n") == text.count("\n") - 1


def test_packet_fields(spark):
    pages = [("a", "CLAIM CODE: clm-2O24-l7\nDate: 03/04/2022\nPurchase Date: 5-6-21\nAdvance 99.00\nTotal Due\n$ 1,234.50"),
             ("b", "nothing 7.25 here 9.75\nTax 100.00\n13/13/2020 then 2021-02-03")]
    got = {x.path: x for x in packets.claim_fields(spark.createDataFrame(pages, "path string, text string")).collect()}
    assert got["a"].claim_code == "CLM-2024-017" and str(got["a"].claim_date) == "2021-06-05" and float(got["a"].amount) == 1234.5
    assert got["b"].claim_code is None and str(got["b"].claim_date) == "2021-02-03" and float(got["b"].amount) == 9.75
    items = packets.line_items(spark.createDataFrame([("p", "Steel beam (long) 2.50 $19.99\nPROJECT TOTAL $19.99\nSteel beam (long) 2.50 $19.99\nno price 3")], "path string, text string"), ["path"]).collect()
    assert [(x.item_description, x.quantity, x.unit_price) for x in items] == [("Steel beam (long)", "2.5", "19.99")]
    assert float(spark.createDataFrame([("total 5.00\nGrand total\n8.00\nProject total 3.00",)], "text string").select(
        packets.page_total(packets.lines_of(F.col("text"))).alias("v")).first().v) == 3.0


def test_weighted_risk_of_a_null_key(spark, tmp_path):
    import duckdb

    from trailworks.plans import catalog

    catalog.load()
    r = random.Random(9)
    spark.createDataFrame([(k, (1, 2, None)[k % 3]) for k in range(60)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(r.randrange(60), r.choice("ANR"), float(r.randrange(1, 50))) for _ in range(2000)],
                          "l_suppkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.JOBS["weighted_risk"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL['weighted_risk']})").fetchall()
    by_key = lambda rows: sorted(map(tuple, rows), key=lambda x: (x[0] is None, x[0]))
    got = by_key(got.collect())
    assert len(got) == 3 and got[2][0] is None and None not in got[2][1:]
    assert [x[0] for x in got] == [x[0] for x in by_key(want)]
    assert all(x[1:] == pytest.approx(y[1:], abs=2e-6) for x, y in zip(got, by_key(want)))


def test_plans_of_a_batch_are_kept_as_numbers():
    import numpy as np
    import pandas as pd

    fold = carryover._fold(12.0, 50.0, 10.0, False).func
    got = fold(pd.Series([np.array([30.0, 80.0]), np.array([])]), pd.Series([0.0, 5.0]))
    assert list(got.columns) == ["days", "capacity", "start", "end"]
    assert all(isinstance(x, np.ndarray) and x.dtype != object for c in got.columns for x in got[c])
    assert got["days"][0].tolist() == [4, 5] and got["start"][0].tolist() == [0.0, -18.0] and got["end"][0].tolist() == [-18.0, 2.0] and len(got["end"][1]) == 0
