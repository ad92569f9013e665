"""Catalog queries against their SQL twins. TRAILWORKS_ALL=1 runs every query."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUICK = ("step_view tool_calls normalized_events failure_spans span_candidates thinking_segments retry_transitions evidence_sample store_merge "
         "lineage_matches policy_audit lexical_search holdings_changes snapshot_modified audit_summary_table claim_screening budget_variance "
         "weighted_risk control_limits roll_forward replenishment_coverage backlog_carry_over settlement_events redaction verifier_feedback streamed_store").split()
NAMES = sorted(E.oracle_sql()) if os.environ.get("TRAILWORKS_ALL") else QUICK


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_evidence_sample_at_its_own_sizes(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN user_id % 2 = 0 THEN user_id ELSE user_id % 9 END AS user_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = E.queries()["evidence_sample_full"](spark, str(tmp_path))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()["evidence_sample_full"])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want
    assert len(got[1]) < con.execute("SELECT count(*) FROM events").fetchone()[0]      # some tasks are longer than the budget


def test_retry_changes_query_has_all_changes(spark, tmp_path):
    # one user: a failed week of 100 operations and one of 150
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(7 * w AS INTEGER)) + to_seconds(i) AS ts, 1::BIGINT AS user_id,
          CASE WHEN i % 3 = 0 OR i = n THEN 'error' ELSE 'view' END AS event_type, 1.0::DOUBLE AS value, '{{"k": ' || (i * (w + 2) % 60) || '}}' AS props
        FROM (VALUES (0, 100), (1, 150)) t(w, n), range(1, 151) r(i) WHERE i <= n) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = E.queries()["retry_changes"](spark, str(tmp_path))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()["retry_changes"])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
    kinds = Counter(x[got[0].index("change")] for x in got[1])
    assert kinds["'retained'"] + kinds["'removed'"] == 100 and kinds["'retained'"] + kinds["'added'"] == 150 and min(kinds.values()) > 0
