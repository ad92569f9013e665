"""Tabular business queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.tabular import (audit, carryover, diff, harmonize, holdings, packets, pivot, quality, rates, replenish,
                                 risk, rollforward, scenario, screening, series)
from .catalog import query
from .views import table

MONEY = "decimal(18,2)"
def D(c):
    return F.col(c).cast("double")


# --- holdings (T1-T7, J13) ------------------------------------------------------------------

def _holdings(spark, sf):
    """Managers are customers, securities parts, periods order years, classes return flags."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("period"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", F.col("l_extendedprice").cast(MONEY).alias("value"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("o_custkey").alias("filing"), "period", F.col("l_partkey").alias("security"),
        F.concat(F.lit("Issuer "), (F.col("l_partkey") % 100).cast("string")).alias("issuer"),
        F.col("l_returnflag").alias("class"), "value")


H_SQL = """h AS (SELECT o_custkey AS filing, year(o_orderdate) AS period, l_partkey AS security, 'Issuer ' || (l_partkey % 100) AS issuer,
  l_returnflag AS class, CAST(l_extendedprice AS DECIMAL(18,2)) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
POS_SQL = H_SQL + """,
pos AS (SELECT filing, period, security, min(issuer) AS issuer, sum(value) AS value FROM h WHERE lower(class) IN ('a', 'n') GROUP BY ALL)"""
CHG_SQL = POS_SQL + """,
chg AS (SELECT coalesce(c.filing, b.filing) AS filing, coalesce(c.security, b.security) AS security, coalesce(c.issuer, b.issuer) AS issuer,
  coalesce(c.value, 0) AS value_current, coalesce(b.value, 0) AS value_baseline, coalesce(c.value, 0) - coalesce(b.value, 0) AS change
  FROM (SELECT * FROM pos WHERE period = 1998) c FULL JOIN (SELECT * FROM pos WHERE period = 1997) b ON c.filing = b.filing AND c.security = b.security)"""
CLASSES = ("a", "n")


@query("holdings_totals", f"""WITH {H_SQL} SELECT filing, period, sum(value)::DOUBLE AS aum, count(*) FILTER (lower(class) IN ('a','n')) AS stock_holdings,
  coalesce(sum(value) FILTER (lower(class) IN ('a','n')), 0)::DOUBLE AS stock_aum, count(DISTINCT security) FILTER (lower(class) IN ('a','n')) AS stock_securities
  FROM h GROUP BY ALL""")
def holdings_totals(spark, sf):
    return holdings.snapshot_totals(_holdings(spark, sf), ["filing", "period"], CLASSES).withColumn("aum", D("aum")).withColumn("stock_aum", D("stock_aum"))


def _changes(spark, sf):
    p = holdings.positions(_holdings(spark, sf), ["filing", "period"], CLASSES)
    return holdings.compare(p.filter("period = 1998").drop("period"), p.filter("period = 1997").drop("period"), ["filing"])


def _out(d):
    return d.select("filing", "security", "issuer", D("value_current").alias("value_current"), D("value_baseline").alias("value_baseline"), D("change").alias("change"))


CHG_OUT = "filing, security, issuer, value_current::DOUBLE AS value_current, value_baseline::DOUBLE AS value_baseline, change::DOUBLE AS change"


@query("holdings_changes", f"WITH {CHG_SQL} SELECT {CHG_OUT} FROM chg")
def holdings_changes(spark, sf):
    return _out(_changes(spark, sf))


@query("holdings_top_buys", f"WITH {CHG_SQL} SELECT {CHG_OUT} FROM chg WHERE change > 0 QUALIFY row_number() OVER (PARTITION BY filing ORDER BY change DESC, security) <= 4")
def holdings_top_buys(spark, sf):
    return _out(holdings.top_changes(_changes(spark, sf), ["filing"], 4, "buy"))


@query("holdings_top_sells", f"WITH {CHG_SQL} SELECT {CHG_OUT} FROM chg WHERE change < 0 QUALIFY row_number() OVER (PARTITION BY filing ORDER BY change, security) <= 3")
def holdings_top_sells(spark, sf):
    return _out(holdings.top_changes(_changes(spark, sf), ["filing"], 3, "sell"))


@query("holdings_new_positions", f"""WITH {CHG_SQL} SELECT {CHG_OUT} FROM chg WHERE value_baseline = 0 AND value_current > 0
  QUALIFY row_number() OVER (PARTITION BY filing ORDER BY change DESC, security) <= 2""")
def holdings_new_positions(spark, sf):
    return _out(holdings.top_changes(_changes(spark, sf), ["filing"], 2, "new"))


@query("top_holders", f"""WITH {H_SQL}, s AS (SELECT security, filing, sum(value) AS value FROM h GROUP BY ALL)
  SELECT security, filing, value::DOUBLE AS value, c_name AS manager FROM s LEFT JOIN customer ON filing = c_custkey
  QUALIFY row_number() OVER (PARTITION BY security ORDER BY s.value DESC, filing) <= 3""")
def top_holders(spark, sf):
    filers = table(spark, sf, "customer").select(F.col("c_custkey").alias("filing"), F.col("c_name").alias("manager"))
    return holdings.top_holders(_holdings(spark, sf), filers, 3).withColumn("value", D("value"))


@query("class_breakdown", f"""WITH {H_SQL}, c AS (SELECT filing, lower(class) AS class, count(*) AS n FROM h WHERE lower(class) IN ('a','n') GROUP BY 1, 2)
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY filing ORDER BY n DESC, class) <= 1""")
def class_breakdown(spark, sf):
    return holdings.class_breakdown(_holdings(spark, sf), ["filing"], 1, CLASSES)


@query("alert_dedup", """WITH a AS (SELECT event_type AS type, user_id, value, props, event_id FROM events)
  SELECT * FROM a WHERE type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1
  UNION ALL SELECT * FROM a WHERE type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) = 1""")
def alert_dedup(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_type").alias("type"), "user_id", "value", "props", "event_id")
    return holdings.dedup_alerts(a, {"purchase": ["user_id"], "error": ["user_id", "props"]}, "event_id")


@query("value_grid", """WITH w AS (SELECT DISTINCT l_suppkey AS filing, l_partkey AS security FROM lineitem WHERE l_returnflag = 'R'),
  v AS (SELECT l_suppkey AS filing, l_partkey AS security, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
  SELECT filing, security, coalesce(value, 0)::DOUBLE AS value FROM w LEFT JOIN v USING (filing, security)""")
def value_grid(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("filing"), F.col("l_partkey").alias("security"),
                                             F.col("l_extendedprice").cast(MONEY).alias("value"), "l_returnflag", "l_linestatus")
    wanted = li.filter("l_returnflag = 'R'").select("filing", "security")
    return holdings.value_grid(li.filter("l_linestatus = 'O'"), wanted).withColumn("value", D("value"))


# --- snapshot diff (T8) ---------------------------------------------------------------------

def _snapshots(spark, sf):
    """Orders against a copy in which low totals are gone and some fields moved."""
    old = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    new = old.filter("o_totalprice >= 20000").select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "P", 1.5).otherwise(0.0)).alias("o_totalprice"),
        F.concat("o_orderpriority", F.lit("  ")).alias("o_orderpriority"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("o_orderstatus"))
    return old, new


@query("snapshot_deleted", "SELECT o_orderkey FROM orders WHERE o_totalprice < 20000")
def snapshot_deleted(spark, sf):
    return diff.deleted_ids(*_snapshots(spark, sf), "o_orderkey")


@query("snapshot_modified", """WITH o AS (SELECT * FROM orders WHERE o_totalprice >= 20000)
  SELECT o_orderkey, 'o_totalprice' AS field, CAST(CAST(o_totalprice AS DECIMAL(28,2)) AS VARCHAR) AS old_value, CAST(CAST(o_totalprice + 1.5 AS DECIMAL(28,2)) AS VARCHAR) AS new_value FROM o WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, NULL FROM o WHERE o_orderpriority = '5-LOW'""")
def snapshot_modified(spark, sf):
    return diff.modified_fields(*_snapshots(spark, sf), "o_orderkey", ints=("o_custkey",), floats=("o_totalprice",))


# --- rule audits (T9-T11, J16) --------------------------------------------------------------

def _flag_counts(d, keys):
    return d.groupBy(*keys, "error_summary").agg(F.count(F.lit(1)).alias("n"), F.sum("error_1").alias("error_1"), F.sum("error_2").alias("error_2"))


def _flag_sql(src, e1, e2, l1, l2, keys):
    return f"""WITH s AS ({src}), f AS (SELECT *, CAST(coalesce({e1}, false) AS INTEGER) AS e1, CAST(coalesce({e2}, false) AS INTEGER) AS e2 FROM s)
    SELECT {keys}, CASE WHEN e1 + e2 = 0 THEN 'None' WHEN e1 + e2 = 2 THEN '{l1}, {l2}' WHEN e1 = 1 THEN '{l1}' ELSE '{l2}' END AS error_summary,
           count(*) AS n, sum(e1)::BIGINT AS error_1, sum(e2)::BIGINT AS error_2 FROM f GROUP BY ALL"""


LO = "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _line_orders(spark, sf, *cols):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(*cols)


@query("audit_price_window", _flag_sql(LO, "l_discount <> l_tax", "l_shipdate::DATE < o_orderdate::DATE OR l_shipdate::DATE > o_orderdate::DATE + 60", "Price Error", "Window Error", "l_returnflag"))
def audit_price_window(spark, sf):
    d = _line_orders(spark, sf, "l_returnflag", "l_discount", "l_tax", "l_shipdate", "o_orderdate", F.date_add(F.to_date("o_orderdate"), 60).alias("last_day"))
    return _flag_counts(audit.apply_rules(d, audit.price_window_rules("l_discount", "l_tax", "l_shipdate", "o_orderdate", "last_day")), ["l_returnflag"])


@query("audit_receiving", _flag_sql("SELECT * FROM lineitem", "l_quantity <> l_linenumber * 7", "l_returnflag IN ('R', 'A') AND l_linestatus <> 'O'", "Qty Variance", "Cold Chain Error", "l_suppkey"))
def audit_receiving(spark, sf):
    d = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_quantity", (F.col("l_linenumber") * 7).cast("double").alias("expected"),
        F.when(F.col("l_returnflag") == "R", " chilled").when(F.col("l_returnflag") == "A", "Frozen ").otherwise("dry").alias("storage"),
        F.when(F.col("l_linestatus") == "O", " ok ").otherwise("warm").alias("temp"))
    return _flag_counts(audit.apply_rules(d, audit.receiving_rules("l_quantity", "expected", "storage", "temp")), ["l_suppkey"])


@query("audit_timesheet", _flag_sql(LO, "l_linenumber * 10 < CAST(left(o_orderpriority, 1) AS INTEGER) * 10", "l_quantity > 40 - CAST(left(o_orderpriority, 1) AS INTEGER) AND l_returnflag = 'N'", "Break Deficit", "Approval Missing", "o_orderpriority"))
def audit_timesheet(spark, sf):
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    rules = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.lit(1).alias("_x")).select(
        "o_orderpriority", (n * 10).alias("min_break"), (40 - n).alias("overtime_threshold"))
    d = _line_orders(spark, sf, "o_orderpriority", (F.col("l_linenumber") * 10).alias("breaks"), F.col("l_quantity").alias("hours"),
                     F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(" ").alias("approval"))
    return _flag_counts(audit.apply_rules(audit.with_rule_table(d, rules, ["o_orderpriority"]), audit.timesheet_rules("breaks", "hours", "approval")), ["o_orderpriority"])


@query("audit_service_queue", _flag_sql(LO, "date_diff('day', o_orderdate, l_shipdate) > CAST(left(o_orderpriority, 1) AS INTEGER) * 15", "o_orderpriority <= '2-HIGH' AND l_returnflag = 'R'", "SLA Breach", "Missing Escalation", "o_orderpriority"))
def audit_service_queue(spark, sf):
    n = F.substring("o_orderpriority", 1, 1).cast("int")
    rules = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.lit(1).alias("_x")).select(
        "o_orderpriority", (n * 15).alias("max_hours"), (n <= 2).alias("escalation_required"))
    d = _line_orders(spark, sf, "o_orderpriority", F.datediff("l_shipdate", "o_orderdate").alias("age"), F.when(F.col("l_returnflag") != "R", "E1").alias("code"))
    return _flag_counts(audit.apply_rules(audit.with_rule_table(d, rules, ["o_orderpriority"]), audit.service_queue_rules("age", "code")), ["o_orderpriority"])


@query("audit_detention", _flag_sql(LO, "date_diff('day', o_orderdate, l_shipdate) > 20 + l_linenumber * 10", "l_returnflag = 'N' AND l_linestatus <> 'F'", "Detention Overrun", "Seal Error", "l_suppkey"))
def audit_detention(spark, sf):
    d = _line_orders(spark, sf, "l_suppkey", F.datediff("l_shipdate", "o_orderdate").alias("actual"), (F.col("l_linenumber") * 10 + 20).alias("allowed"),
                     F.when(F.col("l_returnflag") == "N", "yes ").otherwise("no").alias("required"), F.when(F.col("l_linestatus") == "F", " Verified").otherwise("open").alias("status"))
    return _flag_counts(audit.apply_rules(d, audit.detention_rules("actual", "allowed", "required", "status")), ["l_suppkey"])


def _count_audit(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("at", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_quantity"))
    latest = audit.latest_event(li.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], F.col("l_returnflag") == "N", F.col("l_quantity"), "at")
    plan = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 50).cast("double").alias("expected"),
                                             F.lit(10.0).alias("allowed"), F.when(F.col("o_orderpriority") <= "2-HIGH", "yes").otherwise("no").alias("approval"))
    return audit.plan_audit(plan, latest, ["o_orderkey"], audit.count_variance_rules("approval", "expected", "allowed"))


COUNT_SQL = """ev AS (SELECT l_orderkey, arg_max(l_quantity, (l_shipdate, l_linenumber, l_partkey, l_quantity)) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
  f AS (SELECT o.*, CAST(l_orderkey IS NULL AS INTEGER) AS error_1, CAST(l_orderkey IS NOT NULL AND o_orderpriority <= '2-HIGH' AND abs(o_custkey % 50 - v) > 10 AS INTEGER) AS error_2
  FROM orders o LEFT JOIN ev ON o_orderkey = l_orderkey)"""


@query("audit_count_variance", f"""WITH {COUNT_SQL} SELECT o_orderkey, error_1, error_2, error_1 + error_2 AS total_errors,
  CASE WHEN error_1 = 1 THEN 'Missing Final Count' WHEN error_2 = 1 THEN 'Approval Gap' ELSE 'None' END AS error_summary FROM f""")
def audit_count_variance(spark, sf):
    return _count_audit(spark, sf).select("o_orderkey", "error_1", "error_2", "total_errors", "error_summary")


@query("audit_summary_table", f"""WITH {COUNT_SQL}, g AS (SELECT o_orderpriority, o_custkey::VARCHAR AS o_custkey, sum(error_1)::BIGINT AS error_1, sum(error_2)::BIGINT AS error_2, sum(error_1 + error_2)::BIGINT AS total_errors FROM f GROUP BY 1, 2)
  SELECT * FROM g WHERE total_errors > 0 UNION ALL SELECT 'Grand Total', '-', sum(error_1)::BIGINT, sum(error_2)::BIGINT, sum(total_errors)::BIGINT FROM g""")
def audit_summary_table(spark, sf):
    return audit.summary(_count_audit(spark, sf), ["o_orderpriority", "o_custkey"])


@query("audit_hot_spots", f"WITH {COUNT_SQL} SELECT o_custkey, sum(error_1 + error_2)::BIGINT AS total_errors FROM f GROUP BY 1 HAVING sum(error_1 + error_2) > 0 ORDER BY 2 DESC, 1 LIMIT 3")
def audit_hot_spots(spark, sf):
    return audit.hot_spots(_count_audit(spark, sf), ["o_custkey"], 3)


@query("audit_zone", """WITH ev AS (SELECT l_orderkey, arg_max(l_linestatus, (l_shipdate, l_linenumber, l_partkey, l_linestatus)) AS v FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
  SELECT o_orderkey, CAST(l_orderkey IS NULL AS INTEGER) AS error_1, CAST(coalesce(v <> o_orderstatus, false) AS INTEGER) AS error_2 FROM orders LEFT JOIN ev ON o_orderkey = l_orderkey""")
def audit_zone(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("at", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_linestatus")).withColumnRenamed("l_orderkey", "o_orderkey")
    latest = audit.latest_event(li, ["o_orderkey"], F.col("l_returnflag") != "R", F.col("l_linestatus"), "at")
    return audit.plan_audit(table(spark, sf, "orders"), latest, ["o_orderkey"], audit.zone_rules("o_orderstatus")).select("o_orderkey", "error_1", "error_2")


@query("audit_disposition", """WITH ev AS (SELECT l_orderkey, arg_max(l_returnflag, (l_shipdate, l_linenumber, l_partkey, l_returnflag)) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
  SELECT o_orderkey, CAST(l_orderkey IS NULL AS INTEGER) AS error_1,
    CAST(coalesce(CASE v WHEN 'A' THEN 'F' WHEN 'R' THEN 'P' WHEN 'N' THEN 'N' END <> o_orderstatus, false) AS INTEGER) AS error_2 FROM orders LEFT JOIN ev ON o_orderkey = l_orderkey""")
def audit_disposition(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("at", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_returnflag")).withColumnRenamed("l_orderkey", "o_orderkey")
    aliases = spark.createDataFrame([(" a", "f"), ("r ", "p")], "alias string, name string")
    li = audit.alias_values(li, "l_returnflag", aliases)
    latest = audit.latest_event(li, ["o_orderkey"], F.col("l_linestatus") == "F", F.col("l_returnflag"), "at")
    return audit.plan_audit(table(spark, sf, "orders"), latest, ["o_orderkey"], audit.disposition_rules("o_orderstatus")).select("o_orderkey", "error_1", "error_2")


# --- screening (T4, T12-T16) ----------------------------------------------------------------

@query("claim_screening", """WITH c AS (SELECT CASE WHEN l_linenumber <> 5 THEN l_suppkey END AS party_key, 'acc-' || CASE WHEN l_linenumber = 3 THEN -1 ELSE s_nationkey END AS account,
    l_orderkey AS ref, l_quantity AS amount, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  r AS (SELECT o_orderkey AS ref, (o_custkey % 50)::DOUBLE AS r_amount, o_custkey % 10 AS r_owner FROM orders WHERE o_orderstatus <> 'P'),
  j AS (SELECT c.*, s_suppkey, 'acc-' || s_nationkey AS p_account, r_amount, r_owner FROM c LEFT JOIN supplier ON party_key = s_suppkey LEFT JOIN r USING (ref)),
  f AS (SELECT CASE WHEN party_key IS NULL THEN 'Unknown Employee' WHEN account <> p_account THEN 'Account Mismatch' WHEN r_owner IS NULL THEN 'Invalid Trip ID'
    WHEN abs(amount - r_amount) > 0.01 THEN 'Amount Mismatch' WHEN r_owner <> party_key THEN 'Traveler Mismatch' END AS reason, * FROM j)
  SELECT reason, party_key, count(*) AS n FROM f WHERE reason IS NOT NULL GROUP BY ALL""")
def claim_screening(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey", "l_quantity")
    claims = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(
        F.when(F.col("l_linenumber") != 5, F.col("l_suppkey")).alias("party_key"),
        F.concat(F.lit("acc-"), F.when(F.col("l_linenumber") == 3, -1).otherwise(F.col("s_nationkey")).cast("string")).alias("account"),
        F.col("l_orderkey").alias("ref"), F.col("l_quantity").alias("amount"))
    parties = s.select(F.col("s_suppkey").alias("party_key"), F.concat(F.lit("acc-"), F.col("s_nationkey").cast("string")).alias("p_account"))
    refs = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("ref"), (F.col("o_custkey") % 50).cast("double").alias("r_amount"), (F.col("o_custkey") % 10).alias("r_owner"))
    return screening.screen(claims, parties, refs, party="Employee", reference="Trip ID", owner="Traveler").groupBy("reason", "party_key").agg(F.count(F.lit(1)).alias("n"))


@query("revision_overlay", """WITH r AS (SELECT *, l_linenumber % 4 AS rev, (l_partkey * 10000 + l_suppkey) * 100 + l_quantity::BIGINT AS pos FROM lineitem WHERE l_returnflag <> 'R'),
  b AS (SELECT l_orderkey, arg_max((l_quantity, l_suppkey), (rev, -pos)) AS v FROM r GROUP BY 1)
  SELECT o_orderkey, coalesce(v[1], o_totalprice) AS expected, coalesce(v[2]::VARCHAR, o_orderpriority) AS owner, v IS NOT NULL AS revised FROM orders LEFT JOIN b ON o_orderkey = l_orderkey"""
  .replace("v[1]", "struct_extract(v, 1)").replace("v[2]", "struct_extract(v, 2)"))
def revision_overlay(spark, sf):
    base = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("expected"), F.col("o_orderpriority").alias("owner"))
    rev = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", (F.col("l_linenumber") % 4).alias("rev"), "l_quantity", F.col("l_suppkey").cast("string").alias("who"),
        ((F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("pos"))
    return screening.overlay_revisions(base, rev, "o_orderkey", {"expected": "l_quantity", "owner": "who"}, F.col("l_returnflag") != "R", "rev", "pos")


@query("latest_packets", """SELECT l_orderkey AS ref, l_linenumber AS revision, l_partkey AS page FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1""")
def latest_packets(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ref"), F.col("l_linenumber").alias("revision"), F.col("l_partkey").alias("page"))
    return screening.latest_packets(d, "ref", "revision", "page")


def _labels(spark, sf):
    return table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("label"), F.col("p_partkey").alias("key"), F.col("p_partkey").alias("pos"))


NAMES_SQL = """n0 AS (SELECT p_name || ' ' || p_brand || ' ' || p_type AS label, p_partkey FROM part),
  idx AS (SELECT trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm, min(p_partkey) AS key FROM n0 GROUP BY 1),
  q AS (SELECT DISTINCT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM (
    SELECT CASE WHEN p_partkey % 3 = 0 THEN label WHEN p_partkey % 3 = 1 THEN replace(label, 'i', '') ELSE p_type_first END AS name
    FROM (SELECT *, split_part(label, ' ', 3) || ' ' || split_part(label, ' ', 1) || ' ' || split_part(label, ' ', 2) || ' ' || split_part(label, ' ', 4) AS p_type_first FROM n0))),
  words AS (SELECT norm, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS sorted FROM (SELECT norm FROM idx UNION SELECT norm FROM q))"""


def _name_queries(spark, sf):
    d = _labels(spark, sf)
    part = lambda i: F.split_part("label", F.lit(" "), F.lit(i))
    turned = F.concat_ws(" ", part(3), part(1), part(2), part(4))
    return d.select(F.when(F.col("key") % 3 == 0, F.col("label")).when(F.col("key") % 3 == 1, F.replace("label", F.lit("i"), F.lit(""))).otherwise(turned).alias("name"))


def _lcs_sql(pairs: str) -> str:
    """Length n of the longest common subsequence of all pairs (x, y), row by row of the table."""
    return f"""p_ AS ({pairs}), dp(x, y, i, r) AS (SELECT x, y, 0, list_transform(range(length(y) + 1), lambda k: 0::BIGINT) FROM p_
   UNION ALL SELECT x, y, i + 1, list_transform(range(0, length(y) + 1), lambda j: list_max(list_transform(range(0, j + 1),
     lambda k: CASE WHEN k = 0 THEN r[j + 1] ELSE greatest(r[j + 1], r[k] + (y[k] = x[i + 1])::BIGINT) END))) FROM dp WHERE i < length(x)),
  lcs AS (SELECT x, y, r[length(y) + 1] AS n FROM dp WHERE i = length(x))"""


@query("alias_match", f"""WITH RECURSIVE {NAMES_SQL},
  near AS (SELECT q.norm, i.norm AS cand, a.sorted AS s_norm, b.sorted AS s_cand
     FROM (SELECT DISTINCT norm FROM q WHERE norm NOT IN (SELECT norm FROM idx)) q JOIN words a ON q.norm = a.norm CROSS JOIN idx i JOIN words b ON i.norm = b.norm
     WHERE least(levenshtein(q.norm, i.norm), levenshtein(a.sorted, b.sorted)) <= 0.15 * (length(q.norm) + length(i.norm)) + 0.001),
  {_lcs_sql("SELECT norm AS x, cand AS y FROM near UNION SELECT s_norm, s_cand FROM near")},
  fuzzy AS (SELECT norm, cand, 200.0::DOUBLE * l.n / (length(norm) + length(cand)) AS plain, 200.0::DOUBLE * m.n / (length(norm) + length(cand)) AS srt
     FROM near JOIN lcs l ON l.x = norm AND l.y = cand JOIN lcs m ON m.x = s_norm AND m.y = s_cand),
  best AS (SELECT *, CASE WHEN plain >= 85 THEN 1 ELSE 2 END AS step, CASE WHEN plain >= 85 THEN plain ELSE srt END AS score FROM fuzzy WHERE plain >= 85 OR srt >= 85
     QUALIFY row_number() OVER (PARTITION BY norm ORDER BY CASE WHEN plain >= 85 THEN 1 ELSE 2 END, CASE WHEN plain >= 85 THEN plain ELSE srt END DESC, cand) = 1)
  SELECT name, key, 'exact' AS method, 100.0::DOUBLE AS score FROM q JOIN idx USING (norm)
  UNION ALL SELECT name, key, CASE step WHEN 1 THEN 'ratio' ELSE 'sorted' END, round(score, 4) FROM best JOIN q USING (norm) JOIN idx ON idx.norm = cand""")
def alias_match(spark, sf):
    d = screening.match_names(_name_queries(spark, sf), screening.alias_index(_labels(spark, sf)))
    return d.withColumn("score", F.round("score", 4))


def _best_name_sql(queries: str, labels: str) -> str:
    """Best label of every query, all pairs: CTEs ending in best(name, label, score). queries: name; labels: label, pos."""
    norm = lambda c: f"trim(regexp_replace(replace(replace(lower({c}), 'company', 'co'), 'corporation', 'corp'), '[^a-z0-9]+', ' ', 'g'))"
    turned = lambda c: f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"
    return f"""q_ AS (SELECT name, {norm("name")} AS norm FROM (SELECT DISTINCT name FROM ({queries}))),
  i_ AS (SELECT {norm("label")} AS cand, arg_min(label, pos) AS label FROM ({labels}) GROUP BY 1 HAVING cand <> ''),
  near AS (SELECT DISTINCT norm, cand, {turned("norm")} AS s_norm, {turned("cand")} AS s_cand FROM q_ CROSS JOIN i_),
  {_lcs_sql("SELECT norm AS x, cand AS y FROM near UNION SELECT s_norm, s_cand FROM near")},
  best AS (SELECT name, label, 200.0::DOUBLE * greatest(l.n, m.n) / (length(norm) + length(cand)) AS score, cand
     FROM q_ JOIN near USING (norm) JOIN i_ USING (cand) JOIN lcs l ON l.x = norm AND l.y = cand JOIN lcs m ON m.x = s_norm AND m.y = s_cand
     QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, cand) = 1)"""


def _misspelt(name):
    """Per name: as it is, without vowels, turned around, only its start, and nothing like it."""
    part = lambda i: F.split_part(name, F.lit(" "), F.lit(i))
    return F.explode(F.array(name, F.translate(name, "aeiouAEIOU", ""), F.concat_ws(" ", part(2), part(1)),
                             F.substring(name, 1, 4), F.concat(F.lit("zq "), F.sha2(name, 256).substr(1, 6))))


def _misspelt_sql(table_: str, name: str) -> str:
    return f"""SELECT unnest([{name}, translate({name}, 'aeiouAEIOU', ''), concat_ws(' ', split_part({name}, ' ', 2), split_part({name}, ' ', 1)),
     substring({name}, 1, 4), 'zq ' || substring(sha256({name}), 1, 6)]) AS name FROM {table_}"""


@query("entity_resolution", f"""WITH RECURSIVE f AS (SELECT n_name || ' holdings' AS manager, s_suppkey AS filing, CASE WHEN s_acctbal < 0 THEN 'Y' ELSE 'N' END AS amend FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  rows_ AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY manager ORDER BY amend <> 'N', filing) = 1),
  {_best_name_sql(_misspelt_sql("f", "manager"), "SELECT manager AS label, filing AS pos FROM f")}
  SELECT name AS query, manager, filing, round(score, 6) AS score FROM best JOIN rows_ ON manager = label""")
def entity_resolution(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf, "supplier")
    f = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("filing"), F.concat("n_name", F.lit(" holdings")).alias("manager"),
        F.when(F.col("s_acctbal") < 0, "Y").otherwise("N").alias("is_amendment"), F.col("s_suppkey").alias("pos"))
    q = f.select("manager").distinct().select(_misspelt(F.col("manager")).alias("query"))
    return screening.resolve_entity(q, f).withColumn("score", F.round("score", 6))


@query("issuer_resolution", f"""WITH RECURSIVE h AS (SELECT 'S' || (p_partkey // 2) AS security, p_type AS issuer, ['COM', 'Cl A', 'PUT', 'Note', 'adr'][p_partkey % 5 + 1] AS class, p_partkey AS pos FROM part),
  s AS (SELECT security, lower(issuer) AS issuer, class, pos FROM h WHERE lower(class) IN ('com', 'cl a', 'adr') QUALIFY row_number() OVER (PARTITION BY security ORDER BY pos) = 1),
  first_ AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY issuer ORDER BY pos) = 1),
  {_best_name_sql(_misspelt_sql("part", "p_type"), "SELECT issuer AS label, pos FROM first_")}
  SELECT name AS query, security, issuer, class, round(score, 6) AS score FROM best JOIN first_ ON issuer = label""")
def issuer_resolution(spark, sf):
    p = table(spark, sf, "part")
    classes = F.array(*map(F.lit, ("COM", "Cl A", "PUT", "Note", "adr")))
    h = p.select(F.concat(F.lit("S"), F.expr("p_partkey div 2").cast("string")).alias("security"), F.col("p_type").alias("issuer"),
                 F.get(classes, (F.col("p_partkey") % 5).cast("int")).alias("class"), F.col("p_partkey").alias("pos"))
    q = p.select("p_type").distinct().select(_misspelt(F.col("p_type")).alias("query"))
    return screening.resolve_issuer(q, h).withColumn("score", F.round("score", 6))


@query("code_crosswalk", """SELECT l_orderkey, l_linenumber, l_partkey, s_nationkey AS internal, n_name AS detail FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""")
def code_crosswalk(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("code"))
    m = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("internal"))
    x = table(spark, sf, "nation").select(F.col("n_nationkey").alias("internal"), F.col("n_name").alias("detail"))
    return screening.crosswalk(d, m, x, "code", "internal").drop("code")


# --- pivots (T17-T21, J14) ------------------------------------------------------------------

@query("pivot_revenue_by_type", """SELECT p_type, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def pivot_revenue_by_type(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    d = pivot.lookup(table(spark, sf, "lineitem").select("l_partkey", F.col("l_extendedprice").cast(MONEY).alias("v")), p, ["l_partkey"])
    return pivot.pivot(d, ["p_type"], "v", "sum").withColumn("value", D("value"))


@query("pivot_type_matrix", """SELECT p_type, (sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'A'))::DOUBLE AS "A", (sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'N'))::DOUBLE AS "N",
  (sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R'))::DOUBLE AS "R" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def pivot_type_matrix(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    d = pivot.lookup(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", F.col("l_extendedprice").cast(MONEY).alias("v")), p, ["l_partkey"])
    d = pivot.pivot(d, ["p_type"], "v", "sum", "l_returnflag", ["A", "N", "R"])
    return d.select("p_type", *[D(c).alias(c) for c in ("A", "N", "R")])


@query("pivot_order_counts", """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def pivot_order_counts(spark, sf):
    return pivot.pivot(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", "count", "o_orderstatus", ["F", "O", "P"])


@query("budget_variance", """WITH b AS (SELECT c_nationkey, c_mktsegment, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS bal, count(*) AS n FROM customer GROUP BY ALL),
  e AS (SELECT o_orderkey, c_nationkey, c_mktsegment, 'Q' || quarter(o_orderdate) AS q, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey),
  j AS (SELECT e.*, CASE WHEN q = 'Q1' THEN bal::DOUBLE WHEN q = 'Q2' THEN n * 777.0 WHEN q = 'Q3' THEN 0.0 END AS budget_amount FROM e LEFT JOIN b USING (c_nationkey, c_mktsegment))
  SELECT o_orderkey, q AS fiscal_quarter, round(budget_amount, 2) AS budget_amount, round(amount - budget_amount, 2) AS variance,
    CASE WHEN budget_amount <> 0 THEN round(amount / budget_amount, 8) END AS utilization_pct FROM j""")
def budget_variance(spark, sf):
    c = table(spark, sf, "customer")
    wide = c.groupBy("c_nationkey", "c_mktsegment").agg(
        F.sum(F.col("c_acctbal").cast(MONEY)).cast("double").alias("Q1_BUDGET"), (F.count(F.lit(1)) * 777.0).alias("Q2_BUDGET"), F.lit(0.0).alias("Q3_BUDGET"))
    long = pivot.budget_long(wide, ["c_nationkey", "c_mktsegment"], ["Q1_BUDGET", "Q2_BUDGET", "Q3_BUDGET"])
    o = table(spark, sf, "orders")
    e = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_nationkey", "c_mktsegment", F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("fiscal_quarter"), F.col("o_totalprice").alias("amount"))
    return pivot.budget_variance(e, long, ["c_nationkey", "c_mktsegment", "fiscal_quarter"]).select(
        "o_orderkey", "fiscal_quarter", F.round("budget_amount", 2).alias("budget_amount"), F.round("variance", 2).alias("variance"), F.round("utilization_pct", 8).alias("utilization_pct"))


@query("derived_measures", """WITH d AS (SELECT p_brand, l_quantity, p_retailprice, l_extendedprice, l_discount, l_tax, l_shipdate, o_orderdate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
  SELECT p_brand, count(*) FILTER (l_quantity * p_retailprice < l_extendedprice) AS gains, round(sum(abs(l_discount - l_tax)), 4) AS total_deviation,
    max(date_diff('day', o_orderdate, l_shipdate)) AS longest, count(*) FILTER (l_quantity < 10) AS reorder_yes, min(CAST(floor(year(l_shipdate) / 10) * 10 AS BIGINT)::VARCHAR || 's') AS first_decade FROM d GROUP BY 1""")
def derived_measures(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    d = pivot.lookup(_line_orders(spark, sf, "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "o_orderdate"), p, ["l_partkey"])
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    d = d.select("*", *pivot.margin(F.col("l_quantity"), unit, F.col("p_retailprice")), pivot.yes_no(F.col("l_quantity") < 10).alias("reorder"))
    return d.groupBy("p_brand").agg(
        F.count_if(F.col("l_quantity") * F.col("p_retailprice") < F.col("l_extendedprice")).alias("gains"), F.round(F.sum(pivot.deviation(F.col("l_discount"), F.col("l_tax"))), 4).alias("total_deviation"),
        F.max(F.datediff("l_shipdate", "o_orderdate")).cast("long").alias("longest"), F.count_if(F.col("reorder") == "Yes").alias("reorder_yes"), F.min(pivot.decade(F.year("l_shipdate"))).alias("first_decade"))


@query("product_margin", """SELECT p_type, round(sum(l_quantity * p_retailprice * 1.2), 1) AS revenue, round(sum(l_quantity * p_retailprice * 1.2 - l_quantity * p_retailprice), 1) AS profit FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def product_margin(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_retailprice")
    d = pivot.lookup(table(spark, sf, "lineitem").select("l_partkey", "l_quantity"), p, ["l_partkey"])
    d = d.select("p_type", *pivot.margin(F.col("l_quantity"), F.col("p_retailprice") * 1.2, F.col("p_retailprice")))
    return d.groupBy("p_type").agg(F.round(F.sum("revenue"), 1).alias("revenue"), F.round(F.sum("profit"), 1).alias("profit"))


@query("value_bands", """SELECT CASE WHEN p_size < 3 THEN 'Junior' WHEN p_size < 8 THEN 'Mid' WHEN p_size < 15 THEN 'Senior' ELSE 'Veteran' END AS experience,
  CASE WHEN p_retailprice - 950 <= 0 THEN 'Free' WHEN p_retailprice - 950 <= 100 THEN 'Budget' WHEN p_retailprice - 950 <= 200 THEN 'Standard' ELSE 'Premium' END AS tier,
  CASE WHEN p_size >= 90 THEN 'A' WHEN p_size >= 80 THEN 'B' WHEN p_size >= 70 THEN 'C' WHEN p_size >= 60 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN p_size / 30.0 <= 0.5 THEN 'A' WHEN p_size / 30.0 <= 1.0 THEN 'B' ELSE 'C' END AS quality, count(*) AS n FROM part GROUP BY ALL""")
def value_bands(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").groupBy(
        pivot.experience_band(size).alias("experience"), pivot.price_tier(F.col("p_retailprice") - 950).alias("tier"), pivot.grade_band(size).alias("grade"),
        pivot.quality_grade(size / 30.0).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("tagged_union", """SELECT source, nationkey, count(*) AS n, max(balance) AS top FROM (SELECT 'customer' AS source, c_nationkey AS nationkey, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier) GROUP BY ALL""")
def tagged_union(spark, sf):
    d = pivot.tagged_union({
        "customer": table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance")),
        "supplier": table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance"))})
    return d.groupBy("source", "nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("balance").alias("top"))


# --- risk (T22, T23) ------------------------------------------------------------------------

@query("scenario_lookup", """WITH t AS (SELECT p_brand, l_returnflag AS scenario, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY ALL),
  r AS (SELECT DISTINCT p_brand, l_returnflag AS scenario FROM lineitem JOIN part ON l_partkey = p_partkey)
  SELECT p_brand, scenario, coalesce(value, 0.0) AS value FROM r LEFT JOIN t USING (p_brand, scenario)""")
def scenario_lookup(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    d = pivot.lookup(table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_quantity"), p, ["l_partkey"])
    wide = pivot.pivot(d, ["p_brand"], "l_quantity", "sum", "l_returnflag", ["A", "N"])
    requests = d.select("p_brand", F.col("l_returnflag").alias("scenario")).distinct()
    return risk.scenario_lookup(requests, wide, "p_brand", ["A", "N"])


@query("weighted_risk", """WITH s AS (SELECT s_nationkey, l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS t, sum(l_quantity) FILTER (l_returnflag = 'N') AS m, sum(l_quantity) FILTER (l_returnflag = 'R') AS b
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), r AS (SELECT *, coalesce((t - m) / nullif(b, 0) * 100, 0.0) AS v FROM s)
  SELECT s_nationkey, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, round(median(v), 6) AS median_value, round(avg(v), 6) AS mean_value,
    round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75, round(sum(v * b) / sum(b), 6) AS weighted_mean FROM r GROUP BY 1""")
def weighted_risk(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    d = pivot.lookup(table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity"), s, ["l_suppkey"])
    wide = pivot.pivot(d, ["s_nationkey", "l_suppkey"], "l_quantity", "sum", "l_returnflag", ["A", "N", "R"])
    r = wide.withColumn("v", risk.ratio(F.col("A"), F.col("N"), F.col("R")))
    st = risk.risk_statistics(r, ["s_nationkey"], "v", "R")
    return st.select("s_nationkey", *[F.round(c, 6).alias(c) for c in st.columns if c != "s_nationkey"])


# --- series (T24, T25) ----------------------------------------------------------------------

def _quarterly(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    d = pivot.lookup(table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"), s, ["l_suppkey"])
    return d.groupBy("s_nationkey", (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("year")).agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("rev"), F.count(F.lit(1)).alias("n"))


CYCLE_SQL = """WITH RECURSIVE q AS (SELECT s_nationkey, year(l_shipdate) * 4 + quarter(l_shipdate) AS year, sum(l_quantity) AS qty, sum(l_extendedprice) AS rev, count(*) AS n
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
  s AS (SELECT s_nationkey, row_number() OVER w AS i, count(*) OVER (PARTITION BY s_nationkey) AS m, ln(rev / n) AS a, ln(qty / n) AS b FROM q WINDOW w AS (PARTITION BY s_nationkey ORDER BY year)),
  c AS (SELECT *, 1 + 100.0::DOUBLE * CASE WHEN i IN (1, m) THEN 1 WHEN i IN (2, m - 1) THEN 5 ELSE 6 END AS main,
    100.0::DOUBLE * CASE WHEN i = m THEN 0 WHEN i IN (1, m - 1) THEN -2 ELSE -4 END AS near, CASE WHEN i > m - 2 THEN 0 ELSE 100.0::DOUBLE END AS far FROM s),
  f(s_nationkey, i, p1, o1, t1, za1, zb1, p0, t0, za0, zb0) AS (
    SELECT s_nationkey, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM (SELECT DISTINCT s_nationkey FROM c)
    UNION ALL SELECT c.s_nationkey, c.i, main - p1 * o1 * o1 - p0 * t0 * t0, (near - p1 * o1 * t1) / (main - p1 * o1 * o1 - p0 * t0 * t0), far / (main - p1 * o1 * o1 - p0 * t0 * t0),
      a - o1 * za1 - t0 * za0, b - o1 * zb1 - t0 * zb0, p1, t1, za1, zb1 FROM f JOIN c ON c.s_nationkey = f.s_nationkey AND c.i = f.i + 1),
  g(s_nationkey, i, xa1, xb1, xa2, xb2) AS (
    SELECT s_nationkey, max(i) + 1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM f GROUP BY 1
    UNION ALL SELECT f.s_nationkey, f.i, f.za1 / f.p1 - f.o1 * g.xa1 - f.t1 * g.xa2, f.zb1 / f.p1 - f.o1 * g.xb1 - f.t1 * g.xb2, g.xa1, g.xb1 FROM g JOIN f ON f.s_nationkey = g.s_nationkey AND f.i = g.i - 1 AND f.i > 0)
  SELECT s_nationkey, count(*) AS n_years, CASE WHEN count(*) >= 8 THEN round(corr(a - xa1, b - xb1), 5) END AS correlation FROM s JOIN g USING (s_nationkey, i) GROUP BY 1"""


@query("cycle_correlation", CYCLE_SQL)
def cycle_correlation(spark, sf):
    d = _quarterly(spark, sf).select("s_nationkey", "year", series.real_log(F.col("rev"), F.col("n")).alias("a"), series.real_log(F.col("qty"), F.col("n")).alias("b"))
    return series.cycle_correlation(d, ["s_nationkey"]).withColumn("correlation", F.round("correlation", 5))


@query("annual_series", """WITH m AS (SELECT l_returnflag, year(l_shipdate) AS year, month(l_shipdate) AS period, sum(l_quantity) AS amount FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
  SELECT l_returnflag, year, arg_max(amount, period) AS value FROM m WHERE year < 2001 GROUP BY ALL UNION ALL SELECT l_returnflag, year, round(avg(amount), 6) FROM m WHERE year = 2001 GROUP BY ALL""")
def annual_series(spark, sf):
    m = table(spark, sf, "lineitem").filter("l_linestatus = 'F'").groupBy("l_returnflag", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("period")).agg(F.sum("l_quantity").alias("amount"))
    return series.annual_series(m, ["l_returnflag"], "period", "amount", 2001).withColumn("value", F.round("value", 6))


@query("alias_priority_series", """WITH m AS (SELECT l_returnflag, year(l_shipdate) AS year, l_linenumber AS priority, sum(l_quantity) AS amount FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'N') GROUP BY ALL)
  SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' ELSE 'none' END AS series, year, arg_min(amount, priority) AS amount FROM m GROUP BY ALL""")
def alias_priority_series(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("Flag "), F.col("l_returnflag")).alias("alias"), F.when(F.col("l_linestatus") == "F", "Official").otherwise("draft").alias("record_type"),
                                             F.year("l_shipdate").alias("year"), F.col("l_linenumber").alias("priority")).agg(F.sum("l_quantity").alias("amount"))
    aliases = spark.createDataFrame([("accepted", "flag-a"), ("none", "FLAG N")], "series string, alias string")
    return series.by_priority(m, aliases, ["year"])


@query("register_series", """WITH m AS (SELECT p_type AS code, l_linestatus AS status, year(l_shipdate) AS year, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT p_type AS series, m.year, value FROM (SELECT DISTINCT p_type FROM part) JOIN m ON code = p_type AND lower(status) = 'f' WHERE m.year < 2001
  UNION ALL SELECT p_type, m.year, value FROM (SELECT DISTINCT p_type FROM part) JOIN m ON code = p_type AND status = 'O' WHERE m.year = 2001""")
def register_series(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("code"))
    m = pivot.lookup(table(spark, sf, "lineitem").select("l_partkey", "l_linestatus", "l_shipdate", "l_quantity"), p, ["l_partkey"]).groupBy(
        "code", F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("value"))
    reg = table(spark, sf, "part").select(F.col("p_type").alias("series")).distinct().select(
        "series", F.col("series").alias("history_code"), F.lit("f").alias("history_status"), F.col("series").alias("current_code"), F.lit("O").alias("version"))
    return series.from_register(m, m.withColumnRenamed("status", "version"), reg, 2001)


# --- process quality (T26, T27) -------------------------------------------------------------

def _daily(spark, sf):
    """Daily totals per event type, numbered along the calendar."""
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        F.sum(F.col("value").cast(MONEY)).cast("double").alias("v"), F.count(F.lit(1)).alias("units"), F.count_if(F.col("value") > 90).alias("failures"))
    return quality.indexed(d, ["event_type"], ["day"], F.trunc("day", "month"))


DAY_SQL = """d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS v, count(*) AS units, count(*) FILTER (value > 90) AS failures FROM events GROUP BY ALL),
  x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS idx, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS prev FROM d)"""


@query("weekday_anova", f"""WITH {DAY_SQL}, g AS (SELECT event_type, dayofweek(day) + 1 AS wd, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM x GROUP BY ALL),
  t AS (SELECT event_type, count(*) AS groups, sum(n)::BIGINT AS n, sum(ss) AS within, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS between_, arg_max(wd, m) AS hi, arg_min(wd, m) AS lo FROM g GROUP BY 1)
  SELECT event_type, groups, n, round((between_ / (groups - 1)) / (within / (n - groups)), 6) AS f_stat, hi::INTEGER AS highest_mean_group, lo::INTEGER AS lowest_mean_group FROM t""")
def weekday_anova(spark, sf):
    d = _daily(spark, sf).withColumn("wd", F.dayofweek("day"))
    return quality.anova(d, ["event_type"], "wd", "v").select("event_type", "groups", "n", F.round("f_stat", 6).alias("f_stat"), "highest_mean_group", "lowest_mean_group")


# The tail of F is a regularized incomplete beta function; its integral by Simpson's rule.
@query("weekday_anova_p_values", f"""WITH {DAY_SQL}, g AS (SELECT event_type, dayofweek(day) AS wd, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM x GROUP BY ALL),
  t AS (SELECT event_type, count(*) - 1 AS d1, sum(n)::DOUBLE - count(*) AS d2, ((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM g GROUP BY 1),
  u AS (SELECT *, d2 / 2 AS a, d1 / 2 AS b, d2 / (d2 + d1 * f) AS top FROM t),
  s AS (SELECT event_type, f, sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END *
    CASE WHEN k = 0 THEN 0 ELSE exp((a - 1) * ln(top * k / 20000.0) + (b - 1) * ln(1 - top * k / 20000.0) + lgamma(a + b) - lgamma(a) - lgamma(b)) END) * top / 60000 AS p
    FROM u CROSS JOIN range(20001) r(k) GROUP BY event_type, f, top)
  SELECT event_type, round(f, 6) AS f_stat, round(p, 6) AS p_value FROM s""")
def weekday_anova_p_values(spark, sf):
    d = _daily(spark, sf).withColumn("wd", F.dayofweek("day"))
    return quality.anova(d, ["event_type"], "wd", "v").select("event_type", F.round("f_stat", 6).alias("f_stat"), F.round("p_value", 6).alias("p_value"))


@query("control_limits", f"""WITH {DAY_SQL} SELECT event_type, round(avg(v), 4) AS center, round(avg(abs(v - prev)), 4) AS mr_bar, round(avg(v) + 3 * avg(abs(v - prev)) / 1.128, 4) AS ucl,
  round(avg(v) - 3 * avg(abs(v - prev)) / 1.128, 4) AS lcl, round(3.267 * avg(abs(v - prev)), 4) AS mr_ucl FROM x GROUP BY 1""")
def control_limits(spark, sf):
    d = quality.control_limits(_daily(spark, sf), ["event_type"], "idx", "v")
    return d.select("event_type", *[F.round(c, 4).alias(c) for c in d.columns if c != "event_type"])


@query("trend_stability", f"""WITH {DAY_SQL}, r AS (SELECT event_type, count(v) AS n, regr_slope(v, idx) AS slope, regr_intercept(v, idx) AS intercept, corr(v, idx) AS r, regr_sxx(v, idx) AS sxx, regr_syy(v, idx) AS syy, regr_sxy(v, idx) AS sxy FROM x GROUP BY 1),
  t AS (SELECT *, slope / sqrt((syy - slope * sxy) / (n - 2) / sxx) AS t FROM r)
  SELECT event_type, n, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r, 6) AS r, round(t, 6) AS t_stat, CASE WHEN abs(t) < 2 THEN 'Stable' ELSE 'Unstable' END AS stability,
    CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction FROM t""")
def trend_stability(spark, sf):
    d = quality.regression(_daily(spark, sf), ["event_type"], "idx", "v")
    return d.select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r", 6).alias("r"), F.round("t_stat", 6).alias("t_stat"), "stability", "direction")


@query("mean_against_target", f"""WITH {DAY_SQL} SELECT event_type, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round((avg(v) - 500) / (stddev_samp(v) / sqrt(count(v))), 5) AS t_stat,
  round((avg(v) - 500) / (3 * stddev_samp(v)), 6) AS cpk_lower FROM x GROUP BY 1""")
def mean_against_target(spark, sf):
    d = quality.one_sample_t(_daily(spark, sf), ["event_type"], "v", 500.0)
    return d.select("event_type", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("t_stat", 5).alias("t_stat"), F.round("cpk_lower", 6).alias("cpk_lower"))


# The density of t is summed on a fine grid; the quantile is where the two-sided tail falls to 0.05.
@query("mean_test_p_values", f"""WITH {DAY_SQL}, m AS (SELECT event_type, count(v) AS n, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS se, count(v) - 1.0::DOUBLE AS df FROM x GROUP BY 1),
  u AS (SELECT *, abs(mean - 500) / se AS t, lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) AS c FROM m),
  p AS (SELECT event_type, 1 - 2 * sum(CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(c - (df + 1) / 2 * ln(1 + (least(t, 60) * k / 20000) ** 2 / df))) * least(t, 60) / 60000 AS p
    FROM u CROSS JOIN range(20001) r(k) GROUP BY event_type, t),
  y AS (SELECT event_type, k * 0.0002 AS pos, exp(c - (df + 1) / 2 * ln(1 + (k * 0.0002) ** 2 / df)) AS y FROM u CROSS JOIN range(60001) r(k)),
  z AS (SELECT event_type, pos, 1 - 2 * sum((y + before) / 2 * 0.0002) OVER (PARTITION BY event_type ORDER BY pos) AS tail FROM (SELECT *, lag(y, 1, y) OVER (PARTITION BY event_type ORDER BY pos) AS before FROM y) WHERE pos > 0),
  q AS (SELECT event_type, max(pos) FILTER (tail > 0.05) AS lo, min(tail) FILTER (tail > 0.05) AS t0, max(tail) FILTER (tail <= 0.05) AS t1 FROM z GROUP BY 1)
  SELECT event_type, round(greatest(p, 0), 6) AS p_value, round(mean - (lo + 0.0002 * (t0 - 0.05) / (t0 - t1)) * se, 4) AS ci_low, round(mean + (lo + 0.0002 * (t0 - 0.05) / (t0 - t1)) * se, 4) AS ci_high,
    CASE WHEN p < 0.05 THEN 'reject_h0' ELSE 'fail_to_reject_h0' END AS decision FROM m JOIN p USING (event_type) JOIN q USING (event_type)""")
def mean_test_p_values(spark, sf):
    d = quality.one_sample_t(_daily(spark, sf), ["event_type"], "v", 500.0)
    return d.select("event_type", F.round("p_value", 6).alias("p_value"), F.round("ci_low", 4).alias("ci_low"), F.round("ci_high", 4).alias("ci_high"), "decision")


@query("variation_ranking", f"""WITH {DAY_SQL}, c AS (SELECT event_type, avg(v) AS m, stddev_samp(v) AS s, stddev_samp(v) / avg(v) AS cv FROM x GROUP BY 1)
  SELECT event_type, round(m, 4) AS mean, round(s, 4) AS std, round(cv, 6) AS cv, row_number() OVER (ORDER BY cv DESC, event_type)::INTEGER AS cv_rank FROM c""")
def variation_ranking(spark, sf):
    d = quality.rank_by_variation(quality.variation(_daily(spark, sf), ["event_type"], "v").withColumn("scope", F.lit("all")), ["scope"], "event_type")
    return d.select("event_type", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), F.round("cv", 6).alias("cv"), "cv_rank")


@query("failure_rate_interval", f"""WITH {DAY_SQL}, s AS (SELECT event_type, sum(failures)::BIGINT AS f, sum(units)::BIGINT AS n FROM x GROUP BY 1), w AS (SELECT *, f / n::DOUBLE AS p, 1.959963984540054 AS z FROM s)
  SELECT event_type, f AS failures, n AS units, round(100 * p, 6) AS rate_pct, round(100 * ((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt((p*(1-p) + z*z/(4*n)) / n) / (1 + z*z/n)), 6) AS ci_low,
   round(100 * ((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt((p*(1-p) + z*z/(4*n)) / n) / (1 + z*z/n)), 6) AS ci_high, CASE WHEN 100 * p <= 1 THEN 'Capable' ELSE 'Not Capable' END AS capability FROM w""")
def failure_rate_interval(spark, sf):
    d = quality.failure_rate(_daily(spark, sf), ["event_type"], "failures", "units")
    return d.select("event_type", "failures", "units", *[F.round(c, 6).alias(c) for c in ("rate_pct", "ci_low", "ci_high")], "capability")


# --- harmonization (T28, T29) ---------------------------------------------------------------

UNITS = {"bal": harmonize.Unit("single", 100.0, -10.0, 50.0), "nat": harmonize.Unit("single-reverse", 10.0, 30.0, 250.0)}


@query("harmonized_panel", """WITH t AS (SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_nationkey <> 7)
  SELECT c_custkey, printf('%.2f', CASE WHEN c_acctbal BETWEEN -10 AND 50 THEN c_acctbal WHEN c_acctbal / 100 BETWEEN -10 AND 50 THEN round_even(CAST(c_acctbal / 100 AS DECIMAL(18,4)), 2)::DOUBLE ELSE c_acctbal END) AS bal,
   printf('%.2f', CASE WHEN c_nationkey BETWEEN 30 AND 250 THEN c_nationkey::DOUBLE WHEN c_nationkey * 10 BETWEEN 30 AND 250 THEN c_nationkey * 10.0::DOUBLE ELSE c_nationkey::DOUBLE END) AS nat FROM t""")
def harmonized_panel(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.replace(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")).alias("bal"),
                                            F.when(F.col("c_nationkey") != 7, F.col("c_nationkey").cast("string")).otherwise(" nan ").alias("nat"))
    return harmonize.harmonize(d, UNITS)


@query("latest_complete_draw", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def latest_complete_draw(spark, sf):
    d = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))
    return harmonize.latest_complete(d, ["o_custkey"], "o_orderkey", ["o_totalprice", "status"]).drop("status")


@query("panel_join", """SELECT c_custkey, c_acctbal, n, top FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a ON c_custkey = a.o_custkey
  JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON c_custkey = b.o_custkey""")
def panel_join(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return harmonize.join_panels([
        table(spark, sf, "customer").select("c_custkey", "c_acctbal"), o.filter("o_orderstatus = 'F'").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n")),
        o.filter("o_orderstatus = 'P'").groupBy("c_custkey").agg(F.max("o_totalprice").alias("top"))], ["c_custkey"])


# --- roll-forward (T30-T32) -----------------------------------------------------------------

def _rolled(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice", "l_returnflag")
    flows = li.select("l_partkey", "month", F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice")).otherwise(0.0).alias("adds"),
                      F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0).alias("releases"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("opening"))
    return rollforward.roll_forward(rollforward.dense_months(p, flows, ["l_partkey"], flows.select("month")), ["l_partkey"])


ROLL_SQL = """f AS (SELECT l_partkey, strftime(l_shipdate, '%Y-%m') AS month, sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS adds,
   sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS releases FROM lineitem GROUP BY ALL),
  g AS (SELECT p_partkey AS l_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS opening, m.month FROM part CROSS JOIN (SELECT DISTINCT month FROM f) m),
  r AS (SELECT l_partkey, opening, month, coalesce(adds, 0) AS adds, coalesce(releases, 0) AS releases,
   opening + sum(coalesce(adds, 0) - coalesce(releases, 0)) OVER (PARTITION BY l_partkey ORDER BY month) AS ending_balance FROM g LEFT JOIN f USING (l_partkey, month))"""


@query("roll_forward", f"WITH {ROLL_SQL} SELECT l_partkey, month, opening::DOUBLE AS opening, adds::DOUBLE AS adds, releases::DOUBLE AS releases, ending_balance::DOUBLE AS ending_balance FROM r")
def roll_forward(spark, sf):
    return _rolled(spark, sf).select("l_partkey", "month", *[D(c).alias(c) for c in ("opening", "adds", "releases", "ending_balance")])


@query("roll_forward_totals", f"""WITH {ROLL_SQL}, b AS (SELECT p_brand, sum(adds) AS adds, sum(releases) AS releases, sum(ending_balance) FILTER (month = (SELECT max(month) FROM r)) AS ending_balance,
    sum(CAST(p_retailprice AS DECIMAL(18,2))) FILTER (month = (SELECT max(month) FROM r)) AS gl FROM r JOIN part ON l_partkey = p_partkey GROUP BY 1)
  SELECT p_brand, adds::DOUBLE AS adds, releases::DOUBLE AS releases, ending_balance::DOUBLE AS ending_balance, gl::DOUBLE AS gl_balance, (gl - ending_balance)::DOUBLE AS difference FROM b
  UNION ALL SELECT 'Total', sum(adds)::DOUBLE, sum(releases)::DOUBLE, sum(ending_balance)::DOUBLE, sum(gl)::DOUBLE, sum(gl - ending_balance)::DOUBLE FROM b""")
def roll_forward_totals(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    d = pivot.lookup(_rolled(spark, sf), p.drop("p_retailprice"), ["l_partkey"])
    gl = p.groupBy("p_brand").agg(F.sum(F.col("p_retailprice").cast(MONEY)).alias("gl_balance"))
    return rollforward.totals(d, "p_brand", gl).select("p_brand", *[D(c).alias(c) for c in ("adds", "releases", "ending_balance", "gl_balance", "difference")])


@query("patched_schedule", """WITH r AS (SELECT l_orderkey, arg_max(l_quantity, (l_linenumber, -((l_partkey * 10000 + l_suppkey) * 100 + l_quantity::BIGINT))) AS q FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
  SELECT l_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey::DOUBLE ELSE q END AS amount FROM r JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT -o_orderkey - 1, o_totalprice FROM orders WHERE o_orderstatus = 'P'""")
def patched_schedule(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("amount"), "l_returnflag",
                                             ((F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("pos"))
    base = rollforward.latest_records(li, ["l_orderkey"], "l_linenumber", F.col("l_returnflag") != "A", "pos").select("l_orderkey", "amount")
    o = table(spark, sf, "orders")
    over = o.select(F.lit("override").alias("action"), F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise("").alias("amount"))
    new = o.filter("o_orderstatus = 'P'").select(F.lit("insert").alias("action"), (-F.col("o_orderkey") - 1).alias("l_orderkey"), F.col("o_totalprice").cast("string").alias("amount"))
    return rollforward.apply_patches(base, over.unionByName(new), ["l_orderkey"], ["amount"])


# --- replenishment (T33-T35) ----------------------------------------------------------------

def _stock(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("units"), (F.col("p_size") % 6).cast("double").alias("rate"), F.lit(4.0).alias("stddev"), (F.col("p_size") * 2.0).alias("expiring"))
    inbound = table(spark, sf, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("p_partkey"), F.to_date("l_shipdate").alias("eta"), F.col("l_quantity").alias("qty")) \
        .filter(F.col("eta") >= F.lit("1998-06-01").cast("date"))
    return p, inbound


DAY0, DAY1 = "DATE '1998-06-01'", "DATE '1998-08-30'"
STOCK_SQL = f"""s AS (SELECT p_partkey, p_size * 10.0::DOUBLE AS units, (p_size % 6)::DOUBLE AS rate, p_size * 2.0::DOUBLE AS expiring FROM part),
  i AS (SELECT l_partkey, CAST(l_shipdate AS DATE) AS eta, l_quantity AS qty FROM lineitem WHERE l_returnflag = 'N' AND CAST(l_shipdate AS DATE) >= {DAY0}),
  a AS (SELECT l_partkey, sum(qty) FILTER (eta <= {DAY1}) AS q, min(eta) FILTER (eta <= {DAY1}) AS e_in, min(eta) AS e_all FROM i GROUP BY 1),
  j AS (SELECT s.*, coalesce(q, 0.0) AS inbound, e_in, e_all, date_diff('day', {DAY0}, {DAY1}) AS days FROM s LEFT JOIN a ON p_partkey = l_partkey)"""


@query("replenishment_coverage", f"""WITH {STOCK_SQL}, n AS (SELECT *, CASE WHEN rate > 0 THEN units / rate END AS doh, CASE WHEN rate > 0 THEN greatest(0.0, rate * days - units - inbound) ELSE 0.0 END AS need FROM j),
  m AS (SELECT *, CASE WHEN need > 0 THEN ceil(need / 7.0)::BIGINT ELSE 0 END AS packs, {DAY0} + floor(doh)::INTEGER AS oos FROM n)
  SELECT p_partkey, units, rate, round(doh * 10000) / 10000 AS days_on_hand, strftime(oos, '%Y-%m-%d') AS stock_out_date, inbound, need AS additional, packs AS containers,
    CASE WHEN packs > 0 THEN strftime(oos, '%Y-%m-%d') END AS required_date, coalesce(packs > 0 AND (e_in IS NULL OR oos < e_in), false) AS earlier FROM m""")
def replenishment_coverage(spark, sf):
    s, i = _stock(spark, sf)
    d = replenish.coverage(s, i, ["p_partkey"], F.lit("1998-06-01").cast("date"), F.lit("1998-08-30").cast("date"), F.lit(7.0))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return d.select("p_partkey", "units", "rate", "days_on_hand", text("stock_out_date"), "inbound", "additional", "containers", text("required_date"), "earlier")


@query("stochastic_stock_plan", f"""WITH {STOCK_SQL}, n AS (SELECT *, CASE WHEN rate > 0 THEN units / rate END AS doh, CASE WHEN rate > 0 THEN greatest(0.0, rate * days + 1.645 * 4.0 * sqrt(days) - units - inbound) ELSE 0.0 END AS need FROM j),
  m AS (SELECT *, CASE WHEN need > 0 THEN ceil((need - 1e-9) / 7.0)::BIGINT ELSE 0 END AS packs, {DAY0} + floor(doh + 1e-9)::INTEGER AS oos, {DAY0} + floor((units + inbound) / nullif(rate, 0) + 1e-9)::INTEGER AS dlv FROM n),
  k AS (SELECT *, CASE WHEN packs > 0 THEN CASE WHEN e_all <= oos THEN dlv ELSE oos END END AS req FROM m)
  SELECT p_partkey, round(need, 6) AS additional, packs AS containers, strftime(req, '%Y-%m-%d') AS required_date, packs > 0 AND abs(packs * 7.0 - need) > 1e-9 AS rounding,
    coalesce(packs > 0 AND (e_all IS NULL OR req < e_all), false) AS earlier FROM k""")
def stochastic_stock_plan(spark, sf):
    s, i = _stock(spark, sf)
    d = replenish.stock_plan(s, i, ["p_partkey"], F.lit("1998-06-01").cast("date"), F.lit("1998-08-30").cast("date"), F.lit(7.0), "stochastic")
    return d.select("p_partkey", F.round("additional", 6).alias("additional"), "containers", F.date_format("required_date", "yyyy-MM-dd").alias("required_date"), "rounding", "earlier")


@query("shelf_stock_plan", f"""WITH {STOCK_SQL}, n AS (SELECT *, greatest(0.0, units - expiring) AS usable FROM j)
  SELECT p_partkey, usable, CASE WHEN rate > 0 THEN greatest(0.0, rate * days - usable - inbound) ELSE 0.0 END AS additional FROM n""")
def shelf_stock_plan(spark, sf):
    s, i = _stock(spark, sf)
    return replenish.stock_plan(s, i, ["p_partkey"], F.lit("1998-06-01").cast("date"), F.lit("1998-08-30").cast("date"), F.lit(7.0), "shelf").select("p_partkey", "usable", "additional")


@query("inbound_cleanup", """WITH l AS (SELECT l_orderkey, arg_max((l_returnflag, l_suppkey, l_quantity), (l_linenumber, -((l_partkey * 10000 + l_suppkey) * 100 + l_quantity::BIGINT))) AS r FROM lineitem GROUP BY 1)
  SELECT l_orderkey, struct_extract(r, 3) AS qty, n_name AS location FROM l JOIN nation ON struct_extract(r, 2) = n_nationkey WHERE struct_extract(r, 1) IN ('N', 'A')""")
def inbound_cleanup(spark, sf):
    feed = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lower("l_returnflag").alias("state"), F.concat(F.lit("z"), F.col("l_suppkey").cast("string")).alias("zone"), F.col("l_quantity").alias("qty"),
                                               ((F.col("l_partkey") * 10000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("pos"))
    aliases = table(spark, sf, "nation").select(F.concat(F.lit(" Z"), F.col("n_nationkey").cast("string")).alias("alias"), F.col("n_name").alias("location"))
    return replenish.latest_shipments(feed, "l_orderkey", "l_linenumber", ("N", "A"), "pos", aliases, "zone").select("l_orderkey", "qty", "location")


# --- scenarios (T36, T37) -------------------------------------------------------------------

def _campaigns(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("campaign_id"), F.concat(F.lit("Camp "), F.col("p_partkey").cast("string")).alias("name"),
                                        F.when(F.col("p_type") != "PROMO", "review").otherwise("skip").alias("analysis_flag"), "p_size", "p_retailprice")
    holds = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("campaign_id"), F.when(F.col("l_quantity") * F.col("l_linenumber") >= 343, "hold").otherwise("none").alias("suspension_status"))
    open_ = scenario.open_campaigns(p, holds)
    billing = table(spark, sf, "lineitem").select(
        F.concat(F.lit("CAMP "), F.col("l_partkey").cast("string")).alias("campaign_label"), F.when(F.col("l_linestatus") == "O", "active").otherwise("closed").alias("status"),
        F.struct("l_shipdate", "l_quantity").alias("cycle_tag"), F.col("l_quantity").alias("payment"))
    pay = scenario.latest_payments(billing, open_.select(F.col("name").alias("label"), "campaign_id"))
    over = scenario.clinic_overrides(table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("campaign_id"), F.struct("l_linenumber", "l_suppkey").alias("revision"), F.when(F.col("l_returnflag") == "A", "approved").otherwise("draft").alias("state"), (F.col("l_suppkey") % 9 + 1).cast("int").alias("active_clinics")))
    d = open_.join(pay, "campaign_id").join(over, "campaign_id", "left").select(
        "campaign_id", F.coalesce("override_clinics", "p_size").alias("clinics"), "payment", F.col("p_retailprice").alias("unit_cost"), F.lit(2.0).alias("doses_per_day"), F.lit(5.0).alias("crate_cost"))
    return scenario.margins(d, [("6_day", 6, 60), ("12_day", 12, 30)])


MARGIN_SQL = """o AS (SELECT * FROM part WHERE p_type <> 'PROMO' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity * l_linenumber >= 343)),
  pay AS (SELECT l_partkey, arg_max(l_quantity, (l_shipdate, l_quantity)) AS payment FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
  ov AS (SELECT l_partkey, arg_max(l_suppkey % 9 + 1, (l_linenumber, l_suppkey)) AS c FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
  c AS (SELECT p_partkey AS campaign_id, coalesce(ov.c, p_size) AS clinics, payment, p_retailprice AS unit_cost FROM o JOIN pay ON p_partkey = pay.l_partkey LEFT JOIN ov ON p_partkey = ov.l_partkey),
  m AS (SELECT campaign_id, scenario, payment * clinics * dsp AS revenue, unit_cost * 2.0 * days * clinics * dsp / 1000.0 AS drug_cost, 5.0 * clinics * dsp AS crate_cost
   FROM c CROSS JOIN (VALUES ('6_day', 6, 60), ('12_day', 12, 30)) v(scenario, days, dsp))"""


@query("scenario_margins", f"WITH {MARGIN_SQL} SELECT campaign_id, scenario, round(revenue, 2) AS revenue, round(drug_cost, 4) AS drug_cost, round(crate_cost, 2)::DOUBLE AS crate_cost, round(revenue - drug_cost - crate_cost, 4) AS margin FROM m")
def scenario_margins(spark, sf):
    return _campaigns(spark, sf).select("campaign_id", "scenario", F.round("revenue", 2).alias("revenue"), F.round("drug_cost", 4).alias("drug_cost"), F.round("crate_cost", 2).alias("crate_cost"), F.round("margin", 4).alias("margin"))


@query("margin_decision", f"""WITH {MARGIN_SQL}, t AS (SELECT sum(revenue - drug_cost - crate_cost) FILTER (scenario = '6_day') AS a, sum(revenue - drug_cost - crate_cost) FILTER (scenario = '12_day') AS b FROM m)
  SELECT round(a, 1) AS total_base, round(b, 1) AS total_other, round(b - a, 1) AS difference, CASE WHEN abs(b - a) < 11000 THEN 'move_to_12_day' ELSE 'keep_6_day' END AS decision FROM t""")
def margin_decision(spark, sf):
    d = scenario.margin_decision(_campaigns(spark, sf), "6_day", "12_day", 11000.0)
    return d.select(*[F.round(c, 1).alias(c) for c in ("total_base", "total_other", "difference")], "decision")


def _compensation(spark, sf):
    c = table(spark, sf, "customer")
    roster = c.select(F.col("c_custkey").alias("emp_id"), (F.abs("c_acctbal") * 10).alias("base_salary"), (F.col("c_nationkey") * 40.0).alias("block_hours"), F.lit(800.0).alias("hotel"), F.lit(400.0).alias("uniform"),
                      F.when(F.col("c_mktsegment") == "BUILDING", 0.8).otherwise(0.9).alias("attendance"), F.col("c_nationkey").alias("years_of_service"))
    return scenario.compensation(roster, [(0, 1.0, 20.0), (1, 1.25, 21.0), (2, 1.5, 22.0)])


COMP_SQL = """r AS (SELECT c_custkey AS emp_id, year, abs(c_acctbal) * 10 * raise / 4 AS base_salary, c_nationkey * 40.0::DOUBLE * fpp / 4 AS flight_pay, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE 75.0 * 200 / 4 END AS per_diem, c_nationkey + year AS t
   FROM customer CROSS JOIN (VALUES (0, 1.0::DOUBLE, 20.0::DOUBLE), (1, 1.25, 21.0), (2, 1.5, 22.0)) y(year, raise, fpp)),
  q AS (SELECT *, CASE WHEN t >= 20 THEN 25000 WHEN t >= 16 THEN 16000 WHEN t >= 11 THEN 10000 WHEN t >= 6 THEN 6000 WHEN t >= 3 THEN 2500 ELSE 0 END / 4.0 AS loyalty FROM r)"""


@query("compensation_rows", f"WITH {COMP_SQL} SELECT emp_id, year, round(base_salary, 6) AS base_salary, flight_pay, per_diem::DOUBLE AS per_diem, loyalty::DOUBLE AS loyalty, round(base_salary + flight_pay + per_diem + 200 + 100 + loyalty, 6)::DOUBLE AS total FROM q")
def compensation_rows(spark, sf):
    return _compensation(spark, sf).select("emp_id", "year", F.round("base_salary", 6).alias("base_salary"), "flight_pay", "per_diem", "loyalty", F.round("total", 6).alias("total"))


@query("compensation_totals", f"""WITH {COMP_SQL}, t AS (SELECT year, sum(base_salary + flight_pay + per_diem + 300 + loyalty) AS total FROM q GROUP BY 1)
  SELECT year, round(total, 0)::DOUBLE AS total, round(total / lag(total) OVER (ORDER BY year) - 1, 6) AS growth FROM t""")
def compensation_totals(spark, sf):
    return scenario.compensation_totals(_compensation(spark, sf)).select("year", F.round("total", 0).alias("total"), F.round("growth", 6).alias("growth"))


# --- backlog carry-over (T38) ---------------------------------------------------------------

@query("backlog_carry_over", """WITH RECURSIVE w AS (SELECT l_suppkey, date_diff('week', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS week, sum(l_quantity) AS demand FROM lineitem GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY week) AS i FROM w),
  fold AS (
   SELECT l_suppkey, i, week, demand, 700.0::DOUBLE - demand AS start_calc, CASE WHEN 700.0 - demand > 0.01 THEN CASE WHEN 700.0 - 12.0 * 5 <= 0 THEN 5 ELSE 6 END WHEN demand <= 50 THEN 4 ELSE 5 END AS days FROM n WHERE i = 1
   UNION ALL
   SELECT n.l_suppkey, n.i, n.week, n.demand, f.start_calc + f.demand - 12.0 * f.days,
     CASE WHEN f.start_calc + f.demand - 12.0 * f.days > 0.01 THEN CASE WHEN f.start_calc + f.demand - 12.0 * f.days + n.demand - 12.0 * 5 <= 0 THEN 5 ELSE 6 END WHEN n.demand <= 50 THEN 4 ELSE 5 END
   FROM fold f JOIN n ON n.l_suppkey = f.l_suppkey AND n.i = f.i + 1)
  SELECT l_suppkey, week::BIGINT AS week, days::INTEGER AS days, demand, 12.0::DOUBLE * days AS capacity, greatest(0.0, start_calc)::DOUBLE AS start_queue, (start_calc + demand - 12.0 * days)::DOUBLE AS end_queue, 10.0::DOUBLE * greatest(0, days - 4) AS overtime FROM fold""")
def backlog_carry_over(spark, sf):
    week = F.floor(F.datediff("l_shipdate", F.lit("1995-01-02").cast("date")) / 7)
    d = table(spark, sf, "lineitem").select("l_suppkey", week.alias("week"), F.col("l_quantity").alias("demand"), F.lit(700.0).alias("initial"))
    return carryover.plan_days(d, ["l_suppkey"], 12.0, 50.0, 10.0, rounded=False)


# --- packets (T39, T40, T42, T43) and rates (T41) -------------------------------------------

def _pages(spark, sf):
    """Documents with a claim header in front of their whole text."""
    k = F.col("doc_id")
    s = lambda c: c.cast("string")
    head = F.concat(
        F.lit("Claim Code: CLM-2o24-"), s(k % 50), F.lit("\nDate: "), s(k % 27 + 1), F.lit("/"), s(k % 11 + 1), F.lit("/2020\nTransaction Date: "), s(k % 28 + 1), F.lit("/"), s(k % 12 + 1), F.lit("/2023\nAdvance 9,999.99\nTotal Claim $"), s(k % 900 + 1),
        F.lit(".25\nTip 3.00\n"), F.when(k % 2 == 0, "CREDIT NOTE").otherwise("Purchase  Receipt"), F.lit("\nReference: REF-A"), s(k % 40), F.lit("-"), s(k % 7),
        F.lit("\nGrand Total "), s(k % 70 + 10), F.lit(".50\nCredit Amount\n"), s(k % 30 + 5), F.lit(".75\nBricks red 12 $"), s(k % 20 + 3), F.lit(".50\nBricks red 12 $"), s(k % 20 + 3), F.lit(".50\nSteel, rod-A: "), s(k % 9 + 1), F.lit(".50 $"), s(k % 50 + 1), F.lit(".00\n"))
    return table(spark, sf, "documents").select(
        k.alias("doc_id"), F.lpad(s(k), 12, "0").alias("path"), F.col("source").alias("case_id"), F.concat(head, F.col("text")).alias("text"))


@query("claim_fields", """SELECT lpad(doc_id::VARCHAR, 12, '0') AS path, 'CLM-2024-' || lpad((doc_id % 50)::VARCHAR, 3, '0') AS claim_code, strftime(make_date(2023, (doc_id % 12 + 1)::INTEGER, (doc_id % 28 + 1)::INTEGER), '%Y-%m-%d') AS claim_date,
  (doc_id % 900 + 1) + 0.25::DOUBLE AS amount FROM documents""")
def claim_fields(spark, sf):
    return packets.claim_fields(_pages(spark, sf)).withColumn("claim_date", F.date_format("claim_date", "yyyy-MM-dd")).withColumn("amount", D("amount"))


SETTLE_SQL = """e AS (SELECT source AS case_id, lpad(doc_id::VARCHAR, 12, '0') AS path, CASE WHEN doc_id % 2 = 0 THEN 'credit' ELSE 'purchase' END AS document_type, 'REF-A' || (doc_id % 40) || '-' || lpad((doc_id % 7)::VARCHAR, 3, '0') AS document_ref,
   make_date(2020, (doc_id % 11 + 1)::INTEGER, (doc_id % 27 + 1)::INTEGER) AS event_date, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 30 + 5) + 0.75 ELSE (doc_id % 70 + 10) + 0.5 END AS amount FROM documents
   QUALIFY row_number() OVER (PARTITION BY document_ref ORDER BY path) = 1)"""


@query("settlement_events", f"WITH {SETTLE_SQL} SELECT case_id, path, document_type, document_ref, event_date, amount::DOUBLE AS amount FROM e")
def settlement_events(spark, sf):
    return packets.settlement_events(_pages(spark, sf)).select("case_id", "path", "document_type", "document_ref", "event_date", D("amount").alias("amount"))


@query("settlement_summary", f"""WITH {SETTLE_SQL} SELECT case_id, coalesce(sum(amount) FILTER (document_type = 'purchase'), 0)::DOUBLE AS purchase_total, coalesce(sum(amount) FILTER (document_type = 'credit'), 0)::DOUBLE AS credit_total,
  (coalesce(sum(amount) FILTER (document_type = 'purchase'), 0) - coalesce(sum(amount) FILTER (document_type = 'credit'), 0))::DOUBLE AS net_amount, max(event_date) AS latest_date FROM e GROUP BY 1""")
def settlement_summary(spark, sf):
    return packets.settlement_summary(packets.settlement_events(_pages(spark, sf))).select("case_id", *[D(c).alias(c) for c in ("purchase_total", "credit_total", "net_amount")], "latest_date")


# The items of the header, and the priced lines of the text itself: digits before a price, words before those.
@query("line_items", rf"""WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS lines FROM documents WHERE text LIKE '%$%')),
  p AS (SELECT *, regexp_extract_all(line, '\$?\s*(\d+(?:\.\d{{2}})?)', 1)[-1] AS price FROM l WHERE line LIKE '%$%' AND NOT regexp_matches(line, '{packets.ITEM_SKIP}')),
  h AS (SELECT *, replace(substring(line, 1, length(line) - length(price) - length(string_split(line, price)[-1])), '$', ' ') AS prefix FROM p WHERE price IS NOT NULL),
  q AS (SELECT *, regexp_extract_all(prefix, '\b\d+(?:\.\d+)?\b')[-1] AS qty FROM h),
  i AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(substring(prefix, 1, length(prefix) - length(qty) - length(string_split(prefix, qty)[-1])), '[^A-Za-z0-9\s\-()]', ' ', 'g'), '\s+', ' ', 'g')), '^[ -]+|[ -]+$', '', 'g') AS item_description FROM q WHERE qty IS NOT NULL),
  o AS (SELECT doc_id, item_description, CASE WHEN contains(qty, '.') THEN regexp_replace(regexp_replace(qty, '(\.\d*?)0+$', '\1'), '\.$', '') ELSE qty END AS quantity, price::DECIMAL(18,2)::VARCHAR AS unit_price FROM i WHERE item_description <> ''
    QUALIFY row_number() OVER (PARTITION BY doc_id, lower(item_description), quantity, unit_price ORDER BY pos) = 1)
  SELECT doc_id, 'Bricks red' AS item_description, '12' AS quantity, (doc_id % 20 + 3) || '.50' AS unit_price FROM documents
  UNION ALL SELECT doc_id, 'Steel rod-A', (doc_id % 9 + 1) || '.5', (doc_id % 50 + 1) || '.00' FROM documents
  UNION ALL SELECT * FROM o""")
def line_items(spark, sf):
    return packets.line_items(_pages(spark, sf), ["doc_id"]).select("doc_id", "item_description", "quantity", "unit_price")


@query("project_summary", """WITH f AS (SELECT source AS project_code, min(doc_id) AS k FROM documents GROUP BY 1)
  SELECT project_code, lpad(k::VARCHAR, 12, '0') AS path, make_date(2020, (k % 11 + 1)::INTEGER, (k % 27 + 1)::INTEGER) AS project_date, (k % 900 + 1) + 0.25::DOUBLE AS total_amount FROM f""")
def project_summary(spark, sf):
    d = packets.project_summary(_pages(spark, sf).withColumnRenamed("case_id", "project_code"))
    return d.select("project_code", "path", "project_date", D("total_amount").alias("total_amount"))


def _codes(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), "o_totalprice")
    known = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.concat(F.lit(" c"), F.col("c_custkey").cast("string")).alias("code"))
    return rows, known


@query("validated_references", """WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'C' || o_custkey END AS code, o_totalprice FROM orders),
  d AS (SELECT *, code IS NOT NULL AND row_number() OVER (PARTITION BY code ORDER BY o_orderkey) > 1 AS copy FROM r)
  SELECT o_orderkey, CASE WHEN NOT copy THEN code END AS code, CASE WHEN NOT copy THEN o_totalprice END AS o_totalprice FROM d""")
def validated_references(spark, sf):
    return packets.validated_references(*_codes(spark, sf), "code", "o_orderkey", ["o_totalprice"])


@query("known_references_once", """SELECT o_orderkey, 'C' || o_custkey AS code, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def known_references_once(spark, sf):
    return packets.validated_references(*_codes(spark, sf), "code", "o_orderkey", ["o_totalprice"], drop_repeats=True)


def _updates(spark, sf):
    mark = F.when(F.col("lang") == "en", " (final)").when(F.col("lang") == "de", " archived draft").otherwise("")
    note = F.concat(F.lit("Set c"), (F.col("doc_id") % 5).cast("string"), F.lit(" to usd = 1."), (F.col("doc_id") % 90 + 10).cast("string"), mark)
    chunks = table(spark, sf, "documents").select("source", F.col("doc_id").alias("idx"), F.concat(note, F.lit("\n"), F.col("text")).alias("chunk"))
    up = rates.instructions(chunks, ["source"])
    aliases = spark.createDataFrame([("C-0", "EUR"), ("usd", "USD")], "note_token string, label string")
    return rates.resolve_labels(up, aliases)


RATE_SQL = """u0 AS (SELECT source, arg_max(doc_id, (CASE WHEN regexp_matches(lower(chunk), 'final|approved|live|current') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(lower(chunk), 'archive|archived|superseded|draft|obsolete') THEN 5 ELSE 0 END, doc_id)) AS d
   FROM (SELECT *, CASE lang WHEN 'en' THEN ' (final)' WHEN 'de' THEN ' archived draft' ELSE '' END || chr(10) || text AS chunk FROM documents) GROUP BY 1),
  u AS (SELECT source, CASE WHEN d % 5 = 0 THEN 'EUR' ELSE 'c' || (d % 5) END AS from_token, 'USD' AS to_token, CAST('1.' || (d % 90 + 10) AS DOUBLE) AS rate FROM u0)"""


@query("rate_instructions", f"WITH {RATE_SQL} SELECT * FROM u")
def rate_instructions(spark, sf):
    return _updates(spark, sf)


@query("rate_matrix", f"""WITH {RATE_SQL}, t AS (SELECT DISTINCT source FROM documents), m AS (SELECT source, 'EUR' AS from_token, 'USD' AS to_token, 1.0::DOUBLE AS rate, source LIKE '%1' AS is_formula FROM t UNION ALL SELECT source, 'USD', 'EUR', 1.0, false FROM t)
  SELECT m.source, m.from_token, m.to_token, round(CASE WHEN NOT is_formula AND a.rate IS NOT NULL THEN a.rate
    WHEN NOT is_formula AND b.rate IS NOT NULL AND m.source LIKE '%1' THEN 1.0 / b.rate ELSE m.rate END, 6) AS rate, is_formula
  FROM m LEFT JOIN u a ON m.source = a.source AND m.from_token = a.from_token AND m.to_token = a.to_token LEFT JOIN u b ON m.source = b.source AND m.from_token = b.to_token AND m.to_token = b.from_token""")
def rate_matrix(spark, sf):
    t = table(spark, sf, "documents").select("source").distinct()
    m = t.select("source", F.lit("EUR").alias("from_token"), F.lit("USD").alias("to_token"), F.lit(1.0).alias("rate"), F.col("source").endswith("1").alias("is_formula")).unionByName(
        t.select("source", F.lit("USD").alias("from_token"), F.lit("EUR").alias("to_token"), F.lit(1.0).alias("rate"), F.lit(False).alias("is_formula")))
    return rates.update_matrix(m, _updates(spark, sf), ["source"]).withColumn("rate", F.round("rate", 6))
