"""Probes over the test tables."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.evidence.runner import build_check, draft_questions, probe_counts, probe_outcomes, run_probes
from attest.evidence import verdicts as V
from attest.evidence.tables import EVIDENCE, Probe
from attest.functions.frames import declared, union_all
from attest.operators import probes as P
from attest.plans.sweep import run_ready
from attest.session import shared_folder
from workload.base import ORACLES, query, table, tables

# Months 1995-01 .. 2001-12.
MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]
MONTH_ROWS = ", ".join(f"('{m}')" for m in MONTHS)


@query("probe_anti_join_orders", """
    SELECT CAST(o_orderkey AS VARCHAR) AS value, count(*) AS occurrences FROM orders o
    WHERE o_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
    GROUP BY 1""")
def anti_join_orders(spark: SparkSession, sf: str) -> DataFrame:
    return P.anti_join(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey")


@query("probe_anti_join_report", """
    WITH orphan AS (SELECT d.doc_id, count(*) AS n FROM documents d
                    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1)
    SELECT (SELECT count(*) FROM documents) AS population, count(*) AS exception_count,
           CASE WHEN count(*) = 0 THEN 'pass' ELSE 'inconclusive' END AS verdict FROM orphan""")
def anti_join_report(spark: SparkSession, sf: str) -> DataFrame:
    views = tables(spark, sf, "documents", "labels")
    check = build_check(views, Probe("p", "anti_join", {
        "child": "documents", "child_column": "doc_id", "parent": "labels", "parent_column": "doc_id",
        "expectation": "report"}))
    return probe_outcomes({"p": check}).select("population", "exception_count", "verdict")


@query("probe_anti_join_cross_type", """
    WITH o AS (SELECT CAST(o_custkey AS DOUBLE) AS k FROM orders),
    canon AS (SELECT DISTINCT CAST(CAST(k AS BIGINT) AS VARCHAR) AS v FROM o),
    raw AS (SELECT DISTINCT CAST(k AS VARCHAR) AS v FROM o),
    c AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS v FROM customer)
    SELECT 'canonical' AS mode, count(*) AS missing FROM canon WHERE v NOT IN (SELECT v FROM c)
    UNION ALL SELECT 'raw', count(*) FROM raw WHERE v NOT IN (SELECT v FROM c)""")
def anti_join_cross_type(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("double").alias("k"))
    customer = table(spark, sf, "customer")
    count = lambda mode, form: P.anti_join(orders, "k", customer, "c_custkey", form).agg(
        F.count(F.lit(1)).alias("missing")).select(F.lit(mode).alias("mode"), "missing")
    return count("canonical", True).unionByName(count("raw", False))


@query("probe_duplicate", """
    SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
    GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicate(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("probe_duplicate_texts", """
    SELECT text, count(*) AS occurrences FROM documents GROUP BY 1 HAVING count(*) > 1""")
def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicate(table(spark, sf, "documents"), ["text"], long_text=True)


@query("probe_grain", """
    SELECT conv_id, turn, count(*) AS occurrences FROM conversations GROUP BY 1, 2 HAVING count(*) > 1""")
def grain(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicate(table(spark, sf, "conversations"), ["conv_id", "turn"])


def order_months(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("*", F.date_format("o_orderdate", "yyyy-MM").alias("period"))


@query("probe_coverage_months", f"""
    SELECT unit AS missing_unit FROM (VALUES {MONTH_ROWS}) e(unit)
    WHERE unit NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderdate IS NOT NULL)""")
def coverage_months(spark: SparkSession, sf: str) -> DataFrame:
    return P.coverage(order_months(spark, sf), "period", MONTHS)


CARDINALITY_SQL = """
    SELECT '{name}' AS pair,
           (SELECT count(DISTINCT {c}) FROM {ct}) AS child_distinct,
           (SELECT count(DISTINCT {p}) FROM {pt}) AS parent_distinct,
           (SELECT count({p}) FROM {pt}) AS parent_rows,
           (SELECT count(DISTINCT {c}) FROM {ct} WHERE {c} IN (SELECT {p} FROM {pt} WHERE {p} IS NOT NULL)) AS overlap"""
CARDINALITY_PAIRS = [
    ("orders.o_custkey -> customer.c_custkey", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem.l_linenumber -> part.p_size", "lineitem", "l_linenumber", "part", "p_size"),
    ("lineitem.l_orderkey -> orders.o_orderkey", "lineitem", "l_orderkey", "orders", "o_orderkey"),
]


@query("probe_cardinality", "WITH s AS (" + " UNION ALL ".join(
    CARDINALITY_SQL.format(name=n, ct=ct, c=c, pt=pt, p=p) for n, ct, c, pt, p in CARDINALITY_PAIRS) + """)
    SELECT *, CASE WHEN overlap * 1.0 / child_distinct >= 0.95 AND parent_distinct * 1.0 / parent_rows >= 0.99
                   THEN 'pass' ELSE 'fail' END AS verdict FROM s""")
def cardinality(spark: SparkSession, sf: str) -> DataFrame:
    frames = None
    for name, ct, c, pt, p in CARDINALITY_PAIRS:
        stats = P.cardinality(table(spark, sf, ct), c, table(spark, sf, pt), p)
        verdict = V.cardinality_verdict({k: F.col(k) for k in stats.columns}, 0.95, 0.99)
        row = stats.select(F.lit(name).alias("pair"), "*", verdict.alias("verdict"))
        frames = row if frames is None else frames.unionByName(row)
    return frames


CONTRADICTIONS_SQL = """
    WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) k, CAST(s_nationkey AS VARCHAR) v, count(*) n FROM supplier GROUP BY 1, 2),
    c AS (SELECT CAST(c_custkey AS VARCHAR) k, CAST(c_nationkey AS VARCHAR) v, count(*) n FROM customer GROUP BY 1, 2),
    p AS (SELECT s.k, s.v AS lv, s.n AS ln, c.v AS rv, c.n AS rn FROM s JOIN c ON s.k = c.k WHERE s.v IS DISTINCT FROM c.v),
    lo AS (SELECT k, min(v) AS low FROM s GROUP BY 1), ro AS (SELECT k, min(v) AS low FROM c GROUP BY 1)
    SELECT k AS key, 'left' AS side, lv AS value, any_value(ln) AS rows, CAST(sum(rn) AS BIGINT) AS opponents,
           CASE WHEN lv = any_value(ro.low) THEN max(rv) ELSE any_value(ro.low) END AS other_value, CAST(sum(ln * rn) AS BIGINT) AS pairs
    FROM p JOIN ro USING (k) GROUP BY k, lv
    UNION ALL SELECT k, 'right', rv, any_value(rn), CAST(sum(ln) AS BIGINT),
           CASE WHEN rv = any_value(lo.low) THEN max(lv) ELSE any_value(lo.low) END, 0 FROM p JOIN lo USING (k) GROUP BY k, rv"""


@query("probe_attribute_contradiction", """
    WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) k, CAST(s_nationkey AS VARCHAR) v FROM supplier),
    c AS (SELECT CAST(c_custkey AS VARCHAR) k, CAST(c_nationkey AS VARCHAR) v FROM customer)
    SELECT s.k AS key, s.v AS left_value, c.v AS right_value, count(*) AS occurrences
    FROM s JOIN c ON s.k = c.k WHERE s.v IS DISTINCT FROM c.v GROUP BY 1, 2, 3""")
def attribute_contradiction(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of values that contradict each other."""
    return P.attribute_contradiction(table(spark, sf, "supplier"), table(spark, sf, "customer"), "s_suppkey",
                                     "c_custkey", "s_nationkey", "c_nationkey")


@query("probe_contradiction_sets", CONTRADICTIONS_SQL)
def contradiction_sets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per key, side and value that the other side contradicts, as evidence stores it."""
    found = P.contradictions(table(spark, sf, "supplier"), table(spark, sf, "customer"), "s_suppkey",
                             "c_custkey", "s_nationkey", "c_nationkey")
    return found.withColumn("pairs", F.col("pairs").cast("bigint"))


@query("probe_contradiction_counts", """
    SELECT CAST(o.o_custkey AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS contradictions
    FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey
    WHERE o.o_orderpriority IS DISTINCT FROM p.o_orderpriority GROUP BY 1""")
def contradiction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of one customer with different priorities: pairs within a key, counted without forming them."""
    orders = table(spark, sf, "orders")
    found = P.contradiction_counts(orders, orders, "o_custkey", "o_custkey", "o_orderpriority", "o_orderpriority")
    return found.select("key", F.col("contradictions").cast("bigint").alias("contradictions"))


RECONCILIATION_SQL = """
    WITH l AS (SELECT CAST(o_orderkey AS VARCHAR) AS grp, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1),
    r AS (SELECT CAST(l_orderkey AS VARCHAR) AS grp, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY 1)
    SELECT coalesce(l.grp, r.grp) AS grp, CAST(l.total AS DOUBLE) AS left_total, CAST(r.total AS DOUBLE) AS right_total,
           CAST(coalesce(l.total, 0) - coalesce(r.total, 0) AS DOUBLE) AS diff
    FROM l FULL JOIN r ON l.grp = r.grp
    WHERE abs(coalesce(l.total, 0) - coalesce(r.total, 0)) > 0.01"""


@query("probe_reconciliation", RECONCILIATION_SQL)
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    found = P.reconciliation(
        table(spark, sf, "orders"), table(spark, sf, "lineitem"),
        'CAST("o_orderkey" AS STRING)', 'CAST("l_orderkey" AS STRING)',
        'CAST("o_totalprice" AS DECIMAL(18,2))', 'CAST("l_extendedprice" AS DECIMAL(18,2))')
    return found.select("grp", *[F.col(c).cast("double").alias(c) for c in ("left_total", "right_total", "diff")])


@query("probe_reconciliation_scoped", """
    WITH l AS (SELECT o_orderpriority AS grp, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
               FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    r AS (SELECT o_orderpriority AS grp, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total
          FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
    SELECT coalesce(l.grp, r.grp) AS grp, CAST(l.total AS DOUBLE) AS left_total, CAST(r.total AS DOUBLE) AS right_total,
           CAST(coalesce(l.total, 0) - coalesce(r.total, 0) AS DOUBLE) AS diff
    FROM l FULL JOIN r ON l.grp = r.grp
    WHERE abs(coalesce(l.total, 0) - coalesce(r.total, 0)) > 1000""")
def reconciliation_scoped(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    measure = 'CAST("o_totalprice" AS DECIMAL(18,2))'
    found = P.reconciliation(orders, orders, '"o_orderpriority"', '"o_orderpriority"', measure, measure, 1000.0,
                             "\"o_orderstatus\" = 'O'", "\"o_orderstatus\" <> 'O'")
    return found.select("grp", *[F.col(c).cast("double").alias(c) for c in ("left_total", "right_total", "diff")])


def order_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: each order date opens a 30-day validity; the latest one stays open."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("valid_from"))
    last = orders.groupBy("o_custkey").agg(F.max("valid_from").alias("last_from"))
    return orders.join(last, "o_custkey").select(
        "o_orderkey", "o_custkey", "valid_from",
        F.when(F.col("valid_from") < F.col("last_from"), F.date_add("valid_from", 30)).alias("valid_to"))


VALIDITY_CTE = """
    validity AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS valid_from,
        CASE WHEN CAST(o_orderdate AS DATE) < max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey)
             THEN CAST(o_orderdate AS DATE) + 30 END AS valid_to FROM orders)"""


OVERLAPS_SQL = """
    d AS (SELECT k, vf, vt, count(*) AS n FROM v GROUP BY ALL),
    p AS (SELECT a.k, a.vf AS af, a.vt AS a_to, a.n AS an, b.vf AS bf, b.vt AS bt, b.n AS bn
          FROM d a JOIN d b ON a.k = b.k AND (a.vf < b.vf OR (a.vf = b.vf AND a.vt < b.vt)) AND a.vt >= b.vf),
    e AS (SELECT k, bf AS vf, bt AS vt, sum(an) AS earlier, max(struct_pack(t := a_to, f := af)) AS longest FROM p GROUP BY ALL),
    l AS (SELECT k, af AS vf, a_to AS vt, sum(bn) AS later, max(struct_pack(f := bf, t := bt)) AS latest FROM p GROUP BY ALL),
    touching AS (SELECT k AS key, CAST(vf AS VARCHAR) AS valid_from, CAST(vt AS VARCHAR) AS valid_to, n AS rows,
           CAST(coalesce(earlier, 0) AS BIGINT) AS earlier, CAST(coalesce(later, 0) AS BIGINT) AS later,
           CAST(coalesce(longest.f, latest.f) AS VARCHAR) AS other_from, CAST(coalesce(longest.t, latest.t) AS VARCHAR) AS other_to,
           CAST(n * coalesce(earlier, 0) AS BIGINT) AS pairs
    FROM d LEFT JOIN e USING (k, vf, vt) LEFT JOIN l USING (k, vf, vt) WHERE earlier IS NOT NULL OR later IS NOT NULL)"""


def overlap_rows(found: DataFrame) -> DataFrame:
    return found.withColumns({**{c: F.col(c).cast("string") for c in ("valid_from", "valid_to", "other_from", "other_to")},
                              "pairs": F.col("pairs").cast("bigint")})


def overlap_pairs(found: DataFrame) -> DataFrame:
    return found.select("key", *[F.col(c).cast("string").alias(c) for c in ("a_from", "a_to", "b_from", "b_to")], "occurrences")


@query("probe_validity", f"""
    WITH {VALIDITY_CTE},
    v AS (SELECT CAST(o_custkey AS VARCHAR) k, valid_from vf, coalesce(valid_to, DATE '9999-12-31') vt FROM validity)
    SELECT a.k AS key, CAST(a.vf AS VARCHAR) AS a_from, CAST(a.vt AS VARCHAR) AS a_to, CAST(b.vf AS VARCHAR) AS b_from,
           CAST(b.vt AS VARCHAR) AS b_to, count(*) AS occurrences
    FROM v a JOIN v b ON a.k = b.k AND (a.vf < b.vf OR (a.vf = b.vf AND a.vt < b.vt)) AND a.vt >= b.vf
    GROUP BY ALL""")
def validity(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of overlapping intervals."""
    return overlap_pairs(P.validity_join(order_validity(spark, sf), "o_custkey", "valid_from", "valid_to"))


@query("probe_validity_sets", f"""
    WITH {VALIDITY_CTE},
    v AS (SELECT CAST(o_custkey AS VARCHAR) k, valid_from vf, coalesce(valid_to, DATE '9999-12-31') vt FROM validity),
    {OVERLAPS_SQL} SELECT * FROM touching""")
def validity_sets(spark: SparkSession, sf: str) -> DataFrame:
    """One row per overlapping interval; the sums of `pairs` are those of the row pairs in the SQL."""
    return overlap_rows(P.validity_overlaps(order_validity(spark, sf), "o_custkey", "valid_from", "valid_to"))


@query("probe_validity_counts", f"""
    WITH {VALIDITY_CTE},
    v AS (SELECT CAST(o_custkey AS VARCHAR) k, valid_from vf, coalesce(valid_to, DATE '9999-12-31') vt FROM validity)
    SELECT a.k AS key, count(*) AS overlaps
    FROM v a JOIN v b ON a.k = b.k AND (a.vf < b.vf OR (a.vf = b.vf AND a.vt < b.vt)) AND a.vt >= b.vf GROUP BY 1""")
def validity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping pairs per key by running sums, without forming a pair."""
    found = P.validity_overlap_counts(order_validity(spark, sf), "o_custkey", "valid_from", "valid_to")
    return found.select("key", F.col("overlaps").cast("bigint").alias("overlaps"))


def priority_validity(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderpriority", day.alias("vf"), F.date_add(day, 2).alias("vt"))


@query("probe_validity_hot_key", """
    WITH v AS (SELECT o_orderpriority k, CAST(o_orderdate AS DATE) vf, CAST(o_orderdate AS DATE) + 2 vt FROM orders),
    d AS (SELECT k, vf, vt, count(*) AS n FROM v GROUP BY ALL)
    SELECT a.k AS key, CAST(a.vf AS VARCHAR) AS a_from, CAST(a.vt AS VARCHAR) AS a_to, CAST(b.vf AS VARCHAR) AS b_from,
           CAST(b.vt AS VARCHAR) AS b_to, CAST(a.n * b.n AS BIGINT) AS occurrences
    FROM d a JOIN d b ON a.k = b.k AND (a.vf < b.vf OR (a.vf = b.vf AND a.vt < b.vt)) AND a.vt >= b.vf""")
def validity_hot_key(spark: SparkSession, sf: str) -> DataFrame:
    """Five keys hold all intervals, so every key is compared over interval blocks."""
    return overlap_pairs(P.validity_join(priority_validity(spark, sf), "o_orderpriority", "vf", "vt"))


@query("probe_validity_hot_key_sets", f"""
    WITH v AS (SELECT o_orderpriority k, CAST(o_orderdate AS DATE) vf, CAST(o_orderdate AS DATE) + 2 vt FROM orders),
    {OVERLAPS_SQL} SELECT * FROM touching""")
def validity_hot_key_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Five keys hold all intervals, so every key is swept by several tasks."""
    return overlap_rows(P.validity_overlaps(priority_validity(spark, sf), "o_orderpriority", "vf", "vt"))


# Bands with a gap (21-24) and an overlap (10).
def size_bands(spark: SparkSession) -> DataFrame:
    return declared(spark, "band string, lo bigint, hi bigint", [("s", 1, 10), ("m", 10, 20), ("l", 25, 50)])


BANDS_CTE = "bands(band, lo, hi) AS (VALUES ('s', 1, 10), ('m', 10, 20), ('l', 25, 50))"


@query("probe_range", f"""
    WITH {BANDS_CTE}, vals AS (SELECT DISTINCT CAST(p_size AS VARCHAR) v FROM part WHERE p_size IS NOT NULL),
    m AS (SELECT v, count(*) n FROM vals JOIN bands b ON TRY_CAST(v AS BIGINT) BETWEEN b.lo AND b.hi GROUP BY v)
    SELECT vals.v AS value, coalesce(m.n, 0) AS match_count FROM vals LEFT JOIN m USING (v)
    WHERE coalesce(m.n, 0) <> 1""")
def range_bands(spark: SparkSession, sf: str) -> DataFrame:
    return P.range_join(table(spark, sf, "part"), "p_size", size_bands(spark), "lo", "hi")


@query("probe_range_wide", """
    WITH vals AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) v FROM orders WHERE o_orderstatus <> 'P'),
    b AS (SELECT p_partkey * 7 AS lo, p_partkey * 7 + p_size AS hi FROM part),
    m AS (SELECT v, count(*) n FROM vals JOIN b ON CAST(v AS BIGINT) BETWEEN b.lo AND b.hi GROUP BY v)
    SELECT vals.v AS value, coalesce(m.n, 0) AS match_count FROM vals LEFT JOIN m USING (v)
    WHERE coalesce(m.n, 0) <> 1""")
def range_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One range per part, so the range table grows with the data."""
    ranges = table(spark, sf, "part").select(
        (F.col("p_partkey") * 7).alias("lo"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("hi"))
    return P.range_join(table(spark, sf, "orders"), "o_orderkey", ranges, "lo", "hi", "\"o_orderstatus\" <> 'P'")


DECODE_PAIRS = [
    {"part_expr": "split_part(e.\"p_name\", ' ', 1)", "decode_column": "p_brand"},
    {"part_expr": "split_part(e.\"p_name\", ' ', 2)", "decode_column": "p_type"},
]


@query("probe_decode", """
    SELECT 'p_brand' AS level, split_part(e.p_name, ' ', 1) AS code, count(DISTINCT d.p_brand) AS decoded_values
    FROM part e JOIN part d ON e.p_partkey = d.p_partkey GROUP BY 2 HAVING count(DISTINCT d.p_brand) > 1
    UNION ALL
    SELECT 'p_type', split_part(e.p_name, ' ', 2), count(DISTINCT d.p_type)
    FROM part e JOIN part d ON e.p_partkey = d.p_partkey GROUP BY 2 HAVING count(DISTINCT d.p_type) > 1""")
def decode(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return P.decode(part, part, "p_partkey", DECODE_PAIRS)


def signed_events(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value").cast("decimal(18,2)")
    signed = F.when(F.col("event_type") == "purchase", value).when(F.col("event_type") == "error", -value).otherwise(
        F.lit(0).cast("decimal(18,2)"))
    return table(spark, sf, "events").select("user_id", signed.alias("amount"))


EVENTS_CTE = """ev AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2))
        WHEN event_type = 'error' THEN -CAST(value AS DECIMAL(18,2)) ELSE 0 END AS amount FROM events)"""


@query("probe_balance", f"""
    WITH {EVENTS_CTE} SELECT user_id AS grp, CAST(sum(amount) AS DOUBLE) AS balance FROM ev GROUP BY 1
    HAVING abs(sum(amount)) > 0.01""")
def balance(spark: SparkSession, sf: str) -> DataFrame:
    found = P.balance(signed_events(spark, sf), "amount", '"user_id"', amount_type="decimal(18,2)")
    return found.select("grp", F.col("balance").cast("double").alias("balance"))


@query("probe_subledger", """
    WITH s AS (SELECT coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS t FROM orders WHERE o_orderstatus = 'O'),
    g AS (SELECT coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS t FROM lineitem WHERE l_linenumber IN (1, 2, 3))
    SELECT CAST(s.t AS DOUBLE) AS subledger_total, CAST(g.t AS DOUBLE) AS gl_total, CAST(s.t - g.t AS DOUBLE) AS diff
    FROM s, g WHERE abs(s.t - g.t) > 0.01""")
def subledger(spark: SparkSession, sf: str) -> DataFrame:
    open_orders = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
    found = P.subledger_equals_gl(open_orders, "o_totalprice", table(spark, sf, "lineitem"), "l_extendedprice",
                                  "l_linenumber", [1, "2", 3], amount_type="decimal(18,2)")
    return found.select(*[F.col(c).cast("double").alias(c) for c in found.columns])


@query("probe_symmetry", """
    WITH l AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS legs FROM orders GROUP BY 1),
    r AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, count(*) AS legs FROM lineitem GROUP BY 1)
    SELECT coalesce(l.period, r.period) AS period, coalesce(l.legs, 0) AS left_legs, coalesce(r.legs, 0) AS right_legs
    FROM l FULL JOIN r ON l.period = r.period WHERE coalesce(l.legs, 0) <> coalesce(r.legs, 0)""")
def symmetry(spark: SparkSession, sf: str) -> DataFrame:
    shipped = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("ship_period"))
    return P.ic_symmetry(order_months(spark, sf), shipped, "period", "ship_period")


def probe_views(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The test tables plus the derived tables that probes refer to."""
    views = tables(spark, sf, "orders", "lineitem", "customer", "part", "supplier", "documents", "labels", "conversations")
    views["order_months"] = order_months(spark, sf)
    views["ship_months"] = views["lineitem"].select(F.date_format("l_shipdate", "yyyy-MM").alias("period"))
    views["validity"] = order_validity(spark, sf)
    views["signed_events"] = signed_events(spark, sf)
    views["bands"] = size_bands(spark)
    views["open_orders"] = views["orders"].filter(F.col("o_orderstatus") == "O")
    return views


ALL_PROBES = [
    Probe("p01", "anti_join", {"child": "orders", "child_column": "o_orderkey", "parent": "lineitem",
                               "parent_column": "l_orderkey"}),
    Probe("p02", "anti_join", {"child": "documents", "child_column": "doc_id", "parent": "labels",
                               "parent_column": "doc_id", "expectation": "report"}),
    Probe("p03", "duplicate", {"table": "lineitem", "key_columns": ["l_orderkey", "l_linenumber"]}),
    Probe("p04", "grain", {"table": "conversations", "key_columns": ["conv_id", "turn"]}),
    Probe("p05", "coverage", {"table": "order_months", "unit_column": "period", "expected": MONTHS}),
    Probe("p06", "cardinality", {"child": "orders", "child_column": "o_custkey", "parent": "customer",
                                 "parent_column": "c_custkey"}),
    Probe("p07", "cardinality", {"child": "lineitem", "child_column": "l_linenumber", "parent": "part",
                                 "parent_column": "p_size"}),
    Probe("p08", "attribute_contradiction", {
        "left": "supplier", "right": "customer", "left_key": "s_suppkey", "right_key": "c_custkey",
        "left_attr": "s_nationkey", "right_attr": "c_nationkey"}),
    Probe("p09", "reconciliation", {
        "left": "orders", "right": "lineitem", "left_group_expr": '"o_orderkey"', "right_group_expr": '"l_orderkey"',
        "left_measure_expr": 'CAST("o_totalprice" AS DECIMAL(18,2))',
        "right_measure_expr": 'CAST("l_extendedprice" AS DECIMAL(18,2))'}),
    Probe("p10", "validity_join", {"table": "validity", "key_column": "o_custkey", "valid_from": "valid_from",
                                   "valid_to": "valid_to"}),
    Probe("p11", "range_join", {"table": "part", "value_column": "p_size", "ranges": "bands", "range_from": "lo",
                                "range_to": "hi"}),
    Probe("p12", "decode", {"encoded": "part", "decode": "part", "key": "p_partkey", "column": "p_name",
                            "pairs": DECODE_PAIRS}),
    Probe("p13", "balance", {"journal": "signed_events", "amount": "amount", "group_column": "user_id"}),
    Probe("p14", "subledger_equals_gl", {
        "subledger": "open_orders", "subledger_amount": "o_totalprice", "journal": "lineitem",
        "journal_amount": "l_extendedprice", "account": "l_linenumber", "accounts": [1, 2, 3]}),
    Probe("p15", "ic_symmetry", {"left": "order_months", "right": "ship_months", "left_period": "period",
                                 "right_period": "period"}),
]

CARDINALITY_PROBES = [("p06", "orders", "o_custkey", "customer", "c_custkey"), ("p07", "lineitem", "l_linenumber", "part", "p_size")]

VERDICT_SQL = f"""
    WITH {VALIDITY_CTE}, {EVENTS_CTE}, {BANDS_CTE},
    v AS (SELECT o_custkey k, valid_from vf, coalesce(valid_to, DATE '9999-12-31') vt FROM validity),
    rec AS ({RECONCILIATION_SQL}),
    dec AS (SELECT 1 AS lvl, split_part(p_name, ' ', 1) AS c FROM part GROUP BY 2 HAVING count(DISTINCT p_brand) > 1
            UNION ALL SELECT 2, split_part(p_name, ' ', 2) FROM part GROUP BY 2 HAVING count(DISTINCT p_type) > 1),
    om AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS legs FROM orders GROUP BY 1),
    sm AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, count(*) AS legs FROM lineitem GROUP BY 1),
    card AS ({" UNION ALL ".join(CARDINALITY_SQL.format(name=n, ct=ct, c=c, pt=pt, p=p) for n, ct, c, pt, p in CARDINALITY_PROBES)}),
    shaped AS (SELECT pair, CASE WHEN child_distinct > 0 AND parent_rows > 0 AND overlap * 1.0 / child_distinct >= 0.95
                                      AND parent_distinct * 1.0 / parent_rows >= 0.99 THEN 'pass' ELSE 'fail' END AS verdict FROM card),
    found AS (
    SELECT 'p01' AS probe_id, (SELECT count(*) FROM orders) AS population,
           (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n, 'fail' AS bad
    UNION ALL SELECT 'p02', (SELECT count(*) FROM documents),
           (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), 'inconclusive'
    UNION ALL SELECT 'p03', (SELECT count(*) FROM lineitem),
           (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)), 'fail'
    UNION ALL SELECT 'p04', (SELECT count(*) FROM conversations),
           (SELECT count(*) FROM (SELECT 1 FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)), 'fail'
    UNION ALL SELECT 'p05', 84, (SELECT count(*) FROM (VALUES {MONTH_ROWS}) e(u)
           WHERE u NOT IN (SELECT period FROM om)), 'inconclusive'
    UNION ALL SELECT 'p06', (SELECT count(*) FROM orders), 0, (SELECT verdict FROM shaped WHERE pair = 'p06')
    UNION ALL SELECT 'p07', (SELECT count(*) FROM lineitem), 0, (SELECT verdict FROM shaped WHERE pair = 'p07')
    UNION ALL SELECT 'p08', (SELECT count(*) FROM supplier),
           (SELECT count(*) FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey IS DISTINCT FROM c_nationkey), 'fail'
    UNION ALL SELECT 'p09', (SELECT count(*) FROM orders), (SELECT count(*) FROM rec), 'fail'
    UNION ALL SELECT 'p10', (SELECT count(*) FROM validity),
           (SELECT count(*) FROM v a JOIN v b ON a.k = b.k AND (a.vf < b.vf OR (a.vf = b.vf AND a.vt < b.vt)) AND a.vt >= b.vf), 'fail'
    UNION ALL SELECT 'p11', (SELECT count(*) FROM part),
           (SELECT count(*) FROM (SELECT p_size, (SELECT count(*) FROM bands WHERE p_size BETWEEN lo AND hi) AS m
                                  FROM (SELECT DISTINCT p_size FROM part)) WHERE m <> 1), 'fail'
    UNION ALL SELECT 'p12', (SELECT count(*) FROM part), (SELECT count(*) FROM dec), 'fail'
    UNION ALL SELECT 'p13', (SELECT count(*) FROM events),
           (SELECT count(*) FROM (SELECT 1 FROM ev GROUP BY user_id HAVING abs(sum(amount)) > 0.01)), 'fail'
    UNION ALL SELECT 'p14', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O'),
           (SELECT count(*) FROM (SELECT sum(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'O'),
                                 (SELECT sum(l_extendedprice) AS b FROM lineitem WHERE l_linenumber IN (1, 2, 3))
            WHERE abs(a - b) > 0.01), 'fail'
    UNION ALL SELECT 'p15', (SELECT count(*) FROM orders),
           (SELECT count(*) FROM om FULL JOIN sm ON om.period = sm.period WHERE coalesce(om.legs, 0) <> coalesce(sm.legs, 0)), 'fail'
    ), judged AS (
    SELECT probe_id, population, least(n, population) AS exception_count,
           CASE WHEN probe_id IN ('p06', 'p07') THEN bad WHEN n = 0 THEN 'pass' WHEN probe_id = 'p05' AND n >= population THEN 'fail' ELSE bad END AS verdict FROM found)
"""


@query("verdict_summary", VERDICT_SQL + """
    SELECT probe_id, CAST(population AS BIGINT) AS population, CAST(exception_count AS BIGINT) AS exception_count, verdict,
           CASE WHEN population > 0 THEN exception_count * 1.0 / population END AS exception_rate FROM judged""")
def verdict_summary(spark: SparkSession, sf: str) -> DataFrame:
    """All probes in one plan."""
    views = probe_views(spark, sf)
    outcomes = probe_counts({p.id: build_check(views, p) for p in ALL_PROBES})
    return outcomes.select("probe_id", "population", "exception_count", "verdict", V.exception_rate(
        F.col("exception_count"), F.col("population")).alias("exception_rate"))


@query("verdict_counts", VERDICT_SQL + "SELECT verdict, count(*) AS n FROM judged GROUP BY 1")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    views = probe_views(spark, sf)
    outcomes = probe_counts({p.id: build_check(views, p) for p in ALL_PROBES})
    return outcomes.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# The questions the templates draft, with the names of these probes.
QUESTIONS = {
    "p01": "Fachfrage: orders hat Einträge ohne Gegenstück in lineitem — Datenschnitt, Wartezustand oder Fehler?",
    "p02": "Fachfrage: documents hat Einträge ohne Gegenstück in labels — Datenschnitt, Wartezustand oder Fehler?",
    "p03": 'Fachfrage: lineitem enthält Dubletten über ("l_orderkey", "l_linenumber") — welche Sätze sind führend?',
    "p04": 'Fachfrage: conversations ist nicht eindeutig auf der angenommenen Körnung ("conv_id", "turn") — was ist die echte Körnung?',
    "p05": "Fachfrage: order_months deckt erwartete Einheiten nicht vollständig ab — Datenschnitt oder Lücke?",
    "p08": "Fachfrage: supplier und customer widersprechen sich in verknüpften Attributen — welche Quelle führt?",
    "p09": "Fachfrage: orders und lineitem stimmen je Gruppe nicht überein — welche Abgrenzung fehlt?",
    "p10": "Fachfrage: validity hat überlappende Gültigkeitszeiträume — welche Version gilt?",
    "p11": "Fachfrage: Werte aus part fallen in keinen oder mehrere Bereiche von bands — wie ist die Zuordnung gemeint?",
    "p12": "Fachfrage: Positionscodes in part decodieren nicht eindeutig gegen part — stimmt die Positionslogik?",
    "p13": "Fachfrage: signed_events ist je Gruppe nicht ausgeglichen — fehlt eine Gegenbuchung?",
    "p14": "Fachfrage: Nebenbuch open_orders weicht vom Hauptbuch lineitem ab — welche Posten fehlen?",
    "p15": "Fachfrage: Intercompany-Buchungen sind zwischen order_months und ship_months nicht symmetrisch — wo fehlt die Gegenseite?",
}
TEXTS_CTE = "texts(probe_id, question) AS (VALUES " + ", ".join(f"('{p}', '{q}')" for p, q in QUESTIONS.items()) + ")"


@query("drafted_questions", VERDICT_SQL + f", {TEXTS_CTE} SELECT question FROM texts JOIN judged USING (probe_id) WHERE verdict <> 'pass'")
def drafted_questions(spark: SparkSession, sf: str) -> DataFrame:
    return draft_questions(run_probes(probe_views(spark, sf), ALL_PROBES), ALL_PROBES).select("question")


# Per probe with a set of exceptions: its SQL, its columns, and the order of its report.
SETS = {
    "p01": (ORACLES["probe_anti_join_orders"], ["value", "occurrences"], "occurrences DESC, value"),
    "p02": ("SELECT CAST(doc_id AS VARCHAR) AS value, count(*) AS occurrences FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
            ["value", "occurrences"], "occurrences DESC, value"),
    "p03": ("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
            ["l_orderkey", "l_linenumber", "occurrences"], "occurrences DESC, l_orderkey, l_linenumber"),
    "p04": ("SELECT conv_id, turn, count(*) AS occurrences FROM conversations GROUP BY 1, 2 HAVING count(*) > 1",
            ["conv_id", "turn", "occurrences"], "occurrences DESC, conv_id, turn"),
    "p05": (f"SELECT u AS missing_unit FROM (VALUES {MONTH_ROWS}) e(u) WHERE u NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders)",
            ["missing_unit"], "missing_unit"),
    "p08": (ORACLES["probe_contradiction_sets"], ["key", "side", "value", "rows", "opponents", "other_value", "pairs"], ""),
    "p09": (RECONCILIATION_SQL.replace("CAST(o_orderkey AS VARCHAR)", "o_orderkey").replace("CAST(l_orderkey AS VARCHAR)", "l_orderkey"),
            ["grp", "left_total", "right_total", "diff"], "abs(CAST(diff AS DECIMAL(20,2))) DESC, grp"),
    "p10": (ORACLES["probe_validity_sets"], ["key", "valid_from", "valid_to", "rows", "earlier", "later", "other_from", "other_to", "pairs"], ""),
    "p11": (ORACLES["probe_range"], ["value", "match_count"], "value"),
    "p12": (ORACLES["probe_decode"], ["level", "code", "decoded_values"], "level, code"),
    "p13": (ORACLES["probe_balance"], ["grp", "balance"], "abs(CAST(balance AS DECIMAL(20,2))) DESC, grp"),
    "p14": (ORACLES["probe_subledger"], ["subledger_total", "gl_total", "diff"], "diff"),
    "p15": (ORACLES["probe_symmetry"], ["period", "left_legs", "right_legs"], "period"),
}
# What the first pairs behind a set are made of, where its rows stand for pairs.
PAIR_SETS = {
    "p08": ("""WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) k, CAST(s_nationkey AS VARCHAR) v FROM supplier),
        c AS (SELECT CAST(c_custkey AS VARCHAR) k, CAST(c_nationkey AS VARCHAR) v FROM customer)
        SELECT s.k AS key, s.v AS left_value, c.v AS right_value, count(*) AS occurrences
        FROM s JOIN c ON s.k = c.k WHERE s.v IS DISTINCT FROM c.v GROUP BY 1, 2, 3""",
            ["key", "left_value", "right_value", "occurrences"], "key, left_value, right_value"),
    "p10": (f"""WITH {VALIDITY_CTE}, v AS (SELECT CAST(o_custkey AS VARCHAR) k, valid_from vf, coalesce(valid_to, DATE '9999-12-31') vt FROM validity)
        SELECT a.k AS key, CAST(a.vf AS VARCHAR) AS a_from, CAST(a.vt AS VARCHAR) AS a_to, CAST(b.vf AS VARCHAR) AS b_from,
               CAST(b.vt AS VARCHAR) AS b_to, count(*) AS occurrences
        FROM v a JOIN v b ON a.k = b.k AND (a.vf < b.vf OR (a.vf = b.vf AND a.vt < b.vt)) AND a.vt >= b.vf GROUP BY ALL""",
            ["key", "a_from", "a_to", "b_from", "b_to", "occurrences"], "key, a_from, a_to, b_from, b_to"),
}
MONEY = {"left_total", "right_total", "diff", "balance", "subledger_total", "gl_total"}


def told_sql(sets: dict, limit: int | None = None) -> str:
    """Every row of the sets as one text `column=value;...`, amounts with two decimals; NULL as a dash."""
    shown = lambda c: f"CAST(CAST(round({c}, 2) AS DECIMAL(20,2)) AS VARCHAR)" if c in MONEY else f"CAST({c} AS VARCHAR)"
    parts = []
    for probe, (sql, columns, order) in sets.items():
        rows = f"SELECT * FROM ({sql}) t" + (f" ORDER BY {order} LIMIT {limit}" if limit else "")
        cells = " || ';' || ".join(f"'{c}=' || coalesce({shown(c)}, '-')" for c in columns)
        parts.append(f"SELECT '{probe}' AS probe_id, {cells} AS cells FROM ({rows}) u")
    return " UNION ALL ".join(parts)


def told(columns: list[str], value) -> Column:
    shown = lambda c: value(c).cast("decimal(20,2)").cast("string") if c in MONEY else value(c)
    return F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.coalesce(shown(c), F.lit("-"))) for c in columns])


@query("exception_sets", told_sql(SETS))
def exception_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The full exception sets of all probes as one job stored them, read back through the evidence rows that point to them."""
    sink = f"{shared_folder(spark)}/exceptions-{uuid.uuid4().hex}"
    evidence = run_probes(probe_views(spark, sf), ALL_PROBES, sink=sink)
    parts = [spark.read.parquet(row["result_ref"]).select(F.lit(row["probe_id"]).alias("probe_id"), told(SETS[row["probe_id"]][1], F.col).alias("cells"))
             for row in evidence.select("probe_id", "result_ref").filter("result_ref IS NOT NULL").collect()]
    return union_all(parts)


# Claim c<nn> is tested by probe p<nn>; the listed prerequisites gate some of them.
PREREQUISITES = {"c01": ["c06"], "c03": ["c01"], "c15": ["c04", "c06"], "c13": ["c02"], "c10": ["c06"], "c12": ["c07"]}

SWEEP_SQL = VERDICT_SQL + f"""
    , {TEXTS_CTE}, pre(id, dep) AS (VALUES {", ".join(f"('{c}', '{d}')" for c, deps in PREREQUISITES.items() for d in deps)}),
    own AS (SELECT 'c' || substr(probe_id, 2) AS id, CASE verdict WHEN 'pass' THEN 'tested' WHEN 'fail' THEN 'contradicted' ELSE 'inferred' END AS status
      FROM judged),
    level1 AS (SELECT own.id, coalesce(bool_and(o.status = 'tested'), true) AND coalesce(bool_and(p2.ok), true) AS ran
      FROM own LEFT JOIN pre ON pre.id = own.id LEFT JOIN own o ON o.id = pre.dep
      LEFT JOIN (SELECT pre.id, bool_and(o.status = 'tested') AS ok FROM pre JOIN own o ON o.id = pre.dep GROUP BY 1) p2 ON p2.id = pre.dep GROUP BY 1)"""


def sweep_of(spark: SparkSession, sf: str):
    claims = declared(spark, "id string, depends_on array<string>",
                      [("c" + p.id[1:], PREREQUISITES.get("c" + p.id[1:], [])) for p in ALL_PROBES])
    probes = [replace(p, claim_id="c" + p.id[1:]) for p in ALL_PROBES]
    return run_ready(probe_views(spark, sf), claims, declared(spark, EVIDENCE, []), probes)


@query("sweep_statuses", SWEEP_SQL + """
    SELECT own.id, CASE WHEN ran THEN status ELSE 'inferred' END AS status FROM own JOIN level1 USING (id)""")
def sweep_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """A dependency-gated sweep over all probes: claims whose prerequisites did not hold are not probed."""
    return sweep_of(spark, sf).statuses.select("id", "status")


@query("sweep_results", SWEEP_SQL + """
    SELECT 'p' || substr(own.id, 2) AS probe_id, CASE WHEN ran THEN judged.verdict ELSE 'skipped: prerequisites not tested yet' END AS outcome,
           CASE WHEN ran AND judged.verdict <> 'pass' THEN question END AS question
    FROM own JOIN level1 USING (id) JOIN judged ON judged.probe_id = 'p' || substr(own.id, 2) LEFT JOIN texts ON texts.probe_id = judged.probe_id""")
def sweep_results(spark: SparkSession, sf: str) -> DataFrame:
    """What a sweep gives back beside statuses: executed and skipped probes, verdicts, and the questions it drafted."""
    swept = sweep_of(spark, sf)
    reasons = declared(spark, "probe_id string, reason string", swept.skipped)
    asked = swept.questions.select(F.explode("claim_ids").alias("claim_id"), "question")
    ran = swept.evidence.join(asked, "claim_id", "left").select("probe_id", F.col("verdict").alias("outcome"), "question")
    return ran.unionByName(reasons.select("probe_id", F.concat(F.lit("skipped: "), "reason").alias("outcome"), F.lit(None).cast("string").alias("question")))


@query("sweep_contained", VERDICT_SQL + """
    SELECT probe_id, verdict AS outcome FROM judged WHERE probe_id IN ('p13', 'p03')
    UNION ALL SELECT 'bad amount', CASE WHEN count(*) > 0 THEN 'execution error' ELSE 'pass' END FROM orders WHERE TRY_CAST(o_orderpriority AS DOUBLE) IS NULL
    UNION ALL SELECT 'bad subledger', CASE WHEN count(*) > 0 THEN 'execution error' ELSE 'pass' END FROM orders WHERE TRY_CAST(o_orderstatus AS DOUBLE) IS NULL
    UNION ALL SELECT 'no such view', 'execution error' FROM region WHERE r_regionkey = 0""")
def sweep_contained(spark: SparkSession, sf: str) -> DataFrame:
    """Failing checks beside good ones: one run, in which only the failing ones give no evidence."""
    probes = [p for p in ALL_PROBES if p.id in ("p03", "p13")] + [
        Probe("bad amount", "balance", {"journal": "orders", "amount": "o_orderpriority", "group_column": "o_custkey"}),
        Probe("bad subledger", "subledger_equals_gl", {
            "subledger": "orders", "subledger_amount": "o_orderstatus", "journal": "lineitem", "journal_amount": "l_extendedprice",
            "account": "l_linenumber", "accounts": [1]}),
        Probe("no such view", "duplicate", {"table": "nothing", "key_columns": ["x"]})]
    swept = run_ready(probe_views(spark, sf), declared(spark, "id string, depends_on array<string>", []), declared(spark, EVIDENCE, []), probes)
    failed = declared(spark, "probe_id string, reason string", swept.skipped)
    return swept.evidence.select("probe_id", F.col("verdict").alias("outcome")).unionByName(
        failed.select("probe_id", F.regexp_extract("reason", r"^(execution error) \(", 1).alias("outcome")))


@query("evidence_samples", told_sql({**SETS, **PAIR_SETS}, limit=20))
def evidence_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The bounded samples the evidence rows carry; where a set stands for pairs, its first pairs."""
    evidence = run_probes(probe_views(spark, sf), ALL_PROBES)
    sample = evidence.select("probe_id", F.explode("exception_samples").alias("s"))
    sets = {**SETS, **PAIR_SETS}
    cells = F.lit(None).cast("string")
    for probe, (_, columns, _) in sets.items():
        cells = F.when(F.col("probe_id") == probe, told(columns, lambda c: F.col("s")[c])).otherwise(cells)
    return sample.select("probe_id", cells.alias("cells"))
