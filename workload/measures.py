"""Measures with line items as ledger, orders as invoices and master data, events as activities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from attest.functions.frames import declared
from attest.operators import measures as M
from workload.base import query, table
from workload.probes import MONTHS, MONTH_ROWS

D2 = "decimal(18,2)"


def double(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", "DE").otherwise("US").alias("entity"),
        F.when(F.col("l_returnflag") == "R", 4800).otherwise(4000 + 100 * F.col("l_linenumber")).alias("account_id"),
        F.date_format("l_shipdate", "yyyy-MM").alias("period"), (-F.col("l_extendedprice").cast(D2)).cast(D2).alias("amount"),
        F.col("l_orderkey").alias("doc"), "l_suppkey",
        F.when(F.col("l_linestatus") == "O", "EUR").when(F.col("l_suppkey") % 5 == 0, "GBP").when(
            F.col("l_suppkey") % 5 == 1, "CHF").otherwise("USD").alias("currency"))


LEDGER = """ledger AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'DE' ELSE 'US' END AS entity,
    CASE WHEN l_returnflag = 'R' THEN 4800 ELSE 4000 + 100 * l_linenumber END AS account_id,
    strftime(l_shipdate, '%Y-%m') AS period, CAST(-CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS amount,
    l_orderkey AS doc, l_suppkey, CASE WHEN l_linestatus = 'O' THEN 'EUR' WHEN l_suppkey % 5 = 0 THEN 'GBP'
    WHEN l_suppkey % 5 = 1 THEN 'CHF' ELSE 'USD' END AS currency FROM lineitem)"""


def rates(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly and spot rates of dollars and francs for every month with orders, two different ones for francs in January;
    shipments of later months find none, pounds never do."""
    o = table(spark, sf, "orders")
    level = F.sum(F.col("o_totalprice").cast(D2)).cast("double") / F.count(F.lit(1)) / 1000000
    fixed = lambda c: F.round(c, 4).cast("decimal(9,4)")
    monthly = o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(
        fixed(0.8 + level).alias("M"), fixed(0.9 + level).alias("B"))
    dollars = monthly.select("period", F.lit("USD").alias("from_currency"), F.lit("EUR").alias("to_currency"),
                             F.stack(F.lit(2), F.lit("M"), F.col("M"), F.lit("B"), F.col("B")).alias("rate_type", "rate_value"))
    francs = dollars.withColumns({"from_currency": F.lit("CHF"), "rate_value": fixed(F.col("rate_value") + 0.125)})
    again = francs.filter(F.col("period").endswith("-01")).withColumn("rate_value", fixed(F.col("rate_value") + 0.25))
    return dollars.unionByName(francs).unionByName(again)


RATES = """dollars AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, 'USD' AS currency, CAST(round(0.8::DOUBLE +
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000000, 4) AS DECIMAL(9,4)) AS rate FROM orders GROUP BY 1),
    francs AS (SELECT period, 'CHF' AS currency, CAST(rate + 0.125 AS DECIMAL(9,4)) AS rate FROM dollars),
    rates AS (FROM dollars UNION ALL FROM francs
      UNION ALL SELECT period, currency, CAST(rate + 0.25 AS DECIMAL(9,4)) FROM francs WHERE period LIKE '%-01'),
    pair AS (SELECT period, currency, min(rate) AS low, max(rate) AS high FROM rates GROUP BY 1, 2),
    conv AS (SELECT *, amount * rate AS converted FROM (SELECT ledger.*, CASE WHEN ledger.currency = 'EUR' THEN 'own'
        WHEN low = high THEN 'rate' WHEN low IS NOT NULL THEN 'ambiguous' WHEN ledger.currency = 'USD' THEN 'fallback' ELSE 'missing' END AS rate_state,
      CASE WHEN ledger.currency = 'EUR' THEN CAST(1 AS DECIMAL(9,4)) WHEN low = high THEN low
        WHEN low IS NULL AND ledger.currency = 'USD' THEN CAST(0.92 AS DECIMAL(9,4)) END AS rate FROM ledger LEFT JOIN pair USING (period, currency)))"""
NET = """coalesce(-sum({a}) FILTER (account_id IN (4100, 4200)), 0) - coalesce(sum({a}) FILTER (account_id IN (4800, 4850)), 0)"""


@query("revenue_range", f"""
    WITH {LEDGER} SELECT entity, CAST(-sum(amount) AS DOUBLE) AS revenue FROM ledger
    WHERE account_id BETWEEN 4000 AND 4999 AND account_id NOT BETWEEN 4800 AND 4809 GROUP BY 1""")
def revenue_range(spark: SparkSession, sf: str) -> DataFrame:
    return double(M.revenue_range(ledger(spark, sf)), "revenue")


@query("revenue_external", f"""
    WITH {LEDGER} SELECT entity, period, CAST(-sum(amount) AS DOUBLE) AS revenue FROM ledger
    WHERE account_id BETWEEN 4000 AND 4999 AND account_id NOT BETWEEN 4300 AND 4309 GROUP BY 1, 2""")
def revenue_external(spark: SparkSession, sf: str) -> DataFrame:
    return double(M.revenue_range(ledger(spark, sf), M.INTERCOMPANY, ("entity", "period")), "revenue")


@query("revenue_net", f"""WITH {LEDGER} SELECT entity, CAST({NET.format(a='amount')} AS DOUBLE) AS net_revenue FROM ledger
    WHERE account_id IN (4100, 4200, 4800, 4850) GROUP BY 1""")
def revenue_net(spark: SparkSession, sf: str) -> DataFrame:
    return double(M.net_revenue(ledger(spark, sf)), "net_revenue")


@query("fx_convert", f"""
    WITH {LEDGER}, {RATES} SELECT entity, currency, period, rate_state, CAST(sum(converted) AS DOUBLE) AS converted,
      CAST(max(rate) AS DOUBLE) AS rate FROM conv GROUP BY 1, 2, 3, 4""")
def fx_convert(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.convert(ledger(spark, sf), rates(spark, sf))
    return rows.groupBy("entity", "currency", "period", "rate_state").agg(
        F.sum("converted").cast("double").alias("converted"), F.max("rate").cast("double").alias("rate"))


@query("fx_unconverted", f"""
    WITH {LEDGER}, {RATES} SELECT period, currency, rate_state, count(*) AS n FROM conv WHERE rate IS NULL GROUP BY 1, 2, 3""")
def fx_unconverted(spark: SparkSession, sf: str) -> DataFrame:
    return M.unconverted(M.convert(ledger(spark, sf), rates(spark, sf)))


@query("fx_average", f"""
    WITH {LEDGER}, {RATES}, t AS (SELECT entity, currency, CAST(-sum(amount) AS DECIMAL(18,2)) AS revenue FROM ledger
      WHERE account_id BETWEEN 4000 AND 4999 AND account_id NOT BETWEEN 4300 AND 4309 GROUP BY 1, 2),
    r AS (SELECT currency, CAST(CAST(sum(rate) AS DOUBLE) / count(rate) AS DECIMAL(18,6)) AS ar FROM rates GROUP BY 1)
    SELECT entity, currency, CAST(round(CAST(revenue AS DECIMAL(20,2)) * CASE WHEN currency = 'EUR' THEN CAST(1 AS DECIMAL(18,6)) ELSE ar END, 2)
      AS DOUBLE) AS converted FROM t LEFT JOIN r USING (currency)""")
def fx_average(spark: SparkSession, sf: str) -> DataFrame:
    totals = M.revenue_range(ledger(spark, sf), M.INTERCOMPANY, ("entity", "currency")).withColumn("revenue", F.col("revenue").cast(D2))
    return double(M.convert_totals(totals, rates(spark, sf), "revenue").select("entity", "currency", "converted"), "converted")


@query("group_total", f"""
    WITH {LEDGER}, {RATES} SELECT CAST({NET.format(a='converted')} AS DOUBLE) AS group_total FROM conv""")
def group_total(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.convert(ledger(spark, sf), rates(spark, sf))
    return double(M.group_total(M.net_revenue(rows, amount="converted"), "net_revenue"), "group_total")


@query("measure_comparison", f"""
    WITH {LEDGER}, c AS (SELECT entity AS part, -sum(amount) AS value FROM ledger WHERE account_id BETWEEN 4000 AND 4999
      AND account_id NOT BETWEEN 4800 AND 4809 GROUP BY 1),
    e AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'DE' WHEN o_orderstatus = 'O' THEN 'US' ELSE 'FR' END AS part,
      sum(CAST(o_totalprice AS DECIMAL(18,2))) AS value FROM orders GROUP BY 1)
    SELECT 'revenue' AS measure, coalesce(c.part, e.part) AS part, CAST(c.value AS DOUBLE) AS computed, CAST(e.value AS DOUBLE) AS expected
    FROM c FULL JOIN e ON c.part = e.part WHERE abs(coalesce(c.value, 0) - coalesce(e.value, 0)) > 10000""")
def measure_comparison(spark: SparkSession, sf: str) -> DataFrame:
    computed = M.revenue_range(ledger(spark, sf)).select(F.lit("revenue").alias("measure"), F.col("entity").alias("part"),
                                                         F.col("revenue").alias("value"))
    status = F.col("o_orderstatus")
    expected = table(spark, sf, "orders").groupBy(
        F.when(status == "F", "DE").when(status == "O", "US").otherwise("FR").alias("part")).agg(
        F.sum(F.col("o_totalprice").cast(D2)).alias("value")).withColumn("measure", F.lit("revenue"))
    return double(M.compare_measures(computed, expected, 10000.0), "computed", "expected")


def double_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as debit in their month, line items as credit in the order's entity and shipping month."""
    debit = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "O", "DE").otherwise("US").alias("entity"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.col("o_totalprice").cast(D2).alias("amount"))
    return debit.unionByName(ledger(spark, sf).select("entity", "period", "amount"))


@query("period_balance", f"""
    WITH {LEDGER}, e AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'DE' ELSE 'US' END AS entity, strftime(o_orderdate, '%Y-%m') AS period,
      CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders UNION ALL SELECT entity, period, amount FROM ledger)
    SELECT entity, period, CAST(sum(amount) AS DOUBLE) AS balance FROM e
    WHERE NOT (entity = 'US' AND period IN (SELECT strftime(max(o_orderdate), '%Y-%m') FROM orders))
    GROUP BY 1, 2 HAVING abs(sum(amount)) > 0.01""")
def period_balance(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("period")).select(
        F.lit("US").alias("entity"), "period")
    return double(M.period_balance(double_entry(spark, sf), last), "balance")


@query("subledger_by_entity", f"""
    WITH {LEDGER}, s AS (SELECT CASE WHEN o_orderstatus = 'O' THEN 'DE' WHEN o_orderstatus = 'F' THEN 'US' ELSE 'FR' END AS entity,
      sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1),
    g AS (SELECT entity, sum(amount) AS g FROM ledger WHERE account_id = 4200 GROUP BY 1)
    SELECT coalesce(s.entity, g.entity) AS entity, CAST(coalesce(s, 0) AS DOUBLE) AS subledger_total, CAST(coalesce(g, 0) AS DOUBLE) AS control_total
    FROM s FULL JOIN g ON s.entity = g.entity WHERE abs(coalesce(s, 0) - coalesce(g, 0)) > 0.01""")
def subledger_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    sub = table(spark, sf, "orders").select(
        F.when(status == "O", "DE").when(status == "F", "US").otherwise("FR").alias("entity"), F.col("o_totalprice").cast(D2).alias("amount"))
    return double(M.subledger_by_entity(sub, ledger(spark, sf), 4200), "subledger_total", "control_total")


@query("ic_amount_symmetry", f"""
    WITH {LEDGER} SELECT period, CAST(coalesce(sum(amount) FILTER (entity = 'DE' AND account_id = 4300), 0) AS DOUBLE) AS left_amount,
      CAST(coalesce(sum(amount) FILTER (entity = 'US' AND account_id = 4400), 0) AS DOUBLE) AS right_amount FROM ledger
    WHERE (entity = 'DE' AND account_id = 4300) OR (entity = 'US' AND account_id = 4400) GROUP BY 1 HAVING abs(sum(amount)) > 0.01""")
def ic_amount_symmetry(spark: SparkSession, sf: str) -> DataFrame:
    return double(M.mirrored_accounts(ledger(spark, sf), ("DE", 4300), ("US", 4400)), "left_amount", "right_amount")


@query("activity_days", """
    SELECT o_custkey AS rep_id, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, count(DISTINCT CAST(o_orderdate AS DATE)) AS activity_days
    FROM orders GROUP BY 1, 2""")
def activity_days(spark: SparkSession, sf: str) -> DataFrame:
    return M.activity_days(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query("activity_days_events", """
    SELECT user_id AS rep_id, year(ts) || '-Q' || quarter(ts) AS quarter, count(DISTINCT CAST(ts AS DATE)) AS activity_days FROM events GROUP BY 1, 2""")
def activity_days_events(spark: SparkSession, sf: str) -> DataFrame:
    return M.activity_days(table(spark, sf, "events"), "user_id", "ts")


@query("activity_after_exit", """
    WITH x AS (SELECT user_id AS rep_id, CAST(min(ts) AS DATE) + 20 AS exit_date FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT event_id, user_id FROM events JOIN x ON user_id = rep_id WHERE CAST(ts AS DATE) > exit_date""")
def activity_after_exit(spark: SparkSession, sf: str) -> DataFrame:
    """A representative leaves twenty days after the first signup."""
    ev = table(spark, sf, "events")
    exits = ev.filter("event_type = 'signup'").groupBy(F.col("user_id").alias("rep_id")).agg(
        F.date_add(F.min("ts").cast("date"), 20).alias("exit_date"))
    return M.activity_after_exit(ev, "user_id", "ts", exits).select("event_id", "user_id")


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Key accounts of a customer by order date; each version ends the day before the next one."""
    days = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").cast("date").alias("valid_from")).agg(
        F.concat(F.lit("KA"), F.substring(F.min("o_orderpriority"), 1, 1)).alias("key_account"))
    nxt = F.lead("valid_from").over(Window.partitionBy("customer_id").orderBy("valid_from"))
    return days.withColumn("valid_to", F.date_sub(nxt, 1))


HIERARCHY = """hier AS (SELECT customer_id, valid_from, key_account, lead(valid_from) OVER (PARTITION BY customer_id ORDER BY valid_from) - 1 AS valid_to
    FROM (SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS valid_from, 'KA' || substr(min(o_orderpriority), 1, 1) AS key_account
          FROM orders GROUP BY 1, 2))"""


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query("point_in_time", f"""
    WITH {HIERARCHY} SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS VARCHAR) AS shipped, o_custkey AS customer_id, key_account
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN hier ON customer_id = o_custkey
      AND CAST(l_shipdate AS DATE) BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31')""")
def point_in_time(spark: SparkSession, sf: str) -> DataFrame:
    lines = shipped(spark, sf).select("l_orderkey", "l_linenumber", "l_shipdate", "customer_id")
    return M.point_in_time(lines, "customer_id", "l_shipdate", hierarchy(spark, sf), "key_account").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("string").alias("shipped"), "customer_id", "key_account")


@query("customer_month_asof", f"""
    WITH {HIERARCHY}, lines AS (SELECT coalesce(s_suppkey + 200, o_custkey) AS cid, CAST(l_shipdate AS DATE) AS day,
      CAST(l_extendedprice AS DECIMAL(18,2)) AS revenue, CAST(l_quantity * 100 AS DECIMAL(18,2)) AS cost
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = o_custkey)
    SELECT cid AS customer_id, key_account, strftime(day, '%Y-%m') AS period, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(revenue - cost) AS DOUBLE) AS margin
    FROM lines LEFT JOIN hier ON customer_id = cid AND day BETWEEN valid_from AND coalesce(valid_to, DATE '9999-12-31')
    WHERE cid NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') GROUP BY 1, 2, 3""")
def customer_month_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that share a number with a supplier have moved to that number plus 200; one segment is intercompany."""
    lines = shipped(spark, sf).select(
        "customer_id", F.col("l_shipdate").cast("date").alias("day"), F.col("l_extendedprice").cast(D2).alias("revenue"),
        (F.col("l_quantity") * 100).cast(D2).alias("cost"))
    moved = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("old_id"), (F.col("s_suppkey") + 200).alias("new_id"))
    inside = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("customer_id"))
    return double(M.customer_months(lines, hierarchy(spark, sf), moved, inside), "revenue", "margin")


@query("plan_vs_actual", f"""
    WITH {LEDGER}, p AS (SELECT 'S' || (o_custkey // 10) AS centre, strftime(o_orderdate, '%Y-%m') AS period, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS p FROM orders GROUP BY 1, 2),
    a AS (SELECT 'S' || l_suppkey AS centre, period, sum(amount) AS a FROM ledger GROUP BY 1, 2)
    SELECT coalesce(p.centre, a.centre) AS centre, coalesce(p.period, a.period) AS period, CAST(coalesce(p, 0) AS DOUBLE) AS planned,
      CAST(coalesce(a, 0) AS DOUBLE) AS actual, CAST(coalesce(p, 0) - coalesce(a, 0) AS DOUBLE) AS variance
    FROM p FULL JOIN a ON p.centre = a.centre AND p.period = a.period""")
def plan_vs_actual(spark: SparkSession, sf: str) -> DataFrame:
    centre = lambda c: F.concat(F.lit("S"), c.cast("string")).alias("centre")
    plan = table(spark, sf, "orders").select(centre(F.floor(F.col("o_custkey") / 10)), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
                                             F.col("o_totalprice").cast(D2).alias("amount"))
    actual = ledger(spark, sf).select(centre(F.col("l_suppkey")), "period", "amount")
    return double(M.plan_vs_actual(plan, actual, ["centre", "period"]), "planned", "actual", "variance")


@query("rebate_accrual", """
    WITH i AS (SELECT 'KA' || c_nationkey AS key_account, CAST(o_orderdate AS DATE) AS day, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
      FROM orders JOIN customer ON o_custkey = c_custkey),
    m AS (SELECT key_account, year(day) AS y, strftime(day, '%Y-%m') AS period, sum(amount) AS v FROM i GROUP BY 1, 2, 3),
    q AS (SELECT *, sum(v) OVER (PARTITION BY key_account, y) AS yv FROM m)
    SELECT key_account, period, CAST(yv AS DOUBLE) AS year_volume, CAST(round(CAST(v AS DECIMAL(18,2)) * CAST(0.02 AS DECIMAL(6,4)), 2) AS DOUBLE) AS rebate
    FROM q WHERE yv > 500000 AND round(CAST(v AS DECIMAL(18,2)) * CAST(0.02 AS DECIMAL(6,4)), 2) <> 0""")
def rebate_accrual(spark: SparkSession, sf: str) -> DataFrame:
    invoices = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("KA"), F.col("c_nationkey").cast("string")).alias("key_account"), F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast(D2).alias("amount"))
    return double(M.rebate_accrual(invoices).select("key_account", "period", "year_volume", "rebate"), "year_volume", "rebate")


@query("quarterly", f"""
    WITH {LEDGER} SELECT substr(period, 1, 4) || ' Q' || ((CAST(substr(period, 6, 2) AS INTEGER) - 1) // 3 + 1) AS quarter,
      CAST(-sum(amount) AS DOUBLE) AS revenue FROM ledger WHERE account_id IN (4100, 4200) GROUP BY 1""")
def quarterly(spark: SparkSession, sf: str) -> DataFrame:
    return double(M.quarterly_revenue(ledger(spark, sf)), "revenue")


@query("unsigned_report", f"""
    WITH {LEDGER}, s AS (SELECT period, account_id, CASE WHEN account_id = 4300 THEN -amount ELSE amount END AS amount FROM ledger)
    SELECT period, CAST(account_id AS INTEGER) AS account, CAST(abs(round(sum(amount), 2)) AS DOUBLE) AS amount, CASE WHEN sum(amount) < 0 THEN 'H' ELSE 'S' END AS flag, 'DE' AS journal
    FROM s GROUP BY 1, 2""")
def unsigned_report(spark: SparkSession, sf: str) -> DataFrame:
    signed = ledger(spark, sf).withColumn("amount", F.when(F.col("account_id") == 4300, -F.col("amount")).otherwise(F.col("amount")))
    return double(M.unsigned_report(signed, "DE"), "amount")


@query("anomaly_counts", f"""
    SELECT 'open_without_invoice' AS finding, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n
    UNION ALL SELECT 'several_invoices', (SELECT count(*) FROM (SELECT 1 FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey HAVING count(*) >= 2))
    UNION ALL SELECT 'reversals', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT 'missing_periods', (SELECT count(*) FROM (VALUES {MONTH_ROWS}) e(m) WHERE m NOT IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders))
    UNION ALL SELECT 'intercompany_postings', (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber = 3)
    UNION ALL SELECT 'migrated_customers', (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier))
    UNION ALL SELECT 'legacy_credit_notes', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND strftime(l_shipdate, '%Y-%m') < '1997-07')
    UNION ALL SELECT 'new_credit_notes', (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND strftime(l_shipdate, '%Y-%m') >= '1997-07')
    UNION ALL SELECT 'periods_without_closing_rate', (SELECT count(*) FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders) p
      WHERE m LIKE '%-03' OR m LIKE '%-09')
    UNION ALL SELECT 'late_project_postings', (SELECT count(*) FROM lineitem WHERE strftime(l_shipdate, '%Y-%m') >= '1997-07' AND l_linenumber > 3)""")
def anomaly_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    expected = declared(spark, "period string", [(m,) for m in MONTHS])
    months = orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"))
    # Returned lines are credit notes, in the old table before July 1997 and under a type of their own from then on.
    notes = lines.filter("l_returnflag = 'R'").withColumn("period", F.date_format("l_shipdate", "yyyy-MM"))
    new = F.col("period") >= "1997-07"
    # Closing rates of March and September were never entered.
    kept = rates(spark, sf).filter((F.col("rate_type") != "B") | ~F.substring("period", 6, 2).isin("03", "09"))
    postings = lines.select(F.date_format("l_shipdate", "yyyy-MM").alias("period"),
                            F.when(F.col("l_linenumber") > 3, F.concat(F.lit("P"), "l_linenumber")).alias("project_id"))
    return M.anomaly_counts({
        "open_without_invoice": M.without_counterpart(orders.filter("o_orderstatus = 'O'"), "o_orderkey", lines, "l_orderkey"),
        "several_invoices": M.repeated_references(lines.filter("l_returnflag = 'A'"), "l_orderkey"),
        "reversals": lines.filter("l_returnflag = 'R'"),
        "missing_periods": M.missing_units(expected, months),
        "intercompany_postings": ledger(spark, sf).filter("account_id = 4300"),
        "migrated_customers": table(spark, sf, "customer").join(ids, "c_custkey", "left_semi"),
        **M.credit_notes(notes.filter(~new), notes.filter(new)),
        "periods_without_closing_rate": M.periods_without_rate(kept, "B"),
        "late_project_postings": M.project_postings(postings, "1997-07"),
    })


def activities(spark: SparkSession, sf: str) -> DataFrame:
    """Customer references as people write them: by old id, by name, or as prospects."""
    ev = table(spark, sf, "events")
    ref = (
        F.when(F.col("event_type") == "view", F.col("user_id").cast("string"))
        .when(F.col("event_type") == "click", F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("PROSPECT_"), F.col("user_id").cast("string")))
        .otherwise("unknown")
    )
    return ev.select("event_id", ref.alias("customer_reference"))


@query("reference_forms", """
    WITH a AS (SELECT CASE event_type WHEN 'view' THEN CAST(user_id AS VARCHAR) WHEN 'click' THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
      WHEN 'signup' THEN 'PROSPECT_' || user_id ELSE 'unknown' END AS r FROM events)
    SELECT 'old_id' AS form, (SELECT count(*) FROM a WHERE r IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)) AS n
    UNION ALL SELECT 'name', (SELECT count(*) FROM a WHERE r IN (SELECT c_name FROM customer))
    UNION ALL SELECT 'prospect', (SELECT count(*) FROM a WHERE starts_with(r, 'PROSPECT_'))""")
def reference_forms(spark: SparkSession, sf: str) -> DataFrame:
    return M.reference_forms(activities(spark, sf), "customer_reference", table(spark, sf, "supplier").select("s_suppkey"),
                             table(spark, sf, "customer").select("c_name"), "PROSPECT_")


@query("open_items", """
    SELECT count(*) FILTER (o_orderpriority = '5-LOW' AND o_orderstatus = 'F') AS unapplied_cash,
           count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus <> 'F') AS unpaid FROM orders""")
def open_items(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("invoice_reference"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("payment_reference"))
    return M.open_items(items)


@query("single_period_sum", f"""
    WITH {LEDGER} SELECT period, CAST(sum(amount) AS DOUBLE) AS total FROM ledger WHERE entity = 'US' GROUP BY 1""")
def single_period_sum(spark: SparkSession, sf: str) -> DataFrame:
    return ledger(spark, sf).filter("entity = 'US'").groupBy("period").agg(F.sum("amount").cast("double").alias("total"))


@query("fx_direction", """
    WITH d AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS doc, 1.0::DOUBLE + l_tax + 0.05::DOUBLE AS rate,
      CASE WHEN l_returnflag = 'R' THEN l_extendedprice * (1.0::DOUBLE + l_tax + 0.05::DOUBLE) ELSE l_extendedprice / (1.0::DOUBLE + l_tax + 0.05::DOUBLE) END AS loc FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey FROM d WHERE rate <> 0 AND abs(loc - doc * rate) <= 0.0001::DOUBLE * abs(loc) AND NOT abs(loc - doc / rate) <= 0.0001::DOUBLE * abs(loc)""")
def fx_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines were converted the wrong way round."""
    rate = F.lit(1.0) + F.col("l_tax") + F.lit(0.05)
    price = F.col("l_extendedprice")
    docs = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", price.alias("doc_amount"), rate.alias("rate"),
        F.when(F.col("l_returnflag") == "R", price * rate).otherwise(price / rate).alias("local_amount"))
    return M.wrong_direction(docs).select("l_orderkey", "l_linenumber", "l_suppkey")


GAPS = """ends AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS vf, max(CAST(o_orderdate AS DATE) + 30) AS vt FROM orders GROUP BY 1, 2),
    c AS (SELECT *, max(vt) OVER (PARTITION BY k ORDER BY vf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov FROM ends),
    gaps AS (SELECT k, cov + 1 AS gf, vf - 1 AS gt FROM c WHERE cov + 1 < vf)"""


def month_long_versions(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_custkey", day.alias("valid_from"), F.date_add(day, 30).alias("valid_to"))


@query("validity_gaps", f"""
    WITH {GAPS} SELECT k AS key, CAST(gf AS VARCHAR) AS gap_from, CAST(gt AS VARCHAR) AS gap_to FROM gaps""")
def validity_gaps(spark: SparkSession, sf: str) -> DataFrame:
    gaps = M.validity_gaps(month_long_versions(spark, sf), "o_custkey")
    return gaps.select("key", F.col("gap_from").cast("string").alias("gap_from"), F.col("gap_to").cast("string").alias("gap_to"))


@query("facts_in_gaps", f"""
    WITH {GAPS}, f AS (SELECT o_custkey AS k, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT gaps.k AS key, CAST(gf AS VARCHAR) AS gap_from, CAST(gt AS VARCHAR) AS gap_to, count(*) AS facts
    FROM gaps JOIN f ON f.k = gaps.k AND day BETWEEN gf AND gt GROUP BY 1, 2, 3""")
def facts_in_gaps(spark: SparkSession, sf: str) -> DataFrame:
    gaps = M.validity_gaps(month_long_versions(spark, sf), "o_custkey")
    found = M.facts_in_gaps(gaps, shipped(spark, sf), "customer_id", "l_shipdate")
    return found.select("key", F.col("gap_from").cast("string").alias("gap_from"), F.col("gap_to").cast("string").alias("gap_to"), "facts")
