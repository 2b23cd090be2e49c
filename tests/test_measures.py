import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from attest.functions.frames import declared
from attest.operators import measures as M
from tests.conftest import rows


def test_revenue_follows_the_account_rules(spark):
    ledger = declared(spark, "entity string, account_id bigint, period string, amount double", [
        ("DE", 4100, "2024-01", -100.0), ("DE", 4200, "2024-01", -50.0), ("DE", 4300, "2024-02", -7.0), ("DE", 4800, "2024-02", 10.0), ("DE", 4850, "2024-02", 2.0),
        ("DE", 1200, "2024-02", 999.0), ("US", 4100, "2024-03", -10.0)])
    assert rows(M.revenue_range(ledger)) == [("DE", 155.0), ("US", 10.0)]
    assert rows(M.revenue_range(ledger, M.INTERCOMPANY)) == [("DE", 138.0), ("US", 10.0)]
    assert rows(M.net_revenue(ledger)) == [("DE", 138.0), ("US", 10.0)]
    assert rows(M.quarterly_revenue(ledger)) == [("2024 Q1", 160.0)]
    report = M.unsigned_report(ledger, "DE").filter("account = 4100").select("period", "amount", "flag")
    assert rows(report) == [("2024-01", 100.0, "H"), ("2024-03", 10.0, "H")]


def test_conversion_by_period_and_by_average(spark):
    ledger = declared(spark, "period string, currency string, amount double", [("2024-01", "USD", 100.0), ("2024-02", "USD", 100.0)])
    rates = declared(spark, "period string, from_currency string, to_currency string, rate_type string, rate_value double", [
        ("2024-01", "USD", "EUR", "M", 0.5), ("2024-01", "USD", "EUR", "B", 9.0), ("2024-02", "EUR", "USD", "M", 9.0), ("2024-03", "USD", "EUR", "M", 1.5)])
    assert rows(M.convert(ledger, rates).select("period", "converted")) == [("2024-01", 50.0), ("2024-02", 92.0)]
    totals = declared(spark, "currency string, v decimal(18,2)", []).unionByName(spark.sql("SELECT 'USD' currency, CAST(10 AS DECIMAL(18,2)) v UNION ALL SELECT 'EUR', CAST(3 AS DECIMAL(18,2))"))
    assert [(c, float(v)) for c, v in rows(M.convert_totals(totals, rates, "v").select("currency", "converted"))] == [("EUR", 3.0), ("USD", 10.0)]


def test_comparison_and_balances(spark):
    schema = "measure string, part string, value double"
    got = M.compare_measures(declared(spark, schema, [("Z1", "DE", 100.0), ("Z1", "US", 5.0)]), declared(spark, schema, [("Z1", "DE", 109.0), ("Z2", "DE", 50.0)]), 10.0)
    assert rows(got) == [("Z2", "DE", None, 50.0)]
    ledger = declared(spark, "entity string, account_id bigint, period string, amount double", [("DE", 9001, "1", 5.0), ("US", 9002, "1", -5.0), ("DE", 9001, "2", 4.0), ("US", 9002, "3", 1.0)])
    breaks = declared(spark, "entity string, period string", [("DE", "1"), ("US", "1"), ("US", "3")])
    assert rows(M.period_balance(ledger, breaks)) == [("DE", "2", 4.0)]
    assert rows(M.mirrored_accounts(ledger, ("DE", 9001), ("US", 9002))) == [("2", 4.0, 0.0), ("3", 0.0, 1.0)]
    items = declared(spark, "entity string, amount double", [("DE", 9.0), ("FR", 1.0)])
    assert rows(M.subledger_by_entity(items, ledger, 9001)) == [("FR", 1.0, 0.0)]


def versions_and_facts(seed):
    rng, start = random.Random(seed), date(2024, 1, 1)
    versions, facts = [], []
    for key in ["hot"] * 100 + [f"k{i}" for i in range(20)] * 2:
        vf = start + timedelta(days=rng.randint(0, 300))
        versions.append((key, vf, None if rng.random() < 0.1 else vf + timedelta(days=rng.randint(-1, 25)), f"v{len(versions):03d}"))
    for _ in range(300):
        facts.append(("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 24)}", start + timedelta(days=rng.randint(-5, 330))))
    return versions, facts


def test_point_in_time_against_brute_force(spark):
    versions, facts = versions_and_facts(2)
    want = []
    for key, day in facts:
        hits = sorted((vf, vt or date(9999, 12, 31), v) for k, vf, vt, v in versions if k == key and vf <= day <= (vt or date(9999, 12, 31)))
        want.append((key, day, hits[0][2] if hits else None))
    got = M.point_in_time(declared(spark, "k string, day date", facts), "k", "day", declared(spark, "k string, valid_from date, valid_to date, v string", versions), "v")
    assert rows(got.select("k", "day", "v")) == sorted(want, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("hot_key", [0, 3, 50_000])
def test_values_of_separate_and_overlapping_versions_against_brute_force(spark, hot_key):
    rng, start = random.Random(hot_key), date(2024, 1, 1)
    versions, facts = [], [(None, start), ("none", start), ("k1", None)]
    for i in range(24):
        day = start
        for n in range(rng.randint(1, 6)):
            end = day + timedelta(days=rng.randint(-1, 30))
            versions.append((f"k{i}", day, None if rng.random() < 0.1 else end, rng.choice([None, f"v{n}"])))
            # every third key has versions that overlap, the others follow each other, some with gaps
            day = day + timedelta(days=5) if i % 3 == 0 else (versions[-1][2] or date(2026, 1, 1)) + timedelta(days=rng.randint(1, 9))
    facts += [(f"k{rng.randint(0, 23)}", start + timedelta(days=rng.randint(-5, 90))) for _ in range(300)]
    want = []
    for key, day in facts:
        hits = sorted(((vf, vt or date(9999, 12, 31)), v) for k, vf, vt, v in versions if day and k == key and vf <= day <= (vt or date(9999, 12, 31)))
        want.append((key, day, hits[0][1] if hits else None))
    got = M.point_in_time(declared(spark, "k string, day date", facts), "k", "day",
                          declared(spark, "k string, valid_from date, valid_to date, v string", versions), "v", hot_key)
    assert rows(got.select("k", "day", "v")) == sorted(want, key=lambda r: [(x is None, str(x)) for x in r])


def test_customer_months_take_each_day_once(spark):
    d = date
    lines = declared(spark, "customer_id bigint, day date, revenue decimal(9,2), cost decimal(9,2)", [
        (1, d(2025, 7, 1), Decimal(10), Decimal(4)), (1, d(2025, 7, 1), Decimal(5), None), (7, d(2025, 7, 1), None, Decimal(3)), (None, d(2025, 7, 1), Decimal(1), Decimal(1))])
    versions = declared(spark, "customer_id bigint, valid_from date, valid_to date, key_account string", [(1, d(2024, 1, 1), None, "A")])
    got = M.customer_months(lines, versions, declared(spark, "old_id bigint, new_id bigint", [(7, 1)]), declared(spark, "customer_id bigint", []))
    # a line without cost or revenue has no margin and takes none from other lines of its day
    assert {tuple(r) for r in got.collect()} == {(1, "A", "2025-07", Decimal(15), Decimal(6)), (None, None, "2025-07", Decimal(1), Decimal(0))}
    # versions that follow each other need no join of days with versions
    assert "min_by" not in got._jdf.queryExecution().toString()


def test_gaps_and_facts_in_them_against_brute_force(spark):
    versions, facts = versions_and_facts(4)
    covered: dict = {}
    for key, vf, vt, _ in versions:
        covered.setdefault(key, []).append((vf, vt or date(9999, 12, 31)))
    want_gaps, want_facts = [], []
    for key, spans in covered.items():
        reach = None
        for vf, vt in sorted(spans):
            if reach is not None and reach + timedelta(days=1) < vf:
                want_gaps.append((key, reach + timedelta(days=1), vf - timedelta(days=1)))
            reach = vt if reach is None else max(reach, vt)
            if reach == date(9999, 12, 31):
                break
    for key, gf, gt in want_gaps:
        n = sum(k == key and gf <= day <= gt for k, day in facts)
        if n:
            want_facts.append((key, gf, gt, n))
    gaps = M.validity_gaps(declared(spark, "k string, valid_from date, valid_to date, v string", versions), "k")
    assert rows(gaps) == sorted(want_gaps, key=lambda r: [(False, str(x)) for x in r])
    assert rows(M.facts_in_gaps(gaps, declared(spark, "k string, day date", facts), "k", "day")) == sorted(want_facts, key=lambda r: [(False, str(x)) for x in r])


def test_customer_months_apply_versions_and_migration(spark):
    d = date
    lines = declared(spark, "customer_id bigint, day date, revenue double, cost double", [
        (1, d(2025, 6, 30), 10.0, 4.0), (1, d(2025, 7, 1), 20.0, 5.0), (7, d(2025, 7, 2), 5.0, 1.0), (9, d(2025, 7, 2), 99.0, 0.0), (3, d(2025, 7, 2), 1.0, 0.0)])
    versions = declared(spark, "customer_id bigint, valid_from date, valid_to date, key_account string", [(1, d(2024, 1, 1), d(2025, 6, 30), "A"), (1, d(2025, 7, 1), None, "B")])
    got = M.customer_months(lines, versions, declared(spark, "old_id bigint, new_id bigint", [(7, 1)]), declared(spark, "customer_id bigint", [(9,)]))
    assert rows(got) == [(1, "A", "2025-06", 10.0, 6.0), (1, "B", "2025-07", 25.0, 19.0), (3, None, "2025-07", 1.0, 1.0)]


def test_rebates_activities_and_plan(spark):
    d = date
    invoices = declared(spark, "key_account string, day date, amount double", [("A", d(2024, 1, 5), 400000.0), ("A", d(2024, 2, 5), 200000.0), ("A", d(2025, 2, 5), 500000.0), (None, d(2024, 1, 1), 9e9)])
    assert [(k, p, float(r)) for k, p, r in rows(M.rebate_accrual(invoices).select("key_account", "period", "rebate"))] == [("A", "2024-01", 8000.0), ("A", "2024-02", 4000.0)]
    acts = declared(spark, "rep string, day date", [("R1", d(2024, 1, 1)), ("R1", d(2024, 1, 1)), ("R1", d(2024, 4, 1)), ("R8", d(2025, 10, 1))])
    assert rows(M.activity_days(acts, "rep", "day")) == [("R1", "2024-Q1", 1), ("R1", "2024-Q2", 1), ("R8", "2025-Q4", 1)]
    exits = declared(spark, "rep_id string, exit_date date", [("R8", d(2025, 9, 30)), ("R1", None)])
    assert M.activity_after_exit(acts, "rep", "day", exits).count() == 1
    plan, actual = (declared(spark, "pc string, amount double", v) for v in ([("a", 10.0)], [("a", 4.0), ("b", 1.0)]))
    assert rows(M.plan_vs_actual(plan, actual, ["pc"])) == [("a", 10.0, 4.0, 6.0), ("b", 0.0, 1.0, -1.0)]


def test_anomalies(spark):
    orders = declared(spark, "o string", [("1",), ("2",)])
    invoices = declared(spark, "r string", [("1",), ("1",), (None,)])
    got = M.anomaly_counts({"open": M.without_counterpart(orders, "o", invoices, "r"), "several": M.repeated_references(invoices.filter("r IS NOT NULL"), "r"),
                            "missing": M.missing_units(declared(spark, "p string", [("a",), ("b",)]), declared(spark, "p string", [("a",)]))})
    assert rows(got) == [("missing", 1), ("open", 1), ("several", 1)]
    acts = declared(spark, "ref string", [("1101",), ("1101",), ("Alpha",), ("PROSPECT_1",), ("x",)])
    forms = M.reference_forms(acts, "ref", declared(spark, "id bigint", [(1101,)]), declared(spark, "n string", [("Alpha",)]), "PROSPECT_")
    assert rows(forms) == [("name", 1), ("old_id", 2), ("prospect", 1)]
    items = declared(spark, "invoice_reference string, payment_reference string", [(None, "p"), ("i", None), ("i", "p"), (None, None)])
    assert rows(M.open_items(items)) == [(1, 1)]
    docs = declared(spark, "id string, doc_amount double, local_amount double, rate double", [("wrong", 108.0, 116.64, 1.08), ("right", 108.0, 100.0, 1.08), ("par", 5.0, 5.0, 1.0), ("zero", 1.0, 0.0, 0.0)])
    assert rows(M.wrong_direction(docs).select("id")) == [("wrong",)]
    assert M.validity_gaps(declared(spark, "k string, valid_from date, valid_to date", [("a", date(2024, 1, 1), None), ("a", date(2025, 1, 1), None)]), "k").filter(F.lit(True)).count() == 0


def test_conversion_by_period_and_currency(spark):
    book = declared(spark, "period string, currency string, amount double", [
        ("1", "EUR", 100.0), ("1", "USD", 100.0), ("2", "USD", 100.0), ("1", "CHF", 100.0), ("1", "GBP", 100.0), ("1", None, 5.0)])
    table = declared(spark, "period string, from_currency string, to_currency string, rate_type string, rate_value double", [
        ("1", "USD", "EUR", "M", 0.9), ("1", "USD", "EUR", "M", 0.9), ("1", "USD", "EUR", "B", 7.0), ("1", "CHF", "EUR", "M", 1.1),
        ("1", "CHF", "EUR", "M", 1.2), ("1", "USD", "JPY", "M", 150.0)])
    got = {(r["currency"], r["period"]): (r["rate_state"], r["converted"]) for r in M.convert(book, table).collect()}
    assert got == {("EUR", "1"): ("own", 100.0), ("USD", "1"): ("rate", 90.0), ("USD", "2"): ("fallback", 92.0),
                   ("CHF", "1"): ("ambiguous", None), ("GBP", "1"): ("missing", None), (None, "1"): ("missing", None)}
    assert sorted(tuple(r)[1:] for r in M.unconverted(M.convert(book, table)).collect() if r["currency"]) == [
        ("CHF", "ambiguous", 1), ("GBP", "missing", 1)]
    totals = M.convert_totals(declared(spark, "currency string, v decimal(18,2)", [("EUR", 1), ("USD", 1), ("GBP", 1)]), table, "v")
    assert {r["currency"]: r["converted"] and float(r["converted"]) for r in totals.collect()} == {"EUR": 1.0, "USD": 0.9, "GBP": None}


def test_months_without_a_rate_of_one_type_and_project_postings(spark):
    rates = declared(spark, "period string, rate_type string", [("2024-01", "M"), ("2024-01", "B"), ("2024-02", "M"), ("2024-03", None), ("2024-04", "B")])
    assert rows(M.periods_without_rate(rates, "B")) == [("2024-02",), ("2024-03",)]
    ledger = declared(spark, "period string, project_id string", [("2024-06", "P1"), ("2024-07", "P1"), ("2024-08", None), (None, "P1")])
    assert rows(M.project_postings(ledger, "2024-07")) == [("2024-07", "P1")]
    counted = M.anomaly_counts(M.credit_notes(ledger.limit(0), ledger))
    assert rows(counted) == [("legacy_credit_notes", 0), ("new_credit_notes", 4)]
