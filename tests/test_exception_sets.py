"""Linear exception sets against row pairs, running sums over cut groups, and how sets of many probes are stored together."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from attest.evidence.runner import build_check, run_probes, write_exception_sets
from attest.evidence.tables import EVIDENCE, Probe
from attest.functions.frames import declared, running
from attest.operators import probes as P
from attest.plans.sweep import run_ready
from tests.conftest import rows
from workload import QUERIES


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_sums_carry_over_cut_groups(spark, partitions):
    rng = random.Random(partitions)
    data = [("hot" if rng.random() < 0.6 else f"k{i % 5}", i, rng.randint(0, 9), None if i % 4 else rng.randint(0, 99)) for i in range(600)]
    data += [(None, 1000, 5, 1), (None, 1001, 6, None)]
    want, sums, tops = [], {}, {}
    for g, i, n, m in data:
        want.append((g, i, n, m, sums.get(g, 0), tops.get(g)))
        sums[g] = sums.get(g, 0) + n
        tops[g] = m if tops.get(g) is None else max(tops[g], m if m is not None else tops[g])
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = declared(spark, "g string, i bigint, n bigint, m bigint", data).repartition(5)
        assert rows(running(df, "g", ["i"], {"before": "n"}, {"top": "m"})) == sorted(want, key=lambda r: [(v is None, str(v)) for v in r])
        assert running(df.limit(0), "g", ["i"], {"before": "n"}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_intervals_against_pairs(spark, seed):
    rng = random.Random(seed)
    start = date(2024, 1, 1)
    data = []
    for _ in range(160):
        vf = start + timedelta(days=rng.randint(0, 40))
        data.append(("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 25)}", vf, None if rng.random() < 0.15 else vf + timedelta(days=rng.randint(-2, 9))))
    data += data[:20] + [(None, start, None), ("x", None, start)]
    distinct: dict = {}
    for k, vf, vt in data:
        if k is not None and vf is not None:
            key = (k, vf, vt or date(9999, 12, 31))
            distinct[key] = distinct.get(key, 0) + 1
    want = []
    for (k, vf, vt), n in distinct.items():
        before = [(t, f, m) for (o, f, t), m in distinct.items() if o == k and (f, t) < (vf, vt) and t >= vf]
        after = [(f, t, m) for (o, f, t), m in distinct.items() if o == k and (vf, vt) < (f, t) and vt >= f]
        if before or after:
            other = max(before)[1::-1] if before else max(after)[:2]
            want.append((k, vf, vt, n, sum(x[2] for x in before), sum(x[2] for x in after), *other, n * sum(x[2] for x in before)))
    found = P.validity_overlaps(declared(spark, "k string, vf date, vt date", data), "k", "vf", "vt")
    got = [(*tuple(r)[:8], int(r["pairs"])) for r in found.collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("hot_key", [0, 5, 50_000])
def test_keys_of_any_size_give_the_same_overlaps(spark, hot_key):
    rng, start = random.Random(1), date(2024, 1, 1)
    data = []
    for _ in range(200):
        vf = start + timedelta(days=rng.randint(0, 60))
        data.append((7 if rng.random() < 0.4 else rng.randint(0, 30), vf, vf + timedelta(days=rng.randint(-2, 9))))
    table = declared(spark, "k int, vf date, vt date", data)
    found = P.validity_overlaps(table, "k", "vf", "vt", hot_key)
    assert found.schema["key"].dataType.simpleString() == "string"
    pairs = {}
    for r in P.validity_join(table, "k", "vf", "vt").collect():
        pairs[(r["key"], r["b_from"], r["b_to"])] = pairs.get((r["key"], r["b_from"], r["b_to"]), 0) + r["occurrences"]
    assert {(r["key"], r["valid_from"], r["valid_to"]): int(r["pairs"]) for r in found.collect() if r["pairs"] > 0} == pairs


def test_sets_and_small_keys_are_not_sorted_more_than_once(spark, folder):
    table = declared(spark, "k bigint, vf date, vt date", [(1, date(2024, 1, 1), date(2024, 1, i)) for i in range(2, 30)])
    plan = P.validity_overlaps(table, "k", "vf", "vt")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort ") + plan.count("SortAggregate") <= 1 and plan.count("Exchange ") == 1
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    write_exception_sets({"a": table, "b": table}, str(folder / "unsorted"), "r")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_contradictions_against_pairs(spark):
    rng = random.Random(9)
    side = lambda: [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", rng.choice([None, "a", "b", "c", "d"])) for _ in range(50)]
    left, right = side() + [(None, "a"), ("only left", "a")], side() + [("agree", "x")]
    left.append(("agree", "x"))
    want = []
    for mine, others, name in ((left, right, "left"), (right, left, "right")):
        for k, v in {r for r in mine if r[0] is not None}:
            against = [o for j, o in others if j == k and o != v]
            if against:
                n = sum((k, v) == r for r in mine)
                want.append((k, name, v, n, len(against), n * len(against) if name == "left" else 0))
    table = lambda data: declared(spark, "k string, a string", data)
    found = P.contradictions(table(left), table(right), "k", "k", "a", "a").collect()
    assert sorted(map(repr, ((r["key"], r["side"], r["value"], r["rows"], r["opponents"], int(r["pairs"])) for r in found))) == sorted(map(repr, want))
    assert all(r["other_value"] != r["value"] for r in found)


def test_sets_are_stored_together_and_read_apart(spark, folder):
    sets = {"a/b": declared(spark, "probe_no bigint, amount decimal(9,2)", [(1, 2), (2, None)]),
            "none": declared(spark, "grp string", []), "c d": declared(spark, "grp string, day date", [("x", date(2024, 1, 2)), (None, None)])}
    kept = write_exception_sets(sets, str(folder / "sink"), "r")
    assert kept.found({}) == {"a/b": 2, "none": 0, "c d": 2}
    for name, df in sets.items():
        assert rows(kept.typed(name)) == rows(df) and kept.typed(name).dtypes == df.dtypes
        assert {t for _, t in kept.text(name).dtypes} == {"string"}
    assert spark.read.parquet(kept.path("c d")).filter("day = '2024-01-02'").count() == 1
    with pytest.raises(Exception):
        write_exception_sets(sets, str(folder / "sink"), "r")


def test_pair_checks_always_store_their_set(spark):
    d = date
    views = {"t": declared(spark, "k bigint, vf date, vt date", [(1, d(2024, 1, 1), d(2024, 1, i)) for i in range(2, 30)] * 2)}
    probe = Probe("p", "validity_join", {"table": "t", "key_column": "k", "valid_from": "vf", "valid_to": "vt"})
    row = run_probes(views, [probe]).first()
    stored = spark.read.parquet(row["result_ref"])
    pairs = 4 * 28 * 27 // 2
    assert stored.count() == 28 and int(stored.agg(F.sum(F.col("pairs").cast("bigint"))).first()[0]) == pairs
    assert row["payload"]["exceptions_found"] == str(pairs) and row["exception_count"] == 56 == row["population"]
    assert len(row["exception_samples"]) == 20 and row["exception_samples"][0]["occurrences"] == "4"


def test_amounts_that_are_no_numbers_fail_their_check_only(spark):
    views = {"j": declared(spark, "g string, amount string, account bigint", [("a", "1.5", 1), ("b", "n/a", 2), ("b", None, 1)]),
             "ok": declared(spark, "g string, amount double", [("a", 1.0)])}
    bad = Probe("bad", "balance", {"journal": "j", "amount": "amount", "group_column": "g"})
    ledger = {"subledger": "ok", "subledger_amount": "amount", "journal": "j", "journal_amount": "amount", "account": "account"}
    good = Probe("good", "subledger_equals_gl", {**ledger, "accounts": [1]})
    worse = Probe("worse", "subledger_equals_gl", {**ledger, "accounts": [1, 2]})
    failed: list = []
    evidence = run_probes(views, [bad, good, worse], failed=failed).collect()
    assert [r["probe_id"] for r in evidence] == ["good"] and evidence[0]["verdict"] == "fail"
    assert sorted(p for p, _ in failed) == ["bad", "worse"] and all("'n/a'" in reason for _, reason in failed)
    assert set(evidence[0]["exception_samples"][0]) == {"subledger_total", "gl_total", "diff"}
    assert run_probes(views, [bad], failed=[]).count() == 0
    with pytest.raises(ValueError, match="n/a"):
        run_probes(views, [bad, good])


def test_a_sweep_says_all_it_did(spark):
    views = {"one": declared(spark, "k bigint, t string", [(1, "a"), (2, "b")]), "two": declared(spark, "k bigint, t string", [(1, "1"), (1, "x")])}
    probes = [Probe("p1", "duplicate", {"table": "one", "key_columns": ["k"]}, "a"), Probe("p2", "duplicate", {"table": "two", "key_columns": ["k"]}, "b"),
              Probe("p3", "duplicate", {"table": "one", "key_columns": ["k"]}, "c"), Probe("p4", "balance", {"journal": "two", "amount": "t", "group_column": "k"}, "a")]
    claims = declared(spark, "id string, depends_on array<string>", [("a", []), ("b", []), ("c", ["b"])])
    swept = run_ready(views, claims, declared(spark, EVIDENCE, []), probes)
    assert swept.executed == ["p1", "p2"] and sorted(p for p, _ in swept.skipped) == ["p3", "p4"]
    assert {r["id"]: r["status"] for r in swept.statuses.collect()} == {"a": "tested", "b": "contradicted", "c": "inferred"}
    assert [r["claim_ids"] for r in swept.questions.collect()] == [["b"]]
    assert {r["id"]: r["template"] for r in swept.probes.collect()} == {"p1": "duplicate", "p2": "duplicate", "p3": "duplicate", "p4": "balance"}
    again = run_ready(views, claims, swept.evidence, probes[:2], questions=swept.questions)
    assert again.questions.count() == 0 and again.evidence.count() == 2


def test_unknown_columns_are_refused_before_anything_runs(spark):
    views = {"t": declared(spark, "k bigint, vf date, vt date", []), "r": declared(spark, "lo bigint, hi bigint", [])}
    for template, params in [
            ("validity_join", {"table": "t", "key_column": "k", "valid_from": "vf", "valid_to": "gone"}),
            ("range_join", {"table": "t", "value_column": "gone", "ranges": "r", "range_from": "lo", "range_to": "hi"}),
            ("range_join", {"table": "t", "value_column": "k", "ranges": "r", "range_from": "lo", "range_to": "gone"}),
            ("attribute_contradiction", {"left": "t", "right": "r", "left_key": "k", "right_key": "lo", "left_attr": "gone", "right_attr": "hi"})]:
        with pytest.raises(ValueError, match="gone"):
            build_check(views, Probe("p", template, params))
    good = build_check(views, Probe("p", "range_join", {"table": "t", "value_column": "k", "ranges": "r", "range_from": "lo", "range_to": "hi"}))
    assert good.exceptions().count() == 0 and good.exceptions() is good.exceptions()


def test_probe_queries_return_every_pair(spark, folder):
    """Three values against two, and three intervals that all overlap: sets name one opponent, the queries each of them."""
    both = declared(spark, "s_suppkey bigint, s_nationkey bigint", [(1, 4), (1, 5), (1, 6), (2, 4)])
    both.write.parquet(f"{folder}/supplier.parquet")
    declared(spark, "c_custkey bigint, c_nationkey bigint", [(1, 5), (1, 7), (1, 7), (2, 4)]).write.parquet(f"{folder}/customer.parquet")
    days = [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 2), date(2024, 1, 3)]
    declared(spark, "o_orderkey bigint, o_custkey bigint, o_orderdate date, o_orderpriority string",
             [(i, 1, d, "1-URGENT") for i, d in enumerate(days)]).write.parquet(f"{folder}/orders.parquet")
    found = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).collect())
    assert found("probe_attribute_contradiction") == [
        ("1", "4", "5", 1), ("1", "4", "7", 2), ("1", "5", "7", 2), ("1", "6", "5", 1), ("1", "6", "7", 2)]
    assert [(x[1], x[3], x[5]) for x in found("probe_validity")] == [
        ("2024-01-01", "2024-01-02", 2), ("2024-01-01", "2024-01-03", 1), ("2024-01-02", "2024-01-03", 2)]
    assert [(x[1], x[3], x[5]) for x in found("probe_validity_hot_key")] == [
        ("2024-01-01", "2024-01-02", 2), ("2024-01-01", "2024-01-03", 1), ("2024-01-02", "2024-01-03", 2)]
