import random
from datetime import date, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from attest.evidence import verdicts as V
from attest.evidence.runner import build_check, draft_questions, probe_outcomes, run_probes
from attest.evidence.tables import Probe
from attest.evidence.templates import TEMPLATES, merged_tolerances, question_text
from attest.functions.frames import declared
from attest.operators import probes as P
from tests.conftest import rows


def harbour(spark):
    return {
        "berths": declared(spark, "berth bigint, quay string", [(k, "east" if k < 14 else "west") for k in range(11, 18)]),
        "calls": declared(spark, "moored string, tide string", [
            ("11", "ebb"), ("12", "ebb"), ("40", "flood"), ("40", "slack"), ("40", "slack"), (None, "slack")]),
    }


def outcome(views, template, tolerances=None, **params):
    return probe_outcomes({"p": build_check(views, Probe("p", template, params), tolerances)}).first()


def test_missing_berths(spark):
    v = harbour(spark)
    assert rows(P.anti_join(v["calls"], "moored", v["berths"], "berth")) == [("40", 3)]
    got = outcome(v, "anti_join", child="calls", child_column="moored", parent="berths", parent_column="berth")
    assert (got["population"], got["exception_count"], got["verdict"]) == (6, 1, "fail")
    assert got["exception_samples"] == [{"value": "40", "occurrences": "3"}]


def test_reported_orphans_never_fail(spark):
    got = outcome(harbour(spark), "anti_join", child="calls", child_column="moored", parent="berths", parent_column="berth", expectation="report")
    assert got["verdict"] == "inconclusive" and "domain answer" in got["summary"]


def test_raw_comparison_shows_why_canonical_text_matters(spark):
    a = declared(spark, "k double", [(1.0,), (2.0,)])
    b = declared(spark, "k bigint", [(1,), (2,)])
    assert rows(P.anti_join(a, "k", b, "k")) == []
    assert rows(P.anti_join(a, "k", b, "k", canonical_form=False)) == [("1.0", 1), ("2.0", 1)]


def test_duplicates_count_null_keys(spark):
    t = declared(spark, "a string, b bigint", [("x", 1), ("x", 1), (None, 1), (None, 1), ("y", 1)])
    assert rows(P.duplicate(t, ["a", "b"])) == [("x", 1, 2), (None, 1, 2)]
    assert rows(P.duplicate(t.filter("a = 'y'"), ["a"])) == []
    assert rows(P.duplicate(t, ["a"], long_text=True)) == [("x", 2), (None, 2)]
    with pytest.raises(ValueError):
        P.duplicate(t, ["b"], long_text=True)


def test_coverage_verdicts(spark):
    v = harbour(spark)
    for expected, verdict, missing in ((["ebb", "flood"], "pass", 0), (["ebb", "storm"], "inconclusive", 1), (["storm"], "fail", 1)):
        got = outcome(v, "coverage", table="calls", unit_column="tide", expected=expected)
        assert (got["verdict"], got["exception_count"], got["population"]) == (verdict, missing, len(expected))
    with pytest.raises(ValueError):
        P.coverage(v["calls"], "tide", [])


def test_cardinality(spark):
    v = harbour(spark)
    good = {"child": "berths", "child_column": "berth", "parent": "berths", "parent_column": "berth"}
    assert outcome(v, "cardinality", **good)["verdict"] == "pass"
    bad = outcome(v, "cardinality", child="calls", child_column="moored", parent="berths", parent_column="berth")
    assert (bad["verdict"], bad["exception_count"], bad["exception_samples"]) == ("fail", 0, [])
    assert outcome(v, "cardinality", {"cardinality": {"min_containment": 0.5}}, child="calls", child_column="moored", parent="berths",
                   parent_column="berth")["verdict"] == "pass"
    stats = P.cardinality(v["calls"], "moored", v["berths"], "berth").first()
    assert tuple(stats) == (3, 7, 7, 2)
    nothing = declared(spark, "x bigint", [])
    assert tuple(P.cardinality(nothing, "x", nothing, "x").first()) == (0, 0, 0, 0)
    assert outcome({"e": nothing}, "cardinality", child="e", child_column="x", parent="e", parent_column="x")["verdict"] == "fail"


def test_contradictions_are_null_safe_and_counted(spark):
    left = declared(spark, "k bigint, a string", [(1, "x"), (1, "x"), (2, None), (3, "z"), (4, None)])
    right = declared(spark, "k double, a string", [(1.0, "y"), (1.0, "y"), (2.0, None), (3.0, "z"), (4.0, "w")])
    assert rows(P.attribute_contradiction(left, right, "k", "k", "a", "a")) == [("1", "x", "y", 4), ("4", None, "w", 1)]


def test_reconciliation_tolerance_and_missing_sides(spark):
    left = declared(spark, "grp string, amount double", [("a", 100.0), ("b", 5.0), (None, 1.0)])
    right = declared(spark, "grp string, amount double", [("a", 60.0), ("c", 7.0), (None, 1.0)])
    found = P.reconciliation(left, right, '"grp"', '"grp"', '"amount"', '"amount"')
    assert rows(found) == [("a", 100.0, 60.0, 40.0), ("b", 5.0, None, 5.0), ("c", None, 7.0, -7.0), (None, 1.0, None, 1.0), (None, None, 1.0, -1.0)]
    views = {"l": left.filter("grp = 'a'"), "r": right.filter("grp = 'a'")}
    args = dict(left="l", right="r", left_group_expr='"grp"', right_group_expr='"grp"', left_measure_expr='"amount"', right_measure_expr='"amount"')
    assert outcome(views, "reconciliation", **args)["verdict"] == "fail"
    assert outcome(views, "reconciliation", {"reconciliation": 50}, **args)["verdict"] == "pass"
    assert outcome(views, "reconciliation", left_where="\"grp\" <> 'a'", right_where="\"grp\" <> 'a'", **args)["verdict"] == "pass"


@pytest.mark.parametrize("wide_key", [0, 3, 64])
def test_overlapping_validity_against_brute_force(spark, wide_key):
    rng = random.Random(wide_key)
    start = date(2024, 1, 1)
    data = []
    for _ in range(120):
        vf = start + timedelta(days=rng.randint(0, 90))
        data.append(("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}", vf, None if rng.random() < 0.1 else vf + timedelta(days=rng.randint(-1, 15))))
    table = declared(spark, "k string, vf date, vt date", data)
    closed = [(k, vf, vt or date(9999, 12, 31)) for k, vf, vt in data]
    want: dict = {}
    for ka, fa, ta in closed:
        for kb, fb, tb in closed:
            if ka == kb and (fa < fb or (fa == fb and ta < tb)) and ta >= fb:
                want[(ka, fa, ta, fb, tb)] = want.get((ka, fa, ta, fb, tb), 0) + 1
    got = {tuple(r)[:5]: r["occurrences"] for r in P.validity_join(table, "k", "vf", "vt", wide_key=wide_key).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_pairs_are_counted_without_forming_them(spark, seed):
    rng = random.Random(seed)
    start = date(2024, 1, 1)
    spans = []
    for _ in range(150):
        vf = start + timedelta(days=rng.randint(0, 60))
        spans.append(("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 30)}", vf, None if rng.random() < 0.1 else vf + timedelta(days=rng.randint(-2, 20))))
    table = declared(spark, "k string, vf date, vt date", spans)
    pairs = P.validity_join(table, "k", "vf", "vt").collect()
    total: dict = {}
    for r in pairs:
        total[r["key"]] = total.get(r["key"], 0) + r["occurrences"]
    assert {r["key"]: int(r["overlaps"]) for r in P.validity_overlap_counts(table, "k", "vf", "vt").collect()} == total
    check = build_check({"t": table}, Probe("p", "validity_join", {"table": "t", "key_column": "k", "valid_from": "vf", "valid_to": "vt"}))
    assert [tuple(r) for r in check.first().collect()] == sorted(map(tuple, pairs))[:20]
    side = lambda: [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", rng.choice([None, "a", "b", "c", "d"])) for _ in range(60)]
    views = {n: declared(spark, "k string, a string", side()) for n in ("l", "r")}
    args = (views["l"], views["r"], "k", "k", "a", "a")
    pairs = P.attribute_contradiction(*args).collect()
    total = {}
    for r in pairs:
        total[r["key"]] = total.get(r["key"], 0) + r["occurrences"]
    assert {r["key"]: int(r["contradictions"]) for r in P.contradiction_counts(*args).collect()} == total
    check = build_check(views, Probe("p", "attribute_contradiction", {"left": "l", "right": "r", "left_key": "k", "right_key": "k", "left_attr": "a", "right_attr": "a"}))
    order = lambda r: (r[0], r[1] is not None, r[1] or "", r[2] is not None, r[2] or "")
    assert [tuple(r) for r in check.first().collect()] == sorted(map(tuple, pairs), key=order)[:20]
    assert check.counted().first()[0] == sum(total.values())


def test_identical_and_touching_intervals(spark):
    d = date
    t = declared(spark, "k bigint, vf date, vt date", [(1, d(2024, 1, 1), d(2024, 1, 31)), (1, d(2024, 1, 1), d(2024, 1, 31)), (2, d(2024, 1, 1), d(2024, 1, 31)), (2, d(2024, 1, 31), None), (3, d(2024, 1, 1), d(2024, 1, 30)), (3, d(2024, 1, 31), None)])
    assert [r["key"] for r in P.validity_join(t, "k", "vf", "vt").collect()] == ["2"]


def test_ranges_against_brute_force(spark):
    rng = random.Random(5)
    ranges = [(a, a + rng.randint(-1, 5000)) for a in (rng.randint(-2000, 20000) for _ in range(40))] + [(10, 20), (10, 20)]
    values = [str(rng.randint(-3000, 25000)) for _ in range(300)] + ["x", " ", None, "12.5"]
    found = P.range_join(declared(spark, "v string", [(v,) for v in values]), "v", declared(spark, "lo bigint, hi bigint", ranges), "lo", "hi")
    number = lambda v: 13 if v == "12.5" else int(v) if v.lstrip("-").isdigit() else None
    want = []
    for v in {v for v in values if v and v.strip()}:
        n = 0 if number(v) is None else sum(lo <= number(v) <= hi for lo, hi in ranges)
        if n != 1:
            want.append((v, n))
    assert rows(found) == sorted(want)


def test_range_bounds_may_be_fractions_and_no_ranges_match_nothing(spark):
    values = declared(spark, "v bigint", [(1,), (2,), (3,)])
    assert rows(P.range_join(values, "v", declared(spark, "lo double, hi double", [(1.5, 2.5), (2.9, 9.0)]), "lo", "hi")) == [("1", 0)]
    assert len(rows(P.range_join(values, "v", declared(spark, "lo bigint, hi bigint", []), "lo", "hi"))) == 3


def test_decode_reports_ambiguous_codes(spark):
    items = declared(spark, "id string, code string", [("a", "1 x"), ("b", "1 y"), ("c", "2 x")])
    levels = declared(spark, "id string, l1 string, l2 string", [("a", "A", "X"), ("b", "B", "Y"), ("c", "C", "X")])
    pairs = [{"part_expr": "split_part(e.\"code\", ' ', 1)", "decode_column": "l1"}, {"part_expr": "split_part(e.code, ' ', 2)", "decode_column": "l2"}]
    assert rows(P.decode(items, levels, "id", pairs)) == [("l1", "1", 2)]


def test_balance_and_control_accounts(spark):
    journal = declared(spark, "doc string, account bigint, amount string", [("d1", 1200, "10"), ("d1", 4100, "-10"), ("d2", 1200, "5.5")])
    assert rows(P.balance(journal, "amount", '"doc"')) == [("d2", 5.5)]
    items = declared(spark, "amount double", [(15.0,)])
    assert rows(P.subledger_equals_gl(items, "amount", journal, "amount", "account", ["1200"])) == [(15.0, 15.5, -0.5)]
    assert rows(P.subledger_equals_gl(items, "amount", journal, "amount", "account", [1200], tolerance=1.0)) == []
    with pytest.raises(ValueError):
        P.subledger_equals_gl(items, "amount", journal, "amount", "account", ["12x"])
    with pytest.raises(PySparkException):
        P.balance(declared(spark, "doc string, amount string", [("d", "n/a")]), "amount", '"doc"').collect()


def test_symmetry_counts_legs(spark):
    left = declared(spark, "p string", [("2024-01",), ("2024-01",), ("2024-02",)])
    right = declared(spark, "p string", [("2024-01",), ("2024-02",), ("2024-03",)])
    assert rows(P.ic_symmetry(left, right, "p", "p")) == [("2024-01", 2, 1), ("2024-03", 0, 1)]


def test_empty_tables_pass_vacuously_with_population_zero(spark):
    got = outcome({"e": declared(spark, "x bigint", [])}, "duplicate", table="e", key_columns=["x"])
    assert (got["verdict"], got["population"]) == ("pass", 0)


def test_unknown_names_are_refused(spark):
    v = harbour(spark)
    for template, params in [("nope", {}), ("duplicate", {"table": "nope", "key_columns": ["x"]}), ("duplicate", {"table": 'a"b', "key_columns": ["x"]}),
                             ("anti_join", {"child": "calls", "child_column": "zz", "parent": "berths", "parent_column": "berth"})]:
        with pytest.raises(ValueError):
            build_check(v, Probe("p", template, params))


def test_evidence_carries_bounded_samples_counts_and_fingerprints(spark, folder):
    big = declared(spark, "ref string", [(f"{i:03d}",) for i in range(50)])
    views = {"child": big, "parent": declared(spark, "id string", [("x",)])}
    probe = Probe("p", "anti_join", {"child": "child", "child_column": "ref", "parent": "parent", "parent_column": "id"}, claim_id="c")
    row = run_probes(views, [probe], sink=str(folder / "sink"), run_id="r").first()
    assert (row["population"], row["exception_count"], row["verdict"]) == (50, 50, "fail")
    assert [s["value"] for s in row["exception_samples"]] == [f"{i:03d}" for i in range(20)]
    assert set(row["source_fingerprints"]) == {"child", "parent"} and row["source_fingerprints"]["child"].startswith("50|")
    stored = spark.read.parquet(row["result_ref"])
    assert stored.count() == 50 and {f.dataType.simpleString() for f in stored.schema} == {"string"}


def test_exceptions_never_exceed_the_population(spark):
    one = declared(spark, "k bigint, a string", [(1, "x")])
    many = declared(spark, "k bigint, a string", [(1, f"y{i}") for i in range(5)])
    got = outcome({"l": one, "r": many}, "attribute_contradiction", left="l", right="r", left_key="k", right_key="k", left_attr="a", right_attr="a")
    assert (got["population"], got["exception_count"], int(got["exceptions_found"]), len(got["exception_samples"])) == (1, 1, 5, 5)


def test_evidence_keeps_the_full_set_and_how_it_was_made(spark):
    views = {"ledger": declared(spark, "k string, amount decimal(18,2)", [(f"k{i:02d}", 1 + i) for i in range(30)] + [("even", 5), ("even", -5)])}
    probe = Probe("p", "balance", {"journal": "ledger", "group_column": "k", "amount": "amount"})
    row = run_probes(views, [probe], {"balance": 2}).first()
    assert spark.read.parquet(row["result_ref"]).count() == row["exception_count"] == 28 and len(row["exception_samples"]) == 20
    assert row["exception_samples"][0]["grp"] == "k29"
    assert row["payload"]["params"] == '{"amount": "amount", "group_column": "k", "journal": "ledger"}'
    assert row["payload"]["tolerances"] == '{"absolute": 2}' and row["payload"]["exceptions_found"] == "28"


def test_questions_are_drafted_once_for_results_that_did_not_pass(spark):
    v = harbour(spark)
    bad = {"child": "calls", "child_column": "moored", "parent": "berths", "parent_column": "berth"}
    probes = [Probe("a", "anti_join", bad, claim_id="c1"), Probe("b", "anti_join", bad, claim_id="c2"), Probe("c", "cardinality", bad),
              Probe("d", "duplicate", {"table": "berths", "key_columns": ["berth"]})]
    evidence = run_probes(v, probes)
    drafts = draft_questions(evidence, probes).collect()
    assert [r["question"] for r in drafts] == [question_text("anti_join", bad)]
    assert draft_questions(evidence, probes, stored=draft_questions(evidence, probes)).count() == 0


def test_decimal_amounts_are_summed_exactly(spark):
    cash = declared(spark, "k string, amount double", [("edge", 0.1), ("edge", 0.2), ("edge", -0.29), ("over", 0.02), ("even", 0.0)])
    views = {"cash": cash.select("k", F.col("amount").cast("decimal(18,2)").alias("amount"))}
    row = outcome(views, "balance", journal="cash", amount="amount", group_column="k")
    assert row["exceptions_found"] == 1 and [s["grp"] for s in row["exception_samples"]] == ["over"]
    edge = {"cash": views["cash"].filter("k = 'edge'"), "book": views["cash"].filter("k = 'even'").withColumn("account", F.lit(1))}
    row = outcome(edge, "subledger_equals_gl", subledger="cash", subledger_amount="amount", journal="book",
                  journal_amount="amount", account="account", accounts=[1])
    assert row["exceptions_found"] == 0


def test_tolerances_and_rates(spark):
    assert merged_tolerances("balance", None) == {"absolute": 0.01}
    assert merged_tolerances("balance", {"balance": 5}) == {"absolute": 5}
    assert merged_tolerances("cardinality", {"cardinality": {"min_uniqueness": 0.5}}) == {"min_containment": 0.95, "min_uniqueness": 0.5}
    df = declared(spark, "e bigint, p bigint", [(1, 4), (0, 0), (None, 3)])
    assert [r[0] for r in df.select(V.exception_rate(df.e, df.p)).collect()] == [0.25, None, None]
    assert len(TEMPLATES) == 13 and {n for n, t in TEMPLATES.items() if t.domain} == {"balance", "subledger_equals_gl", "ic_symmetry"}
