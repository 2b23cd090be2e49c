"""Sweeps: gating, containment, and a haulage yard whose claims have known statuses."""

from datetime import date

import pytest

from attest.evidence import tables as T
from attest.evidence.audit import false_promotions
from attest.evidence.status import resolve_status
from attest.evidence.tables import Probe
from attest.functions.frames import declared
from attest.plans.sweep import run_ready

CLAIM = "id string, created_by string, depends_on array<string>"


def no_evidence(spark):
    return declared(spark, T.EVIDENCE, [])


def sweep(spark, views, claims, probes, **options):
    table = declared(spark, CLAIM, claims)
    result = run_ready(views, table, no_evidence(spark), probes, **options)
    resolved = resolve_status(table, result.evidence)
    return result, {r["id"]: r["status"] for r in resolved.collect()}, resolved


def numbers(spark):
    return {"one": declared(spark, "k bigint, t string", [(1, "a"), (2, "b")]), "two": declared(spark, "k bigint, t string", [(1, "1"), (1, "x")])}


PASS = {"table": "one", "key_columns": ["k"]}
FAIL = {"table": "two", "key_columns": ["k"]}


def test_prerequisites_gate_within_one_sweep(spark):
    claims = [("base", "ai", []), ("on_base", "ai", ["base"]), ("bad", "ai", []), ("on_bad", "ai", ["bad", "base"]), ("deep", "ai", ["on_base"])]
    probes = [Probe("p5", "duplicate", PASS, "deep"), Probe("p4", "duplicate", PASS, "on_bad"), Probe("p2", "duplicate", PASS, "on_base"),
              Probe("p1", "duplicate", PASS, "base"), Probe("p3", "duplicate", FAIL, "bad"), Probe("p0", "duplicate", FAIL), Probe("p6", "duplicate", PASS, "nobody")]
    result, status, _ = sweep(spark, numbers(spark), claims, probes)
    assert status == {"base": "tested", "on_base": "tested", "bad": "contradicted", "on_bad": "inferred", "deep": "tested"}
    assert sorted(result.skipped) == [("p4", "prerequisites not tested yet"), ("p6", "unknown claim nobody")]
    assert result.evidence.filter("claim_id IS NULL").count() == 1 and result.evidence.count() == 5


def test_a_failing_check_is_contained(spark):
    claims = [("a", "ai", []), ("b", "ai", []), ("c", "ai", [])]
    probes = [Probe("p1", "duplicate", PASS, "a"), Probe("p2", "balance", {"journal": "two", "amount": "t", "group_column": "k"}, "b"),
              Probe("p3", "duplicate", {"table": "gone", "key_columns": ["k"]}, "c")]
    result, status, _ = sweep(spark, numbers(spark), claims, probes)
    assert status == {"a": "tested", "b": "inferred", "c": "inferred"}
    assert sorted(p for p, _ in result.skipped) == ["p2", "p3"] and all(r.startswith("execution error") for _, r in result.skipped)
    assert result.evidence.count() == 1


def test_many_rows_give_one_small_record(spark, folder):
    views = {"child": spark.range(100_000).selectExpr("CAST(id AS STRING) AS ref"), "parent": spark.range(1).selectExpr("'x' AS id")}
    probe = Probe("p", "anti_join", {"child": "child", "child_column": "ref", "parent": "parent", "parent_column": "id"}, "c")
    result, status, _ = sweep(spark, views, [("c", "ai", [])], [probe], sink=str(folder / "sink"))
    row = result.evidence.first()
    assert status == {"c": "contradicted"} and result.evidence.count() == 1
    assert (row["population"], row["exception_count"], len(row["exception_samples"])) == (100_000, 100_000, 20)
    assert spark.read.parquet(row["result_ref"]).count() == 100_000


DAYS = [f"2023-05-{k:02d}" for k in range(1, 11)]


def yard(spark):
    """A haulage yard: trucks, trips, receipts, sensors, a cash book, and what goes wrong in them."""
    d, table = date, lambda schema, data: declared(spark, schema, data)
    trips = [(k, f"KX {k % 4}", DAYS[k % 10], 12.5 * k, "north" if k % 4 < 2 else "south") for k in range(1, 41)]
    cash = [(f"V{k}", amount, 70 if amount > 0 else 80) for k in range(1, 13) for amount in (20.0 + k, -20.0 - k)]
    return {
        "trucks": table("plate string, depot string, axles bigint", [(f"KX {k}", "north" if k < 2 else "south", 2 + k) for k in range(6)]),
        "trips": table("trip_no bigint, plate string, day string, km double, depot string", trips),
        "receipts": table("receipt string, trip double, litres double, pump string", [
            (f"R{k}", float(k), 3.0 * k, "P1") for k in range(1, 31)] + [("R7", 8.0, 1.0, "P2")]),
        "tolls": table("trip_no string, fee double", [(str(k), 4.0) for k in range(30, 44)]),
        "distances": table("day string, km double", [(day, sum(t[3] for t in trips if t[2] == day) + (9.0 if day == DAYS[4] else 0.0)) for day in DAYS]),
        "seats": table("driver bigint, since date, until date", [(5, d(2023, 1, 1), d(2023, 4, 30)), (5, d(2023, 5, 1), None), (6, d(2023, 2, 1), None)]),
        "leases": table("driver bigint, since date, until date", [(5, d(2023, 1, 1), d(2023, 6, 30)), (5, d(2023, 6, 1), None)]),
        "sensors": table("sensor string, tag string", [(f"S{k}", f"{'AB'[k % 2]}-{k % 3}") for k in range(9)]),
        "tags": table("sensor string, line string, slot string", [(f"S{k}", "AB"[k % 2], str(k % 3)) for k in range(9)]),
        "readings": table("sensor string, degrees bigint", [(f"S{k}", 7 * k) for k in range(9)] + [("S0", 990)]),
        "bands": table("low bigint, high bigint", [(0, 19), (20, 39), (40, 59)]),
        "cash": table("voucher string, amount double, account bigint", cash),
        "petty": table("voucher string, amount double", [("P1", 3.0), ("P1", -3.0), ("P2", 8.0)]),
        "till": table("amount double", [(sum(a for _, a, kind in cash if kind == 70) - 0.5,)]),
        "gate_in": table("day string", [(day,) for day in DAYS]),
        "gate_out": table("day string", [(day,) for day in DAYS[:-2]]),
    }


def joined(child, column, parent, key, **more):
    return ("anti_join", {"child": child, "child_column": column, "parent": parent, "parent_column": key, **more})


def shape(child, column, parent, key):
    return ("cardinality", {"child": child, "child_column": column, "parent": parent, "parent_column": key})


def steady(table):
    return ("validity_join", {"table": table, "key_column": "driver", "valid_from": "since", "valid_to": "until"})


def bands(where):
    return ("range_join", {"table": "readings", "value_column": "degrees", "ranges": "bands", "range_from": "low", "range_to": "high", "where": where})


def alike(left, right):
    return ("attribute_contradiction", {"left": left, "right": right, "left_key": "plate", "right_key": "plate", "left_attr": "depot", "right_attr": "depot"})


def days(table, expected):
    return ("coverage", {"table": table, "unit_column": "day", "expected": expected})


SCENARIO = {
    "a receipt belongs to a trip": ("tested", [joined("receipts", "trip", "trips", "trip_no")]),
    "a receipt spells its trip": ("contradicted", [joined("receipts", "trip", "trips", "trip_no", canonical=False)]),
    "a toll belongs to a trip": ("contradicted", [joined("tolls", "trip_no", "trips", "trip_no")]),
    "every truck drives": ("inferred", [joined("trucks", "plate", "trips", "plate", expectation="report")]),
    "every trip uses a known truck": ("tested", [joined("trips", "plate", "trucks", "plate", expectation="empty"), shape("trips", "plate", "trucks", "plate")]),
    "tolls follow distance": ("contradicted", [shape("tolls", "fee", "trips", "km")]),
    "a trip number is given once": ("tested", [("grain", {"table": "trips", "key_columns": ["trip_no"]})]),
    "a receipt number is given once": ("contradicted", [("duplicate", {"table": "receipts", "key_columns": ["receipt"]})]),
    "there are trips on all days": ("tested", [days("trips", DAYS)]),
    "trips fill a longer plan": ("inferred", [days("trips", [*DAYS, "2023-05-11", "2023-05-12", "2023-05-13"])]),
    "distances are there and agree": ("unresolved", [days("distances", DAYS), ("reconciliation", {
        "left": "distances", "right": "trips", "left_group_expr": '"day"', "right_group_expr": '"day"',
        "left_measure_expr": '"km"', "right_measure_expr": '"km"'})]),
    "distances agree but for one day": ("tested", [("reconciliation", {
        "left": "distances", "right": "trips", "left_group_expr": '"day"', "right_group_expr": '"day"', "left_measure_expr": '"km"',
        "right_measure_expr": '"km"', "left_where": f"\"day\" <> '{DAYS[4]}'", "right_where": f"\"day\" <> '{DAYS[4]}'"})]),
    "a driver has one seat": ("tested", [steady("seats")]),
    "a driver has one lease": ("contradicted", [steady("leases")]),
    "degrees fall into a band": ("contradicted", [bands(None)]),
    "plausible degrees fall into a band": ("tested", [bands('"degrees" < 900')]),
    "tags name line and slot": ("tested", [("decode", {"encoded": "sensors", "decode": "tags", "key": "sensor", "column": "tag", "pairs": [
        {"part_expr": "split_part(e.\"tag\", '-', 1)", "decode_column": "line"}, {"part_expr": "split_part(e.\"tag\", '-', 2)", "decode_column": "slot"}]})]),
    "a truck has one depot": ("tested", [alike("trucks", "trips")]),
    "vouchers balance": ("tested", [("balance", {"journal": "cash", "amount": "amount", "group_column": "voucher"})]),
    "petty cash balances": ("contradicted", [("balance", {"journal": "petty", "amount": "amount", "group_expr": '"voucher"'})]),
    "the till is in the cash book": ("tested", [("subledger_equals_gl", {"subledger": "till", "subledger_amount": "amount", "journal": "cash",
                                                                         "journal_amount": "amount", "account": "account", "accounts": [70]})]),
    "what comes in goes out": ("contradicted", [("ic_symmetry", {"left": "gate_in", "right": "gate_out", "left_period": "day", "right_period": "day"})]),
}


@pytest.mark.parametrize("part", [0, 1])
def test_yard(spark, part):
    chosen = dict(list(SCENARIO.items())[part::2])
    probes = [Probe(f"{name}/{i}", template, params, name) for name, (_, checks) in chosen.items() for i, (template, params) in enumerate(checks)]
    result, status, resolved = sweep(spark, yard(spark), [(name, "ai", []) for name in chosen], probes,
                                     tolerances={"subledger_equals_gl": {"absolute": 1}})
    assert result.skipped == []
    assert status == {name: want for name, (want, _) in chosen.items()}
    assert false_promotions(resolved).count() == 0
    if "petty cash balances" in chosen:
        row = result.evidence.filter("claim_id = 'petty cash balances'").first()
        assert row["exception_count"] == 1 and row["exception_samples"] == [{"grp": "P2", "balance": "8.0"}]
    if "trips fill a longer plan" in chosen:
        assert result.evidence.filter("claim_id = 'trips fill a longer plan'").first()["exception_count"] == 3
