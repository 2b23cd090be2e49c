import itertools
import random

import pytest

from attest.evidence import claims as C
from attest.evidence import indexes as X
from attest.evidence import status as S
from attest.evidence import tables as T
from attest.functions.frames import declared
from tests.conftest import rows

DE = {"entity": "DE", "period": None, "segment": None}
NOWHERE = {"entity": None, "period": None, "segment": None}
KINDS = {
    "pass": ("probe_result", "probe", "pass", None, False), "fail": ("probe_result", "probe", "fail", None, False),
    "open": ("probe_result", "probe", "inconclusive", None, False), "stale fail": ("probe_result", "probe", "fail", None, True),
    "stale pass": ("probe_result", "probe", "pass", None, True), "said": ("testimonial", "human", None, None, False),
    "yes": ("confirmation", "human", None, NOWHERE, False), "yes DE": ("confirmation", "human", None, DE, False),
    "anchor": ("document_anchor", "ai", None, None, False), "declared": ("declaration", "system", None, None, False),
}
TRUTH = [
    ([], "inferred"), (["pass"], "tested"), (["fail"], "contradicted"), (["open"], "inferred"), (["pass", "fail"], "unresolved"),
    (["yes"], "business-confirmed"), (["yes", "pass"], "business-confirmed"), (["yes", "fail"], "unresolved"), (["said"], "inferred"),
    (["said", "fail"], "unresolved"), (["said", "yes"], "inferred"), (["said", "yes DE"], "business-confirmed"), (["said", "pass"], "tested"),
    (["anchor", "declared"], "inferred"), (["stale fail", "pass"], "tested"), (["stale pass", "fail"], "contradicted"), (["stale fail"], "inferred"),
    (["said", "yes", "pass"], "tested"), (["open", "pass"], "tested"), (["open", "fail"], "contradicted"),
]


def evidence_rows(spark, rows_):
    return declared(spark, f"id string, claim_id string, type string, actor string, verdict string, scope {T.SCOPE}, stale boolean", rows_)


def test_truth_table_in_every_order(spark):
    claims, records, want = [], [], {}
    for n, (kinds, status) in enumerate(TRUTH):
        for m, order in enumerate(itertools.permutations(kinds)):
            cid = f"c{n}x{m}"
            claims.append((cid,))
            want[cid] = status
            for i, kind in enumerate(order):
                type_, actor, verdict, scope, stale = KINDS[kind]
                records.append((f"{cid}e{i}", cid, type_, actor, verdict, scope, stale))
    random.Random(1).shuffle(records)
    got = S.resolve_status(declared(spark, "id string", claims), evidence_rows(spark, records))
    assert {r["id"]: r["status"] for r in got.collect()} == want


def test_only_attached_evidence_counts(spark):
    claims = declared(spark, "id string, evidence_ids array<string>", [("c1", ["e1", "e9"]), ("c2", []), ("c3", ["e1", "e2", "e2"])])
    records = evidence_rows(spark, [("e1", "zz", *KINDS["pass"]), ("e2", "c2", *KINDS["fail"])])
    got = S.resolve_status(claims, S.attached(records, S.attachments(claims)))
    assert rows(got.select("id", "status", "probe_fail")) == [("c1", "tested", 0), ("c2", "inferred", 0), ("c3", "unresolved", 1)]


def test_attaching_rejects_unscoped_confirmations_of_statements(spark):
    stored = evidence_rows(spark, [("e1", "c1", *KINDS["said"])])
    fresh = evidence_rows(spark, [("e2", "c1", *KINDS["yes"]), ("e3", "c1", *KINDS["yes DE"]), ("e4", "c2", *KINDS["yes"])])
    kept, rejected = S.attach_evidence(stored, fresh)
    assert [r[0] for r in rows(kept.select("id"))] == ["e1", "e3", "e4"] and [r[0] for r in rows(rejected.select("id"))] == ["e2"]


def test_staleness_reaches_claims_and_questions(spark):
    records = declared(spark, f"id string, claim_id string, type string, actor string, verdict string, scope {T.SCOPE}, stale boolean, source_fingerprints map<string,string>", [
        ("e1", "c1", *KINDS["pass"], {"a": "1", "b": "1"}), ("e2", "c2", *KINDS["pass"], {"a": "1"}), ("e3", "c3", *KINDS["fail"], {"gone": "1"})])
    now = declared(spark, "view string, fingerprint string", [("a", "1"), ("b", "2")])
    marked = S.mark_stale(records, now)
    assert {r["id"]: r["stale"] for r in marked.collect()} == {"e1": True, "e2": False, "e3": True}
    claims = declared(spark, "id string", [("c1",), ("c2",), ("c3",)])
    assert {r["id"]: r["status"] for r in S.resolve_status(claims, marked).collect()} == {"c1": "inferred", "c2": "tested", "c3": "inferred"}
    questions = declared(spark, "id string, claim_ids array<string>", [("q1", ["c2"]), ("q2", ["c2", "c3"])])
    assert rows(S.stale_questions(questions, marked)) == [("q2",)]


def levels(spark, names, edges):
    return dict(map(tuple, C.dependency_levels(declared(spark, "claim_id string", [(n,) for n in names]),
                                               declared(spark, "claim_id string, depends_on string", edges)).collect()))


def test_dependency_levels(spark):
    assert levels(spark, "abc", [("b", "a"), ("c", "b")]) == {"a": 0, "b": 1, "c": 2}
    assert levels(spark, "abcd", [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "a"), ("d", "a")]) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert levels(spark, "ab", []) == {"a": 0, "b": 0}
    assert levels(spark, "", []) == {}
    with pytest.raises(C.CycleError):
        levels(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")])
    with pytest.raises(C.CycleError):
        levels(spark, "a", [("a", "a")])
    with pytest.raises(KeyError):
        levels(spark, "a", [("a", "zz")])


def test_gate_needs_every_prerequisite(spark):
    edges = declared(spark, "claim_id string, depends_on string", [("x", "a"), ("x", "b"), ("y", "a"), ("z", "gone")])
    statuses = declared(spark, "id string, status string", [("a", "tested"), ("b", "contradicted"), ("x", "inferred")])
    assert rows(C.ready_for_probe(edges, statuses)) == [("x", False), ("y", True), ("z", False)]


CLAIM = f"id string, statement string, created_by string, predicate string, params string, scope {T.SCOPE}, validity {T.VALIDITY}, source_ids array<string>, created_at timestamp"


def rule(cid, statement="s", predicate="references", params='{"a": "1"}', scope=None, validity=None, sources=("s1", "s2")):
    return (cid, statement, "ai", predicate, params, scope, validity, list(sources), None)


def test_identity_is_the_rule_not_the_wording(spark):
    claims = C.with_key(declared(spark, CLAIM, [
        rule("a"), rule("b", statement="other words", sources=("s2", "s1")), rule("c", params='{"a": "2"}'), rule("d", scope=DE),
        rule("e", validity={"valid_from": "2024", "valid_to": None}), rule("f", predicate=None), rule("g", sources=("s1",))]))
    keys = {r["id"]: r["claim_key"] for r in claims.collect()}
    assert keys["a"] == keys["b"] and keys["f"] is None
    assert len({keys[c] for c in "acdeg"}) == 5
    import hashlib
    import json
    text = json.dumps({"predicate": "references", "params": {"a": "1"}, "scope": None, "validity": None, "sources": ["s1", "s2"]}, sort_keys=True, ensure_ascii=False)
    assert keys["a"] == hashlib.sha256(text.encode()).hexdigest()


def test_insertion_without_doubles(spark):
    stored = declared(spark, CLAIM, [rule("a")])
    fresh = declared(spark, CLAIM, [rule("b"), rule("c", params="{}"), rule("d", params="{}"), rule("e", predicate=None), rule("f", predicate=None)])
    assert [r[0] for r in rows(C.insert_claims(stored, fresh).select("id"))] == ["c", "e", "f"]


def test_new_claims_are_inferred_without_evidence(spark):
    got = C.new_claims(declared(spark, "id string, statement string, created_by string", [("a", "s", "human")])).first()
    assert (got["status"], got["evidence_ids"], got["source_ids"], got["predicate"]) == ("inferred", [], [], None)


def test_escalation_inherits_and_needs_attached_evidence(spark):
    parents = declared(spark, f"id string, evidence_ids array<string>, scope {T.SCOPE}, validity {T.VALIDITY}, source_ids array<string>", [("p", ["e1"], DE, None, ["s"])])
    evidence = declared(spark, "id string", [("e1",), ("e2",)])
    findings = declared(spark, f"evidence_id string, id string, statement string, created_by string, predicate string, params string, scope {T.SCOPE}, validity {T.VALIDITY}", [
        ("e1", "x", "s", "ai", None, None, None, None), ("e2", "y", "s", "ai", None, None, None, None)])
    got = C.escalate(parents, evidence, findings).collect()
    assert [(r["id"], r["derived_from"], r["derived_from_evidence"], r["scope"]["entity"], r["source_ids"], r["status"], r["evidence_ids"]) for r in got] == [
        ("x", "p", "e1", "DE", ["s"], "inferred", [])]


def test_evidence_is_append_only_and_valid(spark):
    stored = declared(spark, "id string", [("a",)])
    assert C.append_evidence(stored, declared(spark, "id string", [("b",)])).count() == 2
    for bad in ([("a",)], [("b",), ("b",)]):
        with pytest.raises(ValueError):
            C.append_evidence(stored, declared(spark, "id string", bad))
    schema = "id string, type string, actor string, verdict string, statement string, exception_samples array<map<string,string>>, population bigint, exception_count bigint"
    records = declared(spark, schema, [
        ("ok", "probe_result", "probe", "pass", None, [], 5, 5), ("e1", "probe_result", "ai", None, None, [], 5, 6), ("e2", "confirmation", "ai", "pass", None, [], None, None),
        ("e3", "testimonial", "human", None, "", [{"a": "b"}] * 21, None, None), ("bad id", "declaration", "system", None, None, [], None, None)])
    got = {}
    for r in C.evidence_violations(records).collect():
        got.setdefault(r["id"], set()).add(r["violation"])
    assert got == {"e1": {"probe_without_verdict", "probe_not_by_probe", "more_exceptions_than_rows"}, "e2": {"verdict_without_probe", "human_only"},
                   "e3": {"statement_missing", "too_many_samples"}, "bad id": {"malformed_id"}}


def test_every_dangling_edge_is_found(spark):
    claims = declared(spark, "id string, evidence_ids array<string>, depends_on array<string>, derived_from string, derived_from_evidence string, source_ids array<string>", [
        ("c1", ["e1", "e0"], ["c1", "c0"], "c0", "e0", ["s1", "s0"])])
    evidence = declared(spark, "id string, claim_id string, probe_id string", [("e1", "c0", "p0"), ("e2", "c1", "p1"), ("e3", None, None)])
    probes = declared(spark, "id string, claim_id string", [("p1", "c0"), ("p2", None)])
    questions = declared(spark, "id string, claim_ids array<string>", [("q1", ["c1", "c0"])])
    profiles = declared(spark, "id string, source_id string", [("f1", "s0"), ("f2", "s1")])
    sources = declared(spark, "id string", [("s1",)])
    got = C.dangling(claims, evidence, probes, questions, profiles, sources)
    assert {(r["owner"], r["edge"]) for r in got.collect()} == {
        ("claim", "evidence"), ("claim", "dependency"), ("claim", "parent"), ("claim", "origin evidence"), ("claim", "source"), ("evidence", "claim"),
        ("evidence", "probe"), ("probe", "claim"), ("question", "claim"), ("profile", "source")}
    assert got.count() == 10


def test_gap_load_ranks_unproven_claims(spark):
    resolved = declared(spark, "id string, status string", [("a", "inferred"), ("b", "tested"), ("c", "contradicted"), ("d", "business-confirmed")])
    links = C.questions_resting_on(declared(spark, "id string, claim_ids array<string>", [("q1", ["a", "b", "a"]), ("q2", ["a"])]))
    assert rows(C.gap_load(resolved, links)) == [("a", "inferred", 2), ("c", "contradicted", 0)]


def test_role_bindings_by_column(spark):
    claims = declared(spark, "id string, binding map<string,string>", [("a", {"table": "t", "column": "c"}), ("b", {"table": "t"}), ("c", None)])
    assert rows(X.role_bindings_by_column(claims)) == [("t.c", "a")]
    assert rows(X.profiles_by_source(declared(spark, "id string, source_id string", [("p", "s")]))) == [("s", "p")]
