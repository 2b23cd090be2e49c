from pyspark.sql import functions as F

from attest.evidence import audit as A
from attest.evidence import contracts
from attest.evidence import roles as R
from attest.evidence import rules
from attest.evidence.templates import TEMPLATES
from attest.functions.frames import declared
from tests.conftest import rows

ROLE = "role string, definition string, decided_by string"
CAND = "id string, role string, status string, binding map<string,string>"
EV = "claim_id string, type string, stale boolean, payload map<string,string>"


def questions(spark, decided_by, candidates, evidence=()):
    roles = declared(spark, ROLE, [("journal", "d", decided_by)])
    got = R.resolve_roles(roles, declared(spark, CAND, candidates), declared(spark, EV, evidence)).collect()
    return [r["question"] for r in got]


def test_lint_finds_roles_nothing_can_settle(spark):
    roles = declared(spark, ROLE, [("a", "", "balance"), ("b", "", "slot"), ("c", "", "fachfrage"), ("d", "", "duplicate"), ("e", "", "zz"), ("f", "", None)])
    assert rows(R.lint_roles(roles, "finance")) == [("d", "not_a_law_of_the_domain"), ("e", "no_such_template"), ("f", "no_such_template")]


def test_each_open_role_asks_its_question(spark):
    one = ("c1", "journal", "inferred", {"table": "t", "amount": "a"})
    two = ("c2", "journal", "contradicted", {"table": "u"})
    refused = ("c1", "declaration", False, {"decision": "unbindable"})
    probed = ("c2", "probe_result", False, None)
    assert questions(spark, "balance", [one], []) == []
    assert questions(spark, "balance", [one], [refused]) == [R.QUESTION_UNBOUND.format(role="journal")]
    assert questions(spark, "balance", [one, two], [refused]) == []
    assert questions(spark, "balance", [one, two], [refused, probed]) == [R.QUESTION_LOST.format(role="journal")]
    assert questions(spark, "balance", [("c1", "other", "inferred", {})], []) == [R.QUESTION_EMPTY.format(role="journal")]
    assert questions(spark, "balance", [], []) == []
    assert questions(spark, "fachfrage", [two, one]) == [R.QUESTION_CHOOSE.format(role="journal", options="amount=a, table=t | table=u")]
    assert questions(spark, "slot", [one]) == []
    assert questions(spark, "balance", [("c1", "journal", "tested", {})], [probed]) == []


def test_options_are_rows(spark):
    roles = declared(spark, ROLE, [("journal", "d", "fachfrage"), ("ledger", "d", "balance"), ("none", "d", "fachfrage")])
    many = [(f"c{i}", "journal", "inferred", {"table": f"t{i % 50:02}"}) for i in range(120)]
    others = [("x", "ledger", "inferred", {"table": "z"}), ("y", "journal", "inferred", None)]
    got = sorted(rows(R.role_options(roles, declared(spark, CAND, many + others))), key=lambda r: r[1])
    assert got == [("journal", i + 1, f"table=t{i:02}", 3 if i < 20 else 2) for i in range(50)]
    listed = questions(spark, "fachfrage", many)[0]
    assert " | ".join(r[2] for r in got) in listed


def test_questions_are_not_asked_twice(spark):
    roles = declared(spark, ROLE, [("journal", "d", "balance")])
    candidates, evidence = declared(spark, CAND, [("c1", "other", "inferred", {})]), declared(spark, EV, [])
    first = R.resolve_roles(roles, candidates, evidence)
    assert first.count() == 1 and R.resolve_roles(roles, candidates, evidence, stored=first).count() == 0


def test_elections(spark):
    candidates = declared(spark, CAND, [("b", "r1", "tested", {}), ("a", "r1", "contradicted", {}), ("c", "r1", "business-confirmed", {}), ("d", "r2", "inferred", {}),
                                        ("e", "r3", "unresolved", {}), ("f", "r4", "contradicted", {})])
    asked = declared(spark, "id string, claim_ids array<string>", [("q", ["e"])])
    probes = declared(spark, "id string, claim_id string", [("p", "f")])
    assert rows(R.role_elections(candidates, asked, probes)) == [("r1", 3, "elected", "b"), ("r2", 1, "in flight", None), ("r3", 1, "question", None), ("r4", 1, "lost", None)]
    winners = R.rank_candidates(candidates).filter("winner").select("role", "id")
    assert rows(winners) == [("r1", "b")]


PROFILES = "source_id string, table string, column string"


def profiles(spark):
    return declared(spark, PROFILES, [("s1", "orders", "id"), ("s1", "orders", "customer"), ("s2", "customers", "id")])


BIND = "id string, claim_id string, template string, params map<string,string>, no_template_reason string"


def binding_errors(spark, template, params, predicate="references", claim_type="claim", reason=None):
    claims = declared(spark, "id string, claim_type string, predicate string", [("c", claim_type, predicate)])
    got = rules.check_bindings(declared(spark, BIND, [("b", "c", template, params, reason)]), claims, profiles(spark))
    return {(r["error"], r["detail"]) for r in got.collect()}


GOOD = {"child": "orders", "parent": "customers", "child_column": "customer", "parent_column": "id"}


def test_bindings(spark):
    assert binding_errors(spark, "anti_join", GOOD) == set()
    assert binding_errors(spark, "anti_join", {**GOOD, "child_column": "orders.customer"}) == set()
    assert binding_errors(spark, "anti_join", {**GOOD, "child_column": "customers.id"}) == {("not_an_identifier", "child_column"), ("unknown_column", "orders.customers.id")}
    assert binding_errors(spark, "anti_join", {**GOOD, "child_column": "zz"}) == {("unknown_column", "orders.zz")}
    assert binding_errors(spark, "anti_join", {**GOOD, "child": "zz"}) == {("unknown_view", "zz")}
    assert binding_errors(spark, "anti_join", GOOD, predicate="unique_key") == {("template_not_admissible", "anti_join")}
    assert binding_errors(spark, None, {}, reason="no measure") == set()
    assert binding_errors(spark, None, {}) == {("reason_missing", None)}
    assert binding_errors(spark, "balance", {"journal": "orders", "amount": "id", "group_column": "id", "group_expr": "x"}, claim_type="role", predicate="role_binding") == {("exactly_one_of", "group_column, group_expr")}
    subledger = {"subledger": "orders", "subledger_amount": "id", "journal": "customers", "journal_amount": "id", "account": "id", "accounts": '["1200","x"]'}
    assert binding_errors(spark, "subledger_equals_gl", subledger, claim_type="role", predicate="role_binding") == {("not_an_account", "x")}


def test_probes_are_not_bound_twice(spark):
    claims = declared(spark, "id string, role string", [("c", "journal")])
    bindings = declared(spark, BIND, [("b", "c", "anti_join", {**GOOD, "child_column": " customer "}, None), ("n", "c", None, {}, "why")])
    probes = rules.bindings_to_probes(bindings, claims)
    row = probes.first()
    assert probes.count() == 1 and row["roles"] == ["journal"] and '"child_column": "customer"' in row["params"]
    assert rules.bindings_to_probes(bindings, claims, stored=probes).count() == 0


def test_params_are_canonical(spark):
    df = declared(spark, "p map<string,string>", [({"b": ' x ', "a": '["z"," y "]'},)])
    assert df.select(rules.params_json(rules.canonical_params(F.col("p")))).first()[0] == '{"a": ["y", "z"], "b": "x"}'


def test_labels_do_not_depend_on_ids(spark):
    schema = "id string, params string, predicate string, scope string, statement string, validity string"
    one = declared(spark, schema, [("x", "{}", "a", None, "s", None), ("y", "{}", "b", None, "s", None)])
    two = declared(spark, schema, [("2", "{}", "a", None, "s", None), ("1", "{}", "b", None, "s", None)])
    assert {r["label"]: r["predicate"] for r in rules.label_claims(one).collect()} == {r["label"]: r["predicate"] for r in rules.label_claims(two).collect()} == {"c1": "a", "c2": "b"}


def test_contracts_cover_the_registry():
    for template in TEMPLATES.values():
        known = {*template.required, *template.optional, *template.one_of}
        assert all(column in known and view in template.required for column, view in template.column_views)
        assert not set(template.required) & {*template.optional, *template.one_of}
    assert {t for templates, _, _ in contracts.PREDICATES.values() for t in templates} == set(TEMPLATES)
    assert set(contracts.ROLE_TEMPLATES) == {n for n, t in TEMPLATES.items() if t.domain == "finance"}
    assert rules.admissible_templates("claim", "references") == ("anti_join", "cardinality") and rules.admissible_templates("claim", None) == ()


def test_recall_needs_predicate_and_all_groups(spark):
    claims = declared(spark, "id string, predicate string, haystack string", [("a", "references", "Orders AND invoices"), ("b", "covers", "orders storno"), ("c", None, "legacy ids")])
    matchers = ([("r1", None, [["orders"], ["invoices", "bills"]]), ("r2", ["references"], [["storno"]]), ("r3", None, [["LEGACY"]])])
    assert rows(A.recall(claims, matchers)) == [("r1", True, "a"), ("r2", False, None), ("r3", True, "c")]


def test_false_promotions_and_stages(spark):
    resolved = declared(spark, "id string, created_by string, status string, by_probe bigint, probe_results bigint, predicate string", [
        ("a", "ai", "tested", 1, 1, "references"), ("b", "ai", "business-confirmed", 0, 0, "references"), ("c", "human", "business-confirmed", 0, 0, None), ("d", "ai", "inferred", 0, 0, "references")])
    assert [r[0] for r in rows(A.false_promotions(resolved).select("id"))] == ["b"]
    evidence = declared(spark, "id string, claim_id string, type string, probe_id string, payload map<string,string>, created_at string", [
        ("1", "a", "probe_result", "p", None, "1"), ("2", "b", "declaration", None, {"decision": "skipped"}, "1"), ("3", "b", "declaration", None, {"decision": "unbindable"}, "0"),
        ("4", "b", "declaration", None, {"rule": "x"}, "0")])
    staged = A.claim_stages(resolved, evidence, declared(spark, "id string, claim_id string", []), F.col("predicate").isNotNull())
    assert rows(staged.select("id", "stage", "executed")) == [("a", "bound", True), ("b", "unbindable", False), ("c", "semantic_only", False), ("d", "unbound", False)]


def test_untested_claims_have_a_headline_and_the_first_recorded_reason(spark):
    resolved = declared(spark, "id string, status string, probe_results bigint, probe_pass bigint, probe_fail bigint, confirmations bigint, testimonials bigint", [
        ("a", "tested", 1, 1, 0, 0, 0), ("b", "inferred", 0, 0, 0, 0, 2), ("c", "inferred", 0, 0, 0, 0, 0), ("d", "inferred", 1, 0, 0, 0, 0), ("e", "business-confirmed", 0, 0, 0, 1, 0)])
    evidence = declared(spark, "id string, claim_id string, type string, probe_id string, payload map<string,string>, created_at string", [
        ("1", "a", "probe_result", "p", None, "1"), ("2", "b", "declaration", None, {"decision": "skipped", "reason": "later"}, "2"),
        ("3", "b", "declaration", None, {"decision": "unbindable", "reason": "no key"}, "1"), ("4", "d", "probe_result", "p", None, "1"),
        ("5", "e", "declaration", None, {"decision": "skipped"}, "1")])
    staged = A.claim_stages(resolved, evidence, declared(spark, "id string, claim_id string", []), F.lit(True))
    told = {r["id"]: (r["no_probe_reason"], r["headline"]) for r in A.headlines(staged).collect()}
    assert told["a"] == ("", "At least one passing probe is live and no failing probe overrides it. Live trail: 1 passing probe result.")
    assert told["b"] == ("no key", "Never tested — unbindable — the model gave a reason.")
    assert told["c"] == ("", "Never tested — no probe, no recorded reason.")
    assert told["d"] == ("", "Nothing stronger than inferred evidence is live yet. Live trail: no live status-bearing evidence.")
    assert told["e"][0] == "" and told["e"][1].startswith("At least one admissible human confirmation")
