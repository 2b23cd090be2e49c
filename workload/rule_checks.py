"""Validation of proposed rules and bindings; one proposal per part, checked against the profiled test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.evidence import rules as R
from attest.functions.canonical import is_comparable
from attest.functions.frames import declared
from workload.base import TABLES, query, table
from workload.bookkeeping import claims, evidence, mapped, probes, resolved, CL, EV, PR, RESOLVED, DECISION_OF, case


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(f"src_{t}", t, f.name) for t in TABLES for f in table(spark, sf, t).schema.fields if is_comparable(f.dataType)]
    return declared(spark, "source_id string, table string, column string", rows)


IX = "ix AS (SELECT 'src_' || table_name AS source_id, table_name AS v, column_name AS c, table_name || '.' || column_name AS k " \
     "FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ") AND data_type NOT LIKE '%[]')"

KIND = {"ECONOMY": "rule", "STANDARD": "rule", "MEDIUM": "rule", "LARGE": "concept", "PROMO": "rule", "SMALL": "guess"}
PREDICATE = {"ECONOMY": "references", "STANDARD": "references", "MEDIUM": "unique_key", "LARGE": "concept_definition",
             "PROMO": "concept_definition", "SMALL": "frobnicates"}


def _map(**cells) -> Column:
    return F.create_map(*[x for k, v in cells.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_type")
    params = (
        F.when(kind == "ECONOMY", _map(child=" orders.o_custkey", parent="customer.c_custkey"))
        .when(kind == "STANDARD", _map(child=F.concat(F.lit("orders.o_"), F.col("p_size").cast("string"))))
        .when(kind == "MEDIUM", _map(table="part", key_columns='["p_name","p_brand"]', extra="x"))
        .when(kind == "LARGE", _map(term=F.col("p_name")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    columns = F.when(kind == "ECONOMY", F.array(F.lit("orders.o_custkey"))).when(
        kind == "MEDIUM", F.array(F.lit("part.p_name"), F.lit("part.nope")))
    return table(spark, sf, "part").select(
        F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("id"), mapped(kind, KIND).alias("kind"),
        F.concat(F.lit("about "), "p_name").alias("statement"), mapped(kind, PREDICATE).alias("predicate"),
        params.alias("params"), columns.alias("columns"), F.when(kind == "LARGE", F.col("p_name")).alias("term"),
        F.when(F.col("p_size") <= 25, F.col("p_brand")).alias("definition"))


@query("hypothesis_errors", """
    SELECT 'H' || p_partkey AS id, 'missing_param' AS error, 'parent' AS detail FROM part WHERE p_type = 'STANDARD'
    UNION ALL SELECT 'H' || p_partkey, 'unknown_reference', 'orders.o_' || p_size FROM part WHERE p_type = 'STANDARD'
    UNION ALL SELECT 'H' || p_partkey, 'not_grounded', NULL FROM part WHERE p_type IN ('STANDARD', 'PROMO')
    UNION ALL SELECT 'H' || p_partkey, 'param_not_allowed', 'extra' FROM part WHERE p_type = 'MEDIUM'
    UNION ALL SELECT 'H' || p_partkey, 'column_not_profiled', 'part.nope' FROM part WHERE p_type = 'MEDIUM'
    UNION ALL SELECT 'H' || p_partkey, 'unknown_reference', 'part.nope' FROM part WHERE p_type = 'MEDIUM'
    UNION ALL SELECT 'H' || p_partkey, 'concept_without_definition', p_name FROM part WHERE p_type = 'LARGE' AND p_size > 25
    UNION ALL SELECT 'H' || p_partkey, 'kind_does_not_fit_predicate', 'rule' FROM part WHERE p_type = 'PROMO'
    UNION ALL SELECT 'H' || p_partkey, 'unknown_predicate', 'frobnicates' FROM part WHERE p_type = 'SMALL'
    UNION ALL SELECT 'H' || p_partkey, 'unknown_kind', 'guess' FROM part WHERE p_type = 'SMALL'""")
def hypothesis_errors(spark: SparkSession, sf: str) -> DataFrame:
    return R.check_hypotheses(hypotheses(spark, sf), profiles(spark, sf))


@query("accepted_claims", """
    SELECT 'H' || p_partkey AS id, 'about ' || p_name AS statement, 'ai' AS created_by, 'inferred' AS status, p_type = 'LARGE' AS concept,
      CASE p_type WHEN 'ECONOMY' THEN '{"child": "orders.o_custkey", "parent": "customer.c_custkey"}' ELSE '{"term": "' || p_name || '"}' END AS params,
      CASE p_type WHEN 'ECONOMY' THEN 'src_customer,src_orders' ELSE '' END AS sources
    FROM part WHERE p_type = 'ECONOMY' OR (p_type = 'LARGE' AND p_size <= 25)""")
def accepted_claims(spark: SparkSession, sf: str) -> DataFrame:
    known = profiles(spark, sf)
    proposed = hypotheses(spark, sf)
    accepted = proposed.join(R.check_hypotheses(proposed, known).select("id"), "id", "left_anti")
    return R.hypotheses_to_claims(accepted, known).select(
        "id", "statement", "created_by", "status", (F.col("claim_type") == "concept").alias("concept"), "params",
        F.array_join("source_ids", ",").alias("sources"))


def bindings(spark: SparkSession, sf: str) -> DataFrame:
    kind, wide = F.col("p_type"), F.col("p_size") > 25
    none = F.create_map().cast("map<string,string>")
    params = (
        F.when(kind == "ECONOMY", _map(child="orders", parent="customer", child_column="orders.o_custkey", parent_column="c_custkey"))
        .when((kind == "MEDIUM") & ~wide, _map(table="part", key_columns="p_name"))
        .when(kind == "MEDIUM", _map(table="nowhere", key_columns='["p_name","p_brand"]'))
        .when((kind == "PROMO") & ~wide, _map(journal="lineitem", amount="l extended"))
        .when(kind == "PROMO", _map(journal="lineitem", amount="l_tax", group_expr="sum(l_tax)"))
        .otherwise(none)
    )
    template = (
        F.when(kind == "ECONOMY", F.when(wide, "duplicate").otherwise("anti_join"))
        .when(kind == "MEDIUM", "grain").when(kind == "PROMO", "balance").when(kind == "SMALL", "nope").when(kind == "STANDARD", "grain")
    )
    return table(spark, sf, "part").select(
        F.concat(F.lit("B"), F.col("p_partkey").cast("string")).alias("id"),
        F.concat(F.when(kind == "STANDARD", "H-").otherwise("H"), F.col("p_partkey").cast("string")).alias("claim_id"),
        template.alias("template"), params.alias("params"),
        F.when((kind == "SMALL") | ((kind == "LARGE") & ~wide), "because").alias("no_template_reason"))


def bound_claims(spark: SparkSession, sf: str) -> DataFrame:
    return hypotheses(spark, sf).select("id", F.lit("claim").alias("claim_type"), "predicate", F.lit(None).cast("string").alias("role"))


@query("binding_errors", """
    WITH b AS (SELECT 'B' || p_partkey AS id, p_partkey AS k, p_type AS t, p_size > 25 AS wide FROM part)
    SELECT id, 'unknown_claim' AS error, 'H-' || k AS detail FROM b WHERE t = 'STANDARD'
    UNION ALL SELECT id, 'template_not_admissible', 'duplicate' FROM b WHERE t = 'ECONOMY' AND wide
    UNION ALL SELECT id, 'missing_param', unnest(['table', 'key_columns']) FROM b WHERE t = 'ECONOMY' AND wide
    UNION ALL SELECT id, 'unknown_param', unnest(['child', 'parent', 'child_column', 'parent_column']) FROM b WHERE t = 'ECONOMY' AND wide
    UNION ALL SELECT id, 'not_a_list', 'key_columns' FROM b WHERE t = 'MEDIUM' AND NOT wide
    UNION ALL SELECT id, 'unknown_view', 'nowhere' FROM b WHERE t = 'MEDIUM' AND wide
    UNION ALL SELECT id, 'reason_missing', NULL FROM b WHERE t = 'LARGE' AND wide
    UNION ALL SELECT id, 'template_not_admissible', 'balance' FROM b WHERE t = 'PROMO'
    UNION ALL SELECT id, 'exactly_one_of', 'group_column, group_expr' FROM b WHERE t = 'PROMO' AND NOT wide
    UNION ALL SELECT id, 'not_an_identifier', 'amount' FROM b WHERE t = 'PROMO' AND NOT wide
    UNION ALL SELECT id, 'unknown_column', 'lineitem.l extended' FROM b WHERE t = 'PROMO' AND NOT wide
    UNION ALL SELECT id, 'aggregate_in_expression', 'group_expr' FROM b WHERE t = 'PROMO' AND wide
    UNION ALL SELECT id, 'reason_not_allowed', 'nope' FROM b WHERE t = 'SMALL'
    UNION ALL SELECT id, 'template_not_admissible', 'nope' FROM b WHERE t = 'SMALL'
    UNION ALL SELECT id, 'unknown_template', 'nope' FROM b WHERE t = 'SMALL'""")
def binding_errors(spark: SparkSession, sf: str) -> DataFrame:
    return R.check_bindings(bindings(spark, sf), bound_claims(spark, sf), profiles(spark, sf))


@query("bound_probes", """
    SELECT 'B' || p_partkey AS id, 'anti_join' AS template, 'H' || p_partkey AS claim_id,
      '{"child": "orders", "child_column": "o_custkey", "parent": "customer", "parent_column": "c_custkey"}' AS params
    FROM part WHERE p_type = 'ECONOMY' AND p_size <= 25""")
def bound_probes(spark: SparkSession, sf: str) -> DataFrame:
    b, c = bindings(spark, sf), bound_claims(spark, sf)
    accepted = b.join(R.check_bindings(b, c, profiles(spark, sf)).select("id"), "id", "left_anti")
    return R.bindings_to_probes(accepted, c).select("id", "template", "claim_id", "params")


@query("claim_labels", """
    SELECT 'H' || p_partkey AS id, 'c' || row_number() OVER (ORDER BY p_type, p_partkey) AS label FROM part""")
def claim_labels(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    c = table(spark, sf, "part").select(
        F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("id"), F.lit("{}").alias("params"),
        F.col("p_type").alias("predicate"), none.alias("scope"),
        F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("statement"), none.alias("validity"))
    return R.label_claims(c).select("id", "label")


@query("unbound_claims", f"""
    WITH {RESOLVED}, {PR} SELECT id FROM resolved WHERE created_by = 'ai' AND status = 'inferred' AND predicate IS NOT NULL
      AND id NOT IN (SELECT claim_id FROM pr)""")
def unbound_claims(spark: SparkSession, sf: str) -> DataFrame:
    return R.unbound_claims(resolved(spark, sf), probes(spark, sf)).select("id")


@query("refusal_declarations", f"""
    WITH {EV}, {CL} SELECT id AS claim_id, 'skipped' AS decision, 'no check fits ' || predicate AS reason FROM cl
    WHERE predicate IS NOT NULL AND id NOT IN (
      SELECT claim_id FROM ev WHERE type = 'declaration' AND {case('st', DECISION_OF)} = 'skipped')""")
def refusal_declarations(spark: SparkSession, sf: str) -> DataFrame:
    refused = claims(spark, sf).filter(F.col("predicate").isNotNull()).select(
        F.col("id").alias("claim_id"), F.lit("skipped").alias("decision"),
        F.concat(F.lit("no check fits "), "predicate").alias("reason"))
    return R.declare_refusals(refused, evidence(spark, sf)).select(
        "claim_id", F.col("payload")["decision"].alias("decision"), F.col("payload")["reason"].alias("reason"))


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    binding = (
        F.when(seg == "AUTOMOBILE", _map(table="orders", amount=" orders.o_totalprice"))
        .when(seg == "BUILDING", F.create_map().cast("map<string,string>"))
        .otherwise(_map(table="orders", column=F.concat(F.lit("orders.c"), F.col("c_nationkey").cast("string"))))
    )
    role = F.when(seg == "MACHINERY", F.concat(F.lit("r"), F.col("c_nationkey").cast("string"))).otherwise("journal")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("id"), role.alias("role"), binding.alias("binding"))


@query("role_proposal_errors", """
    WITH a AS (SELECT 'A' || c_custkey AS id, c_mktsegment AS s, c_nationkey AS n FROM customer)
    SELECT id, 'unknown_role' AS error, 'r' || n AS detail FROM a WHERE s = 'MACHINERY'
    UNION ALL SELECT id, 'empty_binding', NULL FROM a WHERE s = 'BUILDING'
    UNION ALL SELECT id, 'unknown_part', ' orders.o_totalprice' FROM a WHERE s = 'AUTOMOBILE'
    UNION ALL SELECT id, 'unknown_part', 'orders.c' || n FROM a WHERE s NOT IN ('AUTOMOBILE', 'BUILDING')""")
def role_proposal_errors(spark: SparkSession, sf: str) -> DataFrame:
    known = declared(spark, "role string, definition string, decided_by string", [("journal", "ledger of record", "balance")])
    return R.check_role_proposals(proposals(spark, sf), known, profiles(spark, sf))


@query("role_claims", """
    SELECT 'A' || c_custkey AS id, 'role ''journal'' is played by amount=orders.o_totalprice, table=orders' AS statement,
      '{"binding": {"amount": "orders.o_totalprice", "table": "orders"}, "role": "journal"}' AS params, 'src_orders' AS sources
    FROM customer WHERE c_mktsegment = 'AUTOMOBILE'""")
def role_claims(spark: SparkSession, sf: str) -> DataFrame:
    chosen = proposals(spark, sf).filter(F.try_element_at("binding", F.lit("amount")).isNotNull())
    return R.proposals_to_claims(chosen, profiles(spark, sf)).select(
        "id", "statement", "params", F.array_join("source_ids", ",").alias("sources"))


@query("catalogue_index", f"""WITH {IX} SELECT v AS "view", c AS "column", source_id FROM ix""")
def catalogue_index(spark: SparkSession, sf: str) -> DataFrame:
    _, columns = R.catalogue_index(profiles(spark, sf))
    return columns.select("view", F.split_part("column_key", F.lit("."), F.lit(2)).alias("column"), "source_id")
