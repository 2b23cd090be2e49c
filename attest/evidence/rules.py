"""Validation of proposed rules, role bindings and probe bindings against the profiled catalogue.

Proposals may come from any producer. Parameters are ``map<string,string>``: a list parameter is JSON text such as
``["a","b"]``, anything else is plain text. Each check returns rows ``(id, error, detail)``; a proposal without rows is
accepted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.evidence import contracts as C
from attest.evidence import tables as S
from attest.evidence.claims import json_string, new_claims
from attest.evidence.templates import TEMPLATES
from attest.functions.frames import ranked, union_all

ERRORS = "array<struct<error:string,detail:string>>"


def is_list(value: Column) -> Column:
    return value.startswith("[")


def items(value: Column) -> Column:
    """The texts of a parameter: the members of a list, or the one text."""
    return F.when(is_list(value), F.from_json(value, "array<string>")).otherwise(F.array(value))


def param(params: Column, name: str) -> Column:
    return F.try_element_at(params, F.lit(name))


def _error(error: str, detail: Column) -> Column:
    return F.struct(F.lit(error).alias("error"), detail.cast("string").alias("detail"))


def _each(texts: Column, error: str) -> Column:
    return F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda x: _error(error, x))


def _if(condition: Column, error: str, detail: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(_error(error, detail))).otherwise(
        F.array().cast(ERRORS))


def _unfold(df: DataFrame, errors: list[Column]) -> DataFrame:
    return df.select("id", F.inline(F.flatten(F.array(*errors))))


def catalogue_index(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(views, columns): ``(view, source_id)`` and ``(column_key, view, source_id)`` known from profiles."""
    columns = profiles.select(
        F.concat_ws(".", "table", "column").alias("column_key"), F.col("table").alias("view"), "source_id").distinct()
    views = columns.groupBy("view").agg(F.min("source_id").alias("source_id"))
    return views, columns


def unknown_references(refs: DataFrame, views: DataFrame, columns: DataFrame) -> DataFrame:
    """References ``(id, ref)`` that name a known view but none of its columns; other texts are not references."""
    distinct = refs.select("ref").distinct().withColumn("view", F.split_part(F.col("ref"), F.lit("."), F.lit(1)))
    bad = (
        distinct.join(views.select("view"), "view", "left_semi")
        .join(views.select(F.col("view").alias("ref")), "ref", "left_anti")
        .join(columns.select(F.col("column_key").alias("ref")), "ref", "left_anti")
    )
    return refs.join(bad.select("ref"), "ref", "left_semi").select("id", F.lit("unknown_reference").alias("error"),
                                                                   F.col("ref").alias("detail"))


def _references(df: DataFrame, *texts: Column) -> DataFrame:
    values = F.flatten(F.transform(F.map_values("params"), items))
    return df.select("id", F.explode(F.array_compact(F.concat(values, *texts))).alias("ref"))


def grounding(refs: DataFrame, views: DataFrame, columns: DataFrame) -> DataFrame:
    """``(id, source_ids)``: sources of the views and columns a proposal refers to."""
    known = columns.select(F.col("column_key").alias("ref"), "source_id").unionByName(
        views.select(F.col("view").alias("ref"), "source_id"))
    return refs.distinct().join(known, "ref").groupBy("id").agg(
        F.sort_array(F.collect_set("source_id")).alias("source_ids"))


def check_hypotheses(hypotheses: DataFrame, profiles: DataFrame) -> DataFrame:
    """Errors of proposed rules ``(id, kind, statement, predicate, params, columns, term, definition)``."""
    views, columns = catalogue_index(profiles)
    contract = C.predicate_table(hypotheses.sparkSession)
    known = hypotheses.join(contract, "predicate", "left")
    given = F.map_keys("params")
    concept = F.col("kind") == "concept"
    own = _unfold(known, [
        _if(F.col("required").isNull(), "unknown_predicate", F.col("predicate")),
        _if(~F.col("kind").isin("rule", "concept"), "unknown_kind", F.col("kind")),
        _if(concept != (F.col("predicate") == C.CONCEPT_PREDICATE), "kind_does_not_fit_predicate", F.col("kind")),
        _if(concept & ((F.coalesce("term", F.lit("")) == "") | (F.coalesce("definition", F.lit("")) == "")),
            "concept_without_definition", F.col("term")),
        _each(F.array_except("required", given), "missing_param"),
        _each(F.when(F.col("allowed").isNotNull(), F.array_except(given, F.col("allowed"))), "param_not_allowed"),
    ])
    listed = F.coalesce("columns", F.array().cast("array<string>"))
    refs = _references(hypotheses, listed)
    strange = hypotheses.select("id", F.explode(listed).alias("column_key")).join(
        columns.select("column_key"), "column_key", "left_anti").select(
        "id", F.lit("column_not_profiled").alias("error"), F.col("column_key").alias("detail"))
    floating = hypotheses.filter(F.col("kind") == "rule").join(
        grounding(refs, views, columns).select("id"), "id", "left_anti").select(
        "id", F.lit("not_grounded").alias("error"), F.lit(None).cast("string").alias("detail"))
    return union_all([own, unknown_references(refs, views, columns), strange, floating])


def canonical_params(params: Column) -> Column:
    """Stripped texts; text lists sorted."""
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.transform_values(params, lambda _, v: F.when(
        is_list(v), F.to_json(F.array_sort(F.transform(F.from_json(v, "array<string>"), strip)))).otherwise(strip(v)))


def params_json(params: Column) -> Column:
    """Parameters as JSON text with sorted keys; lists stay lists."""
    cells = F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(
        json_string(e["key"]), F.lit(": "), F.when(is_list(e["value"]), F.concat(
            F.lit("["), F.array_join(F.transform(F.from_json(e["value"], "array<string>"), json_string), ", "),
            F.lit("]"))).otherwise(json_string(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(cells, ", "), F.lit("}"))


def hypotheses_to_claims(hypotheses: DataFrame, profiles: DataFrame) -> DataFrame:
    """Claims of accepted proposals, with sources derived from what they refer to."""
    views, columns = catalogue_index(profiles)
    listed = F.coalesce("columns", F.array().cast("array<string>"))
    sources = grounding(_references(hypotheses, listed), views, columns)
    rows = hypotheses.join(sources, "id", "left").select(
        "id", "statement", F.lit(S.AI).alias("created_by"),
        F.when(F.col("kind") == "concept", "concept").otherwise("claim").alias("claim_type"),
        "predicate", params_json(canonical_params(F.col("params"))).alias("params"),
        F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), "term", "definition")
    return new_claims(rows)


def check_role_proposals(proposals: DataFrame, roles: DataFrame, profiles: DataFrame) -> DataFrame:
    """Errors of role proposals ``(id, role, binding)``: known role, at least one part, each part a view or column."""
    views, columns = catalogue_index(profiles)
    known = columns.select(F.col("column_key").alias("detail")).unionByName(views.select(F.col("view").alias("detail")))
    no_role = proposals.join(roles.select("role"), "role", "left_anti").select(
        "id", F.lit("unknown_role").alias("error"), F.col("role").alias("detail"))
    empty = proposals.filter(F.coalesce(F.size("binding"), F.lit(0)) <= 0).select(
        "id", F.lit("empty_binding").alias("error"), F.lit(None).cast("string").alias("detail"))
    parts = proposals.select("id", F.explode(F.map_values("binding")).alias("detail")).join(
        known, "detail", "left_anti").select("id", F.lit("unknown_part").alias("error"), "detail")
    return union_all([no_role, empty, parts])


def proposals_to_claims(proposals: DataFrame, profiles: DataFrame) -> DataFrame:
    """Role claims of accepted proposals."""
    views, columns = catalogue_index(profiles)
    refs = proposals.select("id", F.explode(F.map_values("binding")).alias("part")).select("id", F.trim("part").alias("ref"))
    trimmed = F.map_from_entries(F.transform(F.array_sort(F.map_entries("binding")), lambda e: F.struct(
        e["key"].alias("key"), F.trim(e["value"]).alias("value"))))
    text = lambda sep: F.array_join(F.transform(
        F.map_entries("binding"), lambda e: F.concat(e["key"], F.lit(sep), e["value"])), ", ")
    rows = proposals.withColumn("binding", trimmed).join(grounding(refs, views, columns), "id", "left").select(
        "id", F.concat(F.lit("role '"), F.col("role"), F.lit("' is played by "), text("=")).alias("statement"),
        F.lit(S.AI).alias("created_by"), F.lit("role").alias("claim_type"),
        F.lit(C.ROLE_PREDICATE).alias("predicate"),
        F.concat(F.lit('{"binding": '), params_json(F.col("binding")), F.lit(', "role": '), json_string(F.col("role")),
                 F.lit("}")).alias("params"),
        F.coalesce("source_ids", F.array().cast("array<string>")).alias("source_ids"), "role", "binding")
    return new_claims(rows)


def normalise_params(template: Column, params: Column) -> Column:
    """``view.column`` reduced to ``column`` where the parameter is bound to exactly that view."""
    def bare(key: Column, text: Column) -> Column:
        chain = F.when(F.lit(False), text)
        for name, pairs in ((name, t.column_views) for name, t in TEMPLATES.items()):
            for column_param, view_param in pairs:
                prefix = F.concat(param(params, view_param), F.lit("."))
                chain = chain.when((template == name) & (key == column_param) & text.startswith(prefix),
                                   F.substring(text, F.length(prefix) + 1, F.length(text)))
        return chain.otherwise(text)

    return F.transform_values(params, lambda k, v: F.when(
        is_list(v), F.to_json(F.transform(F.from_json(v, "array<string>"), lambda x: bare(k, x)))).otherwise(bare(k, v)))


def check_params(bindings: DataFrame) -> DataFrame:
    """Errors of template parameters ``(id, template, params)`` against the contract of their template."""
    known = bindings.join(C.template_contracts(bindings.sparkSession), "template", "left")
    given = F.map_keys("params")
    entries = F.map_entries("params")
    single = F.size(F.array_intersect("one_of", given))
    allowed = lambda e: F.array_contains(F.col("allowed"), e["key"])
    named = lambda condition: F.transform(F.filter(entries, condition), lambda e: e["key"])
    aggregate = lambda e: F.exists(F.array(*[F.lit(a) for a in C.AGGREGATES]),
                                   lambda a: F.contains(F.lower(e["value"]), a))
    scalar = lambda e: ~is_list(e["value"])
    accounts = items(param(F.col("params"), "accounts"))
    return _unfold(known, [
        _if(F.col("required").isNull(), "unknown_template", F.col("template")),
        _each(F.array_except("required", given), "missing_param"),
        _if((F.size("one_of") > 0) & (single != 1), "exactly_one_of", F.array_join(F.array_sort("one_of"), ", ")),
        _each(F.array_except(given, F.col("allowed")), "unknown_param"),
        _each(named(lambda e: e["key"].isin(*C.LIST_PARAMS) & allowed(e) & scalar(e)), "not_a_list"),
        _each(F.when((F.col("template") == "subledger_equals_gl") & is_list(param(F.col("params"), "accounts")),
                     F.filter(accounts, lambda a: a.try_cast("bigint").isNull())), "not_an_account"),
        _each(named(lambda e: e["key"].endswith("_expr") & allowed(e) & scalar(e) & aggregate(e)), "aggregate_in_expression"),
        _each(named(lambda e: ~e["key"].endswith("_expr") & ~e["key"].endswith("where") & allowed(e) & scalar(e)
                    & ~e["value"].rlike(r"(?U)^\w+\z")), "not_an_identifier"),
    ])


def check_bindings(bindings: DataFrame, claims: DataFrame, profiles: DataFrame) -> DataFrame:
    """Errors of probe bindings ``(id, claim_id, template, params, no_template_reason)``.

    A binding may decline a template if it says why. Otherwise the template must be admissible for the claim's
    predicate, the parameters must fit its contract, and views and columns must exist.
    """
    spark = bindings.sparkSession
    views, columns = catalogue_index(profiles)
    about = claims.select(F.col("id").alias("claim_id"), "claim_type", "predicate", F.lit(True).alias("claim_known"))
    rules = C.predicate_table(spark).select("predicate", "templates")
    rows = bindings.join(about, "claim_id", "left").join(rules, "predicate", "left")
    reason = F.coalesce("no_template_reason", F.lit("")) != ""
    admissible = F.when(F.col("claim_type") == "role", F.array(*[F.lit(t) for t in C.ROLE_TEMPLATES])).otherwise(
        F.coalesce("templates", F.array().cast("array<string>")))
    own = _unfold(rows, [
        _if(F.col("claim_known").isNull(), "unknown_claim", F.col("claim_id")),
        _if(F.col("claim_known") & F.col("template").isNull() & ~reason, "reason_missing", F.lit(None)),
        _if(F.col("claim_known") & F.col("template").isNotNull() & reason, "reason_not_allowed", F.col("template")),
        _if(F.col("claim_known") & F.col("template").isNotNull() & ~F.array_contains(admissible, F.col("template")),
            "template_not_admissible", F.col("template")),
    ])
    bound = rows.filter(F.col("claim_known") & F.col("template").isNotNull()).select(
        "id", "template", normalise_params(F.col("template"), F.col("params")).alias("params"))
    used_views = bound.select("id", F.explode(F.map_filter("params", lambda k, _: k.isin(*C.VIEW_PARAMS))).alias(
        "view_param", "view"))
    lost_views = used_views.join(views.select("view"), "view", "left_anti").select(
        "id", F.lit("unknown_view").alias("error"), F.col("view").alias("detail"))
    used_columns = bound.join(C.column_contracts(spark), "template").select(
        "id", F.try_element_at("params", F.col("view_param")).alias("view"),
        F.explode(items(F.try_element_at("params", F.col("column_param")))).alias("name")).filter(
        F.col("name").isNotNull()).join(views.select("view"), "view", "left_semi")
    lost_columns = used_columns.withColumn("column_key", F.concat_ws(".", "view", "name")).join(
        columns.select("column_key"), "column_key", "left_anti").select(
        "id", F.lit("unknown_column").alias("error"), F.col("column_key").alias("detail")).distinct()
    return union_all([own, check_params(bound), unknown_references(_references(bound), views, columns), lost_views,
                      lost_columns])


def bindings_to_probes(bindings: DataFrame, claims: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Probes of accepted bindings; a probe equal to a stored one in template, claim and params is not repeated."""
    roles = claims.select(F.col("id").alias("claim_id"), "role")
    rows = bindings.filter(F.col("template").isNotNull()).join(roles, "claim_id", "left").select(
        "id", "template", "claim_id", F.array_compact(F.array("role")).alias("roles"),
        params_json(canonical_params(normalise_params(F.col("template"), F.col("params")))).alias("params"))
    if stored is None:
        return rows
    return rows.join(stored.select("template", "claim_id", "params").distinct(), ["template", "claim_id", "params"], "left_anti")


def claim_identity(claims: DataFrame) -> Column:
    """Text that orders claims by what they say, never by id."""
    return F.to_json(F.struct("params", "predicate", "scope", "statement", "validity"), {"ignoreNullFields": "false"})


def label_claims(claims: DataFrame) -> DataFrame:
    """Claims with stable labels ``c1``, ``c2`` ... in identity order."""
    return ranked(claims.withColumn("identity", claim_identity(claims)), "n", "identity", "id").withColumn(
        "label", F.concat(F.lit("c"), F.col("n").cast("string"))).drop("identity")


def unbound_claims(resolved: DataFrame, probes: DataFrame) -> DataFrame:
    """Machine-made, still inferred rules without a probe."""
    bound = probes.select(F.col("claim_id").alias("id")).filter(F.col("id").isNotNull()).distinct()
    return resolved.filter(
        (F.col("created_by") == S.AI) & (F.col("status") == S.INFERRED) & F.col("predicate").isNotNull()
    ).join(bound, "id", "left_anti")


def declare_refusals(refusals: DataFrame, evidence: DataFrame) -> DataFrame:
    """Declarations why claims got no probe ``(claim_id, decision, reason)``, once per claim and decision."""
    once = refusals.groupBy("claim_id", "decision").agg(F.min("reason").alias("reason"))
    said = evidence.filter(F.col("type") == S.DECLARATION).select(
        "claim_id", F.try_element_at("payload", F.lit("decision")).alias("decision")).distinct()
    return once.join(said, ["claim_id", "decision"], "left_anti").select(
        F.sha2(F.concat_ws("|", "claim_id", "decision"), 256).alias("id"), F.lit(S.DECLARATION).alias("type"),
        F.lit(S.SYSTEM).alias("actor"), "claim_id",
        F.create_map(F.lit("decision"), F.col("decision"), F.lit("reason"), F.col("reason")).alias("payload"))


def admissible_templates(claim_type: str, predicate: str | None) -> tuple[str, ...]:
    if claim_type == "role":
        return C.ROLE_TEMPLATES
    known: Mapping = C.PREDICATES
    return tuple(known[predicate][0]) if predicate in known else ()
