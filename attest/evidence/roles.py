"""Domain roles: lint of the role pack, election among candidates, questions for roles that stay open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.evidence import tables as S
from attest.evidence.templates import TEMPLATES
from attest.functions.frames import declared, ranked_within

# Ways to settle a role besides a domain law, and the four questions.
BY_QUESTION = "fachfrage"
BY_SLOT = "slot"
QUESTION_LOST = ("Fachfrage: Für die Rolle '{role}' hat keine vorgeschlagene Bindung ihre Invarianten-Sonde bestanden — "
                 "welche Quelle ist führend?")
QUESTION_UNBOUND = ("Fachfrage: Für die Rolle '{role}' konnte keine vorgeschlagene Bindung an ihre Invarianten-Sonde "
                    "gebunden werden — welches Fachwissen fehlt?")
QUESTION_CHOOSE = "Fachfrage: Die Rolle '{role}' kann keine Sonde entscheiden — welche Bindung gilt: {options}?"
QUESTION_EMPTY = ("Fachfrage: Für die Rolle '{role}' wurde kein Kandidat vorgeschlagen — gibt es diese Rolle in dieser "
                  "Datenlandschaft?")


def template_table(spark: SparkSession) -> DataFrame:
    return declared(spark, "template string, domain string", [(n, t.domain) for n, t in TEMPLATES.items()])


def lint_roles(roles: DataFrame, domain: str) -> DataFrame:
    """``(role, violation)``: roles nothing can settle, or that a foreign or generic check would settle."""
    known = template_table(roles.sparkSession).withColumnRenamed("template", "decided_by")
    other = roles.filter(~F.coalesce(F.col("decided_by").isin(BY_QUESTION, BY_SLOT), F.lit(False)))
    judged = other.join(known.withColumn("known", F.lit(True)), "decided_by", "left")
    return judged.withColumn(
        "violation",
        F.when(F.col("known").isNull(), "no_such_template")
        .when(~F.col("domain").eqNullSafe(F.lit(domain)), "not_a_law_of_the_domain"),
    ).filter(F.col("violation").isNotNull()).select("role", "violation")


def binding_text(binding: Column) -> Column:
    """``k=v`` parts of a binding in key order."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(binding)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def standing(status: Column) -> Column:
    """Order of candidates: settled ones first, contradicted ones last."""
    return (F.when(status.isin(*S.SETTLED), 0).when(status == S.UNRESOLVED, 1).when(status == S.INFERRED, 2)
            .otherwise(3))


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """``(role, id, status, standing, winner)``: candidates of a role with the elected one marked.

    The winner is the first settled candidate by standing and id; it is found by aggregation, so a role with very many
    candidates is never sorted in one task.
    """
    ranked = candidates.select("role", "id", "status", standing(F.col("status")).alias("standing"))
    best = ranked.groupBy("role").agg(F.min_by("id", F.struct("standing", "id")).alias("first_id"))
    return ranked.join(best, "role").select(
        "role", "id", "status", "standing",
        ((F.col("id") == F.col("first_id")) & (F.col("standing") == 0)).alias("winner"))


def role_elections(candidates: DataFrame, questions: DataFrame, probes: DataFrame) -> DataFrame:
    """``(role, n_candidates, outcome, elected)`` with outcome elected, question, in flight or lost."""
    asked = questions.select(F.explode("claim_ids").alias("id")).distinct().withColumn("asked", F.lit(1))
    bound = probes.select(F.col("claim_id").alias("id")).filter(F.col("id").isNotNull()).distinct().withColumn(
        "bound", F.lit(1))
    rows = candidates.select("role", "id", "status", standing(F.col("status")).alias("standing")).join(
        asked, "id", "left").join(bound, "id", "left")
    per_role = rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max("asked").alias("asked"), F.max("bound").alias("bound"),
        F.min("standing").alias("best"), F.min_by("id", F.struct("standing", "id")).alias("first_id"))
    return per_role.select(
        "role", "n_candidates",
        F.when(F.col("best") == 0, "elected").when(F.col("asked") == 1, "question")
        .when(F.col("bound").isNull(), "in flight").otherwise("lost").alias("outcome"),
        F.when(F.col("best") == 0, F.col("first_id")).alias("elected"))


def _say(text: str, options: Column | None = None) -> Column:
    head, tail = text.split("{role}")
    parts = [F.lit(head), F.col("role")]
    if options is None:
        return F.concat(*parts, F.lit(tail))
    before, after = tail.split("{options}")
    return F.concat(*parts, F.lit(before), options, F.lit(after))


def role_options(roles: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(role, position, option, n_claims)``: the bindings people may choose from, for roles that only they decide.

    One row per option in the order of the question's text, for roles with more options than a text can show. A role of
    any size is ordered by many tasks; equal bindings of several claims are one option.
    """
    asked = roles.filter(F.col("decided_by") == BY_QUESTION).select("role").distinct()
    options = candidates.select("role", binding_text(F.col("binding")).alias("option")).filter(F.col("option").isNotNull()).join(
        asked, "role", "left_semi").groupBy("role", "option").agg(F.count(F.lit(1)).alias("n_claims"))
    return ranked_within(options, "position", ["role"], "option").select("role", "position", "option", "n_claims")


def resolve_roles(roles: DataFrame, candidates: DataFrame, evidence: DataFrame,
                  stored: DataFrame | None = None) -> DataFrame:
    """``(question, role, n_candidates)``: one question for every role that nothing has settled.

    `candidates` are role claims with ``(id, role, status, binding)``, `evidence` carries ``claim_id``. A role whose
    candidates still wait for a probe or a recorded refusal raises no question yet; without any candidate at all in
    the project nothing is asked.
    """
    live_result = (F.col("type") == S.PROBE_RESULT) & ~F.coalesce("stale", F.lit(False))
    refusal = (F.col("type") == S.DECLARATION) & F.map_contains_key(
        F.coalesce("payload", F.create_map().cast("map<string,string>")), F.lit("decision"))
    spoken = evidence.filter(F.col("claim_id").isNotNull()).groupBy(F.col("claim_id").alias("id")).agg(
        F.bool_or(live_result).alias("probed"), F.bool_or(refusal).alias("refused"))
    per_claim = candidates.join(spoken, "id", "left").select(
        "role", F.col("status").isin(*S.SETTLED).alias("settled"), F.coalesce("probed", F.lit(False)).alias("probed"),
        F.coalesce("refused", F.lit(False)).alias("refused"), binding_text(F.col("binding")).alias("option"))
    per_role = per_claim.groupBy("role").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.bool_or("settled").alias("settled"),
        F.bool_or("probed").alias("probed"), F.bool_and("refused").alias("all_refused"))
    # The options are part of the question text; only roles that people decide list them.
    asked_roles = roles.filter(F.col("decided_by") == BY_QUESTION).select("role")
    options = per_claim.join(asked_roles, "role", "left_semi").groupBy("role").agg(
        F.array_join(F.sort_array(F.collect_set("option")), " | ").alias("options"))
    # One row at most, so it may be broadcast.
    searched = F.broadcast(candidates.select(F.lit(1).alias("searched")).limit(1))
    joined = roles.filter(F.col("decided_by") != BY_SLOT).join(per_role, "role", "left").join(options, "role", "left")
    joined = joined.withColumn("searched", F.lit(1)).join(searched, "searched", "left_semi")
    text = (
        F.when(F.coalesce("settled", F.lit(False)), F.lit(None))
        .when(F.col("n_candidates").isNull(), _say(QUESTION_EMPTY))
        .when(F.col("decided_by") == BY_QUESTION, _say(QUESTION_CHOOSE, F.col("options")))
        .when(F.col("probed"), _say(QUESTION_LOST))
        .when(F.col("all_refused"), _say(QUESTION_UNBOUND))
    )
    drafts = joined.select(text.alias("question"), "role", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates")).filter(
        F.col("question").isNotNull())
    return drafts if stored is None else drafts.join(stored.select("question"), "question", "left_anti")
