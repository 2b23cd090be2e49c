"""Reports over claims and evidence: funnel, defeats, false promotions, recall, expected verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.evidence import tables as S
from attest.evidence import verdicts as V
from attest.evidence.roles import template_table
from attest.evidence.status import rationale
from attest.functions.frames import declared

# Stages a claim can be in.
STAGES = ("bound", "unbindable", "semantic_only", "skipped", "unbound")


# How each stage is told.
STAGE_LABELS = {
    "bound": "bound to a probe",
    "unbindable": "unbindable — the model gave a reason",
    "semantic_only": "semantic-only — no probe template can test it",
    "skipped": "skipped — validation rejected the binding",
    "unbound": "no probe, no recorded reason",
}


def claim_stages(resolved: DataFrame, evidence: DataFrame, probes: DataFrame, testable: Column) -> DataFrame:
    """Claims with ``stage``, ``executed`` and ``no_probe_reason``; `testable` tells whether any template may test the claim.

    A claim is bound when a probe names it or its evidence names a probe; otherwise the first recorded refusal decides.
    The reason is that of this refusal, and empty where none was recorded.
    """
    decision, reason = (F.try_element_at("payload", F.lit(k)) for k in ("decision", "reason"))
    refusal = (F.col("type") == S.DECLARATION) & decision.isin(*STAGES)
    said = evidence.filter(F.col("claim_id").isNotNull()).groupBy(F.col("claim_id").alias("id")).agg(
        F.min_by(F.when(refusal, F.struct(decision.alias("decision"), reason.alias("reason"))),
                 F.when(refusal, F.struct("created_at", "id"))).alias("refusal"),
        F.max(F.when(F.col("probe_id").isNotNull(), 1)).alias("by_evidence"))
    bound = probes.filter(F.col("claim_id").isNotNull()).select(F.col("claim_id").alias("id")).distinct().withColumn(
        "by_probe_table", F.lit(1))
    return resolved.join(said, "id", "left").join(bound, "id", "left").withColumn(
        "stage",
        F.when(F.coalesce("by_probe_table", "by_evidence").isNotNull(), "bound")
        .when(F.col("refusal").isNotNull(), F.col("refusal.decision"))
        .when(~testable, "semantic_only")
        .otherwise("unbound"),
    ).withColumns({"executed": F.col("probe_results") > 0, "no_probe_reason": F.coalesce("refusal.reason", F.lit(""))}).drop(
        "refusal", "by_evidence", "by_probe_table")


def headlines(staged: DataFrame) -> DataFrame:
    """Claims with ``headline``: that a claim was never tested and why, or else what its live evidence says."""
    label = F.lit(None).cast("string")
    for stage, text in STAGE_LABELS.items():
        label = F.when(F.col("stage") == stage, text).otherwise(label)
    untested = (F.col("status") == S.INFERRED) & (F.col("stage") != "bound")
    told = rationale(staged)
    return told.withColumn("headline", F.when(untested, F.concat(F.lit("Never tested — "), label, F.lit("."))).otherwise(
        F.col("rationale"))).drop("rationale")


def funnel(staged: DataFrame) -> DataFrame:
    """``(step, name, n)``: how many claims were proposed, bound, judged, and which status they have."""
    steps = F.array(
        F.struct(F.lit("proposed").alias("step"), F.lit("claims").alias("name")),
        F.struct(F.lit("bound").alias("step"), F.col("stage").alias("name")),
        F.struct(F.lit("judged").alias("step"), F.when(F.col("executed"), "executed").alias("name")),
        F.struct(F.lit("status").alias("step"), F.col("status").alias("name")),
    )
    return staged.select(F.inline(steps)).filter(F.col("name").isNotNull()).groupBy("step", "name").agg(
        F.count(F.lit(1)).alias("n"))


def defeats(evidence: DataFrame, probes: DataFrame) -> DataFrame:
    """Failing probe results with the template and domain that felled the claim."""
    domains = template_table(evidence.sparkSession)
    failed = evidence.filter((F.col("type") == S.PROBE_RESULT) & (F.col("verdict") == V.FAIL))
    about = probes.select(F.col("id").alias("probe_id"), "template")
    detail = F.when(F.col("exception_count").isNull() | F.col("population").isNull(), "probe failed").otherwise(
        F.concat(F.col("exception_count").cast("string"), F.lit(" exception"),
                 F.when(F.col("exception_count") == 1, "").otherwise("s"), F.lit(" in "),
                 F.col("population").cast("string"), F.lit(" rows")))
    return failed.join(about, "probe_id", "left").join(domains, "template", "left").select(
        "claim_id", F.col("id").alias("evidence_id"), F.coalesce("template", F.lit("unknown template")).alias("template"),
        F.coalesce("domain", F.lit("")).alias("domain"), detail.alias("detail"))


def false_promotions(resolved: DataFrame) -> DataFrame:
    """Machine-made claims with a status above inferred that no probe evidence supports; none may exist."""
    return resolved.filter((F.col("created_by") == S.AI) & (F.col("status") != S.INFERRED) & (F.col("by_probe") == 0))


Rule = tuple[str, Sequence[str] | None, Sequence[Sequence[str]]]


def recall(claims: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(rule, found, claim_id)``: whether some claim has an allowed predicate and hits every token group.

    `claims` carries ``(id, predicate, haystack)``, `rules` is a short declared list of (rule, predicates or None, token
    groups). Each claim is tested against the list inside its row, so claims are never multiplied by rules; only hits
    leave the scan.
    """
    text = F.lower(F.col("haystack"))
    hits = []
    for rule, predicates, groups in rules:
        allowed = F.lit(True) if predicates is None else F.coalesce(F.col("predicate").isin(list(predicates)), F.lit(False))
        for group in groups:
            one = F.lit(False)
            for token in group:
                one = one | text.contains(token.lower())
            allowed = allowed & one
        hits.append(F.when(allowed, F.lit(rule)))
    found = claims.select("id", F.explode(F.array_compact(F.array(*hits))).alias("rule")).groupBy("rule").agg(
        F.min("id").alias("claim_id"))
    return declared(claims.sparkSession, "rule string", [(r[0],) for r in rules]).join(found, "rule", "left").select(
        "rule", F.col("claim_id").isNotNull().alias("found"), "claim_id")


def expected_verdict_findings(traps: DataFrame, deny: DataFrame, must_find: DataFrame) -> DataFrame:
    """``(check, trap_id)``: entries of an expected-verdict list that contradict each other.

    `traps` is ``(trap_id, category, deny_promotion, detected)``, `deny` and `must_find` are ``(trap_id)``.
    """
    denied = F.coalesce("deny_promotion", F.lit(False))
    seen = F.coalesce("detected", F.lit(False))
    classes = F.coalesce("category", F.lit(""))
    finding = lambda df, name: df.select(F.lit(name).alias("check"), "trap_id")
    known = traps.select("trap_id", denied.alias("denied"), seen.alias("seen"))
    return (
        finding(deny.join(known, "trap_id", "left").filter(~F.coalesce("denied", F.lit(False))), "deny_set")
        .unionByName(finding(must_find.join(known, "trap_id", "left").filter(~F.coalesce("seen", F.lit(False))), "recall_set"))
        .unionByName(finding(traps.filter(classes.contains("K6") & denied), "k6_orphans"))
        .unionByName(finding(traps.filter(classes.contains("K7") & ~denied), "k7_poisoned"))
        .unionByName(finding(traps.filter(~seen), "all_detected"))
    )


def trap_class_counts(traps: DataFrame) -> DataFrame:
    return traps.select(F.explode(F.split("category", ",")).alias("class")).groupBy(
        F.trim("class").alias("class")).agg(F.count(F.lit(1)).alias("n"))
