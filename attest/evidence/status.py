"""Status of claims, derived from their evidence in one aggregation and never stored by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.evidence import tables as S
from attest.evidence import verdicts as V


def attachments(claims: DataFrame) -> DataFrame:
    """``(claim_id, evidence_id)`` links of claims that list their evidence."""
    return claims.select(F.col("id").alias("claim_id"), F.explode("evidence_ids").alias("evidence_id")).distinct()


def attached(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence rows with the claim they are attached to, once per claim."""
    return links.select("claim_id", F.col("evidence_id").alias("id")).distinct().join(
        evidence.drop("claim_id"), "id")


def explicit_scope(scope: Column) -> Column:
    return F.coalesce(scope["entity"], scope["period"], scope["segment"]).isNotNull()


def status_of(fails: Column, passes: Column, confirmed: Column, testimonial: Column) -> Column:
    """Conflict stays visible as unresolved; only passing probes and confirmations promote."""
    return (
        F.when(fails & (passes | confirmed | testimonial), S.UNRESOLVED)
        .when(fails, S.CONTRADICTED)
        .when(confirmed, S.CONFIRMED)
        .when(passes, S.TESTED)
        .otherwise(S.INFERRED)
    )


def evidence_facts(evidence: DataFrame) -> DataFrame:
    """Per claim, what its live evidence says; `evidence` carries ``claim_id``.

    A confirmation of a claim that rests on a user statement counts only with an explicit scope. Whether a claim has
    such a statement is known after the same aggregation, so both kinds of confirmation are counted apart.
    """
    live = ~F.coalesce("stale", F.lit(False))
    is_probe = live & (F.col("type") == S.PROBE_RESULT)
    confirmation = live & (F.col("type") == S.CONFIRMATION)
    scoped = F.coalesce(explicit_scope(F.col("scope")), F.lit(False))
    count = lambda condition, name: F.count_if(F.coalesce(condition, F.lit(False))).alias(name)
    return evidence.groupBy("claim_id").agg(
        count(is_probe & (F.col("verdict") == V.PASS), "probe_pass"),
        count(is_probe & (F.col("verdict") == V.FAIL), "probe_fail"),
        count(confirmation, "confirmations"),
        count(confirmation & scoped, "scoped_confirmations"),
        count(live & (F.col("type") == S.TESTIMONIAL), "testimonials"),
        count(F.col("type") == S.PROBE_RESULT, "probe_results"),
        count(F.col("actor") == S.PROBE, "by_probe"),
    )


def _facts_status() -> Column:
    testimonial = F.col("testimonials") > 0
    confirmed = (F.col("scoped_confirmations") > 0) | ((F.col("confirmations") > 0) & ~testimonial)
    return status_of(F.col("probe_fail") > 0, F.col("probe_pass") > 0, confirmed, testimonial)


FACTS = ("probe_pass", "probe_fail", "confirmations", "scoped_confirmations", "testimonials", "probe_results", "by_probe")


def resolve_status(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims with ``status`` and the counts behind it; `evidence` carries the claim it is attached to."""
    facts = evidence_facts(evidence.filter(F.col("claim_id").isNotNull()))
    known = claims.drop("status", *FACTS).join(facts.withColumnRenamed("claim_id", "id"), "id", "left")
    for name in FACTS:
        known = known.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    return known.withColumn("status", _facts_status())


def _judge(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """`fresh` with ``admitted``; only confirmations without a scope have to be looked up among the `known` statements."""
    stated = known.filter((F.col("type") == S.TESTIMONIAL) & ~F.coalesce("stale", F.lit(False))).select(
        "claim_id").distinct().withColumn("testimonial", F.lit(True))
    doubtful = F.coalesce(F.col("type") == S.CONFIRMATION, F.lit(False)) & ~F.coalesce(
        explicit_scope(F.col("scope")), F.lit(False))
    looked_up = fresh.filter(doubtful).join(stated, "claim_id", "left").withColumn(
        "admitted", F.col("testimonial").isNull()).select(*fresh.columns, "admitted")
    return fresh.filter(~doubtful).withColumn("admitted", F.lit(True)).unionByName(looked_up)


def admissible(evidence: DataFrame) -> DataFrame:
    """Evidence with ``admitted``: confirmations of testimonial claims need an explicit scope."""
    return _judge(evidence, evidence)


def attach_evidence(stored: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored plus admitted rows, rejected rows); rules are checked against stored evidence."""
    columns = stored.columns
    judged = _judge(fresh, stored)
    return (stored.unionByName(judged.filter("admitted").select(*columns)),
            judged.filter("NOT admitted").select(*columns))


def status_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _counted(count: Column, singular: str) -> Column:
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(f" {singular}"),
                                      F.when(count == 1, "").otherwise("s")))


def rationale(resolved: DataFrame) -> DataFrame:
    """Adds a sentence on why a claim has its status and which live evidence stands behind it."""
    trail = F.concat_ws(
        ", ",
        _counted(F.col("probe_pass"), "passing probe result"),
        _counted(F.col("probe_fail"), "failing probe result"),
        _counted(F.col("confirmations"), "confirmation"),
        _counted(F.col("testimonials"), "testimonial"),
    )
    # The reasons shown for each status.
    why = (
        F.when(F.col("status") == S.UNRESOLVED,
               "Conflict is present: at least one failing probe coexists with supporting evidence.")
        .when(F.col("status") == S.CONTRADICTED,
              "At least one failing probe is present and no competing supporting evidence remains live.")
        .when(F.col("status") == S.CONFIRMED,
              "At least one admissible human confirmation is live and no failing probe overrides it.")
        .when(F.col("status") == S.TESTED, "At least one passing probe is live and no failing probe overrides it.")
        .otherwise("Nothing stronger than inferred evidence is live yet.")
    )
    return resolved.withColumn("rationale", F.concat(
        why, F.lit(" Live trail: "), F.when(trail == "", "no live status-bearing evidence").otherwise(trail),
        F.lit(".")))


def stale_evidence(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """``(id, changed)``: evidence whose stored fingerprints differ from the current ones of the same views.

    `current` is ``(view, fingerprint)``. A view that no longer exists counts as changed.
    """
    stamps = evidence.select("id", F.explode("source_fingerprints").alias("view", "was"))
    compared = stamps.join(current.select("view", F.col("fingerprint").alias("now")), "view", "left")
    return compared.groupBy("id").agg(
        F.bool_or(~F.col("was").eqNullSafe(F.col("now"))).alias("changed"))


def mark_stale(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """Evidence with ``stale`` set where its sources changed; rows already stale stay so."""
    changed = stale_evidence(evidence, current).filter("changed").select("id", F.lit(True).alias("changed"))
    return evidence.join(changed, "id", "left").withColumn(
        "stale", F.coalesce("stale", F.lit(False)) | F.coalesce("changed", F.lit(False))).drop("changed")


def stale_questions(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Questions that rest on a claim with stale evidence."""
    touched = evidence.filter(F.col("stale")).select("claim_id").filter(F.col("claim_id").isNotNull()).distinct()
    return questions.select("id", F.explode("claim_ids").alias("claim_id")).join(touched, "claim_id", "left_semi").select(
        "id").distinct()
