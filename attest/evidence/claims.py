"""Rules as rows: identity, insertion without doubles, escalation, dependencies, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.evidence import tables as S
from attest.evidence import verdicts as V
from attest.functions.frames import union_all
from attest.session import settle


class CycleError(ValueError):
    """Claim dependencies form a cycle."""


def new_claims(rows: DataFrame) -> DataFrame:
    """Claims from proposals: always inferred, without evidence; `rows` carries statement, author and rule columns."""
    empty = F.array().cast("array<string>")
    have = set(rows.columns)
    extra = {
        "source_ids": empty, "depends_on": empty, "claim_type": F.lit("claim"),
        "predicate": F.lit(None).cast("string"), "params": F.lit(None).cast("string"),
        "scope": F.lit(None).cast(S.SCOPE), "validity": F.lit(None).cast(S.VALIDITY),
    }
    for name, default in extra.items():
        if name not in have:
            rows = rows.withColumn(name, default)
    return rows.withColumn("status", F.lit(S.INFERRED)).withColumn("evidence_ids", empty)


def json_string(c: Column) -> Column:
    """A text as JSON string, NULL as ``null``."""
    inner = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def _json_struct(c: Column, fields: tuple[str, ...]) -> Column:
    cells = F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), json_string(c[name])) for name in fields])
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("{"), cells, F.lit("}")))


def claim_key(predicate: Column, params: Column, scope: Column, validity: Column, source_ids: Column) -> Column:
    """Identity of a rule: what it says and where it holds, never how it is worded. NULL without a predicate.

    `params` is JSON text with sorted keys.
    """
    sources = F.array_join(F.transform(F.sort_array(source_ids), json_string), ", ")
    text = F.concat(
        F.lit('{"params": '), F.coalesce(params, F.lit("{}")),
        F.lit(', "predicate": '), json_string(predicate),
        F.lit(', "scope": '), _json_struct(scope, ("entity", "period", "segment")),
        F.lit(', "sources": ['), sources,
        F.lit('], "validity": '), _json_struct(validity, ("valid_from", "valid_to")), F.lit("}"))
    return F.when(predicate.isNotNull(), F.sha2(text, 256))


def with_key(claims: DataFrame) -> DataFrame:
    return claims.withColumn("claim_key", claim_key(
        F.col("predicate"), F.col("params"), F.col("scope"), F.col("validity"), F.col("source_ids")))


def first_per_key(keyed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in `order`; combines before the shuffle, so a popular key stays small."""
    columns = keyed.columns
    row = F.struct(*columns)
    return keyed.groupBy(F.col(key).alias("__key")).agg(
        F.min_by(row, F.struct(*order)).alias("row")).select("row.*").select(*columns)


def insert_claims(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed claims that are new: one per identity, none that is stored already; keyless rows always enter."""
    keyed = with_key(proposed)
    rules = first_per_key(keyed.filter(F.col("claim_key").isNotNull()), "claim_key", ["created_at", "id"])
    known = with_key(stored).select("claim_key").filter(F.col("claim_key").isNotNull()).distinct()
    return rules.join(known, "claim_key", "left_anti").unionByName(keyed.filter(F.col("claim_key").isNull()))


def escalate(parents: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """New claims from exceptions that are rules of their own.

    `findings` is ``(evidence_id, id, statement, created_by, predicate, params, scope, validity)``; scope and validity
    fall back to the parent's. Findings whose evidence is not attached to a parent claim do not enter.
    """
    origin = parents.select(
        F.col("id").alias("parent_id"), F.explode("evidence_ids").alias("evidence_id"),
        F.col("scope").alias("parent_scope"), F.col("validity").alias("parent_validity"), "source_ids")
    real = evidence.select(F.col("id").alias("evidence_id"))
    rows = findings.join(real, "evidence_id", "left_semi").join(origin, "evidence_id")
    return new_claims(rows.select(
        "id", "statement", "created_by", "predicate", "params",
        F.coalesce("scope", "parent_scope").alias("scope"),
        F.coalesce("validity", "parent_validity").alias("validity"), "source_ids",
        F.col("parent_id").alias("derived_from"), F.col("evidence_id").alias("derived_from_evidence")))


def append_evidence(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored plus fresh records; an id that exists already is an error, records are never replaced."""
    doubled = fresh.join(stored.select("id"), "id", "left_semi").select("id").unionByName(
        fresh.groupBy("id").count().filter("count > 1").select("id")).limit(1).collect()
    if doubled:
        raise ValueError(f"evidence {doubled[0][0]} already exists; records are append-only")
    return stored.unionByName(fresh)


def evidence_violations(evidence: DataFrame) -> DataFrame:
    """``(id, violation)``: records that break a rule of their type."""
    kind, actor, verdict = F.col("type"), F.col("actor"), F.col("verdict")
    is_probe = kind == S.PROBE_RESULT
    rules = {
        "probe_without_verdict": is_probe & verdict.isNull(),
        "probe_not_by_probe": is_probe & ~actor.eqNullSafe(F.lit(S.PROBE)),
        "verdict_without_probe": ~is_probe & verdict.isNotNull(),
        "unknown_verdict": verdict.isNotNull() & ~verdict.isin(V.PASS, V.FAIL, V.INCONCLUSIVE),
        "human_only": kind.isin(S.CONFIRMATION, S.TESTIMONIAL) & ~actor.eqNullSafe(F.lit(S.HUMAN)),
        "statement_missing": (kind == S.TESTIMONIAL) & (F.coalesce("statement", F.lit("")) == ""),
        "too_many_samples": F.size("exception_samples") > S.MAX_SAMPLES,
        "more_exceptions_than_rows": F.col("exception_count") > F.col("population"),
        "malformed_id": ~F.coalesce(F.col("id").rlike(r"^[0-9A-Za-z]{1,64}$"), F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return evidence.select("id", F.explode(found).alias("violation"))


def dangling(
    claims: DataFrame, evidence: DataFrame, probes: DataFrame, questions: DataFrame, profiles: DataFrame,
    sources: DataFrame,
) -> DataFrame:
    """``(owner, owner_id, edge, missing)``: references that lead nowhere, over all ten edges between the tables."""
    def links(df: DataFrame, owner: str, one: Sequence[tuple[str, str, str]], many: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
        """All references of one table in one pass; `one` and `many` list (edge, target, column)."""
        ref = lambda edge, target, value: F.struct(
            F.lit(edge).alias("edge"), F.lit(target).alias("target"), value.alias("missing"))
        single = F.array(*[ref(edge, target, F.col(column)) for edge, target, column in one])

        def listed(edge: str, target: str, column: str) -> Column:
            return F.coalesce(F.transform(F.col(column), lambda x: ref(edge, target, x)), F.slice(single, 1, 0))

        lists = [listed(*each) for each in many]
        return df.select(F.col("id").alias("owner_id"), F.explode(F.concat(single, *lists)).alias("r")).select(
            F.lit(owner).alias("owner"), "owner_id", "r.edge", "r.target", "r.missing").filter(F.col("missing").isNotNull())

    refs = settle(union_all([
        links(claims, "claim", [("parent", "claim", "derived_from"), ("origin evidence", "evidence", "derived_from_evidence")],
              [("dependency", "claim", "depends_on"), ("evidence", "evidence", "evidence_ids"), ("source", "source", "source_ids")]),
        links(evidence, "evidence", [("claim", "claim", "claim_id"), ("probe", "probe", "probe_id")]),
        links(probes, "probe", [("claim", "claim", "claim_id")]),
        links(questions.withColumn("__none", F.lit(None).cast("string")), "question", [("claim", "claim", "__none")],
              [("claim", "claim", "claim_ids")]),
        links(profiles, "profile", [("source", "source", "source_id")]),
    ]), "references")
    known = union_all([df.select(F.lit(target).alias("target"), F.col("id").alias("missing")) for target, df in (
        ("claim", claims), ("evidence", evidence), ("source", sources), ("probe", probes))])
    # Each referenced id is looked up once, however many rows refer to it; only the lost ones go back to the rows.
    lost = refs.select("target", "missing").distinct().join(known, ["target", "missing"], "left_anti")
    return refs.join(lost, ["target", "missing"], "left_semi").select("owner", "owner_id", "edge", "missing")


def dependency_levels(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """``(claim_id, level)``: claims without prerequisites are level 0, others come after their last prerequisite.

    `claims` has ``claim_id``, `edges` has ``(claim_id, depends_on)``. Each round removes the edges whose
    prerequisite waits for nothing; the number of rounds is the depth of the graph. Unknown prerequisites and cycles
    are errors.
    """
    edges = settle(edges.select("claim_id", "depends_on").distinct(), "edges")
    lost = edges.join(claims.select(F.col("claim_id").alias("depends_on")), "depends_on", "left_anti").limit(1).collect()
    if lost:
        raise KeyError(f"claim {lost[0]['claim_id']} depends on unknown claim {lost[0]['depends_on']}")
    # An edge goes on waiting while its prerequisite itself waits; a claim gets its level when its last edge goes.
    waiting, open_edges = edges, edges.count()
    left_queue: list[DataFrame] = []
    while open_edges > 0:
        blocked = waiting.select("claim_id").distinct()
        after = settle(waiting.join(blocked.withColumnRenamed("claim_id", "depends_on"), "depends_on", "left_semi"), "edges")
        left_queue.append(blocked.join(after.select("claim_id").distinct(), "claim_id", "left_anti").withColumn(
            "level", F.lit(len(left_queue) + 1)))
        waiting, left = after, after.count()
        if left == open_edges:
            raise CycleError("dependency cycle between claims")
        open_edges = left
    if not left_queue:
        return claims.select("claim_id", F.lit(0).alias("level"))
    return claims.select("claim_id").join(union_all(left_queue), "claim_id", "left").select(
        "claim_id", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def ready_for_probe(edges: DataFrame, statuses: DataFrame) -> DataFrame:
    """``(claim_id, ready)`` for claims with prerequisites: all of them tested or confirmed."""
    known = statuses.select(F.col("id").alias("depends_on"), F.col("status").isin(*S.SETTLED).alias("ok"))
    return edges.join(known, "depends_on", "left").groupBy("claim_id").agg(
        F.bool_and(F.coalesce("ok", F.lit(False))).alias("ready"))


def questions_resting_on(questions: DataFrame) -> DataFrame:
    """``(claim_id, question_id)`` links."""
    return questions.select(F.explode("claim_ids").alias("claim_id"), F.col("id").alias("question_id")).distinct()


def gap_load(resolved: DataFrame, links: DataFrame) -> DataFrame:
    """Unproven claims with the number of questions that rest on them; sort by ``n_questions`` descending to rank.

    `links` is ``(claim_id, question_id)`` as given by ``questions_resting_on``.
    """
    load = links.distinct().groupBy(F.col("claim_id").alias("id")).agg(F.count(F.lit(1)).alias("n_questions"))
    return resolved.filter(~F.col("status").isin(*S.SETTLED)).select("id", "status").join(load, "id", "left").select(
        "id", "status", F.coalesce("n_questions", F.lit(0)).alias("n_questions"))
