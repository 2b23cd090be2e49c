"""Run all probes whose prerequisites hold, level by level, with statuses derived in between."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.evidence import tables as S
from attest.evidence.claims import dependency_levels, ready_for_probe
from attest.evidence.runner import build_check, draft_questions, run_probes, view_fingerprints
from attest.evidence.status import resolve_status
from attest.functions.frames import declared
from attest.session import settle


@dataclass
class SweepResult:
    """What a sweep did: its evidence, the probes that ran and those that were skipped (with the reason), all claims with
    the status that old and new evidence give them, the questions drafted for results that did not pass, and the probes
    as rows of the probe table."""

    evidence: DataFrame
    executed: list[str] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    statuses: DataFrame | None = None
    questions: DataFrame | None = None
    probes: DataFrame | None = None


def _failure(problem: Exception) -> str:
    text = str(problem).strip()
    return f"execution error ({type(problem).__name__}): {text.splitlines()[0] if text else ''}"


def _buildable(views: Mapping[str, DataFrame], probes: Sequence[S.Probe], tolerances, skipped: list[tuple[str, str]]) -> list[S.Probe]:
    """The probes whose names and parameters fit their views; the others are skipped before anything runs."""
    good = []
    for probe in probes:
        try:
            build_check(views, probe, tolerances)
        except Exception as problem:  # noqa: BLE001 - any failing check is contained and reported
            skipped.append((probe.id, _failure(problem)))
        else:
            good.append(probe)
    return good


def _run_contained(views: Mapping[str, DataFrame], probes: Sequence[S.Probe], tolerances, sink, run_id,
                   skipped: list[tuple[str, str]], prints: DataFrame | None) -> list[DataFrame]:
    """Evidence of one level, from one run: checks that cannot be built are left out before it, and those that meet values
    they cannot judge are told apart by it. Only if the run as a whole breaks, each probe runs alone."""
    probes = _buildable(views, probes, tolerances, skipped)
    if not probes:
        return []
    failed: list[tuple[str, str]] = []
    try:
        part = settle(run_probes(views, probes, tolerances, sink, run_id, prints, failed), "evidence")
    except Exception as problem:  # noqa: BLE001 - any failing check is contained and reported
        if len(probes) == 1:
            skipped.append((probes[0].id, _failure(problem)))
            return []
    else:
        skipped += failed
        return [part] if len(failed) < len(probes) else []
    parts: list[DataFrame] = []
    for probe in probes:
        # Stored exception sets of the failed joint run stay under their own run id.
        parts += _run_contained(views, [probe], tolerances, sink, f"{run_id}-{probe.id}", skipped, None)
    return parts


def _prints(views: Mapping[str, DataFrame], probes: Sequence[S.Probe], tolerances) -> DataFrame | None:
    """Fingerprints of all views of a sweep, made once; without them if a view cannot be read, so that only its probes fail."""
    used = {v for p in _buildable(views, probes, tolerances, []) for v in build_check(views, p, tolerances).views}
    if not used:
        return None
    try:
        return settle(view_fingerprints(views, sorted(used)), "prints")
    except Exception:  # noqa: BLE001 - the probes of the view report what is wrong with it
        return None


def run_ready(
    views: Mapping[str, DataFrame],
    claims: DataFrame,
    evidence: DataFrame,
    probes: Sequence[S.Probe],
    tolerances: Mapping[str, Any] | None = None,
    sink: str | None = None,
    questions: DataFrame | None = None,
) -> SweepResult:
    """A sweep over `probes`: evidence, statuses, drafted questions, and the probes that were skipped with their reasons.

    `claims` is the claim table, `evidence` what is known so far, with ``claim_id``, `questions` those already asked. Claims
    are visited after their prerequisites, and a prerequisite may be satisfied within the same sweep. Probes without a
    claim run first. Views are fingerprinted once.
    """
    spark = claims.sparkSession
    result = SweepResult(evidence=evidence.limit(0))
    prints = _prints(views, probes, tolerances)
    run_id = uuid.uuid4().hex
    listed = declared(spark, "claim_id string", [(p.claim_id,) for p in probes if p.claim_id]).distinct()
    edges = claims.select(F.col("id").alias("claim_id"), F.explode("depends_on").alias("depends_on")).distinct()
    levels = dependency_levels(claims.select(F.col("id").alias("claim_id")), edges)
    level_of = {r["claim_id"]: r["level"] for r in levels.join(listed, "claim_id", "left_semi").collect()}
    known = evidence.select("claim_id", "type", "actor", "verdict", "scope", "stale")
    produced = _run_contained(views, [p for p in probes if not p.claim_id], tolerances, sink, run_id, result.skipped, prints)
    for probe in probes:
        if probe.claim_id and probe.claim_id not in level_of:
            result.skipped.append((probe.id, f"unknown claim {probe.claim_id}"))
    gated = edges.join(listed, "claim_id", "left_semi")
    for level in sorted(set(level_of.values())):
        here = [p for p in probes if p.claim_id and level_of.get(p.claim_id) == level]
        if level > 0:
            current = known
            for part in produced:
                current = current.unionByName(part.select(*known.columns))
            verdicts = ready_for_probe(gated, resolve_status(claims.select("id"), current))
            held_back = {r["claim_id"] for r in verdicts.filter(~F.col("ready")).select("claim_id").collect()}
            for probe in here:
                if probe.claim_id in held_back:
                    result.skipped.append((probe.id, "prerequisites not tested yet"))
            here = [p for p in here if p.claim_id not in held_back]
        produced += _run_contained(views, here, tolerances, sink, f"{run_id}-{level}", result.skipped, prints)
    for part in produced:
        result.evidence = result.evidence.unionByName(part, allowMissingColumns=True)
    left_out = {p for p, _ in result.skipped}
    result.executed = [p.id for p in probes if p.id not in left_out]
    result.statuses = resolve_status(claims, known.unionByName(result.evidence.select(*known.columns)))
    result.questions = draft_questions(result.evidence, probes, questions)
    result.probes = declared(spark, "id string, template string, claim_id string, roles array<string>, params string",
                             [(p.id, p.template, p.claim_id, list(p.roles), json.dumps(p.params, sort_keys=True, ensure_ascii=False, default=str))
                              for p in probes])
    return result
