"""Run probes: exceptions and populations of many probes become evidence rows.

The exception sets of all probes of a run are written in one job, as text, each into a folder of its own; counts and
samples are taken from what was written, so that nothing is computed twice and the evidence can be followed to its full
set. The rows of a view that is the population of several probes are counted once, together with its fingerprint.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attest.evidence import tables as S
from attest.evidence import verdicts as V
from attest.evidence.templates import TEMPLATES, Check, merged_tolerances, question_text
from attest.functions.fingerprints import fingerprint_text, table_fingerprint
from attest.functions.frames import declared, union_all
from attest.session import open_folders, settle, shared_folder


def build_check(views: Mapping[str, DataFrame], probe: S.Probe, tolerances: Mapping[str, Any] | None = None) -> Check:
    if probe.template not in TEMPLATES:
        raise ValueError(f"unknown probe template: {probe.template!r}")
    template = TEMPLATES[probe.template]
    return template.check(views, probe.params, merged_tolerances(probe.template, tolerances))


def as_text(exceptions: DataFrame) -> DataFrame:
    """The exception set with every column as text, as the sink stores it."""
    return exceptions.select([F.col(c).cast("string").alias(c) for c in exceptions.columns])


@dataclass(frozen=True)
class ExceptionSets:
    """Exception sets as they were stored: one folder per probe below `folder`, all columns as text."""

    folder: str
    part: str
    numbers: Mapping[str, int]
    rows: DataFrame
    kinds: Mapping[str, StructType]

    def path(self, probe_id: str) -> str:
        return f"{self.folder}/{self.part}={self.numbers[probe_id]}"

    def typed(self, probe_id: str) -> DataFrame:
        """The set of one probe with the columns and types it had before it became text."""
        own = self.rows.filter(F.col(self.part) == self.numbers[probe_id])
        return own.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.kinds[probe_id]])

    def text(self, probe_id: str) -> DataFrame:
        """The set of one probe as it was stored, with its own columns only."""
        return self.rows.filter(F.col(self.part) == self.numbers[probe_id]).select([F.col(f"`{n}`") for n in self.kinds[probe_id].names])

    def found(self, weighted: Mapping[str, str]) -> dict[str, int]:
        """Violations per probe: the rows of its set, or the sum of a column that `weighted` names. One pass over all sets."""
        weight = F.lit(None).cast("decimal(38,0)")
        for probe_id, column in weighted.items():
            weight = F.when(F.col(self.part) == self.numbers[probe_id], F.col(column).cast("decimal(38,0)")).otherwise(weight)
        sums = {r[0]: (r[1], int(r[2] or 0)) for r in self.rows.groupBy(self.part).agg(F.count(F.lit(1)), F.sum(weight)).collect()}
        return {p: sums.get(n, (0, 0))[p in weighted] for p, n in self.numbers.items()}

    def faults(self, columns: Mapping[str, str]) -> dict[str, str]:
        """One value that could not be judged per probe that has any; `columns` names where a probe's set shows them."""
        shown = F.lit(None).cast("string")
        for probe_id, column in columns.items():
            shown = F.when(F.col(self.part) == self.numbers[probe_id], F.col(f"`{column}`")).otherwise(shown)
        bad = self.rows.select(self.part, shown.alias("fault")).filter("fault IS NOT NULL").groupBy(self.part).agg(F.min("fault"))
        at = {n: p for p, n in self.numbers.items()}
        return {at[r[0]]: r[1] for r in bad.collect()} if columns else {}


def write_exception_sets(sets: Mapping[str, DataFrame], sink: str, run_id: str) -> ExceptionSets:
    """Store the exception sets of many probes by one job: a union of all of them, tagged with the probe's number.

    Columns of one name share a column of the union; what a set does not have is NULL there and takes no room.
    """
    spark = next(iter(sets.values())).sparkSession
    names = list(dict.fromkeys(c for found in sets.values() for c in found.columns))
    part = "probe_no"
    while part.lower() in {n.lower() for n in names}:
        part += "_"
    numbers = {probe_id: i for i, probe_id in enumerate(sets)}
    tagged = [as_text(found).withColumn(part, F.lit(numbers[p])) for p, found in sets.items()]
    folder = f"{sink.rstrip('/')}/run_id={run_id}"
    with open_folders(spark, len(sets)):
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).write.mode("errorifexists").partitionBy(part).parquet(folder)
    stored = ", ".join([*[f"`{n}` string" for n in {n.lower(): n for n in reversed(names)}.values()], f"{part} int"])
    return ExceptionSets(folder, part, numbers, spark.read.schema(stored).parquet(folder), {p: f.schema for p, f in sets.items()})


def _outcome(probe_id: str, check: Check) -> DataFrame:
    """One row: exceptions found, verdict and summary of a check. The number found is never cut."""
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(38,0)").alias("exception_count")
    if check.statistics_only:
        counted = check.exceptions().withColumn("exception_count", whole(F.lit(0)))
    elif check.counted is not None:
        counted = check.counted().select(whole(F.col("found")))
    else:
        counted = check.exceptions().agg(whole(F.count(F.lit(1))))
    return counted.select(F.lit(probe_id).alias("probe_id"), F.col("exception_count").alias("exceptions_found"),
                          check.verdict.alias("verdict"), check.summary.alias("summary"))


def _counted_rows(found: DataFrame) -> DataFrame:
    """``exception_count``, which a rate can be made of, beside the number found: no more than the population."""
    return found.withColumn("exception_count", F.least("exceptions_found", F.col("population").cast("decimal(38,0)")).cast("bigint"))


def _samples(probe_id: str, check: Check) -> DataFrame:
    """The first exceptions in report order, as text maps."""
    first = check.first() if check.first is not None else check.exceptions().orderBy(*check.order).limit(S.MAX_SAMPLES)
    first = first if check.fault is None else first.drop(check.fault)
    cells = [part for c in first.columns for part in (F.lit(c), F.col(c).cast("string"))]
    return first.select(F.lit(probe_id).alias("probe_id"), F.monotonically_increasing_id().alias("at"),
                        F.create_map(*cells).alias("sample"))


def _gather(parts: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """One row per probe from frames that each know some of the columns."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.groupBy("probe_id").agg(*[F.any_value(c, F.lit(True)).alias(c) for c in columns])


def _populations(checks: Mapping[str, Check], row_counts: DataFrame | None = None) -> DataFrame:
    """``(probe_id, population)``; the rows of a view are counted once for all checks it drives, or taken from
    `row_counts` (view, row_count)."""
    drawn = {p: c for p, c in checks.items() if c.driving is not None}
    parts = [c.population.select(F.lit(p).alias("probe_id"), "population") for p, c in checks.items() if p not in drawn]
    if drawn:
        spark = next(iter(drawn.values())).population.sparkSession
        if row_counts is None:
            first = {c.driving: c for c in reversed(drawn.values())}
            row_counts = union_all([c.population.select(F.lit(view).alias("view"), F.col("population").alias("row_count"))
                                    for view, c in first.items()])
        asked = declared(spark, "probe_id string, view string", [(p, c.driving) for p, c in drawn.items()])
        parts.append(asked.join(row_counts.select("view", F.col("row_count").alias("population")), "view").select("probe_id", "population"))
    return union_all(parts)


def _counted_parts(checks: Mapping[str, Check], row_counts: DataFrame | None = None) -> list[DataFrame]:
    return [_populations(checks, row_counts), union_all([_outcome(p, c) for p, c in checks.items()])]


COUNTS = ("population", "exceptions_found", "verdict", "summary")


def probe_counts(checks: Mapping[str, Check]) -> DataFrame:
    """``(probe_id, population, exceptions_found, verdict, summary, exception_count)`` for all checks in one plan,
    without samples. ``exceptions_found`` counts report rows; ``exception_count`` does not exceed the population."""
    return _counted_rows(_gather(_counted_parts(checks), COUNTS))


def probe_outcomes(checks: Mapping[str, Check], row_counts: DataFrame | None = None, clean: Collection[str] = ()) -> DataFrame:
    """``probe_counts`` with the first exceptions of each check as ``exception_samples``; those in `clean` have none."""
    # Samples come first: what they store, the counts read again.
    samples = [_samples(p, c) for p, c in checks.items() if not c.statistics_only and p not in clean]
    parts = _counted_parts(checks, row_counts)
    empty = F.array().cast("array<map<string,string>>")
    if not samples:
        return _counted_rows(_gather(parts, COUNTS)).withColumn("exception_samples", empty)
    cells = F.struct("at", F.map_entries("sample").alias("cells"))
    # At most 20 rows per probe come together here.
    parts.append(union_all(samples).groupBy("probe_id").agg(F.array_sort(F.collect_list(cells)).alias("picked")))
    return _counted_rows(_gather(parts, (*COUNTS, "picked"))).select(
        "probe_id", "population", "exceptions_found", "exception_count", "verdict", "summary",
        F.coalesce(F.transform("picked", lambda item: F.map_from_entries(item["cells"])), empty).alias("exception_samples"))


def view_fingerprints(views: Mapping[str, DataFrame], names: Sequence[str] | None = None) -> DataFrame:
    """``(view, row_count, schema_hash, max_date, fingerprint)`` of the named views, in one job."""
    chosen = sorted(set(views if names is None else names))
    parts = [table_fingerprint(views[name]).withColumn("view", F.lit(name)) for name in chosen]
    return union_all(parts).select(
        "view", "row_count", "schema_hash", "max_date",
        fingerprint_text(F.col("row_count"), F.col("schema_hash"), F.col("max_date")).alias("fingerprint"))


def _stamps(prints: DataFrame, checks: Mapping[str, Check]) -> DataFrame:
    used = declared(prints.sparkSession, "probe_id string, view string",
                    [(p, v) for p, c in checks.items() for v in sorted(set(c.views))])
    return used.join(prints, "view").groupBy("probe_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("view", "fingerprint")))).alias("source_fingerprints"))


def run_probes(
    views: Mapping[str, DataFrame],
    probes: Sequence[S.Probe],
    tolerances: Mapping[str, Any] | None = None,
    sink: str | None = None,
    run_id: str | None = None,
    prints: DataFrame | None = None,
    failed: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """Evidence rows for `probes`, with what is needed to run them again: parameters and tolerances.

    The full exception sets are always stored, in `sink` or in a folder of the shared one, and no set has more rows than
    its data. `prints` may hold the stored fingerprints of the views (see `view_fingerprints`); otherwise they are made here.
    A check that meets a value it cannot judge fails without disturbing the others of its run: it gives no evidence and is
    named in `failed` with the reason, or raises an error if no such list is given.
    """
    spark = next(iter(views.values())).sparkSession
    run_id = run_id or uuid.uuid4().hex
    checks = {probe.id: build_check(views, probe, tolerances) for probe in probes}
    sets = {p: c.exceptions() for p, c in checks.items() if not c.statistics_only}
    stored, found = {}, {}
    if sets:
        kept = write_exception_sets(sets, sink or f"{shared_folder(spark)}/exceptions", run_id)
        faults = kept.faults({p: checks[p].fault for p in sets if checks[p].fault is not None})
        reasons = [(p, f"execution error (ValueError): the amount {value!r} is no number") for p, value in faults.items()]
        if reasons and failed is None:
            raise ValueError("; ".join(f"{p}: {reason}" for p, reason in reasons))
        for p, reason in reasons:
            failed.append((p, reason))
            del checks[p], sets[p]
        probes = [p for p in probes if p.id in checks]
        if not probes:
            return declared(spark, S.EVIDENCE, [])
        found = kept.found({p: "pairs" for p in sets if checks[p].weight is not None})
        for p, check in list(checks.items()):
            if p in sets:
                own = kept.typed(p)
                told = declared(spark, "found decimal(38,0)", [(Decimal(found[p]),)])
                checks[p] = replace(check, exceptions=lambda own=own: own, counted=lambda told=told: told,
                                    first=None if check.pairs_of is None else lambda own=own, of=check.pairs_of: of(own))
                stored[p] = kept.path(p)
    if prints is None:
        prints = settle(view_fingerprints(views, [v for c in checks.values() for v in c.views]), "prints")
    told = lambda value: json.dumps(value, sort_keys=True, ensure_ascii=False, default=str)
    about = declared(spark, "probe_id string, claim_id string, template string, stored string, params string, tolerances string",
                     [(p.id, p.claim_id, p.template, stored.get(p.id), told(p.params),
                       told(merged_tolerances(p.template, tolerances))) for p in probes])
    clean = {p for p, n in found.items() if n == 0}
    rows = about.join(probe_outcomes(checks, prints, clean), "probe_id").join(_stamps(prints, checks), "probe_id")
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(run_id), "probe_id"), 256).alias("id"),
        F.lit(S.PROBE_RESULT).alias("type"), F.lit(S.PROBE).alias("actor"), "claim_id", "probe_id", "verdict",
        none(S.SCOPE).alias("scope"), none("string").alias("statement"), "population", "exception_count",
        "exception_samples",
        F.when(F.col("exception_count") > 0, F.col("stored")).alias("result_ref"),
        F.create_map(*[x for name in ("template", "summary", "params", "tolerances", "exceptions_found")
                       for x in (F.lit(name), F.col(name).cast("string"))]).alias("payload"),
        "source_fingerprints", F.lit(False).alias("stale"), F.current_timestamp().alias("created_at"))


def draft_questions(evidence: DataFrame, probes: Sequence[S.Probe], stored: DataFrame | None = None) -> DataFrame:
    """Questions for people, one per distinct text, from probe results that did not pass."""
    spark = evidence.sparkSession
    texts = declared(spark, "probe_id string, question string",
                     [(p.id, question_text(p.template, p.params)) for p in probes])
    raised = (
        evidence.filter((F.col("type") == S.PROBE_RESULT) & (F.col("verdict") != V.PASS))
        .join(texts.filter(F.col("question").isNotNull()), "probe_id")
    )
    drafts = raised.groupBy("question").agg(
        F.min_by("claim_id", F.struct("created_at", "id")).alias("claim_id"))
    if stored is not None:
        drafts = drafts.join(stored.select("question"), "question", "left_anti")
    return drafts.select(
        F.sha2("question", 256).alias("id"), "question",
        F.array_compact(F.array("claim_id")).alias("claim_ids"))


def verdict_counts(evidence: DataFrame) -> DataFrame:
    return evidence.filter(F.col("verdict").isNotNull()).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("type", "actor").agg(F.count(F.lit(1)).alias("n"))


def template_counts(probes: DataFrame) -> DataFrame:
    return probes.groupBy("template").agg(F.count(F.lit(1)).alias("n"))
