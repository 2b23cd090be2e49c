"""Schemas and fixed vocabulary of the metadata tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# Statuses of a claim, authors, evidence types, sample bound.
INFERRED = "inferred"
TESTED = "tested"
CONTRADICTED = "contradicted"
UNRESOLVED = "unresolved"
CONFIRMED = "business-confirmed"
STATUSES = (INFERRED, TESTED, CONTRADICTED, UNRESOLVED, CONFIRMED)
SETTLED = (TESTED, CONFIRMED)

AI, PROBE, HUMAN, SYSTEM = "ai", "probe", "human", "system"
ACTORS = (AI, PROBE, HUMAN, SYSTEM)

PROBE_RESULT = "probe_result"
DOCUMENT_ANCHOR = "document_anchor"
CONFIRMATION = "confirmation"
TESTIMONIAL = "testimonial"
DECLARATION = "declaration"
EVIDENCE_TYPES = (PROBE_RESULT, DOCUMENT_ANCHOR, CONFIRMATION, TESTIMONIAL, DECLARATION)

MAX_SAMPLES = 20

SCOPE = "struct<entity:string,period:string,segment:string>"
VALIDITY = "struct<valid_from:string,valid_to:string>"

CLAIMS = (
    f"id string, claim_type string, statement string, created_by string, predicate string, params string, "
    f"scope {SCOPE}, validity {VALIDITY}, source_ids array<string>, evidence_ids array<string>, "
    "depends_on array<string>, derived_from string, derived_from_evidence string, role string, "
    "binding map<string,string>, term string, definition string, created_at timestamp"
)
EVIDENCE = (
    f"id string, type string, actor string, claim_id string, probe_id string, verdict string, scope {SCOPE}, "
    "statement string, population bigint, exception_count bigint, "
    "exception_samples array<map<string,string>>, result_ref string, payload map<string,string>, "
    "source_fingerprints map<string,string>, stale boolean, created_at timestamp"
)
PROBES = "id string, template string, claim_id string, roles array<string>, params string, created_at timestamp"
QUESTIONS = ("id string, question string, sql string, result_ref string, claim_ids array<string>, stale boolean, "
             "created_at timestamp")
SOURCES = "id string, name string, kind string, location string, fingerprint map<string,string>"
ROLES = "role string, definition string, decided_by string"


@dataclass(frozen=True)
class Probe:
    """One check to run: a template, its parameters and the claim it is meant to falsify."""

    id: str
    template: str
    params: dict[str, Any] = field(default_factory=dict)
    claim_id: str | None = None
    roles: tuple[str, ...] = ()
