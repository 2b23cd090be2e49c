"""Verdicts as expressions over exception counts; the data decides, nothing else does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes of a probe run.
PASS = "pass"
FAIL = "fail"
INCONCLUSIVE = "inconclusive"

# Expectations of a reference check.
EXPECT_EMPTY = "empty"
EXPECT_REPORT = "report"


def empty_expected(exceptions: Column) -> Column:
    """Any exception falsifies the rule."""
    return F.when(exceptions == 0, PASS).otherwise(FAIL)


def report_only(exceptions: Column) -> Column:
    """Exceptions are a finding for people to judge, never a failure."""
    return F.when(exceptions == 0, PASS).otherwise(INCONCLUSIVE)


def anti_join_verdict(exceptions: Column, expectation: str) -> Column:
    return report_only(exceptions) if expectation == EXPECT_REPORT else empty_expected(exceptions)


def coverage_verdict(missing: Column, expected: int) -> Column:
    """All covered passes, none covered fails, anything between stays open."""
    return F.when(missing == 0, PASS).when(missing >= expected, FAIL).otherwise(INCONCLUSIVE)


def containment(overlap: Column, child_distinct: Column) -> Column:
    return F.coalesce(F.try_divide(overlap.cast("double"), child_distinct.cast("double")), F.lit(0.0))


def uniqueness(parent_distinct: Column, parent_rows: Column) -> Column:
    return F.coalesce(F.try_divide(parent_distinct.cast("double"), parent_rows.cast("double")), F.lit(0.0))


def cardinality_verdict(stats: dict[str, Column], min_containment: float, min_uniqueness: float) -> Column:
    """A reference contains nearly all child keys and points to an identifying parent column."""
    contained = containment(stats["overlap"], stats["child_distinct"]) >= min_containment
    unique = uniqueness(stats["parent_distinct"], stats["parent_rows"]) >= min_uniqueness
    return F.when(contained & unique, PASS).otherwise(FAIL)


def exception_rate(exceptions: Column, population: Column) -> Column:
    """Share of exceptions; NULL for an empty or unknown population."""
    return F.try_divide(exceptions.cast("double"), population.cast("double"))
