"""Queries over the test tables: importing this package registers all of them."""

from workload import bookkeeping, measures, probes, profiling, rule_checks, stores  # noqa: F401
from workload.base import ORACLES, QUERIES  # noqa: F401
