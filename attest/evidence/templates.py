"""Registry of probe templates: how parameters become a check, its verdict, its report order and its question.

A template turns named views and parameters into a ``Check``: the exceptions as a DataFrame, the table whose rows are
the population, and the verdict. Adding a template means adding one entry here.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from inspect import Parameter, signature
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.evidence import verdicts as V
from attest.evidence.tables import MAX_SAMPLES
from attest.functions.canonical import comparison_key
from attest.operators import probes as P
from attest.session import settle


@dataclass(frozen=True)
class Check:
    """One instantiated probe.

    `exceptions` gives the full set, never more rows than the data has. Where each of its rows stands for many pairs of
    rows, `weight` is their number and `pairs_of` gives the first pairs behind a set; `counted` and `first` are the same for
    the set of this check: its size as one row ``(found)`` and its first rows.
    """

    views: tuple[str, ...]
    population: DataFrame
    exceptions: Callable[[], DataFrame]
    order: tuple[Column, ...]
    verdict: Column
    summary: Column
    # A statistics row decides the verdict but is no exception itself.
    statistics_only: bool = False
    weight: Column | None = None
    counted: Callable[[], DataFrame] | None = None
    first: Callable[[], DataFrame] | None = None
    pairs_of: Callable[[DataFrame], DataFrame] | None = None
    # The view whose rows are the population, unless the population is something else.
    driving: str | None = None
    # A column of the set that is not NULL where a row could not be judged: then the check has failed.
    fault: str | None = None


Views = Mapping[str, DataFrame]
Params = Mapping[str, Any]
Tolerances = Mapping[str, float]


@dataclass(frozen=True)
class ProbeTemplate:
    """A builder and what is known about its parameters.

    The builder's keyword parameters are the template's contract: those without a default are required, the others are
    optional. `columns` says which views a column parameter must exist on, `one_of` names optional ones of which exactly one
    must be given.
    """

    build: Callable[..., Check]
    question: str | None = None
    tolerances: Tolerances = field(default_factory=dict)
    domain: str | None = None
    columns: Mapping[str, str | tuple[str, ...]] = field(default_factory=dict)
    one_of: tuple[str, ...] = ()

    def _keywords(self) -> list[Parameter]:
        return [x for x in signature(self.build).parameters.values() if x.kind is Parameter.KEYWORD_ONLY]

    @property
    def required(self) -> list[str]:
        return [x.name for x in self._keywords() if x.default is Parameter.empty]

    @property
    def optional(self) -> list[str]:
        return [x.name for x in self._keywords() if x.default is not Parameter.empty and x.name not in self.one_of]

    @property
    def column_views(self) -> list[tuple[str, str]]:
        """(column parameter, view parameter) pairs."""
        return [(c, v) for c, views in self.columns.items() for v in ((views,) if isinstance(views, str) else views)]

    def check(self, views: Views, params: Params, tolerances: Tolerances) -> Check:
        known = {x.name for x in self._keywords()}
        return self.build(views, tolerances, **{k: v for k, v in params.items() if k in known})


def _view(views: Views, name: str) -> DataFrame:
    if '"' in name or "`" in name:
        raise ValueError(f"illegal identifier: {name!r}")
    if name not in views:
        raise ValueError(f"unknown view: {name!r}")
    return views[name]


def _known(rows: DataFrame, *columns: str) -> None:
    """Refuse unknown columns of checks whose work begins only when their exceptions are asked for."""
    for column in columns:
        comparison_key(rows, column)


def _count() -> Column:
    return F.col("exception_count")


def _groups_summary() -> Column:
    return F.when(_count() == 0, "no violations").otherwise(
        F.concat(_count().cast("string"), F.lit(" violating groups")))


def _plain(views: tuple[str, ...], driving: DataFrame, exceptions: DataFrame, order: list[Column]) -> Check:
    """A check over the rows of its first view."""
    return Check(views, driving.agg(F.count(F.lit(1)).alias("population")), lambda: exceptions, tuple(order),
                 V.empty_expected(_count()), _groups_summary(), driving=views[0])


def _pairs(views: tuple[str, ...], driving: DataFrame, exceptions: Callable[[], DataFrame], order: list[Column],
           pairs_of: Callable[[DataFrame], DataFrame]) -> Check:
    """A check whose violations are pairs of rows; each row of its set says in `pairs` how many it stands for."""
    kept: list[DataFrame] = []

    def stored() -> DataFrame:
        if not kept:
            kept.append(settle(exceptions(), "pair-rows"))
        return kept[0]

    return Check(views, driving.agg(F.count(F.lit(1)).alias("population")), exceptions, tuple(order),
                 V.empty_expected(_count()), _groups_summary(), weight=F.col("pairs"), pairs_of=pairs_of, driving=views[0],
                 counted=lambda: (kept[0] if kept else exceptions()).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("found")),
                 first=lambda: pairs_of(stored()))


def _anti_join(views: Views, tol: Tolerances, *, child: str, parent: str, child_column: str, parent_column: str, canonical: bool = True,
               expectation: str = V.EXPECT_EMPTY) -> Check:
    child_rows, parent_rows = _view(views, child), _view(views, parent)
    found = P.anti_join(child_rows, child_column, parent_rows, parent_column, canonical)
    base = _plain((child, parent), child_rows, found, [F.col("occurrences").desc(), F.col("value")])
    if expectation != V.EXPECT_REPORT:
        return base
    summary = F.when(_count() == 0, "no orphans").otherwise(
        F.concat(_count().cast("string"), F.lit(" orphaned groups — needs a domain answer")))
    return replace(base, verdict=V.report_only(_count()), summary=summary)


def _duplicate(views: Views, tol: Tolerances, *, table: str, key_columns: Sequence[str]) -> Check:
    table_rows = _view(views, table)
    keys = list(key_columns)
    return _plain((table,), table_rows, P.duplicate(table_rows, keys),
                  [F.col("occurrences").desc(), *[F.col(k) for k in keys]])


def _coverage(views: Views, tol: Tolerances, *, table: str, unit_column: str, expected: Sequence[Any], canonical: bool = True) -> Check:
    table_rows = _view(views, table)
    expected = list(expected)
    found = P.coverage(table_rows, unit_column, expected, canonical)
    n = len(expected)
    summary = (
        F.when(_count() == 0, f"all {n} units covered")
        .when(_count() >= n, "no expected unit is covered")
        .otherwise(F.concat(F.lit("partial coverage: "), _count().cast("string"),
                            F.lit(f" of {n} units missing — a finding, not an error")))
    )
    asked = P.expected_units(table_rows, expected).agg(F.count(F.lit(1)).alias("population"))
    return Check((table,), asked, lambda: found, (F.col("missing_unit"),), V.coverage_verdict(_count(), n), summary)


def _cardinality(views: Views, tol: Tolerances, *, child: str, parent: str, child_column: str, parent_column: str) -> Check:
    child_rows, parent_rows = _view(views, child), _view(views, parent)
    stats = P.cardinality(child_rows, child_column, parent_rows, parent_column)
    columns = {name: F.col(name) for name in stats.columns}
    verdict = V.cardinality_verdict(columns, tol["min_containment"], tol["min_uniqueness"])
    figures = F.format_string(
        "containment=%.3f, parent uniqueness=%.3f",
        V.containment(columns["overlap"], columns["child_distinct"]),
        V.uniqueness(columns["parent_distinct"], columns["parent_rows"]))
    summary = F.when(verdict == V.PASS, figures).otherwise(F.concat(F.lit("not reference-shaped: "), figures))
    return Check((child, parent), child_rows.agg(F.count(F.lit(1)).alias("population")), lambda: stats, (), verdict,
                 summary, statistics_only=True, driving=child)


def _attribute_contradiction(views: Views, tol: Tolerances, *, left: str, right: str, left_key: str, right_key: str,
                             left_attr: str, right_attr: str, canonical: bool = True) -> Check:
    left_rows, right_rows = _view(views, left), _view(views, right)
    _known(left_rows, left_key, left_attr)
    _known(right_rows, right_key, right_attr)
    args = (left_rows, right_rows, left_key, right_key, left_attr, right_attr)
    return _pairs((left, right), left_rows, lambda: P.contradictions(*args, canonical),
                  [F.col("key"), F.col("side"), F.col("value")], lambda found: P.first_contradictions(found, MAX_SAMPLES))


def _reconciliation(views: Views, tol: Tolerances, *, left: str, right: str, left_group_expr: str, right_group_expr: str,
                    left_measure_expr: str, right_measure_expr: str, left_where: str | None = None,
                    right_where: str | None = None) -> Check:
    left_rows, right_rows = _view(views, left), _view(views, right)
    found = P.reconciliation(left_rows, right_rows, left_group_expr, right_group_expr, left_measure_expr,
                             right_measure_expr, tol["absolute"], left_where, right_where)
    return _plain((left, right), left_rows, found, [F.abs("diff").desc(), F.col("grp")])


def _validity_join(views: Views, tol: Tolerances, *, table: str, key_column: str, valid_from: str, valid_to: str) -> Check:
    table_rows = _view(views, table)
    _known(table_rows, key_column, valid_from, valid_to)
    args = (table_rows, key_column, valid_from, valid_to)
    return _pairs((table,), table_rows, lambda: P.validity_overlaps(*args),
                  [F.col("key"), F.col("valid_from"), F.col("valid_to")], lambda found: P.first_validity_overlaps(found, MAX_SAMPLES))


def _range_join(views: Views, tol: Tolerances, *, table: str, value_column: str, ranges: str, range_from: str, range_to: str,
                where: str | None = None) -> Check:
    table_rows, ranges_rows = _view(views, table), _view(views, ranges)
    _known(table_rows, value_column)
    _known(ranges_rows, range_from, range_to)
    kept: list[DataFrame] = []

    def found() -> DataFrame:
        if not kept:
            kept.append(P.range_join(table_rows, value_column, ranges_rows, range_from, range_to, where))
        return kept[0]

    return replace(_plain((table, ranges), table_rows, table_rows, [F.col("value")]), exceptions=found)


def _decode(views: Views, tol: Tolerances, *, encoded: str, decode: str, key: str, column: str, pairs: Sequence[Any]) -> Check:
    encoded_rows, table = _view(views, encoded), _view(views, decode)
    found = P.decode(encoded_rows, table, key, pairs)
    return _plain((encoded, decode), encoded_rows, found, [F.col("level"), F.col("code")])


def _balance(views: Views, tol: Tolerances, *, journal: str, amount: str, group_column: str | None = None,
             group_expr: str | None = None) -> Check:
    journal_rows = _view(views, journal)
    group = f"`{group_column}`" if group_column else group_expr
    found = P.balance(journal_rows, amount, group, tol["absolute"], contained=True)
    return replace(_plain((journal,), journal_rows, found, [F.abs("balance").desc(), F.col("grp")]), fault="fault")


def _subledger(views: Views, tol: Tolerances, *, subledger: str, subledger_amount: str, journal: str, journal_amount: str, account: str,
               accounts: Sequence[Any]) -> Check:
    subledger_rows, journal_rows = _view(views, subledger), _view(views, journal)
    found = P.subledger_equals_gl(subledger_rows, subledger_amount, journal_rows, journal_amount, account,
                                  accounts, tol["absolute"], contained=True)
    return replace(_plain((subledger, journal), subledger_rows, found, [F.col("diff")]), fault="fault")


def _ic_symmetry(views: Views, tol: Tolerances, *, left: str, right: str, left_period: str, right_period: str) -> Check:
    left_rows, right_rows = _view(views, left), _view(views, right)
    found = P.ic_symmetry(left_rows, right_rows, left_period, right_period)
    return _plain((left, right), left_rows, found, [F.col("period")])


# Default tolerances, domains and the questions drafted when a check does not pass.
TEMPLATES: dict[str, ProbeTemplate] = {
    "anti_join": ProbeTemplate(
        _anti_join,
        "Fachfrage: {child} hat Einträge ohne Gegenstück in {parent} — Datenschnitt, Wartezustand oder Fehler?",
        columns={"child_column": "child", "parent_column": "parent"}),
    "duplicate": ProbeTemplate(
        _duplicate,
        "Fachfrage: {table} enthält Dubletten über ({key_list}) — welche Sätze sind führend?",
        columns={"key_columns": "table"}),
    "grain": ProbeTemplate(
        _duplicate,
        "Fachfrage: {table} ist nicht eindeutig auf der angenommenen Körnung ({key_list}) — was ist die echte Körnung?",
        columns={"key_columns": "table"}),
    "coverage": ProbeTemplate(
        _coverage,
        "Fachfrage: {table} deckt erwartete Einheiten nicht vollständig ab — Datenschnitt oder Lücke?",
        columns={"unit_column": "table"}),
    "cardinality": ProbeTemplate(_cardinality, None, {"min_containment": 0.95, "min_uniqueness": 0.99},
        columns={"child_column": "child", "parent_column": "parent"}),
    "attribute_contradiction": ProbeTemplate(
        _attribute_contradiction,
        "Fachfrage: {left} und {right} widersprechen sich in verknüpften Attributen — welche Quelle führt?",
        columns={"left_key": "left", "left_attr": "left", "right_key": "right", "right_attr": "right"}),
    "reconciliation": ProbeTemplate(
        _reconciliation,
        "Fachfrage: {left} und {right} stimmen je Gruppe nicht überein — welche Abgrenzung fehlt?",
        {"absolute": 0.01}),
    "validity_join": ProbeTemplate(
        _validity_join,
        "Fachfrage: {table} hat überlappende Gültigkeitszeiträume — welche Version gilt?",
        columns={"key_column": "table", "valid_from": "table", "valid_to": "table"}),
    "range_join": ProbeTemplate(
        _range_join,
        "Fachfrage: Werte aus {table} fallen in keinen oder mehrere Bereiche von {ranges} — wie ist die Zuordnung gemeint?",
        columns={"value_column": "table", "range_from": "ranges", "range_to": "ranges"}),
    "decode": ProbeTemplate(
        _decode,
        "Fachfrage: Positionscodes in {encoded} decodieren nicht eindeutig gegen {decode} — stimmt die Positionslogik?",
        columns={"key": ("encoded", "decode")}),
    "balance": ProbeTemplate(
        _balance,
        "Fachfrage: {journal} ist je Gruppe nicht ausgeglichen — fehlt eine Gegenbuchung?",
        {"absolute": 0.01}, "finance",
        columns={"amount": "journal", "group_column": "journal"}, one_of=("group_column", "group_expr")),
    "subledger_equals_gl": ProbeTemplate(
        _subledger,
        "Fachfrage: Nebenbuch {subledger} weicht vom Hauptbuch {journal} ab — welche Posten fehlen?",
        {"absolute": 0.01}, "finance",
        columns={"subledger_amount": "subledger", "journal_amount": "journal", "account": "journal"}),
    "ic_symmetry": ProbeTemplate(
        _ic_symmetry,
        "Fachfrage: Intercompany-Buchungen sind zwischen {left} und {right} nicht symmetrisch — wo fehlt die Gegenseite?",
        {}, "finance",
        columns={"left_period": "left", "right_period": "right"}),
}


def merged_tolerances(template: str, overrides: Mapping[str, Any] | None) -> dict[str, float]:
    """Template defaults with configured overrides; a plain number overrides the absolute tolerance."""
    override = (overrides or {}).get(template, {})
    if not isinstance(override, Mapping):
        override = {"absolute": override}
    return {**TEMPLATES[template].tolerances, **override}


def question_text(template: str, params: Params) -> str | None:
    """The question a non-passing run raises, or None for templates that raise none."""
    text = TEMPLATES[template].question
    if text is None:
        return None
    words = {k: v for k, v in params.items() if isinstance(v, (str, int, float))}
    if "key_columns" in params:
        words["key_list"] = ", ".join(f'"{c}"' for c in params["key_columns"])
    return text.format(**words)
