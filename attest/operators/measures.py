"""Measures over ledgers, invoices, activities and versioned master data.

Amounts are summed in the type they come in; pass decimals where sums must not depend on row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.frames import union_all
from attest.functions.intervals import day_number, stab_join
from attest.session import settle

# Revenue accounts, the ranges netted or excluded, fallback rate, rebate terms, open end of a version.
REVENUE = (4000, 4999)
REBATES = (4800, 4809)
INTERCOMPANY = (4300, 4309)
EXTERNAL_ACCOUNTS = (4100, 4200)
CONTRA_ACCOUNTS = (4800, 4850)
FALLBACK_RATES = {"USD": "0.92"}
REBATE_THRESHOLD = 500_000
REBATE_SHARE = "0.02"
OPEN_END = "9999-12-31"

# Keys with more versions than this are looked up over blocks, all others are swept by one task each.
HOT_KEY = 50_000


def revenue_range(ledger: DataFrame, without: tuple[int, int] = REBATES, by: Sequence[str] = ("entity",)) -> DataFrame:
    """Revenue per group: credit postings of the revenue range, without one sub-range, as a positive figure."""
    account = F.col("account_id")
    kept = ledger.filter(account.between(*REVENUE) & ~account.between(*without))
    return kept.groupBy(*by).agg((-F.sum("amount")).alias("revenue"))


def net_revenue(ledger: DataFrame, by: Sequence[str] = ("entity",), amount: str = "amount") -> DataFrame:
    """External revenue less contra accounts, in one pass."""
    account = F.col("account_id")
    part = lambda accounts: F.coalesce(
        F.sum(F.when(account.isin(*accounts), F.col(amount))), F.lit(0))
    return ledger.filter(account.isin(*EXTERNAL_ACCOUNTS, *CONTRA_ACCOUNTS)).groupBy(*by).agg(
        (-part(EXTERNAL_ACCOUNTS) - part(CONTRA_ACCOUNTS)).alias("net_revenue"))


def convert(ledger: DataFrame, rates: DataFrame, target: str = "EUR", rate_type: str = "M", currency: str = "currency",
            fallback: Mapping[str, str] = FALLBACK_RATES) -> DataFrame:
    """Ledger rows with ``rate``, ``rate_state`` and ``converted``, by the rate of their period and currency.

    `rates` is ``(period, from_currency, to_currency, rate_type, rate_value)``. Rows in the target currency pass with
    rate 1 (state ``own``). A pair without a rate in its period takes the declared fallback of its currency
    (``fallback``) or has none (``missing``); several different rates of one period and pair are no rate (``ambiguous``).
    Rows without a rate have a NULL amount and are counted by `unconverted`.
    """
    kind = rates.schema["rate_value"].dataType
    chosen = rates.filter((F.col("to_currency") == target) & (F.col("rate_type") == rate_type))
    # One row per period and pair; stored first so that its size is known and the ledger is not shuffled for the lookup.
    one = settle(chosen.groupBy("period", F.col("from_currency").alias(currency)).agg(
        F.min("rate_value").alias("__low"), F.max("rate_value").alias("__high")), "rates")
    own = F.col(currency) == target
    spare = F.lit(None).cast(kind)
    for code, value in fallback.items():
        spare = F.when(F.col(currency) == code, F.lit(value).cast(kind)).otherwise(spare)
    found, same = F.col("__low").isNotNull(), F.col("__low") == F.col("__high")
    state = F.when(own, "own").when(found & same, "rate").when(found, "ambiguous").when(spare.isNotNull(), "fallback").otherwise("missing")
    rate = F.when(own, F.lit(1).cast(kind)).when(found & same, F.col("__low")).when(~found, spare)
    return ledger.join(one, ["period", currency], "left").withColumns({"rate": rate, "rate_state": state}).drop(
        "__low", "__high").withColumn("converted", F.col("amount") * F.col("rate"))


def unconverted(rows: DataFrame, currency: str = "currency") -> DataFrame:
    """``(period, currency, rate_state, n)``: converted rows that found no rate, or several."""
    return rows.filter(F.col("rate").isNull()).groupBy("period", currency, "rate_state").agg(F.count(F.lit(1)).alias("n"))


def convert_totals(totals: DataFrame, rates: DataFrame, value: str, target: str = "EUR", rate_type: str = "M") -> DataFrame:
    """Totals with ``currency`` converted at the average rate of all periods; the target currency stays as it is and a
    currency without rates has a NULL amount."""
    average = rates.filter((F.col("to_currency") == target) & (F.col("rate_type") == rate_type)).groupBy(
        F.col("from_currency").alias("currency")).agg(
        (F.sum("rate_value").cast("double") / F.count("rate_value")).cast("decimal(18,6)").alias("average_rate"))
    factor = F.when(F.col("currency") == target, F.lit(1).cast("decimal(18,6)")).otherwise(F.col("average_rate"))
    return totals.join(average, "currency", "left").withColumn("converted", F.round(F.col(value) * factor, 2)).drop("average_rate")


def group_total(parts: DataFrame, value: str) -> DataFrame:
    return parts.agg(F.sum(value).alias("group_total"))


def compare_measures(computed: DataFrame, expected: DataFrame, tolerance: float) -> DataFrame:
    """``(measure, part, computed, expected)`` further apart than the tolerance; a missing figure counts as zero."""
    both = computed.select("measure", "part", F.col("value").alias("computed")).join(
        expected.select("measure", "part", F.col("value").alias("expected")), ["measure", "part"], "full_outer")
    gap = F.coalesce("computed", F.lit(0)) - F.coalesce("expected", F.lit(0))
    return both.filter(F.abs(gap) > F.lit(tolerance))


def period_balance(ledger: DataFrame, known_breaks: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``(entity, period, balance)`` that do not close, without the expected breaks ``(entity, period)``."""
    open_periods = ledger.groupBy("entity", "period").agg(F.sum("amount").alias("balance")).filter(
        F.abs("balance") > F.lit(tolerance))
    return open_periods.join(known_breaks.select("entity", "period"), ["entity", "period"], "left_anti")


def subledger_by_entity(subledger: DataFrame, ledger: DataFrame, account: int, tolerance: float = 0.01) -> DataFrame:
    """Entities whose subledger total differs from the control account; one shuffle for both sides."""
    zero = F.lit(0).cast(subledger.schema["amount"].dataType)
    rows = union_all([
        subledger.select("entity", F.col("amount").alias("s"), zero.alias("g")),
        ledger.filter(F.col("account_id") == account).select("entity", zero.alias("s"), F.col("amount").alias("g")),
    ])
    return rows.groupBy("entity").agg(F.sum("s").alias("subledger_total"), F.sum("g").alias("control_total")).filter(
        F.abs(F.col("subledger_total") - F.col("control_total")) > F.lit(tolerance))


def mirrored_accounts(ledger: DataFrame, left: tuple[str, int], right: tuple[str, int], tolerance: float = 0.01) -> DataFrame:
    """Periods in which the mirrored (entity, account) pairs do not add up to zero."""
    is_left = (F.col("entity") == left[0]) & (F.col("account_id") == left[1])
    is_right = (F.col("entity") == right[0]) & (F.col("account_id") == right[1])
    side = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("amount"))), F.lit(0))
    return ledger.filter(is_left | is_right).groupBy("period").agg(
        side(is_left).alias("left_amount"), side(is_right).alias("right_amount")).filter(
        F.abs(F.col("left_amount") + F.col("right_amount")) > F.lit(tolerance))


def quarter_label(year: Column, quarter: Column, separator: str) -> Column:
    return F.concat(year.cast("string"), F.lit(separator), quarter.cast("string"))


def activity_days(activities: DataFrame, rep: str, moment: str) -> DataFrame:
    """Distinct days with activity per representative and quarter."""
    day = F.col(moment).cast("date")
    days = activities.select(F.col(rep).alias("rep_id"), day.alias("day")).distinct()
    return days.groupBy("rep_id", quarter_label(F.year("day"), F.quarter("day"), "-Q").alias("quarter")).agg(
        F.count(F.lit(1)).alias("activity_days"))


def activity_after_exit(activities: DataFrame, rep: str, moment: str, exits: DataFrame) -> DataFrame:
    """Activities dated after the representative left; `exits` is ``(rep_id, exit_date)``."""
    return activities.join(exits, F.col(rep) == F.col("rep_id")).filter(F.col(moment).cast("date") > F.col("exit_date"))


def point_in_time(facts: DataFrame, key: str, moment: str, versions: DataFrame, value: str, hot_key: int = HOT_KEY) -> DataFrame:
    """Facts with the value of the version valid at their date, NULL where none is.

    `versions` is ``(key, valid_from, valid_to, value)`` under the given names; open ends are NULL. If several versions
    hold, the earliest one counts. Each (key, day) is looked up once, however many facts share it.
    """
    day = F.col(moment).cast("date")
    asked = facts.select(F.col(key).alias("k"), day.alias("day")).filter(F.col("k").isNotNull() & F.col("day").isNotNull()).distinct()
    found = _held(asked, _spans(versions, key, value), hot_key).filter(F.col("v").isNotNull())
    return facts.withColumn("__day", day).join(
        found.select(F.col("k").alias(key), F.col("day").alias("__day"), F.col("v").alias(value)), [key, "__day"], "left").drop("__day")


def _spans(versions: DataFrame, key: str, value: str) -> DataFrame:
    """Versions that hold at least one day as ``(k, vf, vt, v)``, stored."""
    spans = versions.select(
        F.col(key).alias("k"), F.col("valid_from").cast("date").alias("vf"),
        F.coalesce(F.col("valid_to").cast("date"), F.lit(OPEN_END).cast("date")).alias("vt"), F.col(value).alias("v"))
    return settle(spans.filter(F.col("k").isNotNull() & (F.col("vf") <= F.col("vt"))), "versions")


def _held(asked: DataFrame, spans: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """`asked`, ``(k, day)`` once each and further columns, with the value `v` of the earliest version that holds.

    Where the versions of a key follow each other without overlap, the last one that has begun is the only one that can
    hold, so that one sort of the days and versions of a key answers all its days. Keys whose versions overlap, and those
    with more than `hot_key` versions, are looked up interval by interval or over blocks (``stab_join``).
    """
    if asked.schema["k"].dataType != spans.schema["k"].dataType:
        return _looked_up(asked, spans)
    earlier = Window.partitionBy("k").orderBy("vf", "vt").rowsBetween(Window.unboundedPreceding, -1)
    hot = settle(spans.groupBy("k").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_key).select("k"), "hot")
    some = spans if hot.isEmpty() else spans.join(hot, "k", "left_anti")
    mixed = some.withColumn("__end", F.max("vt").over(earlier)).filter(F.col("vf") <= F.col("__end")).select("k").distinct()
    apart = settle(hot.unionByName(mixed), "apart")
    if apart.isEmpty():
        return _last_begun(asked, spans)
    plain, other = ([df.join(apart, "k", how) for df in (asked, spans)] for how in ("left_anti", "left_semi"))
    return _last_begun(*plain).unionByName(_looked_up(*other))


def _last_begun(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """``_held`` for keys whose versions do not overlap."""
    starts = spans.select("k", F.col("vf").alias("__at"), F.lit(0).alias("__kind"), F.struct("vt", "v").alias("__begun"))
    days = asked.withColumns({"__at": F.col("day"), "__kind": F.lit(1), "__begun": F.lit(None).cast(starts.schema["__begun"].dataType)})
    so_far = Window.partitionBy("k").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = days.unionByName(starts, allowMissingColumns=True).withColumn("__last", F.last("__begun", ignorenulls=True).over(so_far))
    return last.filter("__kind = 1").withColumn("v", F.when(F.col("__last")["vt"] >= F.col("day"), F.col("__last")["v"])).drop(
        "__at", "__kind", "__begun", "__last")


def _looked_up(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """``_held`` for any versions."""
    points = asked.select("k", "day").filter(F.col("k").isNotNull() & F.col("day").isNotNull())
    hits = stab_join(points, day_number(F.col("day")), spans, day_number(F.col("vf")), day_number(F.col("vt")), ["k"])
    return asked.join(hits.groupBy("k", "day").agg(F.min_by("v", F.struct("vf", "vt", "v")).alias("v")), ["k", "day"], "left")


def customer_months(lines: DataFrame, versions: DataFrame, new_ids: DataFrame, intercompany: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Revenue and margin per customer, key account and month.

    `lines` is ``(customer_id, day, revenue, cost)``; `new_ids` ``(old_id, new_id)`` replaces migrated customers and
    `intercompany` ``(customer_id)`` is left out. Lines are summed per customer and day before any look-up of versions, which
    then takes each day of a customer once, with its sums.
    """
    current = lines.join(new_ids.select(F.col("old_id").alias("customer_id"), "new_id"), "customer_id", "left").withColumn(
        "customer_id", F.coalesce("new_id", "customer_id")).withColumn("day", F.col("day").cast("date"))
    daily = current.groupBy("customer_id", "day").agg(
        F.sum("revenue").alias("revenue"), F.sum(F.col("revenue") - F.col("cost")).alias("margin"))
    external = daily.join(intercompany.select("customer_id").distinct(), "customer_id", "left_anti")
    spans = _spans(versions, "customer_id", "key_account")
    placed = _held(external.withColumnRenamed("customer_id", "k"), spans, hot_key).withColumnsRenamed({"k": "customer_id", "v": "key_account"})
    return placed.groupBy("customer_id", "key_account", F.date_format("day", "yyyy-MM").alias("period")).agg(
        F.sum("revenue").alias("revenue"), F.sum("margin").alias("margin"))


def plan_vs_actual(plan: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned and actual amounts per key with the variance; one shuffle for both sides, missing sides count as zero."""
    kind = plan.schema["amount"].dataType
    zero = F.lit(0).cast(kind)
    rows = union_all([
        plan.select(*keys, F.col("amount").alias("p"), zero.alias("a")),
        actual.select(*keys, zero.alias("p"), F.col("amount").alias("a")),
    ])
    return rows.groupBy(*keys).agg(F.sum("p").alias("planned"), F.sum("a").alias("actual")).withColumn(
        "variance", F.col("planned") - F.col("actual"))


def rebate_accrual(invoices: DataFrame, threshold: float = REBATE_THRESHOLD, share: str = REBATE_SHARE) -> DataFrame:
    """Monthly rebate of key accounts whose year exceeds the threshold; `invoices` is ``(key_account, day, amount)``.

    The year is summed over at most twelve monthly rows per key account.
    """
    monthly = invoices.filter(F.col("key_account").isNotNull()).groupBy(
        "key_account", F.year("day").alias("year"), F.date_format("day", "yyyy-MM").alias("period")).agg(
        F.sum("amount").alias("month_volume"))
    year = Window.partitionBy("key_account", "year")
    rebate = F.round(F.col("month_volume").cast("decimal(18,2)") * F.lit(share).cast("decimal(6,4)"), 2)
    return monthly.withColumn("year_volume", F.sum("month_volume").over(year)).filter(
        F.col("year_volume") > F.lit(threshold)).withColumn("rebate", rebate).filter(F.col("rebate") != 0)


def quarterly_revenue(ledger: DataFrame, accounts: Sequence[int] = EXTERNAL_ACCOUNTS) -> DataFrame:
    """Revenue per quarter from period texts ``YYYY-MM``."""
    month = F.substring("period", 6, 2).cast("int")
    label = quarter_label(F.substring("period", 1, 4), F.floor((month - 1) / 3) + 1, " Q")
    return ledger.filter(F.col("account_id").isin(*accounts)).groupBy(label.alias("quarter")).agg(
        (-F.sum("amount")).alias("revenue"))


def unsigned_report(ledger: DataFrame, journal: str) -> DataFrame:
    """Monthly totals per account as reports show them: always positive, with a debit (S) or credit (H) flag."""
    return ledger.groupBy("period", F.col("account_id").alias("account")).agg(F.sum("amount").alias("total")).select(
        "period", "account", F.abs(F.round("total", 2)).alias("amount"),
        F.when(F.col("total") < 0, "H").otherwise("S").alias("flag"), F.lit(journal).alias("journal"))


def without_counterpart(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows no other row refers to (open orders without an invoice)."""
    return rows.join(others.select(F.col(other_key).alias(key)).distinct(), key, "left_anti")


def repeated_references(rows: DataFrame, key: str, at_least: int = 2) -> DataFrame:
    """Keys that several rows refer to (orders with several invoices)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)


def missing_units(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Units of a list that never occur; both frames have the same single column."""
    return expected.subtract(present)


def reference_forms(activities: DataFrame, reference: str, old_ids: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """How customer references are written: ``(form, n)`` for old ids, names and prospect codes.

    References are counted per value first, so that a frequent one is looked up once.
    """
    seen = activities.groupBy(F.col(reference).cast("string").alias("ref")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda df, form: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(form).alias("form"), "n")
    known = lambda ids: ids.select(F.col(ids.columns[0]).cast("string").alias("ref")).distinct()
    return union_all([
        total(seen.join(known(old_ids), "ref", "left_semi"), "old_id"),
        total(seen.join(known(names), "ref", "left_semi"), "name"),
        total(seen.filter(F.col("ref").startswith(prefix)), "prospect"),
    ])


def open_items(items: DataFrame) -> DataFrame:
    """``(unapplied_cash, unpaid)``: payments without invoice and invoices without payment."""
    invoice, payment = F.col("invoice_reference").isNotNull(), F.col("payment_reference").isNotNull()
    return items.agg(F.count_if(~invoice & payment).alias("unapplied_cash"), F.count_if(invoice & ~payment).alias("unpaid"))


def credit_notes(legacy: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """Credit notes of the table that was given up and of the type that replaced it, as two findings."""
    return {"legacy_credit_notes": legacy, "new_credit_notes": current}


def periods_without_rate(rates: DataFrame, rate_type: str) -> DataFrame:
    """``(period)`` of the months that have rates, but none of `rate_type`: one aggregation over the rates."""
    return rates.groupBy("period").agg(F.bool_or(F.col("rate_type") == rate_type).alias("has")).filter(
        ~F.coalesce("has", F.lit(False))).select("period")


def project_postings(ledger: DataFrame, first_period: str) -> DataFrame:
    """Postings that name a project from a month on."""
    return ledger.filter((F.col("period") >= first_period) & F.col("project_id").isNotNull())


def anomaly_counts(findings: Mapping[str, DataFrame]) -> DataFrame:
    """``(finding, n)``: how many rows each finding has, in one job."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("finding"), "n")
                      for name, df in findings.items()])


def wrong_direction(documents: DataFrame, relative_error: float = 1e-4) -> DataFrame:
    """Documents whose local amount was multiplied by the rate where it should have been divided.

    `documents` has ``(doc_amount, local_amount, rate)``. Amounts that fit both readings are not reported.
    """
    doc, local, rate = (F.col(c).cast("double") for c in ("doc_amount", "local_amount", "rate"))
    near = lambda guess: F.abs(local - guess) <= F.lit(relative_error) * F.abs(local)
    return documents.filter((rate != 0) & near(doc * rate) & ~near(doc / rate))


def validity_gaps(versions: DataFrame, key: str) -> DataFrame:
    """``(key, gap_from, gap_to)``: days between versions of a key that no version covers.

    Per key and start day only the latest end matters, so a key has at most one row per calendar day when its rows are
    ordered.
    """
    ends = versions.select(
        F.col(key).alias("key"), F.col("valid_from").cast("date").alias("vf"),
        F.coalesce(F.col("valid_to").cast("date"), F.lit(OPEN_END).cast("date")).alias("vt"),
    ).groupBy("key", "vf").agg(F.max("vt").alias("vt"))
    ordered = Window.partitionBy("key").orderBy("vf")
    covered = F.max("vt").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("covered", covered).filter(F.date_add("covered", 1) < F.col("vf")).select(
        "key", F.date_add("covered", 1).alias("gap_from"), F.date_sub("vf", 1).alias("gap_to"))


def facts_in_gaps(gaps: DataFrame, facts: DataFrame, key: str, moment: str) -> DataFrame:
    """Gaps that facts still refer to, with the number of facts."""
    daily = facts.groupBy(F.col(key).alias("key"), F.col(moment).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    hits = stab_join(daily, day_number(F.col("day")), gaps, day_number(F.col("gap_from")), day_number(F.col("gap_to")), ["key"])
    return hits.groupBy("key", "gap_from", "gap_to").agg(F.sum("n").alias("facts"))
