"""Falsification checks as DataFrame operators.

Every function returns the rows that speak against a rule, with typed columns and without a sort; the report order of
each check is declared in the registry (``attest.evidence.templates``). Keys compare in canonical text form unless
``canonical_form=False`` asks for the raw rendering. Both sides of a key comparison are reduced to distinct keys before
they are shuffled together, so a key that fills a third of a table travels as one row per task.

SQL fragments (group and measure expressions, scopes) are row-level expressions over the named table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.canonical import comparison_key, lenient_bigint, plain_key
from attest.functions.frames import declared, running, running_inside, union_all
from attest.functions.intervals import WIDE_KEY, day_number, stab_join
from attest.session import settle

# Where open intervals end.
OPEN_END = "9999-12-31"

# Keys with more intervals than this are swept by several tasks, all others by one task each.
HOT_KEY = 50_000


def fragment(sql: str) -> Column:
    """A row-level SQL expression; identifiers may be written in double quotes or in backticks."""
    outside = sql.split("'")
    outside[::2] = [part.replace('"', "`") for part in outside[::2]]
    return F.expr("'".join(outside))


def _scoped(df: DataFrame, where: str | None) -> DataFrame:
    return df.filter(fragment(where)) if where else df


def _keys_of(*sides: tuple[DataFrame, str], canonical_form: bool = True) -> list[Column]:
    """Comparison keys of several columns: whole numbers where all of them hold such, else text.

    Whole numbers have one text each, so that they may be compared as they are and become text in the result.
    """
    plain = [plain_key(df, column) for df, column in sides]
    if all(key is not None for key in plain):
        return plain
    return [comparison_key(df, column, canonical_form) for df, column in sides]


def anti_join(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str,
              canonical_form: bool = True) -> DataFrame:
    """Child keys without a parent and how often they occur: ``(value, occurrences)``. NULL keys are ignored."""
    own, other = _keys_of((child, child_column), (parent, parent_column), canonical_form=canonical_form)
    keys = child.select(own.alias("value")).filter(F.col("value").isNotNull())
    known = parent.select(other.alias("value")).distinct()
    found = keys.groupBy("value").agg(F.count(F.lit(1)).alias("occurrences")).join(known, "value", "left_anti")
    return found.select(F.col("value").cast("string").alias("value"), "occurrences")


def duplicate(table: DataFrame, key_columns: Sequence[str], long_text: bool = False) -> DataFrame:
    """Key groups that hold more than one row: ``(*key_columns, occurrences)``; NULLs form a group like any value.

    With `long_text` (text keys only) digests are counted first and only texts whose digest repeats are shuffled and
    compared in full, so that unique documents never leave their task.
    """
    if long_text:
        if any(not isinstance(table.schema[c].dataType, T.StringType) for c in key_columns):
            raise ValueError("long_text needs text keys")
        keys = table.select(*[table[c] for c in key_columns])
        digest = F.sha2(F.to_json(F.struct(*key_columns), {"ignoreNullFields": "false"}), 256)
        digested = keys.withColumn("__digest", digest)
        repeated = digested.groupBy("__digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__digest")
        table = digested.join(settle(repeated, "repeated"), "__digest", "left_semi")
    return table.groupBy(*[table[c] for c in key_columns]).agg(F.count(F.lit(1)).alias("occurrences")).filter(
        F.col("occurrences") > 1)


def expected_units(table: DataFrame, expected: Sequence) -> DataFrame:
    if not expected:
        raise ValueError("coverage needs at least one expected unit")
    return declared(table.sparkSession, "missing_unit string", [(str(v),) for v in expected])


def coverage(table: DataFrame, unit_column: str, expected: Sequence, canonical_form: bool = True) -> DataFrame:
    """Expected units that never occur: ``(missing_unit)``.

    The declared list filters the scan first, so only units that were asked for are ever shuffled.
    """
    units = expected_units(table, expected)
    seen = (
        table.select(comparison_key(table, unit_column, canonical_form).alias("missing_unit"))
        .join(units, "missing_unit", "left_semi").distinct()
    )
    return units.join(seen, "missing_unit", "left_anti")


def cardinality(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row of reference statistics: ``(child_distinct, parent_distinct, parent_rows, overlap)``."""
    own, other = _keys_of((child, child_column), (parent, parent_column))
    left = child.select(own.alias("k")).filter(F.col("k").isNotNull())
    right = parent.select(other.alias("k")).filter(F.col("k").isNotNull())
    children = left.distinct().withColumn("in_child", F.lit(True))
    parents = right.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    return children.join(parents, "k", "full_outer").agg(
        F.count("in_child").alias("child_distinct"),
        F.count("rows").alias("parent_distinct"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("parent_rows"),
        F.count_if(F.col("in_child").isNotNull() & F.col("rows").isNotNull()).alias("overlap"),
    )


def attribute_contradiction(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_attr: str,
                            right_attr: str, canonical_form: bool = True) -> DataFrame:
    """Linked rows whose attributes differ: ``(key, left_value, right_value, occurrences)``.

    NULL differs from every value and agrees with NULL. Equal rows are counted on both sides before the join, and
    ``occurrences`` is the number of row pairs behind a contradiction.
    """
    def side(df: DataFrame, key: str, attr: str, value: str, count: str) -> DataFrame:
        picked = df.select(comparison_key(df, key, canonical_form).alias("key"),
                           comparison_key(df, attr, canonical_form).alias(value))
        return picked.filter(F.col("key").isNotNull()).groupBy("key", value).agg(F.count(F.lit(1)).alias(count))

    linked = side(left, left_key, left_attr, "left_value", "nl").join(
        side(right, right_key, right_attr, "right_value", "nr"), "key")
    return linked.filter(~F.col("left_value").eqNullSafe(F.col("right_value"))).select(
        "key", "left_value", "right_value", (F.col("nl") * F.col("nr")).alias("occurrences"))


def contradiction_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_attr: str,
                         right_attr: str, canonical_form: bool = True) -> DataFrame:
    """``(key, contradictions)``: row pairs whose attributes differ, counted without forming any pair.

    Of the L x R pairs of a key those with equal attributes agree, so two aggregations are enough, whatever the number
    of rows a key holds.
    """
    def side(df: DataFrame, key: str, attr: str, nl: int, nr: int) -> DataFrame:
        return df.select(
            comparison_key(df, key, canonical_form).alias("key"), comparison_key(df, attr, canonical_form).alias("value"),
            F.lit(nl).cast("bigint").alias("nl"), F.lit(nr).cast("bigint").alias("nr"))

    both = side(left, left_key, left_attr, 1, 0).unionByName(side(right, right_key, right_attr, 0, 1))
    per_value = both.filter(F.col("key").isNotNull()).groupBy("key", "value").agg(
        F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
    wide = lambda c: c.cast("decimal(19,0)")
    agreeing = F.sum(wide(F.col("nl")) * wide(F.col("nr")))
    pairs = wide(F.sum("nl")) * wide(F.sum("nr"))
    return per_value.groupBy("key").agg((pairs - agreeing).cast("decimal(38,0)").alias("contradictions")).filter(
        F.col("contradictions") > 0)


def contradictions(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_attr: str, right_attr: str,
                   canonical_form: bool = True) -> DataFrame:
    """``(key, side, value, rows, opponents, other_value, pairs)``: each value of a key that the other side contradicts.

    One row per key, side and value, whatever the number of row pairs: `opponents` are the rows of the other side with
    another value, `other_value` is one of theirs (the smallest or the greatest). `pairs` is the number of contradicting
    row pairs the row stands for; it is told on the left side only, so that its sum counts every pair once.
    """
    def side(df: DataFrame, key: str, attr: str, nl: int, nr: int) -> DataFrame:
        return df.select(
            comparison_key(df, key, canonical_form).alias("key"), comparison_key(df, attr, canonical_form).alias("value"),
            F.lit(nl).cast("bigint").alias("nl"), F.lit(nr).cast("bigint").alias("nr"))

    both = side(left, left_key, left_attr, 1, 0).unionByName(side(right, right_key, right_attr, 0, 1))
    per_value = both.filter(F.col("key").isNotNull()).groupBy("key", "value").agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"))
    # NULL is a value of its own and the smallest one
    per_value = settle(per_value.withColumn("mark", F.struct(F.col("value").isNotNull().alias("known"), "value")), "per-value")
    held = lambda n: F.when(F.col(n) > 0, F.col("mark"))
    totals = per_value.groupBy("key").agg(
        F.sum("nl").alias("all_l"), F.sum("nr").alias("all_r"), F.min(held("nl")).alias("low_l"), F.max(held("nl")).alias("high_l"),
        F.min(held("nr")).alias("low_r"), F.max(held("nr")).alias("high_r")).filter((F.col("all_l") > 0) & (F.col("all_r") > 0))
    wide = lambda c: c.cast("decimal(19,0)")

    def row(name: str, own: str, other: str) -> Column:
        against = F.col(f"all_{other}") - F.col(f"n{other}")
        named = F.when(F.col(f"low_{other}") == F.col("mark"), F.col(f"high_{other}")["value"]).otherwise(F.col(f"low_{other}")["value"])
        pairs = wide(F.col(f"n{own}")) * wide(against) if own == "l" else F.lit(0)
        return F.struct(F.lit(name).alias("side"), F.col("value"), F.col(f"n{own}").alias("rows"), against.alias("opponents"),
                        named.alias("other_value"), pairs.cast("decimal(38,0)").alias("pairs"))

    sides = F.filter(F.array(row("left", "l", "r"), row("right", "r", "l")), lambda x: (x["rows"] > 0) & (x["opponents"] > 0))
    return per_value.join(totals, "key").select("key", F.explode(sides).alias("x")).select("key", "x.*")


def first_contradictions(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` pairs ``(key, left_value, right_value, occurrences)`` behind the rows of `contradictions`.

    They belong to the first keys, and to the `limit` + 1 smallest values of either side of a key.
    """
    keys = settle(found.filter("side = 'left'").select("key").distinct().orderBy("key").limit(limit), "keys")
    turn = F.row_number().over(Window.partitionBy("key", "side").orderBy("value"))
    few = found.join(F.broadcast(keys), "key", "left_semi").withColumn("__turn", turn).filter(F.col("__turn") <= limit + 1)
    of = lambda side, value, n: few.filter(F.col("side") == side).select("key", F.col("value").alias(value), F.col("rows").alias(n))
    linked = of("left", "left_value", "nl").join(of("right", "right_value", "nr"), "key")
    return linked.filter(~F.col("left_value").eqNullSafe(F.col("right_value"))).select(
        "key", "left_value", "right_value", (F.col("nl") * F.col("nr")).alias("occurrences")).orderBy(
        "key", "left_value", "right_value").limit(limit)


def reconciliation(left: DataFrame, right: DataFrame, left_group: str, right_group: str, left_measure: str,
                   right_measure: str, tolerance: float = 0.01, left_where: str | None = None,
                   right_where: str | None = None) -> DataFrame:
    """Groups whose sums differ by more than the tolerance: ``(grp, left_total, right_total, diff)``.

    A group missing on one side counts as zero there; a NULL group never matches the other side's NULL group.
    """
    def totals(df: DataFrame, where: str | None, group: str, measure: str, name: str) -> DataFrame:
        return _scoped(df, where).groupBy(fragment(group).alias("grp")).agg(F.sum(fragment(measure)).alias(name))

    both = totals(left, left_where, left_group, left_measure, "left_total").join(
        totals(right, right_where, right_group, right_measure, "right_total"), "grp", "full_outer")
    diff = F.coalesce("left_total", F.lit(0)) - F.coalesce("right_total", F.lit(0))
    return both.withColumn("diff", diff).filter(F.abs("diff") > F.lit(tolerance)).select(
        "grp", "left_total", "right_total", "diff")


def _intervals(table: DataFrame, key_column: str, valid_from: str, valid_to: str, key: Column | None = None) -> DataFrame:
    """Distinct intervals per key with their number of rows; open ends are filled in."""
    start = table[valid_from]
    end = F.coalesce(table[valid_to], F.lit(OPEN_END).cast(table.schema[valid_from].dataType))
    return (
        table.select((comparison_key(table, key_column) if key is None else key).alias("key"), start.alias("vf"), end.alias("vt"))
        .filter(F.col("key").isNotNull() & F.col("vf").isNotNull())
        .groupBy("key", "vf", "vt").agg(F.count(F.lit(1)).alias("n"))
    )


def validity_join(table: DataFrame, key_column: str, valid_from: str, valid_to: str,
                  wide_key: int = WIDE_KEY) -> DataFrame:
    """Overlapping closed intervals of one key: ``(key, a_from, a_to, b_from, b_to, occurrences)``, a before b.

    Identical intervals are not reported against each other; ``occurrences`` is the number of row pairs. Interval b can
    only follow a if b starts inside a, so b's start is looked up in a; keys with many intervals are spread over blocks
    of days and touch overlapping pairs only.
    """
    intervals = settle(_intervals(table, key_column, valid_from, valid_to), "intervals")
    a = intervals.select("key", F.col("vf").alias("a_from"), F.col("vt").alias("a_to"), F.col("n").alias("an"))
    b = intervals.select("key", F.col("vf").alias("b_from"), F.col("vt").alias("b_to"), F.col("n").alias("bn"))
    starts_inside = stab_join(b, day_number(F.col("b_from")), a, day_number(F.col("a_from")), day_number(F.col("a_to")),
                              keys=["key"], wide_key=wide_key, stored=True)
    before = (F.col("a_from") < F.col("b_from")) | ((F.col("a_from") == F.col("b_from")) & (F.col("a_to") < F.col("b_to")))
    return starts_inside.filter(before & (F.col("a_to") >= F.col("b_from"))).select(
        "key", "a_from", "a_to", "b_from", "b_to", (F.col("an") * F.col("bn")).alias("occurrences"))


def validity_overlaps(table: DataFrame, key_column: str, valid_from: str, valid_to: str, hot_key: int = HOT_KEY) -> DataFrame:
    """``(key, valid_from, valid_to, rows, earlier, later, other_from, other_to, pairs)``: the intervals of a key that overlap.

    One row per distinct interval, whatever the number of overlapping row pairs. `earlier` and `later` are the rows of
    other intervals that overlap it and come before or after it in the order of start and end; the other interval named is
    the one that lasts longest before it or, if there is none, the one that starts last inside it. `pairs` is `rows` times
    `earlier`, so its sum counts every overlapping row pair once.

    A sweep over the starts and ends of a key in time order keeps what has begun and what has ended as running sums: what
    began before an interval and has not ended when it starts is what overlaps it from before. A key of up to `hot_key`
    intervals is swept in one task, where its rows are sorted once; larger ones are swept by many tasks (see ``running``).
    """
    intervals = settle(_intervals(table, key_column, valid_from, valid_to, *_keys_of((table, key_column))), "intervals")
    hot = settle(intervals.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_key).select("key"), "hot")
    order, sums, tops = ["at", "kind", "other"], {"begun_before": "begun", "open_before": "open"}, {"longest": "ending", "latest": "starting"}
    # As many tasks as the session shuffles with: the rows are few bytes each, and by bytes alone they end up in too few.
    tasks = int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = lambda df: _swept(running_inside(_events(df.repartition(tasks, "key")), "key", order, sums, tops))
    if hot.isEmpty():
        swept = inside(intervals)
    else:
        few, many = (intervals.join(hot, "key", how) for how in ("left_anti", "left_semi"))
        swept = inside(few).unionByName(_swept(running(_events(many), "key", order, sums, tops)))
    return swept.withColumn("key", F.col("key").cast("string"))


def _events(intervals: DataFrame) -> DataFrame:
    """The start of every interval ``(key, vf, vt, n)`` and the end of those that do not end before they start."""
    real, n, zero = F.col("vf") <= F.col("vt"), F.col("n"), F.lit(0).cast("bigint")
    ending, starting = F.struct("vt", "vf"), F.struct("vf", "vt")
    start = F.struct(F.col("vf").alias("at"), F.lit(0).alias("kind"), F.col("vt").alias("other"), n.alias("begun"),
                     F.when(real, n).otherwise(zero).alias("open"), F.when(real, ending).alias("ending"),
                     F.when(F.lit(True), starting).alias("starting"))
    end = F.struct(F.col("vt").alias("at"), F.lit(1).alias("kind"), F.col("vf").alias("other"), zero.alias("begun"),
                   (-n).alias("open"), F.when(F.lit(False), ending).alias("ending"), F.when(F.lit(False), starting).alias("starting"))
    return intervals.select("key", F.explode(F.when(real, F.array(start, end)).otherwise(F.array(start))).alias("e")).select("key", "e.*")


def _swept(events: DataFrame) -> DataFrame:
    """The rows of ``validity_overlaps`` from events with what ran before them."""
    start, zero = F.col("kind") == 0, F.lit(0).cast("bigint")
    at_start, at_end = lambda c: F.when(start, c), lambda c: F.when(~start, c)
    # An interval has one start and at most one end, so each maximum is that of one row.
    merged = events.groupBy("key", F.when(start, F.col("at")).otherwise(F.col("other")).alias("valid_from"),
                            F.when(start, F.col("other")).otherwise(F.col("at")).alias("valid_to")).agg(
        F.sum("begun").alias("rows"), F.sum(at_start(F.col("open_before"))).alias("earlier"),
        F.coalesce(F.sum(at_end(F.col("begun_before"))) - F.sum(at_start(F.col("begun_before") + F.col("begun"))), zero).alias("later"),
        *[F.max(at(F.col(top)[c])).alias(f"{top}_{c}") for top, at in (("longest", at_start), ("latest", at_end)) for c in ("vf", "vt")])
    before = F.col("earlier") > 0
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return merged.filter(before | (F.col("later") > 0)).select(
        "key", "valid_from", "valid_to", "rows", "earlier", "later",
        F.when(before, F.col("longest_vf")).otherwise(F.col("latest_vf")).alias("other_from"),
        F.when(before, F.col("longest_vt")).otherwise(F.col("latest_vt")).alias("other_to"),
        (wide("rows") * wide("earlier")).cast("decimal(38,0)").alias("pairs"))


def validity_overlap_counts(table: DataFrame, key_column: str, valid_from: str, valid_to: str) -> DataFrame:
    """``(key, overlaps)``: overlapping row pairs per key, counted without forming any pair."""
    found = validity_overlaps(table, key_column, valid_from, valid_to)
    return found.groupBy("key").agg(F.sum("pairs").cast("decimal(38,0)").alias("overlaps")).filter(F.col("overlaps") > 0)


def first_validity_overlaps(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` pairs ``(key, a_from, a_to, b_from, b_to, occurrences)`` behind the rows of `validity_overlaps`.

    The first `limit` intervals that a later one overlaps are enough as left side.
    """
    a = found.filter("later > 0").orderBy("key", "valid_from", "valid_to").limit(limit).select(
        "key", F.col("valid_from").alias("a_from"), F.col("valid_to").alias("a_to"), F.col("rows").alias("an"))
    b = found.filter("earlier > 0").select("key", F.col("valid_from").alias("b_from"), F.col("valid_to").alias("b_to"), F.col("rows").alias("bn"))
    before = (F.col("a_from") < F.col("b_from")) | ((F.col("a_from") == F.col("b_from")) & (F.col("a_to") < F.col("b_to")))
    return b.join(F.broadcast(settle(a, "first")), "key").filter(before & (F.col("a_to") >= F.col("b_from"))).select(
        "key", "a_from", "a_to", "b_from", "b_to", (F.col("an") * F.col("bn")).alias("occurrences")).orderBy(
        "key", "a_from", "a_to", "b_from", "b_to").limit(limit)


def _whole_bound(c: Column, data_type: T.DataType, up: bool) -> Column:
    """A range bound as whole number: the lower bound rounds up, the upper bound down."""
    if isinstance(data_type, T.StringType):
        c = c.cast("decimal(38,10)")
    return (F.ceil(c) if up else F.floor(c)).cast("bigint")


def range_join(table: DataFrame, value_column: str, ranges: DataFrame, range_from: str, range_to: str,
               where: str | None = None) -> DataFrame:
    """Values that fall into no range or into several: ``(value, match_count)``.

    Values and bounds are merged: sorted together into range partitions, each bound changes the number of open ranges by
    one, and what a partition begins with is carried over from those before it. One row per value and two per distinct
    range, whatever their sizes. A value that is no number falls into no range, a range that ends before it starts holds
    nothing.
    """
    scoped = _scoped(table, where)
    values = scoped.select(comparison_key(scoped, value_column).alias("value")).filter(
        F.col("value").isNotNull()).distinct()
    bounds = ranges.select(
        _whole_bound(ranges[range_from], ranges.schema[range_from].dataType, True).alias("lo"),
        _whole_bound(ranges[range_to], ranges.schema[range_to].dataType, False).alias("hi"),
    ).filter(F.col("lo") <= F.col("hi")).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    no_value = F.lit(None).cast("string")
    event = lambda df, at, kind, value, change: df.select(
        F.lit(0).alias("all"), at.alias("at"), F.lit(kind).alias("kind"), value.alias("value"), change.cast("bigint").alias("change"))
    merged = union_all([
        event(bounds, F.col("lo"), 0, no_value, F.col("n")),
        event(values, lenient_bigint(F.col("value")), 1, F.col("value"), F.lit(0)),
        event(bounds, F.col("hi"), 2, no_value, -F.col("n")),
    ])
    swept = running(merged, "all", ["at", "kind", "value"], {"open": "change"})
    return swept.filter((F.col("kind") == 1) & (F.col("open") != 1)).select("value", F.col("open").alias("match_count"))


def decode(encoded: DataFrame, decode_table: DataFrame, key: str, pairs: Sequence[Mapping[str, str]]) -> DataFrame:
    """Code parts that decode to several values: ``(level, code, decoded_values)``.

    Each pair names a part expression over the encoded rows (alias ``e``) and the column it decodes to. Parts are
    computed before the join and equal rows counted once, so only distinct (key, part) combinations are shuffled.
    """
    parts = [fragment(p["part_expr"]).cast("string").alias(f"part_{i}") for i, p in enumerate(pairs)]
    names = [f"part_{i}" for i in range(len(pairs))]
    targets = [decode_table[p["decode_column"]].cast("string").alias(f"target_{i}") for i, p in enumerate(pairs)]
    codes = encoded.alias("e").select(F.col(f"e.{key}").alias("k"), *parts).distinct()
    values = decode_table.select(decode_table[key].alias("k"), *targets).distinct()
    cells: list[Column] = []
    for i, (pair, name) in enumerate(zip(pairs, names)):
        cells += [F.lit(i), F.lit(pair["decode_column"]), F.col(name), F.col(f"target_{i}")]
    levels = codes.join(values, "k").select(
        F.stack(F.lit(len(pairs)), *cells).alias("position", "level", "code", "target"))
    return levels.groupBy("position", "level", "code").agg(F.count_distinct("target").alias("decoded_values")).filter(
        F.col("decoded_values") > 1).drop("position")


def amounts_type(*columns: T.DataType) -> str:
    """The type to sum amounts of these column types in: decimals are summed as such, exactly, everything else as double.

    A decimal has room for 10 more digits in its sum; wider ones, and differences of unlike decimals that need more than 28
    digits, are summed as double.
    """
    if all(isinstance(c, T.DecimalType) for c in columns):
        scale = max(c.scale for c in columns)
        precision = max(c.precision - c.scale for c in columns) + scale
        if precision <= 28:
            return f"decimal({precision},{scale})"
    return "double"


def _number(df: DataFrame, column: str, amount_type: str, contained: bool) -> tuple[Column, Column]:
    """(amount as a number, the text of an amount that is none). Only contained checks go on past such an amount."""
    raw = df[column]
    if not contained:
        return raw.cast(amount_type), F.lit(None).cast("string")
    value = raw.try_cast(amount_type)
    return value, F.when(raw.isNotNull() & value.isNull(), raw.cast("string"))


def balance(journal: DataFrame, amount: str, group: str, tolerance: float = 0.01,
            amount_type: str | None = None, contained: bool = False) -> DataFrame:
    """Groups whose signed sum exceeds the tolerance: ``(grp, balance)``. An amount that is no number fails the job.

    Without an `amount_type`, decimals are summed exactly and all other amounts as double (see ``amounts_type``).

    If `contained`, such an amount is shown in a column `fault` of its group instead, and the job goes on.
    """
    value, fault = _number(journal, amount, amount_type or amounts_type(journal.schema[amount].dataType), contained)
    sums = journal.groupBy(fragment(group).alias("grp")).agg(F.sum(value).alias("balance"), F.max(fault).alias("fault"))
    found = sums.filter((F.abs("balance") > F.lit(tolerance)) | F.col("fault").isNotNull())
    return found if contained else found.drop("fault")


def subledger_equals_gl(subledger: DataFrame, subledger_amount: str, journal: DataFrame, journal_amount: str,
                        account: str, accounts: Sequence[int | str], tolerance: float = 0.01,
                        amount_type: str | None = None, contained: bool = False) -> DataFrame:
    """One row if the subledger total and the control accounts differ: ``(subledger_total, gl_total, diff)``.

    Without an `amount_type`, decimals are summed exactly and all other amounts as double (see ``amounts_type``). If
    `contained`, an amount that is no number is shown in a column `fault` instead of failing the job.
    """
    amount_type = amount_type or amounts_type(subledger.schema[subledger_amount].dataType, journal.schema[journal_amount].dataType)
    numbers = [int(a) for a in accounts]
    posted = journal.filter(F.col(account).isin(*numbers))
    (s, s_fault), (g, g_fault) = (_number(df, c, amount_type, contained) for df, c in ((subledger, subledger_amount), (posted, journal_amount)))
    totals = subledger.agg(F.sum(s).alias("s"), F.max(s_fault).alias("fault")).unionByName(
        posted.agg(F.sum(g).alias("g"), F.max(g_fault).alias("fault")), allowMissingColumns=True)
    zero = F.lit(0).cast(amount_type)
    found = totals.agg(F.coalesce(F.sum("s"), zero).alias("subledger_total"), F.coalesce(F.sum("g"), zero).alias("gl_total"),
                       F.max("fault").alias("fault")).withColumn("diff", F.col("subledger_total") - F.col("gl_total"))
    found = found.filter((F.abs("diff") > F.lit(tolerance)) | F.col("fault").isNotNull())
    return found.select("subledger_total", "gl_total", "diff", *(["fault"] if contained else []))


def ic_symmetry(left: DataFrame, right: DataFrame, left_period: str, right_period: str) -> DataFrame:
    """Periods with different numbers of legs on both sides: ``(period, left_legs, right_legs)``."""
    def legs(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy(comparison_key(df, column).alias("period")).agg(F.count(F.lit(1)).alias(name))

    both = legs(left, left_period, "left_legs").join(legs(right, right_period, "right_legs"), "period", "full_outer")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    return both.select("period", zero("left_legs"), zero("right_legs")).filter(
        F.col("left_legs") != F.col("right_legs"))
