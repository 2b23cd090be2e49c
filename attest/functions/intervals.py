"""Interval lookups as equi-joins.

A condition such as ``point BETWEEN lo AND hi`` alone forces Spark to compare every pair of rows. Here both sides are
mapped to the blocks of a binary grid over the integers: a closed interval is covered by disjoint blocks
``(level, node)``, and a point lies in exactly one block per level. A point therefore meets an interval in exactly one
block if it lies inside and in none otherwise, so that an ordinary hash join on ``(level, node)`` answers the lookup
without false candidates, spreads a hot key over its blocks, and never builds the product of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.session import settle

TOP_LEVEL = 62

# Keys with more intervals than this are looked up over blocks instead of interval by interval.
WIDE_KEY = 64


def _mask(level: int) -> int:
    return (1 << level) - 1


def cover(lo: str, hi: str, top: int) -> Column:
    """Disjoint blocks covering the closed interval of the columns `lo` and `hi`; empty if lo > hi.

    On each level at most one block is taken at either end, the top level takes all that is left. Written as one SQL
    expression, which keeps plans small: ``b.l`` and ``b.r`` are the first and last block of level ``k`` inside.
    """
    mask = "(shiftleft(1L, k) - 1)"
    return F.expr(f"""
        flatten(transform(sequence(0, {top}), k -> transform(
            array(named_struct('l', shiftright({lo}, k) + IF(({lo} & {mask}) <> 0, 1, 0),
                               'r', shiftright({hi}, k) - IF(({hi} & {mask}) = {mask}, 0, 1))),
            b -> transform(
                CASE WHEN b.l > b.r THEN array()
                     WHEN k = {top} THEN sequence(b.l, b.r)
                     ELSE array_compact(array(IF((b.l & 1) = 1, b.l, NULL), IF((b.r & 1) = 0, b.r, NULL))) END,
                n -> named_struct('level', k, 'node', n)))[0]))""")


def path(point: str, top: int) -> Column:
    """The block of every level that holds the value of the column `point`."""
    blocks = ", ".join(f"named_struct('level', {k}, 'node', shiftright({point}, {k}))" for k in range(top + 1))
    return F.expr(f"array({blocks})")


def top_level(intervals: DataFrame) -> int:
    """The level whose blocks are wider than every interval (``__lo``, ``__hi``), so that each takes two of them at most.

    One number is read. It also bounds the blocks of a point, one per level: narrow intervals need few.
    """
    width = F.coalesce(F.try_subtract("__hi", "__lo"), F.lit((1 << 63) - 1))
    widest = intervals.filter(F.col("__hi") >= F.col("__lo")).agg(F.max(width)).first()[0] or 0
    return min(int(widest).bit_length(), TOP_LEVEL)


def _block_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], top: int) -> DataFrame:
    """Join on equal keys and common block; points carry ``__at``, intervals ``__lo`` and ``__hi``."""
    def by_block(df: DataFrame, blocks: Column) -> DataFrame:
        return df.withColumn("__block", F.explode(blocks)).select(
            "*", F.col("__block.level").alias("__level"), F.col("__block.node").alias("__node")).drop("__block")

    left = by_block(points, path("__at", top))
    right = by_block(intervals, cover("__lo", "__hi", top))
    return left.join(right, [*keys, "__level", "__node"])


def stab_join(
    points: DataFrame,
    point: Column,
    intervals: DataFrame,
    lo: Column,
    hi: Column,
    keys: Sequence[str] = (),
    top: int | None = None,
    wide_key: int = WIDE_KEY,
    stored: bool = False,
) -> DataFrame:
    """Inner join of points with the intervals that hold them, on equal `keys`.

    `point`, `lo` and `hi` are whole numbers (days, codes). Keys with at most `wide_key` intervals are joined on the key
    alone and filtered; keys with more, and lookups without a key, go through blocks. `top` is the coarsest block level,
    by default the one that fits the widest interval; with a given one, wider intervals take several blocks of it. Column names of both sides must differ except for
    `keys`. Both sides are read several times and are written once first, unless they are `stored` tables already.
    """
    placed = points.withColumn("__at", point.cast("bigint"))
    spans = intervals.withColumn("__lo", lo.cast("bigint")).withColumn("__hi", hi.cast("bigint"))
    columns = [*keys, *[c for c in points.columns if c not in keys], *[c for c in intervals.columns if c not in keys]]
    if not keys:
        return _block_join(placed, spans, keys, top_level(spans) if top is None else top).select(*columns)
    keys = list(keys)
    if not stored:
        placed, spans = settle(placed, "points"), settle(spans, "intervals")
    wide = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > wide_key).select(*keys)
    inside = F.col("__at").between(F.col("__lo"), F.col("__hi"))
    if wide.isEmpty():
        return placed.join(spans, keys).filter(inside).select(*columns)
    top = top_level(spans) if top is None else top
    few = placed.join(spans.join(wide, keys, "left_anti"), keys).filter(inside)
    many = _block_join(placed.join(wide, keys, "left_semi"), spans.join(wide, keys, "left_semi"), keys, top)
    return few.select(*columns).unionByName(many.select(*columns))


def day_number(c: Column) -> Column:
    """Days since 1970-01-01 of a date or timestamp."""
    return F.unix_date(c.cast("date")).cast("bigint")
