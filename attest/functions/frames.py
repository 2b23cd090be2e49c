"""Small helpers around DataFrames that carry configuration, not data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def declared(spark: SparkSession, schema: str | T.StructType, rows: Iterable[Sequence]) -> DataFrame:
    """A DataFrame of declared rows (parameters, registries); Spark knows its exact size and broadcasts by size."""
    struct = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = struct.fieldNames()
    table = pa.Table.from_pylist([dict(zip(names, row)) for row in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def ranked(df: DataFrame, rank: str, *order) -> DataFrame:
    """`df` with a gapless 1-based rank in `order`, without sorting everything in one task.

    The sorted rows are stored with their partition and position; the rows per partition, a list as long as the number
    of partitions, give each partition its offset.
    """
    from attest.session import settle

    place = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumn("__part", F.shiftright(place, 33)).withColumn(
        "__at", place.bitwiseAND(F.lit((1 << 33) - 1)))
    placed = settle(placed, "ranked")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(
        rank, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def ranked_within(df: DataFrame, rank: str, group: Sequence[str], *order) -> DataFrame:
    """`df` with a 1-based rank inside each group; a group of any size is sorted by many tasks."""
    placed = ranked(df, "__place", *group, *order)
    starts = placed.groupBy(*group).agg(F.min("__place").alias("__start"))
    return placed.join(starts, list(group)).withColumn(rank, F.col("__place") - F.col("__start") + 1).drop(
        "__place", "__start")


def running_inside(df: DataFrame, group: str, order: Sequence[str], sums: Mapping[str, str] | None = None,
                   tops: Mapping[str, str] | None = None) -> DataFrame:
    """What ``running`` gives, by one sort of each group in one task: for groups that are known to be small."""
    earlier = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({**{n: F.coalesce(F.sum(c).over(earlier), F.lit(0)) for n, c in (sums or {}).items()},
                           **{n: F.max(c).over(earlier) for n, c in (tops or {}).items()}})


def running(df: DataFrame, group: str, order: Sequence[str], sums: Mapping[str, str] | None = None,
            tops: Mapping[str, str] | None = None) -> DataFrame:
    """`df` with running sums and running maxima over the rows that come earlier in `order` inside each group.

    `sums` and `tops` map new columns to the columns they run over; a sum starts at 0, a maximum at NULL. `order` must put
    the rows of a group into one order, so that the sort can cut a group of any size anywhere: the rows are sorted into
    range partitions and stored, each partition is summed on its own, and what a group had in earlier partitions is
    carried over. A partition takes over at most one group, so the carried rows are no more than the partitions.
    """
    from attest.session import settle

    sums, tops = dict(sums or {}), dict(tops or {})
    place = F.monotonically_increasing_id()
    placed = settle(df.orderBy(group, *order).withColumn("__part", F.shiftright(place, 33)).withColumn("__at", place), "sorted")
    over = lambda w: {**{n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()},
                      **{n: F.max(c).over(w) for n, c in tops.items()}}
    inside = Window.partitionBy("__part", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(group, "__part").agg(*[F.sum(c).alias(c) for c in sums.values()], *[F.max(c).alias(c) for c in tops.values()])
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumns({**over(earlier), "__nth": F.row_number().over(Window.partitionBy(group).orderBy("__part"))})
    carried = carried.filter("__nth > 1").select(F.col(group).alias("__group"), F.col("__part").alias("__of"),
                                                 *[F.col(n).alias(f"__{n}") for n in (*sums, *tops)])
    found = placed.withColumns(over(inside)).join(
        F.broadcast(carried), (F.col(group) == F.col("__group")) & (F.col("__part") == F.col("__of")), "left")
    return found.select(*[F.col(c) for c in df.columns],
                        *[(F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0))).alias(n) for n in sums],
                        *[F.greatest(F.col(n), F.col(f"__{n}")).alias(n) for n in tops])
