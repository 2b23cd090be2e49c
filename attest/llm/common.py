"""Helpers shared by the corpus operators: stored steps, stable keys, components, gapless numbering."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.session import settle

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the cluster's shared folder and read back; its shuffle files go as soon as it is written."""
    with setting(df.sparkSession, _CLEAN, "true"):
        return settle(df, name)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored step that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def code_point_order(column: Column) -> Column:
    """Strings compare by bytes in Spark, which for UTF-8 is the order of code points; nulls come last."""
    return column.asc_nulls_last()


def unsigned_crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def arrow_map(df: DataFrame, body: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` for a function of one batch."""

    def over(batches):
        for batch in batches:
            if batch.num_rows:
                yield from body(batch)

    return df.mapInArrow(over, schema)


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, root): each node of `edges` (a, b, both not null) with the smallest node of its component.

    Large-star and small-star passes: every pass is one grouped minimum and one join, each node keeps at most its
    neighbours' number of rows, and each pass is stored, so that a lost executor repeats only that pass. Stops when a
    pass changes nothing; the number of passes grows with the logarithm of the longest chain, and more than `rounds` of them
    are an error. A node that occurs in no
    edge with another node is not in the result.
    """
    now = stored(edges.select(F.col("a"), F.col("b")).where("a != b").distinct(), name)
    state = None
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                             F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = stored(small.select("e.a", "e.b").where("a != b").distinct(), name)
        figures = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if figures == state:
            break
        state = figures
    else:
        raise RuntimeError(f"components did not settle in {rounds} passes")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the columns an operator reads; whatever else the input has cannot clash with its own names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """Two independent hashes of a whole row; rows have equal ones only if they are equal (but for collisions).

    Hash functions pass over nulls, so a null flag goes beside each column, and columns with parts of their own are hashed
    as JSON, which shows their nulls. Maps whose entries are in another order count as different.
    """
    parts: list[Column] = []
    for name, kind in df.dtypes:
        own = F.col(f"`{name}`")
        nested = any(word in kind for word in ("array<", "map<", "struct<", "variant"))
        parts += [own.isNull(), F.to_json(F.struct(own.alias("c")), {"ignoreNullFields": "false"}) if nested else own]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second half"), *parts)


def row_of(df: DataFrame) -> Column:
    """All columns in one struct, so that no name of theirs meets one of an operator; `unfolded` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unfolded(df: DataFrame, columns: Sequence[str], row: str = "row", **changed: Column) -> DataFrame:
    """The `columns` that `row_of` put into `row`, some of them `changed`."""
    return df.select(*[(changed[c] if c in changed else F.col(row).getField(c)).alias(c) for c in columns])
