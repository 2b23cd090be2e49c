"""Column profiles from value counts: statistics, frequent values, samples, shapes and value classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.canonical import CLASS_EMPTY, canonical, class_of_kinds, pattern_mask, value_kinds
from attest.functions.frames import declared, union_all
from attest.operators.values import Counts, columns_frame, settled_counts, texts_of

TOP_VALUES = 10
SAMPLE_VALUES = 200
TOP_PATTERNS = 5


def extremes(counts: Counts) -> DataFrame:
    """``(cid, min, max)`` of the columns that hold long texts, straight from their tables: each task keeps two texts."""
    parts = []
    for cid, table, column in counts.late_columns:
        df = counts.views[table]
        text = canonical(df[column], df.schema[column].dataType)
        parts.append(df.agg(F.min(text).alias("least"), F.max(text).alias("most")).withColumn("cid", F.lit(cid)))
    spark = counts.frame.sparkSession
    return union_all(parts) if parts else declared(spark, "cid int, least string, most string", [])


def column_statistics(counts: Counts) -> DataFrame:
    """Per column: rows, NULLs, distinct values, extremes and lengths of the canonical text."""
    size = F.coalesce(F.length("value"), F.col("late.size"))
    found = counts.frame.withColumn("size", size).groupBy("cid").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("size").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("null_count"),
        F.count("size").alias("distinct_count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min("size").cast("bigint").alias("len_min"),
        F.round(F.try_divide(F.sum(F.col("size").cast("bigint") * F.col("n")).cast("double"),
                             F.sum(F.when(F.col("size").isNotNull(), F.col("n"))).cast("double")), 1).alias("len_avg"),
        F.max("size").cast("bigint").alias("len_max"),
    )
    return found.join(extremes(counts), "cid", "left").withColumns(
        {"min": F.coalesce("least", "min"), "max": F.coalesce("most", "max")}).drop("least", "most")


def _place(rank: Column, *order) -> Column:
    return rank.over(Window.partitionBy("cid").orderBy(*order))


def _near(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The rows ``(cid, shown, head, a, …)`` of every column that may be among the first `limit` in the order of `order` and
    then of what is shown. `head` orders like it as far as the first characters of long texts tell; all rows that it cannot
    tell apart are kept. Spark cuts each task to the first rows per column before the shuffle."""
    return rows.withColumn("rank", _place(F.rank(), *order, F.coalesce("shown", "head"))).filter(F.col("rank") <= limit).drop("rank", "head")


def _first(full: DataFrame, limit: int, text: Column, *order) -> DataFrame:
    """The first rows of what `_near` kept, once the `text` behind long ones is known."""
    told = full.withColumn("shown", F.coalesce("shown", text)).drop("text", "a")
    return told.withColumn("rank", _place(F.row_number(), *order, F.col("shown"))).filter(F.col("rank") <= limit)


def _values(counts: Counts) -> DataFrame:
    return counts.present().select("cid", F.col("value").alias("shown"), F.col("late.head").alias("head"), F.col("late.a").alias("a"), "n")


def _shapes(counts: Counts) -> DataFrame:
    return counts.present().groupBy(
        "cid", pattern_mask(F.col("value")).alias("shown"), F.col("late.mask_head").alias("head"), F.col("late.mask_a").alias("mask_a"),
        F.col("late.mask_b").alias("mask_b")).agg(F.min("late.a").alias("a"), F.count(F.lit(1)).alias("n")).drop("mask_a", "mask_b")


def top_values(counts: Counts, limit: int = TOP_VALUES) -> DataFrame:
    """Most frequent values, ties in value order."""
    near = texts_of(counts, _near(_values(counts), limit, F.desc("n")))
    return _first(near, limit, F.col("text"), F.desc("n")).withColumnRenamed("shown", "value")


def value_sample(counts: Counts, limit: int = SAMPLE_VALUES) -> DataFrame:
    """The smallest distinct values of every column: a listing to look at, nothing is decided by it."""
    near = texts_of(counts, _near(_values(counts).drop("n"), limit))
    return _first(near, limit, F.col("text")).withColumnRenamed("shown", "value")


def top_patterns(counts: Counts, limit: int = TOP_PATTERNS) -> DataFrame:
    """Most frequent shapes among all distinct values."""
    near = texts_of(counts, _near(_shapes(counts), limit, F.desc("n")))
    return _first(near, limit, pattern_mask(F.col("text")), F.desc("n")).withColumnRenamed("shown", "mask")


def top_lists(counts: Counts) -> tuple[DataFrame, DataFrame]:
    """`top_values` and `top_patterns` with one read of the long texts behind both."""
    both = _near(_values(counts), TOP_VALUES, F.desc("n")).withColumn("what", F.lit("value")).unionByName(
        _near(_shapes(counts), TOP_PATTERNS, F.desc("n")).withColumn("what", F.lit("mask")))
    full = texts_of(counts, both)
    of = lambda what: full.filter(F.col("what") == what).drop("what")
    return (_first(of("value"), TOP_VALUES, F.col("text"), F.desc("n")).withColumnRenamed("shown", "value"),
            _first(of("mask"), TOP_PATTERNS, pattern_mask(F.col("text")), F.desc("n")).withColumnRenamed("shown", "mask"))


def value_classes(counts: Counts) -> DataFrame:
    """The narrowest class that all distinct values of a column belong to."""
    kinds = F.when(F.col("value").isNotNull(), value_kinds(F.col("value"))).otherwise(F.col("late.kinds"))
    return counts.frame.withColumn("kinds", kinds).groupBy("cid").agg(class_of_kinds(F.col("kinds")).alias("value_class"))


def classified_columns(columns: DataFrame, counts: Counts) -> DataFrame:
    """``(cid, table, column, distinct_count, value_class)``, the input of the overlap matrix."""
    distinct = counts.present().groupBy("cid").agg(F.count(F.lit(1)).alias("distinct_count"))
    return (
        columns.join(distinct, "cid", "left")
        .join(value_classes(counts), "cid", "left")
        .select("cid", "table", "column", F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
                F.coalesce("value_class", F.lit(CLASS_EMPTY)).alias("value_class"))
    )


def profile_views(views: Mapping[str, DataFrame], counts: Counts | None = None, lists: bool = True) -> DataFrame:
    """One row per column of `views`, with its statistics and class and, unless `lists` is false, its frequent values and shapes.

    `counts` may be a stored value-count table; otherwise the sources are counted once first.
    """
    counts = settled_counts(views, counts, masks=lists)
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name)
    found = columns_frame(views).join(column_statistics(counts), "cid", "left").join(value_classes(counts), "cid", "left")
    shown = ["table", "column", "type", zero("row_count"), zero("null_count"), zero("distinct_count"),
             "min", "max", "len_min", "len_avg", "len_max", F.coalesce("value_class", F.lit(CLASS_EMPTY)).alias("value_class")]
    if not lists:
        return found.select(*shown)
    listed = lambda frame, name, field: frame.groupBy("cid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", field, "n"))),
                    lambda item: F.struct(item[field].alias(field), item["n"].alias("count"))).alias(name))
    values, patterns = top_lists(counts)
    return found.join(listed(values, "top_values", "value"), "cid", "left").join(
        listed(patterns, "patterns", "mask"), "cid", "left").select(*shown, "top_values", "patterns")


def upsert_profiles(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh profiles with the ids of stored ones where (source, table, column) is known, new ids elsewhere."""
    key = ["source_id", "table", "column"]
    known = stored.select(*key, F.col("id").alias("__id"))
    return fresh.join(known, key, "left").withColumn(
        "id", F.coalesce("__id", F.sha2(F.concat_ws("\x1f", *key), 256))).drop("__id")
