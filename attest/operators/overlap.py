"""Candidate matrix: measured value overlap between columns of different tables.

The matrix only reports what the data shows, chance overlaps included; no candidate carries a status.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.canonical import class_family
from attest.operators.profile import classified_columns
from attest.operators.values import Counts, columns_frame, settled_counts
from attest.session import settle

# Fixed value: the containment a candidate needs.
CONTAINMENT_THRESHOLD = 0.5


def shared_values(counts: Counts) -> DataFrame:
    """``(left_cid, right_cid, overlap)``: distinct values that two columns both hold, for all pairs that share one.

    Values are first grouped by the set of columns that hold them and equal sets are counted, so pairs are formed once
    per set instead of once per value, and pairs without a common value are never formed.
    """
    holders = counts.present().groupBy("value", F.col("late.a"), F.col("late.b")).agg(
        F.sort_array(F.collect_set("cid")).alias("holders")).filter(F.size("holders") >= 2)
    sets = holders.groupBy("holders").agg(F.count(F.lit(1)).alias("n"))
    lefts = sets.select("holders", "n", F.explode("holders").alias("left_cid"))
    return (
        lefts.select("left_cid", "n", F.explode("holders").alias("right_cid"))
        .filter(F.col("left_cid") < F.col("right_cid"))
        .groupBy("left_cid", "right_cid").agg(F.sum("n").alias("overlap"))
    )


def column_pairs(classified: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Pairs with a common value that may be compared: two distinct values at least, different tables, one class family."""
    usable = classified.filter(F.col("distinct_count") >= 2).withColumn("family", class_family(F.col("value_class")))
    side = lambda prefix: usable.select(
        F.col("family").alias(f"{prefix}_family"), F.col("cid").alias(f"{prefix}_cid"), F.col("table").alias(f"{prefix}_table"),
        F.concat_ws(".", "table", "column").alias(prefix), F.col("distinct_count").alias(f"{prefix}_distinct"))
    return overlaps.join(side("left"), "left_cid").join(side("right"), "right_cid").filter(
        (F.col("left_family") == F.col("right_family")) & (F.col("left_table") != F.col("right_table"))
    ).drop("left_family", "right_family", "left_table", "right_table")


def score_pairs(pairs: DataFrame, threshold: float = CONTAINMENT_THRESHOLD) -> DataFrame:
    """Containment and Jaccard of pairs; the threshold is tested before rounding."""
    smaller = F.least("left_distinct", "right_distinct")
    either = F.col("left_distinct") + F.col("right_distinct") - F.col("overlap")
    return (
        pairs.filter(F.col("overlap") / smaller >= threshold)
        .select("left", "right", "overlap", "left_distinct", "right_distinct",
                F.round(F.col("overlap") / smaller, 4).alias("containment"),
                F.round(F.col("overlap") / either, 4).alias("jaccard"))
    )


def matrix_order() -> list:
    """Report order of candidates."""
    return [F.col("containment").desc(), F.col("overlap").desc(), F.col("left"), F.col("right")]


def overlapping_pairs(views: Mapping[str, DataFrame], counts: Counts | None = None) -> DataFrame:
    """Stored pairs of comparable columns with their common values, the input of matrix and header."""
    counts = settled_counts(views, counts, masks=False)
    classified = classified_columns(columns_frame(views), counts)
    return settle(column_pairs(classified, shared_values(counts)), "pairs")


def candidate_matrix(
    views: Mapping[str, DataFrame],
    threshold: float = CONTAINMENT_THRESHOLD,
    counts: Counts | None = None,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """All candidate pairs of `views`; `pairs` may be what `overlapping_pairs` returned."""
    return score_pairs(overlapping_pairs(views, counts) if pairs is None else pairs, threshold)


def matrix_header(pairs: DataFrame, threshold: float = CONTAINMENT_THRESHOLD) -> DataFrame:
    """One row on how the matrix was made: the threshold and the number of pairs that share a value."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs_examined")).select(F.lit(threshold).alias("threshold"), "pairs_examined")


def candidates_by_column(matrix: DataFrame) -> DataFrame:
    """Each candidate seen from both of its columns."""
    view = lambda own, other: matrix.select(
        F.col(own).alias("column_key"), F.col(other).alias("other"), "containment", "overlap")
    return view("left", "right").unionByName(view("right", "left"))
