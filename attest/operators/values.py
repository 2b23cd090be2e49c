"""Distinct canonical values of every column, counted once and shared by profiles and the overlap matrix.

Numbers, days and moments are counted in their own types and become text once per distinct value. Short texts are counted as
they are. A text of more than ``HEAD`` characters is counted by a digest of 128 bits, together
with what profiles need of it: its first characters, its length and its shape. So long texts are read where they lie and
never shuffled; the few that are shown are fetched by a second read (`texts_of`).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.canonical import canonical, is_comparable, pattern_mask, value_kinds
from attest.functions.fingerprints import sql_type_name
from attest.functions.frames import declared, union_all
from attest.session import settle

COLUMN_SCHEMA = "cid int, table string, column string, type string"

# Characters up to which a value is its own key.
HEAD = 256
LATE = ("struct<a:bigint,b:bigint,head:string,size:int,kinds:struct<integer:boolean,decimal:boolean,date:boolean>,"
        "mask_a:bigint,mask_b:bigint,mask_head:string>")


def column_list(views: Mapping[str, DataFrame]) -> list[tuple[int, str, str, str]]:
    """Comparable columns as (cid, table, column, type); ids follow the order of the text key ``table.column``."""
    found = sorted(
        (f"{table}.{field.name}", table, field.name, sql_type_name(field.dataType))
        for table, df in views.items()
        for field in df.schema.fields
        if is_comparable(field.dataType)
    )
    return [(cid, table, column, type_name) for cid, (_, table, column, type_name) in enumerate(found)]


def columns_frame(views: Mapping[str, DataFrame]) -> DataFrame:
    spark = next(iter(views.values())).sparkSession
    return declared(spark, COLUMN_SCHEMA, column_list(views))


@dataclass(frozen=True)
class Counts:
    """Value counts of `views`: ``(cid, value, late, n)``. `value` is NULL where `late` stands for a long text; where both
    are NULL the row counts NULLs."""

    frame: DataFrame
    views: Mapping[str, DataFrame]

    def present(self) -> DataFrame:
        return self.frame.filter(F.col("value").isNotNull() | F.col("late").isNotNull())

    @cached_property
    def late_columns(self) -> list[tuple[int, str, str]]:
        """(cid, table, column) of the columns that hold long texts; at most one row per column reaches the driver."""
        found = {r[0] for r in self.frame.filter(F.col("late").isNotNull()).select("cid").distinct().collect()}
        return [(cid, table, column) for cid, table, column, _ in column_list(self.views) if cid in found]


def _is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def digest(text: Column) -> tuple[Column, Column]:
    """Two independent 64-bit halves of a digest."""
    return F.xxhash64(text), F.xxhash64(F.lit("second half"), text)


def _late(text: Column, masks: bool) -> Column:
    a, b = digest(text)
    mask = pattern_mask(text) if masks else F.lit(None).cast("string")
    mask_a, mask_b = digest(mask)
    what = F.struct(a.alias("a"), b.alias("b"), F.left(text, F.lit(HEAD)).alias("head"), F.length(text).alias("size"),
                    value_kinds(text).alias("kinds"), mask_a.alias("mask_a"), mask_b.alias("mask_b"), F.left(mask, F.lit(HEAD)).alias("mask_head"))
    return F.when(F.length(text) > HEAD, what.cast(LATE))


def _raw_type(data_type: T.DataType) -> T.DataType:
    """The type in which the cells of a column are counted: whole numbers share one, what has no form of its own is text."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(data_type, (*_ONE_TEXT, *_MERGED)):
        return data_type
    return T.StringType()


# Numbers of one type have different texts if they differ. Moments of one second, days of two eras, and a boolean that is
# NULL or false share theirs, so their texts are counted once more.
_ONE_TEXT = (T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_MERGED = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def _cells(rows: DataFrame, cells: list[tuple[int, Column]]) -> DataFrame:
    """``(cid, cell)`` of the named columns of a table, in long form."""
    named = rows.select(*[c.alias(f"c{cid}") for cid, c in cells])
    return named.select(F.stack(F.lit(len(cells)), *[x for cid, _ in cells for x in (F.lit(cid), F.col(f"c{cid}"))]).alias("cid", "cell"))


def _counted(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cid", "cell").agg(F.count(F.lit(1)).alias("n"))


def value_counts(views: Mapping[str, DataFrame], masks: bool = True) -> Counts:
    """How often each canonical value (NULL included) occurs in each column.

    The columns of one type are turned into long form and counted together, each table is read once per type with the
    columns of that type only; long texts are a type of their own. The counts combine on the map side, so a value that fills
    a third of a column leaves each task as one row. Without `masks` the shapes of long texts are not made.
    """
    by_type: dict[T.DataType, dict[str, list[tuple[int, str]]]] = {}
    for cid, table, column, _ in column_list(views):
        by_type.setdefault(_raw_type(views[table].schema[column].dataType), {}).setdefault(table, []).append((cid, column))
    none, parts = F.lit(None).cast(LATE), []
    for kind, tables in by_type.items():
        text = isinstance(kind, T.StringType)
        long_form = {t: _cells(views[t], [(cid, canonical(views[t][c], views[t].schema[c].dataType) if text else views[t][c].cast(kind))
                                          for cid, c in members]) for t, members in tables.items()}
        cells = union_all(long_form.values())
        if text:
            short = F.length("cell") <= HEAD
            parts.append(_counted(cells.filter(short | F.col("cell").isNull())).select("cid", F.col("cell").alias("value"), none.alias("late"), "n"))
            texts = [t for t, members in tables.items() if any(_is_text(views[t].schema[c].dataType) for _, c in members)]
            if texts:
                late = union_all(long_form[t] for t in texts).filter(~short).select("cid", _late(F.col("cell"), masks).alias("cell"))
                parts.append(_counted(late).select("cid", F.lit(None).cast("string").alias("value"), F.col("cell").alias("late"), "n"))
            continue
        found = _counted(cells).select("cid", canonical(F.col("cell"), kind).alias("value"), "n")
        if isinstance(kind, _MERGED):
            found = found.groupBy("cid", "value").agg(F.sum("n").alias("n"))
        parts.append(found.select("cid", "value", none.alias("late"), "n"))
    if not parts:
        spark = next(iter(views.values())).sparkSession
        return Counts(declared(spark, f"cid int, value string, late {LATE}, n bigint", []), views)
    return Counts(union_all(parts), views)


def settled_counts(views: Mapping[str, DataFrame], counts: Counts | None = None, masks: bool = True) -> Counts:
    """Value counts as a stored table: profiles and matrix read it several times, the sources only once."""
    return Counts(settle(value_counts(views, masks).frame, "counts"), views) if counts is None else counts


def long_texts(counts: Counts) -> DataFrame | None:
    """``(cid, text)``: the long texts where they lie, or None if no column has any."""
    parts = []
    for cid, table, column in counts.late_columns:
        df = counts.views[table]
        text = canonical(df[column], df.schema[column].dataType)
        parts.append(df.select(F.lit(cid).alias("cid"), text.alias("text")).filter(F.length("text") > HEAD))
    return union_all(parts) if parts else None


def texts_of(counts: Counts, wanted: DataFrame) -> DataFrame:
    """`wanted` with `text`: the long text behind the column `a` (first half of its digest) of each row that has one.

    The rows wanted are stored first, so that Spark knows how few they are and sends them to the texts, not the texts
    through a shuffle.
    """
    wanted = settle(wanted, "wanted")
    texts = long_texts(counts)
    if texts is None:
        return wanted.withColumn("text", F.lit(None).cast("string"))
    keys = wanted.filter(F.col("a").isNotNull()).select("cid", "a").distinct()
    met = texts.withColumn("a", digest(F.col("text"))[0]).join(settle(keys, "keys"), ["cid", "a"], "left_semi")
    return wanted.join(met.groupBy("cid", "a").agg(F.any_value("text").alias("text")), ["cid", "a"], "left")
