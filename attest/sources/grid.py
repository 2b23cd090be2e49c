"""Sheets as raw grids: find the header, resolve spanning parents, drop blank rows, bring cells into canonical text.

A grid is a DataFrame ``(row_no, cells)`` with the cells of a row as ``array<string>`` or as
``array<struct<kind,text>>`` where the producer knows cell types. ``row_no`` only has to be comparable; gaps do not
matter. The result is an all-text table plus the decisions that were taken.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.canonical import canonical_cell
from attest.functions.frames import declared, union_all
from attest.functions.names import column_slug, unique_names
from attest.session import settle

# Names of the grid rules.
RULE_MERGED_HEADER = "merged_header_resolved"
RULE_BLANK_ROWS = "blank_rows_skipped"

DECISIONS = "column string, rule string, before string, after string"


@dataclass(frozen=True)
class Sheet:
    """An all-text table and the decisions behind it, both lazy."""

    table: DataFrame
    decisions: DataFrame


def read_grid(spark: SparkSession, location: str, **options: str) -> DataFrame:
    """Rows of a delimited text file as a grid, in file order, without treating any row as header.

    The grid is stored once. Row numbers come from where Spark cut the files, and the cuts may move from job to job (with the
    number of executors, say); a header found by one job would then be compared with the rows of another. Rows may have
    more cells than the first one, which is often a title: separators are counted first, and no cell is lost. Only with
    ``multiLine``, where a record is more than a line, the first record gives the width.
    """
    reader = spark.read.options(header=False, inferSchema=False, **options)
    first = len(reader.csv(location).columns)
    widest = first
    if str(options.get("multiLine", "false")).lower() != "true":
        separator = str(options.get("sep", options.get("delimiter", ",")))
        cells = F.regexp_count("value", F.lit(re.escape(separator))) + 1
        # One number: separators inside quotes make it too large, never too small.
        widest = max(first, spark.read.text(location).agg(F.max(cells)).first()[0] or 0)
    names = [f"c{i}" for i in range(max(widest, 1))]
    raw = reader.option("maxColumns", str(max(widest, 20480))).schema(", ".join(f"{n} string" for n in names)).csv(location)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    grid = settle(raw.select(place.alias("row_no"), F.array(*names).alias("cells")), "grid")
    if len(names) == first:
        return grid
    filled = F.array_max(F.transform("cells", lambda c, i: F.when(c.isNotNull(), i + 1).otherwise(0)))
    width = max(first, grid.agg(F.max(filled)).first()[0] or 0)
    return grid.select("row_no", F.slice("cells", 1, width).alias("cells"))


def _cell(cells: Column, typed: bool, i: int) -> tuple[Column, Column | None]:
    cell = F.get(cells, i)
    return (cell["text"], cell["kind"]) if typed else (cell, None)


def _header_names(grid: DataFrame, typed: bool, spans: Sequence[tuple[int, int]]) -> tuple[list[str], list, list]:
    """Column names, the raw header cells and the positions of the header rows; reads each of them once."""
    text = (lambda c: c["text"]) if typed else (lambda c: c)
    filled = grid.filter(F.exists("cells", lambda c: text(c).isNotNull()))
    top = filled.orderBy("row_no").limit(1).collect()
    if not top:
        return [], [], []
    rows = [[c["text"] if typed and c is not None else c for c in top[0]["cells"]]]
    if not spans:
        names = [c if c is not None else f"col{i + 1}" for i, c in enumerate(rows[0])]
        return names, rows[0], [top[0]["row_no"]]
    below = grid.filter(F.col("row_no") > _literal(grid, top[0]["row_no"])).orderBy("row_no").limit(1).collect()
    if not below:
        return [c if c is not None else f"col{i + 1}" for i, c in enumerate(rows[0])], rows[0], [top[0]["row_no"]]
    rows.append([c["text"] if typed and c is not None else c for c in below[0]["cells"]])
    parents = list(rows[0])
    for first, last in spans:
        for i in range(first, last + 1):
            if rows[0][first] is not None and i < len(parents):
                parents[i] = rows[0][first]
    names = []
    for i, parent in enumerate(parents):
        child = rows[1][i] if i < len(rows[1]) else None
        named = [part for part in (parent, child) if part is not None]
        names.append("_".join(named) if named else f"col{i + 1}")
    return names, rows[0], [top[0]["row_no"], below[0]["row_no"]]


def _literal(grid: DataFrame, value) -> Column:
    """A row position as expression, whatever type positions have."""
    kind = grid.schema["row_no"].dataType
    if isinstance(kind, T.StructType):
        return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
    return F.lit(value).cast(kind)


def normalize_grid(grid: DataFrame, spans: Sequence[tuple[int, int]] = ()) -> Sheet:
    """Turn a grid into an all-text table.

    The first row with content is the header. `spans` lists header cells that stretch over several columns as
    ``(first, last)`` positions; then the next row holds sub-headers and names become ``parent_child``.
    """
    spark = grid.sparkSession
    typed = isinstance(grid.schema["cells"].dataType.elementType, T.StructType)
    raw_names, header, heads = _header_names(grid, typed, spans)
    columns = unique_names(column_slug(n) for n in raw_names)
    text = (lambda c: c["text"]) if typed else (lambda c: c)
    filled = F.exists("cells", lambda c: text(c).isNotNull())
    if not columns:
        return Sheet(declared(spark, "empty string", []), declared(spark, DECISIONS, []))
    body = grid.filter(F.col("row_no") > _literal(grid, heads[-1]))
    rows = body.filter(filled)
    forms = []
    for i in range(len(columns)):
        value, kind = _cell(F.col("cells"), typed, i)
        forms.append(canonical_cell(value, kind))
    table = rows.select(*[form["text"].alias(name) for form, name in zip(forms, columns)])

    def shown(i: int) -> Column:
        value, kind = _cell(F.col("cells"), typed, i)
        quoted = F.concat(F.lit("'"), value, F.lit("'"))
        return quoted if kind is None else F.when(F.coalesce(kind, F.lit("text")) == "text", quoted).otherwise(value)

    cells = F.array(*[
        F.struct(F.lit(name).alias("column"), form["rule"].alias("rule"), shown(i).alias("before"),
                 form["text"].alias("after"))
        for i, (form, name) in enumerate(zip(forms, columns))
    ])
    changed = rows.select("row_no", F.inline(cells)).filter(F.col("rule").isNotNull()).groupBy("column", "rule").agg(
        F.min_by(F.struct("before", "after"), "row_no").alias("example")
    ).select("column", "rule", "example.before", "example.after")
    blank = body.filter(~filled).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit("*").alias("column"), F.lit(RULE_BLANK_ROWS).alias("rule"),
        F.concat(F.col("n").cast("string"), F.lit(" blank rows")).alias("before"), F.lit("dropped").alias("after"))
    parts = [changed, blank]
    if len(heads) == 2:
        parts.append(declared(spark, DECISIONS, [("*", RULE_MERGED_HEADER, str(header), str(raw_names))]))
    return Sheet(table, union_all(parts))


def write_sheet(sheet: Sheet, path: str) -> DataFrame:
    """Store a sheet as all-text Parquet and read it back."""
    sheet.table.write.mode("overwrite").parquet(path)
    return sheet.table.sparkSession.read.schema(sheet.table.schema).parquet(path)


def new_decisions(decisions: DataFrame, stored: DataFrame) -> DataFrame:
    """Decisions not yet declared for the same source state: ``(source, table, column, rule, before, after, stamp)``."""
    key = ["source", "table", "column", "rule", "before", "after", "stamp"]
    fresh = decisions.select(*key).distinct()
    same = [fresh[k].eqNullSafe(stored[k]) for k in key]
    return fresh.join(stored, same, "left_anti")
