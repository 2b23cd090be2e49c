"""Value counts that are kept between scans, so that only tables that changed are counted again.

Counts are stored per view, stamp of its files and run. A list beside them names what a run wrote to the end; only that is
used again, so a scan that was broken off leaves nothing wrong behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.frames import declared, union_all
from attest.functions.names import slug, view_name
from attest.operators.values import LATE, Counts, column_list, value_counts
from attest.session import settle
from attest.sources import specs as S
from attest.sources.catalog import Catalog

KEPT = f"column string, value string, late {LATE}, n bigint, view string, stamp string, run string"
STAMPS = "view string, stamp string"
LIST = f"{STAMPS}, run string"


def view_stamps(spark: SparkSession, specs: Sequence[S.SourceSpec]) -> DataFrame:
    """``(view, stamp)`` of all views that come from files: what their files are called, how large and how old they are.

    Only paths are read. The stamps of the files of a view are combined by sums, which need no order. Views of a database
    connection have no files and no stamp.
    """
    parts = [declared(spark, STAMPS, [])]
    for spec in specs:
        if spec.kind not in (S.TABLES, S.CSV, S.SHEET):
            continue
        path = S.plain_path(F.col("path"))
        if spec.kind == S.TABLES:
            root = S.plain_path(F.lit(spec.location.rstrip("/") + "/"))
            table = F.split_part(F.substring(path, F.length(root) + 1, F.length(path)), F.lit("/"), F.lit(1))
            files = S.list_files(spark, spec.location, "*.parquet").withColumn("table", F.regexp_replace(table, r"\.parquet$", ""))
            names = {r[0]: view_name(spec.name, r[0]) for r in files.select("table").distinct().collect()}
            named = files.join(declared(spark, "table string, view string", list(names.items())), "table")
        elif spec.kind == S.CSV:
            stem = spec.location.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
            named = S.list_files(spark, spec.location).withColumn("view", F.lit(view_name(spec.name, stem)))
        else:
            title = slug(spec.options.get("sheet", "sheet1")) or "column"
            named = S.list_files(spark, spec.location).withColumn("view", F.lit(f"{slug(spec.name)}__{title}"))
        # how the source is read is part of the stamp: other options give other values
        one = F.xxhash64("path", "length", "modificationTime", F.lit(repr(sorted(spec.options.items()))))
        sums = [F.sum(part.cast("decimal(38,0)")) for part in (one, F.xxhash64(one, "path"))]
        parts.append(named.groupBy("view").agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), *sums), 256).alias("stamp")))
    return union_all(parts)


@dataclass(frozen=True)
class Recount:
    """Counts of all views, and the names of those that had to be counted now."""

    counts: Counts
    counted: list[str]


def kept_counts(catalog: Catalog, stamps: DataFrame, folder: str, masks: bool = True) -> Recount:
    """Value counts of the catalogue: those of unchanged views are read from `folder`, the others are counted and kept there.

    `stamps` is what `view_stamps` returned; it must have been made before the views are counted. Views without a stamp are
    always counted. One name and stamp per view reach the driver.
    """
    spark, views = catalog.spark, catalog.views
    now = {r["view"]: r["stamp"] for r in stamps.collect() if r["view"] in views}
    store, listed = f"{folder.rstrip('/')}/counts", f"{folder.rstrip('/')}/list"
    declared(spark, LIST, []).write.mode("append").parquet(listed)
    flavour, run = "m" if masks else "p", f"r{uuid.uuid4().hex}"
    want = {v: f"{flavour}{now[v]}" if v in now else None for v in views}
    asked = declared(spark, STAMPS, [(v, s) for v, s in want.items() if s is not None])
    done = {r["view"]: r["run"] for r in spark.read.schema(LIST).parquet(listed).join(asked, ["view", "stamp"]).groupBy("view").agg(
        F.min("run").alias("run")).collect()}
    missing = [v for v in views if v not in done]
    parts = []
    if missing:
        chosen = {v: views[v] for v in missing}
        names = declared(spark, "cid int, view string, column string, stamp string, run string",
                         [(cid, view, column, want[view], run) for cid, view, column, _ in column_list(chosen)])
        fresh = settle(value_counts(chosen, masks).frame.join(F.broadcast(names), "cid").drop("cid"), "counted")
        fresh.filter("stamp IS NOT NULL").write.mode("append").partitionBy("view", "stamp", "run").parquet(store)
        declared(spark, LIST, [(v, want[v], run) for v in missing if want[v] is not None]).write.mode("append").parquet(listed)
        parts.append(fresh.select("view", "column", "value", "late", "n"))
    if done:
        stored = spark.read.schema(KEPT).parquet(store)
        # the runs are literals, so only their folders are read
        stored = stored.filter(F.col("run").isin(sorted(set(done.values()))))
        stored = stored.join(F.broadcast(declared(spark, LIST, [(v, want[v], r) for v, r in done.items()])), ["view", "stamp", "run"], "left_semi")
        parts.append(stored.select("view", "column", "value", "late", "n"))
    numbers = declared(spark, "cid int, view string, column string", [(cid, view, column) for cid, view, column, _ in column_list(views)])
    frame = union_all(parts).join(F.broadcast(numbers), ["view", "column"]).select("cid", "value", "late", "n")
    return Recount(Counts(frame, views), sorted(missing))
