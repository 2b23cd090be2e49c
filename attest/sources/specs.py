"""Declared sources: nothing is read unless it is listed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.frames import declared

# Kinds of sources. A database is a folder of Parquet tables or a JDBC connection.
TABLES, JDBC, CSV, SHEET, DOCUMENT = "tables", "jdbc", "csv", "sheet", "document"
KINDS = (TABLES, JDBC, CSV, SHEET, DOCUMENT)


@dataclass(frozen=True)
class SourceSpec:
    name: str
    kind: str
    location: str
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown source kind: {self.kind!r} ({self.name})")


def load_specs(entries: Iterable[Mapping]) -> list[SourceSpec]:
    """Specs from declared entries ``{name, kind, location, options?}``; names must be unique."""
    specs = [SourceSpec(e["name"], e["kind"], e["location"], e.get("options", {})) for e in entries]
    names = [s.name for s in specs]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated source names: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return specs


def read_specs(spark: SparkSession, path: str) -> list[SourceSpec]:
    """Specs from a JSON-lines file of declared entries."""
    rows = spark.read.schema("name string, kind string, location string, options map<string,string>").json(path)
    return load_specs(r.asDict() | {"options": r["options"] or {}} for r in rows.collect())


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modificationTime)`` of the files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(folder).select("path", "length", "modificationTime")
    )


def plain_path(path: Column) -> Column:
    """A path without scheme, so that declared and listed locations compare."""
    return F.regexp_replace(path, r"^[a-z0-9]+:/+(?=/)|^file:(?=/)", "")


def undeclared_files(spark: SparkSession, folder: str, specs: list[SourceSpec]) -> DataFrame:
    """Files in a folder that no source declares; they are listed, never read."""
    known = declared(spark, "location string", [(s.location.rstrip("/"),) for s in specs])
    known = known.select(plain_path(F.col("location")).alias("location"))
    files = list_files(spark, folder).select(plain_path(F.col("path")).alias("path"), "length")
    steps = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    covered = files.select("path", F.explode(ancestors).alias("location")).join(known, "location", "left_semi")
    return files.join(covered.select("path"), "path", "left_anti")
