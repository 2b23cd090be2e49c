"""From declared sources to profiles and candidate matrix. Scanning measures; it creates no claims."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.frames import declared, union_all
from attest.operators import overlap, profile
from attest.operators.values import settled_counts
from attest.plans.rescan import kept_counts, view_stamps
from attest.session import settle
from attest.sources.catalog import Catalog, build_catalog, write_matrix
from attest.sources.fingerprint import source_fingerprint, upsert_sources
from attest.sources.grid import new_decisions
from attest.sources.specs import JDBC, SourceSpec

SOURCES = "id string, name string, kind string, location string, fingerprint map<string,string>"
DECLARATIONS = "source string, table string, column string, rule string, before string, after string, stamp string"


@dataclass
class ScanResult:
    catalog: Catalog
    sources: DataFrame
    declarations: DataFrame
    profiles: DataFrame
    matrix: DataFrame
    header: DataFrame
    counted: list[str]


def source_states(spark: SparkSession, specs: Sequence[SourceSpec], content: bool = True) -> DataFrame:
    """Current sources with fingerprints; a JDBC source has no file and carries its location only."""
    rows = []
    for spec in specs:
        if spec.kind == JDBC:
            state = declared(spark, "files bigint, size bigint, sha256 string", [(None, None, None)])
        else:
            state = source_fingerprint(spark, spec.location, content)
        rows.append(state.select(
            F.lit(spec.name).alias("name"), F.lit(spec.kind).alias("kind"), F.lit(spec.location).alias("location"),
            F.create_map(F.lit("size"), F.col("size").cast("string"), F.lit("sha256"), F.col("sha256")).alias("fingerprint")))
    return union_all(rows)


def scan(
    spark: SparkSession,
    specs: Sequence[SourceSpec],
    stored_sources: DataFrame | None = None,
    stored_declarations: DataFrame | None = None,
    stored_profiles: DataFrame | None = None,
    folder: str | None = None,
    content: bool = True,
    keep: str | None = None,
) -> ScanResult:
    """Catalogue, fingerprints, declared decisions, profiles and matrix in one go.

    Running it again with what was stored keeps ids and adds only decisions that are new for a source state. With a
    `folder`, profiles and matrix are written there. With `keep`, a folder that holds value counts between scans, only
    views whose files changed are counted again.
    """
    file_stamps = None if keep is None else settle(view_stamps(spark, specs), "stamps")
    catalog = build_catalog(spark, specs)
    states = settle(source_states(spark, specs, content), "sources")
    sources = upsert_sources(
        declared(spark, SOURCES, []) if stored_sources is None else stored_sources, states)
    stamps = states.select(F.col("name").alias("source"), F.col("fingerprint")["sha256"].alias("stamp"))
    declarations = new_decisions(
        catalog.decision_table().join(stamps, "source", "left"),
        declared(spark, DECLARATIONS, []) if stored_declarations is None else stored_declarations)
    recount = None if keep is None else kept_counts(catalog, file_stamps, keep)
    counts = settled_counts(catalog.views) if recount is None else recount.counts
    belongs = declared(spark, "table string, source string", list(catalog.source_of.items())).join(
        sources.select(F.col("name").alias("source"), F.col("id").alias("source_id")), "source").drop("source")
    profiles = profile.profile_views(catalog.views, counts).join(belongs, "table")
    profiles = profile.upsert_profiles(
        declared(spark, "id string, source_id string, table string, column string", [])
        if stored_profiles is None else stored_profiles, profiles)
    pairs = overlap.overlapping_pairs(catalog.views, counts)
    matrix, header = overlap.score_pairs(pairs), overlap.matrix_header(pairs)
    if folder is not None:
        profiles.write.mode("overwrite").parquet(f"{folder}/profiles")
        write_matrix(matrix, header, folder)
    return ScanResult(catalog, sources, declarations, profiles, matrix, header,
                      sorted(catalog.views) if recount is None else recount.counted)
