"""Lookups between metadata tables as link tables: one row per link, never a list per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.evidence import tables as S


def evidence_by_claim(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence that claims list and that exists."""
    links = claims.select(F.col("id").alias("claim_id"), F.explode("evidence_ids").alias("evidence_id")).distinct()
    return links.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")


def dependants(claims: DataFrame) -> DataFrame:
    return claims.select(F.explode("depends_on").alias("claim_id"), F.col("id").alias("dependant_id"))


def derived_children(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("derived_from").isNotNull()).select(
        F.col("derived_from").alias("claim_id"), F.col("id").alias("child_id"))


def claims_by_source(claims: DataFrame) -> DataFrame:
    return claims.select(F.explode("source_ids").alias("source_id"), F.col("id").alias("claim_id"))


def role_bindings_by_column(claims: DataFrame) -> DataFrame:
    table, column = F.try_element_at("binding", F.lit("table")), F.try_element_at("binding", F.lit("column"))
    return claims.filter(table.isNotNull() & column.isNotNull()).select(
        F.concat_ws(".", table, column).alias("column_key"), F.col("id").alias("claim_id"))


def declarations_by_column(evidence: DataFrame) -> DataFrame:
    part = lambda name: F.coalesce(F.try_element_at("payload", F.lit(name)), F.lit("")).alias(name)
    return evidence.filter(F.col("type") == S.DECLARATION).select(
        part("source"), part("table"), part("column"), F.col("id").alias("evidence_id"))


def profiles_by_source(profiles: DataFrame) -> DataFrame:
    return profiles.select("source_id", F.col("id").alias("profile_id"))


def fingerprint_names(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.explode(F.map_keys("source_fingerprints")).alias("name")).distinct()
