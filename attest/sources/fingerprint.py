"""Fingerprints of files and sources, and source records that keep their id across scans."""

from __future__ import annotations

import hashlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.session import listing


# Bytes up to which Spark reads a file as one value, and bytes that a stream holds at a time.
ONE_VALUE = 64 << 20
CHUNK = 4 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path names, and the path inside it."""
    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def _stream(path: str):
    """A file as a stream, in whatever store its path names."""
    store, inside = store_of(path)
    return store.open_input_stream(inside)


def _stream_digests(batches):
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            state = hashlib.sha256()
            with _stream(path) as stream:
                while chunk := stream.read(CHUNK):
                    state.update(chunk)
            digests.append(state.hexdigest())
        yield batch.append_column("sha256", pa.array(digests, pa.string()))


def file_fingerprints(spark: SparkSession, location: str, content: bool = True, one_value: int = ONE_VALUE) -> DataFrame:
    """``(path, size, sha256)`` per file. Without `content` the digest covers path, size and change time only.

    Files of at most `one_value` bytes are digested where Spark reads them. Larger ones, of any size, are opened by a task as
    a stream and digested chunk by chunk, each file in a row of its own that any executor can take over; their store must be
    one that Arrow opens too, else the job fails with the path. The listing of large files reads no content. Spark passes over files without bytes.
    """
    with listing(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    if not content:
        return files.select("path", F.col("length").alias("size"), F.sha2(F.concat_ws(
            "|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256).alias("sha256"))
    small = files.filter(F.col("length") <= one_value).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > one_value).select("path", F.col("length").alias("size")).repartition("path")
    return small.unionByName(large.mapInArrow(_stream_digests, "path string, size bigint, sha256 string"))


def source_fingerprint(spark: SparkSession, location: str, content: bool = True, one_value: int = ONE_VALUE) -> DataFrame:
    """One row ``(files, size, sha256)`` for a source of one or many files.

    A single file keeps its own digest. For many files the digests are combined by exclusive or of their quarters,
    which needs no order and combines on the map side; the path enters each digest so that equal files do not cancel.
    """
    files = file_fingerprints(spark, location, content, one_value)
    named = F.sha2(F.concat_ws("|", "path", "sha256"), 256)
    quarter = lambda i: F.conv(F.substring(named, 16 * i + 1, 15), 16, 10).cast("bigint")
    rest = F.conv(F.concat(*[F.substring(named, 16 * i, 1) for i in range(1, 5)]), 16, 10).cast("bigint")
    pieces = [F.bit_xor(quarter(i)) for i in range(4)] + [F.bit_xor(rest)]
    combined = F.sha2(F.concat_ws("|", *[p.cast("string") for p in pieces]), 256)
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"),
        F.when(F.count(F.lit(1)) == 1, F.max("sha256")).otherwise(combined).alias("sha256"))


def upsert_sources(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sources by name ``(id, name, kind, location, fingerprint)``: known ones keep their id, others get a new one."""
    old = stored.select("name", F.col("id").alias("old_id"), F.col("kind").alias("old_kind"),
                        F.col("location").alias("old_location"), F.col("fingerprint").alias("old_fingerprint"))
    merged = old.join(fresh.drop("id"), "name", "full_outer")
    return merged.select(
        F.coalesce("old_id", F.sha2("name", 256)).alias("id"), "name",
        F.coalesce("old_kind", "kind").alias("kind"), F.coalesce("old_location", "location").alias("location"),
        F.coalesce("fingerprint", "old_fingerprint").alias("fingerprint"))
