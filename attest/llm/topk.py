"""Exact top-k by inner product with vector-approximation files.

Every vector is stored with its quantised cell. A first scan reads cells only: the cell's lower bounds give each query,
per partition, a score that its k-th result reaches for certain, and the best of these is its threshold. A second scan
takes the vectors whose upper bound reaches the threshold, in the order of their bounds, and stops when the next bound
cannot reach the k-th exact score. Queries go in blocks of bounded bytes, one pair of scans per block; vectors are never
shuffled and every task sends at most k rows per query and batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import stored

BLOCK_BYTES = 16 << 20
BATCH_CELLS = 1 << 24


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double, as long integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    return F.coalesce(vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _cells(dims: int, low: int, width: int):
    def over(batches):
        for batch in batches:
            exact = _matrix(batch.column("vector"), dims)
            cells = ((exact - low) // width).astype(np.uint8)
            data = cells.tobytes()
            yield batch.append_column("cells", pa.array([data[k:k + dims] for k in range(0, len(data), dims)]
                                                        if dims else [b""] * batch.num_rows, pa.binary()))

    return over


def _corners(batch: pa.RecordBatch, dims: int, low: int, width: int) -> np.ndarray:
    """The lower corner of each row's cell."""
    cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, dims)
    return cells.astype(np.float64) * width + low


def _batches(batches, queries: int):
    """Runs of rows so small that a score for each query and row fits in memory."""
    rows = max(1, BATCH_CELLS // max(1, queries))
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def _thresholds(keys, queries, k: int, low: int, width: int):
    dims = queries.shape[1]

    def over(batches):
        slack = (width - 1) * np.minimum(queries, 0).sum(1)
        best = np.full((len(keys), k), -np.inf)
        for batch in _batches(batches, len(keys)):
            lower = queries @ _corners(batch, dims, low, width).T + slack[:, None]
            lower[keys[:, None] == batch.column("key").to_numpy()[None, :]] = -np.inf
            both = np.concatenate([best, lower], 1)
            best = -np.partition(-both, k - 1, 1)[:, :k]
        least = best.min(1)
        sure = np.flatnonzero(np.isfinite(least))
        yield pa.RecordBatch.from_arrays([pa.array(sure), pa.array(least[sure])], names=["query", "least"])

    return over


def _exact(keys, ids, queries, least, k: int, low: int, width: int):
    dims = queries.shape[1]
    whole = queries.astype(np.int64)

    def over(batches):
        slack = (width - 1) * np.maximum(queries, 0).sum(1)
        for batch in _batches(batches, len(ids)):
            upper = queries @ _corners(batch, dims, low, width).T + slack[:, None]
            vec = batch.column("vec_id").to_numpy()
            upper[keys[:, None] == batch.column("key").to_numpy()[None, :]] = -np.inf
            vectors = _matrix(batch.column("vector"), dims)
            found_k, found_q, found_v, found_s = [], [], [], []
            for q in np.flatnonzero((upper >= least[:, None]).any(1)).tolist():
                near = np.flatnonzero((upper[q] >= least[q]) & (upper[q] > -np.inf))
                near = near[np.argsort(-upper[q, near], kind="stable")]
                held_v, held_s = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for first in range(0, len(near), 4 * k):
                    if len(held_s) == k and upper[q, near[first]] < held_s[-1]:
                        break
                    step = near[first:first + 4 * k]
                    held_v = np.concatenate([held_v, vec[step]])
                    held_s = np.concatenate([held_s, vectors[step] @ whole[q]])
                    order = np.lexsort((held_v, -held_s))[:k]
                    held_v, held_s = held_v[order], held_s[order]
                reach = held_s >= least[q]
                found_k.append(np.full(int(reach.sum()), keys[q]))
                found_q.append(np.full(int(reach.sum()), ids[q]))
                found_v.append(held_v[reach])
                found_s.append(held_s[reach])
            if found_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found_k, found_q, found_v, found_s)],
                                                 names=["query_key", "query_id", "vec_id", "score"])

    return over


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = 64, cells: int = 32, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every row of `queries` with rows of `vectors`.

    Components become floor(scale * x); scores are exact up to 2**63 and bounds up to 2**53. Ties go to the smaller id. A row is no
    candidate for itself; rows that share its id with another vector are, and so are further rows equal to it. Each query row
    has a list of its own, also where ids repeat. Rows with a null id, or a vector that is null or has null or non-finite
    components, take no part; vectors meet only vectors of their own length. Repeated rows are candidates as often as they
    occur; a repeated query is asked once. With fewer than k candidates all are returned; empty tables give no rows.
    """
    def side(df):
        own = F.col(f"`{vector}`")
        return df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), own.alias("v")).where(
            F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", scaled(F.col("v"), scale).alias("vector")).withColumn(
            "key", F.xxhash64("vec_id", "vector"))

    rows = side(vectors)
    asked = stored(side(queries).dropDuplicates(["key"]), "queries")
    spans = rows.select(F.size("vector").alias("dims"), F.array_min("vector").alias("a"), F.array_max("vector").alias("b"))
    spans = spans.groupBy("dims").agg(F.min("a").alias("low"), F.max("b").alias("high")).collect()  # a row per vector length
    lengths = {r.dims for r in asked.select(F.size("vector").alias("dims")).distinct().collect()}
    parts = []
    for span in sorted(spans):
        dims, low = span.dims, span.low
        if dims not in lengths or dims == 0:
            continue
        width = max(1, -(-(span.high - low + 1) // cells))
        file = stored(rows.where(F.size("vector") == dims).mapInArrow(
            _cells(dims, low, width), "vec_id long, vector array<long>, key long, cells binary"), "cells")
        size = max(1, block_bytes // (8 * dims))
        mine = asked.where(F.size("vector") == dims)
        blocks = max(1, -(-mine.count() // size))
        blocked = stored(mine.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks))), "blocks")
        for block in range(blocks):  # one pair of scans per block of queries, of about block_bytes
            held = blocked.where(F.col("block") == block).select("key", "vec_id", "vector").toArrow().combine_chunks()
            if not held.num_rows:
                continue
            keys, ids = (held.column(c).combine_chunks().to_numpy().astype(np.int64) for c in ("key", "vec_id"))
            matrix = _matrix(held.column("vector").combine_chunks(), dims).astype(np.float64)
            first = file.select("key", "cells").mapInArrow(_thresholds(keys, matrix, k, low, width), "query long, least double")
            least = np.full(len(ids), -np.inf)
            for r in first.groupBy("query").agg(F.max("least").alias("least")).collect():
                least[r.query] = r.least
            parts.append(file.mapInArrow(_exact(keys, ids, matrix, least, k, low, width), "query_key long, query_id long, vec_id long, score long"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for more in parts[1:]:
        found = found.union(more)
    # rows equal to a query are found by their number, as the scans pass over all of them
    twins = rows.select("key").join(asked.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x * x)
    copies = asked.where(F.size("vector") > 0).join(twins, "key").select(
        F.col("key").alias("query_key"), F.col("vec_id").alias("query_id"), "vec_id", own.alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - 1, F.lit(k)))).alias("copy"))
    found = found.unionByName(copies.drop("copy"))
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
