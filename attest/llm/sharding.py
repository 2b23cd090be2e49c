"""Shards of nearly equal bytes by sampled splitters.

The key of a record is made of its text's hash and its id's hash, so equal texts are neighbours in key order while no key
is hot. Splitters are quantiles of a sample in which a record's chance grows with its size; they cut the key range into
many small ranges. The exact bytes of each range are counted, ranges with too many rows are subdivided by key, and the
running sum of bytes in key order decides the shard of each record. Shards differ by less than one record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import arrow_map, stored

ROWS_PER_RANGE = 20_000
DRAWS_PER_RANGE = 16
MOST_RANGES = 100_000


def splitters(sizes: DataFrame, ranges: int, total: int) -> np.ndarray:
    """At most `ranges - 1` boundaries of the keys of `sizes` (key, size, n): quantiles of a size-weighted sample.

    A row of n equal records of one size is drawn by its own hash with a chance of draws * n * size / total, so that a
    rerun draws the same rows. The sample has about DRAWS_PER_RANGE rows per range, and MOST_RANGES bounds both.
    """
    draws = ranges * DRAWS_PER_RANGE
    chance = F.col("size") * F.col("n") * F.lit(draws / max(total, 1))
    draw = (F.xxhash64("key", F.lit("draw")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)))
    sample = np.sort(np.array([r.key for r in sizes.where(draw < chance).select("key").collect()], np.int64))
    if not len(sample):
        return sample
    return np.unique(sample[(np.arange(1, ranges) * len(sample)) // ranges])


def _range_rows(bounds: np.ndarray):
    def rows(batch: pa.RecordBatch):
        key = batch.column("key").to_numpy()
        yield batch.append_column("range", pa.array(np.searchsorted(bounds, key, side="right").astype(np.int32)))

    return rows


def _before(parts: DataFrame, group: list[str], amount: str, name: str) -> DataFrame:
    """(group, range, part, `name`): the `amount` of all earlier parts of the group.

    Ranges are summed first, at most MOST_RANGES rows in a group, then the parts inside each range; so the number of parts,
    which grows with the rows, meets in no task, and both tables are left to Spark's size check.
    """
    ranges = parts.groupBy(*group, "range").agg(F.sum(amount).alias("all"))
    along = (Window.partitionBy(*group) if group else Window).orderBy("range")
    ranges = ranges.select(*group, "range", (F.sum("all").over(along) - F.col("all")).alias("earlier"))
    inside = Window.partitionBy(*group, "range").orderBy("part")
    return parts.withColumn("within", F.sum(amount).over(inside) - F.col(amount)).join(ranges, [*group, "range"]).select(
        *group, "range", "part", (F.col("earlier") + F.col("within")).alias(name))


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 24,
          rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    Size is the UTF-8 bytes of the text plus 8; a null text has no bytes. Records are laid out in key order; a record is
    in the shard in which the middle of its bytes falls, so all shards have the same bytes to within one record. Equal
    texts are neighbours, on one shard or on consecutive ones. Equal rows (ties) are counted once with their number and
    given out again after numbering. Slots count from 0 in each shard without gaps. An empty table gives no rows; other
    columns are not read.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    own = F.col(f"`{doc_id}`")
    key = F.shiftleft(F.shiftrightunsigned(F.xxhash64(body), 24), 24).bitwiseOR(
        F.xxhash64(own, F.lit("id")).bitwiseAND(F.lit((1 << 24) - 1)))
    rows = docs.select(own.alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), key.alias("key"))
    rows = stored(rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    records, total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0))).first()
    ranges = max(1, min(MOST_RANGES, max(shards * 4, records // rows_per_range)))
    bounds = splitters(rows, ranges, total)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranged = stored(arrow_map(rows, _range_rows(bounds), f"{kinds}, range int"), "ranged")
    # overfull ranges are cut into equal parts of their own stretch of keys
    stretch = stored(ranged.groupBy("range").agg(
        F.count(F.lit(1)).alias("m"), F.min("key").alias("low"), F.max("key").alias("high")), "stretch")
    cuts = F.ceil(F.col("m") / F.lit(2 * rows_per_range))
    # keys are halved first: the distance of two 64-bit keys fits 64 bits then
    part = F.floor((F.shiftright("key", 1) - F.shiftright("low", 1)) /
                   (F.shiftright("high", 1) - F.shiftright("low", 1) + 1).cast("double") * cuts)
    divided = ranged.join(stretch, "range").withColumn("part", F.least(part, cuts - 1).cast("int"))
    in_order = Window.partitionBy("range", "part").orderBy("key", "doc_id", "text_crc32", "size")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    numbered = stored(divided.select(
        "range", "part", "doc_id", "size", "text_crc32", "n",
        F.coalesce(F.sum(F.col("size") * F.col("n")).over(before), F.lit(0)).alias("at")), "numbered")
    parts = stored(numbered.groupBy("range", "part").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")), "parts")
    placed = numbered.join(_before(parts, [], "bytes", "before"), ["range", "part"])
    each = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn(
        "middle", F.col("before") + F.col("at") + F.col("k") * F.col("size") + F.floor(F.col("size") / 2))
    target = F.least(F.floor(F.col("middle") * F.lit(shards) / F.lit(float(max(total, 1)))), F.lit(shards - 1)).cast("int")
    sharded = stored(each.select("range", "part", "middle", "doc_id", "size", "text_crc32", target.alias("shard")), "sharded")
    counts = stored(sharded.groupBy("shard", "range", "part").agg(F.count(F.lit(1)).alias("c")), "counts")
    starts = _before(counts, ["shard"], "c", "first")
    order = Window.partitionBy("shard", "range", "part").orderBy("middle")
    return sharded.join(starts, ["shard", "range", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.row_number().over(order) - 1).cast("long").alias("slot"))
