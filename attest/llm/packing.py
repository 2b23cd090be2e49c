"""Best-fit packing of documents into sequences, with lower bounds that certify each partition's number of bins.

Every partition packs its pieces best-fit decreasing and compares the number of bins with dual-feasible-function bounds
of its lengths. A partition that meets its bound is done. The others keep their full bins and release the pieces of bins
with room, which are dealt anew to fewer partitions and packed again, until the bounds are met or one partition holds
what is left. A partition never holds more than a fixed number of pieces (ids, lengths and checksums, no texts).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import stored
from attest.llm.hashing import slices
from attest.llm.tokens import Encoder

PIECES_PER_PARTITION = 100_000


def _piece_rows(columns: list[str], path: str, capacity: int, end_id: int, marks: bool):
    def over(batches):
        encoder = Encoder(path, marks)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids, counts = encoder.encode(part.column("__text"))
                lasts = np.cumsum(counts)
                ids = np.insert(ids, lasts, np.uint32(end_id)).astype("<u4")
                counts = counts + 1
                firsts = np.cumsum(counts) - counts
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(part.num_rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = counts - (pieces - 1) * capacity  # the first piece takes what whole pieces leave
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, short[row], capacity)
                data, begin = ids.tobytes(), (firsts[row] + start) * 4
                crc = [zlib.crc32(data[b:e]) for b, e in zip(begin.tolist(), (begin + length * 4).tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in columns), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[*columns, "piece", "start", "length", "ids_crc32"])

    return over


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The largest of several dual-feasible-function bounds for `counts[length]` items of each length."""
    sizes = np.arange(capacity + 1)
    items = np.concatenate([[0], np.cumsum(counts)])  # items shorter than a length
    total = np.concatenate([[0], np.cumsum(counts * sizes)])
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    # items over capacity - a fill a bin each, items over half have a bin each with room for items from a to half
    a = np.arange(0, half + 1)
    alone = items[-1] - items[np.minimum(capacity - a, capacity) + 1]
    large = items[capacity - a + 1] - items[half + 1]
    room = large * capacity - (total[capacity - a + 1] - total[half + 1])
    middle = total[half + 1] - total[a]
    best = max(best, int((alone + large + np.maximum(0, -(-(middle - room) // capacity))).max()))
    for k in range(1, 33):  # rounding to k-ths of a bin
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, room left in each bin)."""
    order = np.argsort(-lengths, kind="stable").tolist()
    plain = lengths.tolist()
    bins, offsets = [0] * len(plain), [0] * len(plain)
    room: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit r: some bin has room r
    for item in order:
        size = plain[item]
        fitting = present >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            chosen = open_by_room[left].pop()
            if not open_by_room[left]:
                present ^= 1 << left
        else:
            chosen, left = len(room), capacity
            room.append(capacity)
        bins[item], offsets[item] = chosen, capacity - left
        left -= size
        room[chosen] = left
        open_by_room[left].append(chosen)
        if left:
            present |= 1 << left
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(room, np.int64)


def _pack(capacity: int, turn: int, last: bool):
    def over(batches):
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        lengths = whole.column("length").to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        keep = np.ones(len(lengths), bool) if last or gap <= 0 else room[bins] == 0
        part = TaskContext.get().partitionId()
        sequence = (turn << 56) + (part << 28) + bins
        whole = whole.drop_columns(["sequence_id", "offset"]).append_column(
            "sequence_id", pa.array(sequence, mask=~keep)).append_column("offset", pa.array(offsets, mask=~keep))
        yield from whole.combine_chunks().to_batches()

    return over


def pack(docs: DataFrame, columns: list[str], tokenizer: str, text: str = "text", capacity: int = 1024, end_id: int = 2,
         per_partition: int = PIECES_PER_PARTITION, turns: int = 8, marks: bool = False) -> DataFrame:
    """One row per piece: `columns`, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text and `end_id`; only documents of more than `capacity` ids are cut, into whole
    pieces after a first one that takes the rest. Null and empty texts are one piece with `end_id` alone; repeated rows
    are packed as often as they occur; an empty table gives no rows. `columns` may have any names but these six.
    With `marks` the tokenizer's added tokens, such as <|endoftext|>, get their own ids; without, they are spelled out.
    """
    if not 1 < capacity < 1 << 28 or per_partition >= 1 << 28:
        raise ValueError("capacity and pieces of a partition must be below 2**28")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("string").alias("__text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    shape = f"{kinds}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(rows.mapInArrow(_piece_rows(columns, tokenizer, capacity, end_id, marks), shape), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumns({
        "sequence_id": F.monotonically_increasing_id().bitwiseOR(F.lit(1 << 62)), "offset": F.lit(0).cast("long")})
    placed, open_ = [full], pieces.where(F.col("length") < capacity).withColumns({
        "sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    before = None
    for turn in range(turns):
        left = open_.count()
        if not left:
            break
        parts = -(-left // per_partition)
        last = parts == 1 or turn == turns - 1 or (before is not None and parts > before // 2)
        before = parts
        open_ = stored(open_.repartition(parts).mapInArrow(
            _pack(capacity, turn, last), f"{shape}, sequence_id long, offset long"), "packed")
        placed.append(open_.where("sequence_id is not null"))
        if last:
            break
        open_ = open_.where("sequence_id is null")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out
