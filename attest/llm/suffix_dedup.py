"""Removal of byte strings that occur more than once, by a depth-limited radix sort of suffixes.

Suffixes are compared only through `length` bytes, most significant part first, and only suffixes whose group still has
more than one member go on to the next, deeper digit:

1. The first digit of a suffix is the gram with the smallest hash inside its first `length` bytes. Consecutive suffixes
   share it, so one row stands for the whole run of suffixes around that gram. Groups of one are done. Runs that are
   equal as a whole are repeated as a whole, and one row of them stays as a partner for the others.
2. The runs left over are cut into blocks of suffixes at the same distances from the gram. The digit is the text that
   all suffixes of a block have in common. Blocks alone in their group are done.
3. The digit is all `length` bytes. The groups left are exactly the repeated windows.

Every pass is a count by a hash with partial sums before the shuffle, so a string that fills a third of the corpus
arrives as one row per task. Both sides of a match carry 128 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import arrow_map, discard, stored
from attest.llm.hashing import mix, power_hashes, signed, slices, span_hash, text_column

_PIECE = 1 << 21
_PLACE = np.uint64((1 << 26) - 1)


class Depth:
    """The widths that follow from the length of a window."""

    def __init__(self, length: int):
        if not 2 <= length < 1 << 13:
            raise ValueError("length must lie between 2 and 8191 bytes")
        self.length = length
        self.power = 1 << (length.bit_length() - 1)
        self.gram = 1 << (max(1, length // 3).bit_length() - 1)
        self.reach = length - self.gram + 1
        self.block = max(1, min(length // 12, length - self.power + 1))


def _runs(raw: np.ndarray, at: np.ndarray, d: Depth):
    """(gram hash, run hash, first start, last start, gram start) of the runs of suffixes that share their gram."""
    windows = len(raw) - d.length + 1
    if windows <= 0:
        return None
    levels = power_hashes(raw, {d.gram, d.power})
    grams = levels[d.gram]
    best = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= d.reach:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    best = np.minimum(best[:windows], best[d.reach - width:d.reach - width + windows])
    gram = (best & _PLACE).astype(np.int64)
    inside = np.zeros(windows + 1, np.int64)
    from_, to = at[:-1], at[1:] - d.length + 1
    fits = to > from_
    np.add.at(inside, from_[fits], 1)
    np.add.at(inside, to[fits], -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]))
    if not len(starts):
        return None
    gram = gram[starts]
    cut = np.flatnonzero((np.diff(gram) != 0) | (np.diff(starts) != 1)) + 1
    # a text may begin where the windows of the text before end
    head = np.r_[0, cut]
    first, last, gram = starts[head], starts[np.r_[cut - 1, len(starts) - 1]], gram[head]
    whole = span_hash(levels[d.power], d.power, first, last + d.length - first, 5)
    return grams[gram], mix(whole, (gram - first).astype(np.uint64)), first, last, gram


def _pieces(raw: np.ndarray, length: int):
    """Overlapping pieces of one long text; each window lies in exactly one of them."""
    for begin in range(0, max(1, len(raw) - length + 1), _PIECE):
        yield begin, raw[begin:begin + _PIECE + length - 1]


def _run_rows(d: Depth):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, "text"):
            raw, at = text_column(part.column("text"))
            key, size = part.column("key").to_numpy(), part.column("size").to_numpy()
            if part.num_rows == 1 and len(raw) > 2 * _PIECE:
                work = [(b, piece, np.array([0, len(piece)])) for b, piece in _pieces(raw, d.length)]
            else:
                work = [(0, raw, at)]
            for begin, piece, offsets in work:
                found = _runs(piece, offsets, d)
                if found is None:
                    continue
                gram_hash, run_hash, first, last, gram = found
                doc = np.searchsorted(offsets, first, side="right") - 1
                place = ((first - offsets[doc] + begin) << 28) | ((last - first) << 14) | (gram - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(gram_hash)), pa.array(signed(run_hash)), pa.array(key[doc]), pa.array(size[doc]),
                     pa.array(place)], names=["gram", "run", "key", "size", "place"])

    return rows


def _segments(d: Depth):
    """Texts with their open runs -> one row per run with the bytes its windows cover."""

    def rows(batch: pa.RecordBatch):
        raw, at = text_column(batch.column("text"))
        opened = batch.column("opened")
        counts = np.diff(opened.offsets.to_numpy())
        flat = opened.flatten()
        gram, place, alone = (flat.field(k) for k in ("gram", "place", "alone"))
        where = place.to_numpy()
        doc = np.repeat(np.arange(batch.num_rows), counts)
        first = where >> 28
        begin = at[doc] + first
        end = begin + ((where >> 14) & 0x3FFF) + d.length
        data = raw.tobytes()
        for k in range(0, len(where), 20000):
            text = pa.array([data[b:e] for b, e in zip(begin[k:k + 20000].tolist(), end[k:k + 20000].tolist())], pa.binary())
            n = len(text)
            yield pa.RecordBatch.from_arrays(
                [gram.slice(k, n), pa.array(batch.column("key").to_numpy()[doc[k:k + n]]),
                 pa.array(batch.column("size").to_numpy()[doc[k:k + n]]), place.slice(k, n), alone.slice(k, n), text],
                names=["gram", "key", "size", "place", "alone", "bytes"])

    return rows


def _block_rows(d: Depth):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, "bytes"):
            raw, at = text_column(part.column("bytes"))
            level = power_hashes(raw, {d.power})[d.power]
            where = part.column("place").to_numpy()
            gram, many = where & 0x3FFF, ((where >> 14) & 0x3FFF) + 1
            low, high = np.maximum(gram - many + 1, 0) // d.block, gram // d.block  # blocks by distance from the gram
            low = np.where(gram - many + 1 < 0, -((many - 1 - gram + d.block - 1) // d.block), low)
            counts = high - low + 1
            row = np.repeat(np.arange(part.num_rows), counts)
            block = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + low[row]
            core = span_hash(level, d.power, at[row] + gram[row] - block * d.block,
                             np.full(len(row), d.length - d.block + 1), 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("gram").take(pa.array(row)), pa.array(signed(mix(core, block.astype(np.uint64)))),
                 pa.array(part.column("key").to_numpy()[row]), pa.array(part.column("size").to_numpy()[row]),
                 pa.array(where[row]), pa.array(block.astype(np.int32))],
                names=["gram", "core", "key", "size", "place", "block"])

    return rows


def _window_rows(d: Depth):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, "bytes", 1 << 18):
            raw, at = text_column(part.column("bytes"))
            level = power_hashes(raw, {d.power})[d.power]
            where = part.column("place").to_numpy()
            gram, many = where & 0x3FFF, ((where >> 14) & 0x3FFF) + 1
            blocks = part.column("blocks")
            row = np.repeat(np.arange(part.num_rows), np.diff(blocks.offsets.to_numpy()))
            block = blocks.flatten().to_numpy().astype(np.int64)
            low = np.maximum(gram[row] - (block + 1) * d.block + 1, 0)
            high = np.minimum(gram[row] - block * d.block, many[row] - 1)
            counts = high - low + 1
            item = np.repeat(np.arange(len(row)), counts)
            start = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + low[item]
            row = row[item]
            window = span_hash(level, d.power, at[row] + start, np.full(len(row), d.length), 2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [part.column("gram").take(take), pa.array(signed(window)), part.column("key").take(take),
                 part.column("size").take(take), pa.array((where[row] >> 28) + start), part.column("alone").take(take)],
                names=["gram", "window", "key", "size", "start", "alone"])

    return rows


def repeated_spans(texts: DataFrame, length: int = 400) -> DataFrame:
    """(key, size, spans): starts of repeated windows as runs (first, last), for the texts of `texts` (key, size, text).

    `key` and `size` name a text, not a row: rows with the same pair hold the same text and repeat each other. Runs may
    overlap or touch. A text without a repeated window has no row.
    """
    d = Depth(length)
    long_enough = texts.where(F.col("size") >= length).select("key", "size", "text")
    runs = stored(arrow_map(long_enough, _run_rows(d), "gram long, run long, key long, size int, place long"), "runs")
    # counts are stored before they are joined: a join of two plain shuffles can be split where a key is hot
    twice = stored(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "twice")
    met = stored(runs.join(twice, "gram", "left_semi"), "met")
    discard(runs)
    groups = stored(met.groupBy("gram", "run").agg(
        F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("size").alias("size"),
        F.first("place").alias("place")), "groups")
    equal = met.join(groups.where("n > 1").select("gram", "run"), ["gram", "run"], "left_semi")
    equal = equal.select("key", "size", "place").distinct().select(
        "key", "size", F.shiftright("place", 28).alias("first"),
        (F.shiftright("place", 28) + F.shiftright("place", 14).bitwiseAND(F.lit(0x3FFF))).alias("last"))
    several = stored(groups.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "several")
    opened = groups.join(several, "gram", "left_semi").groupBy("key", "size").agg(
        F.collect_list(F.struct("gram", "place", (F.col("n") == 1).alias("alone"))).alias("opened"))
    once = long_enough.groupBy("key", "size").agg(F.first("text").alias("text"))
    segments = stored(arrow_map(
        once.join(opened, ["key", "size"]).select("key", "size", "text", "opened"), _segments(d),
        "gram long, key long, size int, place long, alone boolean, bytes binary"), "segments")
    blocks = stored(arrow_map(segments, _block_rows(d),
                              "gram long, core long, key long, size int, place long, block int"), "blocks")
    shared = stored(blocks.groupBy("gram", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "core"),
                    "shared")
    kept = blocks.join(shared, ["gram", "core"], "left_semi").groupBy("key", "size", "place").agg(
        F.collect_list("block").alias("blocks"))
    windows = stored(arrow_map(segments.join(kept, ["key", "size", "place"]).select(
        "gram", "key", "size", "place", "alone", "bytes", "blocks"), _window_rows(d),
        "gram long, window long, key long, size int, start long, alone boolean"), "windows")
    discard(blocks)
    discard(segments)
    again = stored(windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "gram", "window"), "again")
    single = windows.where("alone").join(again, ["gram", "window"], "left_semi").select(
        "key", "size", F.col("start").alias("first"), F.col("start").alias("last"))
    return stored(equal.unionByName(single).groupBy("key", "size").agg(
        F.collect_list(F.struct("first", "last")).alias("spans")), "spans")


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal covered runs of half-open pieces."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    head = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
    return starts[head], ends[np.r_[head[1:] - 1, len(ends) - 1]]


def _cut(length: int, keep: list[str]):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, "__text"):
            raw, at = text_column(part.column("__text"))
            data, spans = raw.tobytes(), part.column("__spans")
            flat, offsets = spans.flatten(), spans.offsets.to_numpy() - spans.offsets[0].as_py()
            first, last = (flat.field(k).to_numpy() for k in ("first", "last"))
            kept, removed, runs = [], [], []
            for row in range(part.num_rows):
                low, high = offsets[row], offsets[row + 1]
                text = data[at[row]:at[row + 1]]
                if low == high:
                    kept.append(text)
                    removed.append(0)
                    runs.append([])
                    continue
                start, end = _covered(first[low:high], last[low:high] + length)
                edges = [0, *np.stack([start, end], 1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)))
                removed.append(int((end - start).sum()))
                runs.append([{"start": s, "end": e} for s, e in zip(start.tolist(), end.tolist())])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(np.diff(at)), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
                 pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())],
                names=[*keep, "n_bytes", "n_removed", "spans", "kept", "kept_text"])

    return rows


def remove_repeats(docs: DataFrame, columns: list[str], text: str = "text", length: int = 400) -> DataFrame:
    """`columns` of every row, and n_bytes, n_removed, spans (start, end: maximal removed runs), kept (bytes) and
    kept_text (the characters of kept; one of which a cut leaves only some bytes is not among them).

    A byte goes if it lies in a string of `length` bytes that also starts anywhere else, in the same text or another;
    strings are judged on the input and do not cross texts. Null texts are empty. Repeated rows repeat each other, ties do
    not arise, empty tables give no rows, texts shorter than `length` stay whole, and texts longer than 4 MB are read in
    overlapping pieces. `columns` may have any names but the five above.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = docs.select(F.xxhash64(body).alias("key"), F.octet_length(body).alias("size"), body.alias("text"))
    spans = repeated_spans(texts, length)
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], body.alias("__text"), F.xxhash64(body).alias("__key"),
                       F.octet_length(body).alias("__size"))
    joined = rows.join(spans.select(F.col("key").alias("__key"), F.col("size").alias("__size"), F.col("spans").alias("__s")),
                       ["__key", "__size"], "left")
    none = F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)")
    joined = joined.select(*[F.col(f"`{c}`") for c in columns], "__text", F.coalesce("__s", none).alias("__spans"))
    kinds = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in columns)
    return arrow_map(joined, _cut(length, columns),
                     f"{kinds}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary, kept_text string")
