"""Vectorised hashes over whole Arrow text columns: every byte window, every word, every line of a batch at once.

All functions work on the concatenated UTF-8 bytes of a batch, so that a batch of many short texts and one very long
text cost the same. Hashes are unsigned 64-bit numbers; equal bytes give equal hashes in every batch and process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.uint64(0x5851F42D4C957F2D)
_SHIFT = np.uint64(32)

# The 64-bit codes of the 256 bytes, from a fixed rule.
_CODES = (np.arange(1, 257, dtype=np.uint64) * _GOLD) ^ ((np.arange(1, 257, dtype=np.uint64) * _ODD) >> np.uint64(29))

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of an ordered pair of hashes."""
    out = a * _GOLD + b * _ODD
    out ^= out >> _SHIFT
    return out * _GOLD


def scramble(a: np.ndarray) -> np.ndarray:
    out = a ^ (a >> np.uint64(31))
    out = out * _ODD
    return out ^ (out >> _SHIFT)


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows of about `most_bytes` text at most; a longer single text is a run of its own."""
    if batch.num_rows == 0:
        return
    _, at = text_column(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(at, at[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def power_hashes(raw: np.ndarray, widths: set[int]) -> dict[int, np.ndarray]:
    """Hashes of all windows of each of `widths` bytes (powers of two) by their start; fewer of the longer windows."""
    level, width = _CODES[raw], 1
    out = {1: level} if 1 in widths else {}
    while width < max(widths):
        level = mix(level[:-width], level[width:]) if len(level) > width else level[:0]
        width *= 2
        if width in widths:
            out[width] = level
    return out


def span_hash(level: np.ndarray, width: int, starts: np.ndarray, lengths: np.ndarray, parts: int) -> np.ndarray:
    """Hashes of spans of `width` to `parts * width` bytes from evenly placed windows that together cover them."""
    out = lengths.astype(np.uint64)
    for k in range(parts):
        out = mix(out, level[starts + (lengths - width) * k // (parts - 1)])
    return out


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of code times base power up to each position, and the inverse powers that shift a difference back."""
    n = len(codes)
    powers = np.empty(n + 1, np.uint64)
    inverse = np.empty(n + 1, np.uint64)
    powers[0] = inverse[0] = 1
    powers[1:] = _BASE
    inverse[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * powers[:-1], out=sums[1:])
    return sums, inverse


def piece_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte pieces [start, end) of any lengths."""
    return coded_hashes(_CODES[raw], starts, ends)


def coded_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the pieces [start, end) of a sequence of 64-bit codes."""
    if len(codes) == 0:
        return np.zeros(len(starts), np.uint64)
    sums, inverse = _prefix(codes)
    return scramble((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


@dataclass
class Words:
    """The words (runs of bytes other than the six ASCII spaces) of a batch: text number, byte range, hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray

    def counts(self, docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=docs)


def words_of(raw: np.ndarray, at: np.ndarray) -> Words:
    """All words of the texts that lie in `raw` between the offsets `at`; no word crosses texts."""
    n = len(raw)
    inside = ~SPACES[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = at[:-1][at[:-1] < n]
    begins[firsts] = inside[firsts]
    stops = np.zeros(n + 1, dtype=bool)
    stops[1:] = inside
    stops[1:n] &= ~inside[1:]
    cuts = at[1:][at[1:] > 0]
    stops[cuts] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops)
    doc = np.searchsorted(at, start, side="right") - 1
    return Words(doc, start, end, piece_hashes(raw, start, end))


def shingles_of(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of `width` words inside one text."""
    n = len(words.doc) - width + 1
    if n <= 0:
        return words.doc[:0], words.code[:0]
    code = words.code[:n]
    for k in range(1, width):
        code = mix(code, words.code[k:n + k])
    whole = words.doc[:n] == words.doc[width - 1:]
    return words.doc[:n][whole], code[whole]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
