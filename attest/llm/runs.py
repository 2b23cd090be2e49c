"""Periodic runs in word sequences by minimizers of several scales.

A run is a stretch of words that repeats with its smallest period and that no neighbouring word extends. Runs of short
periods are found by direct scans of each lag. Longer periods fall into scales: inside a run whose period a scale covers,
the smallest hash in a window of word groups comes back exactly one period later, so two neighbouring minimizers with equal
groups give the period and a place inside the run. From there the words themselves are compared in both directions. All
steps work on the words of many documents at once; a batch of short texts and one very long text cost the same a word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.llm.common import arrow_map
from attest.llm.hashing import mix, slices, text_column, words_of

# Periods up to this one are found by direct lag scans.
SHORT = 8
_BLOCK = 1 << 20

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _lag_scan(code: np.ndarray, doc: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal stretches of at least `least` words in which words `lag` apart are equal."""
    if len(code) <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(code) - lag + 2, np.int8)
    same[1:-1] = (code[lag:] == code[:-lag]) & (doc[lag:] == doc[:-lag])
    edge = np.diff(same)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + lag
    long = end - start >= least
    return start[long], end[long]


def _equal_words(code: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, room: np.ndarray,
                 take: np.ndarray) -> np.ndarray:
    """How many of the words at, at + step, ... (at most `room`) equal the word `period` further on, up to the first that
    does not. `take` words are compared first, then twice as many, so the work follows the answer."""
    done = np.zeros(len(at), np.int64)
    active, take = np.flatnonzero(room > 0), np.maximum(take, 1)
    while len(active):
        n = np.minimum(take[active], room[active] - done[active])
        found = n.copy()
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - 1) // _BLOCK)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(n)]):
            own = np.repeat(np.arange(lo, hi), n[lo:hi])
            off = np.arange(len(own)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi])
            who = active[own]
            place = at[who] + step * (done[who] + off)
            bad = np.flatnonzero(code[place] != code[place + period[who]])
            where, first = np.unique(own[bad], return_index=True)
            found[where] = off[bad[first]]
        done[active] += found
        active = active[(found == n) & (done[active] < room[active])]
        take = take * 2
    return done


def _minimizers(groups: np.ndarray, width: int, ends: np.ndarray) -> np.ndarray:
    """Places of the smallest of each `width` neighbouring groups of `width` words (the leftmost if several are equal),
    in ascending order, each once. `ends`: the end of each place's document."""
    n = len(groups)
    low = np.uint64((1 << max(1, (n - 1).bit_length())) - 1)
    places = np.arange(n, dtype=np.uint64)
    least, size = (groups & ~low) | places, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:size - width], least[width - size:])
    inside = ends[:len(least)] - places[:len(least)].astype(np.int64) >= 2 * width - 1
    chosen = (least[inside] & low).astype(np.int64)
    return chosen[np.r_[True, chosen[1:] != chosen[:-1]]] if len(chosen) else chosen


def runs_of(code: np.ndarray, counts: np.ndarray, copies: int = 4, least: int = 6) -> tuple[np.ndarray, ...]:
    """(start, end, period) of all runs of at least `copies` periods and `least` words, by start, then period.

    `code` holds the word hashes of documents of `counts` words one after another; places count through all of them.
    """
    last = np.cumsum(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    found = []
    for lag in range(1, SHORT + 1):
        start, end = _lag_scan(code, doc, lag, max(least, copies * lag))
        found.append((start, end, np.full(len(start), lag)))
    place = np.arange(len(code))
    level, wide, low = code, 1, SHORT + 1
    while True:
        stays = counts[doc] >= copies * low  # documents that can hold a run of this scale
        if not stays.any():
            break
        if not stays.all():
            place, doc, level = place[stays], doc[stays], level[stays]
        width = ((copies - 1) * low + 1) // 2  # periods from low to width are found with windows and groups of this width
        n = len(place)
        while wide * 2 <= width:
            level = np.concatenate([mix(level[:-wide], level[wide:]), level[-wide:]])
            wide *= 2
        groups = level
        if wide < width:
            groups = np.concatenate([mix(level[:wide - width], level[width - wide:]), level[wide - width:]])
        size = np.bincount(doc, minlength=len(counts))
        ends = np.cumsum(size)[doc]
        chosen = _minimizers(groups, width, ends)
        a, b = chosen[:-1], chosen[1:]
        gap = b - a
        link = (groups[a] == groups[b]) & (doc[a] == doc[b]) & (gap >= low) & (gap <= width)
        joined = np.zeros(len(link), bool)  # continues the chain of the link before it
        joined[1:] = link[1:] & link[:-1] & (gap[1:] == gap[:-1])
        heads = np.flatnonzero(link & ~joined)
        if len(heads):
            tails = np.flatnonzero(link & ~np.r_[joined[1:], False])
            period, first, until = gap[heads], place[a[heads]], place[b[tails]]
            own = doc[a[heads]]
            reach = np.full(len(heads), width)
            left = _equal_words(code, first - 1, period, -1, first - (last - counts)[own], reach)
            right = _equal_words(code, first, period, 1, last[own] - period - first, until - first + 2 * width)
            start, end = first - left, first + right + period
            long = end - start >= np.maximum(least, copies * period)
            found.append((start[long], end[long], period[long]))
        low = width + 1
    start, end, period = (np.concatenate(x) for x in zip(*found))
    # a stretch has one smallest period; others over the same words are its multiples
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """The words [start, end) of each text joined by one space."""
    size = end - start
    more = np.zeros(len(size), np.int64)
    more[:-1] = doc[1:] == doc[:-1]
    full = size + more
    stop = np.cumsum(full)
    offsets = np.zeros(docs + 1, np.int64)
    np.cumsum(np.bincount(doc, weights=full, minlength=docs), out=offsets[1:])
    total = int(offsets[-1])
    data = raw[np.minimum(np.repeat(start - (stop - full), full) + np.arange(total), max(len(raw) - 1, 0))] if total else raw[:0]
    data[(stop - 1)[more > 0]] = 0x20
    return pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _described(copies: int, least: int):
    def body(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, "text"):
            raw, at = text_column(part.column("text"))
            words = words_of(raw, at)
            counts = words.counts(part.num_rows)
            start, end, period = runs_of(words.code, counts, copies, least)
            first = np.cumsum(counts) - counts
            own = words.doc[start]
            spans = pa.StructArray.from_arrays([pa.array(start - first[own]), pa.array(end - start), pa.array(period)],
                                               names=RUN.names)
            heads = np.zeros(part.num_rows + 1, np.int32)
            np.cumsum(np.bincount(own, minlength=part.num_rows), out=heads[1:])
            covered = np.zeros(len(words.doc) + 1, np.int64)
            np.add.at(covered, start + period, 1)
            np.add.at(covered, end, -1)
            kept = np.cumsum(covered)[:-1] == 0
            text = _joined(raw, words.start[kept], words.end[kept], words.doc[kept], part.num_rows)
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [part.column(n) for n in names] + [pa.array(counts), pa.ListArray.from_arrays(pa.array(heads), spans), text],
                names=[*names, "n_words", "runs", "collapsed"])

    return body


def find_runs(docs: DataFrame, keys: Sequence[str], text: str = "text", copies: int = 4, least: int = 6,
              prefix: str = "") -> DataFrame:
    """Per row of `docs`: `keys`, n_words, runs (start, length, period; words count from 0) and the collapsed text.

    A run has at least `copies` (3 or more) periods and `least` words; words are what the six ASCII white-space characters
    leave between them. The collapsed text keeps the words that no run holds beyond its first period, joined by one space.
    Rows do not depend on each other and nothing is shuffled: repeated rows give repeated results, an empty table no rows.
    A null text and one without words have no runs and an empty collapsed text; very long texts are worked on whole, in a
    slice of their own. Keys may be null and of any type; of other columns nothing is read. `prefix` goes before the three
    new names, for keys that bear one of them. Words are compared by hashes of 64 bits.
    """
    if copies < 3:
        raise ValueError("a run needs at least three periods")
    plain = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    out = arrow_map(plain, _described(copies, least), schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)],
                      *[F.col(c).alias(prefix + c) for c in ("n_words", "runs", "collapsed")])


def strongest(runs):
    """The run with the greatest exact length / period of a list in start order, the first if several are equal."""
    ahead = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.reduce(runs, F.lit(None).cast(RUN), lambda best, r: F.when(ahead(best, r), r).otherwise(best))
