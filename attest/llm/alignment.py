"""Alignment of two tokenizers over whole texts, and how often their tokens end together in the corpus.

Inside a task all steps are Arrow's: token lists are flattened with the index of their text, byte ends are cumulative sums
that start again in each text, a merge of the ascending (text, end) finds the tokens of both sides that end together, and a group-by
counts the pairs of a chunk of texts. Spark adds the counts of the chunks and finds the highest count of each token of the
second side. That table goes to every task, and chunks look their pairs up where they lie: of two tokens that end together
one spells an end of the other, so the vocabularies bound the table (324,302 pairs for those of the query), whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.llm.common import setting, stored
from attest.llm.hashing import slices, text_column
from attest.llm.tokens import Encoder, _byte_letters

# Texts are aligned in slices of about SLICE_BYTES; the slices of about CHUNK_BYTES share one list of pairs.
SLICE_BYTES = 1 << 19
CHUNK_BYTES = 1 << 20
# Rows that a task holds at a time: texts while they are aligned, chunks when they are read again.
_TEXTS, _CHUNKS = 500, 4
_SIDE = 32  # bits of a token id in a pair
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")

Tokens = tuple[np.ndarray, np.ndarray]


class ByteLevel:
    """Side of a byte-level BPE file: tokens of the text after one space; contents of added tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            entries[k] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.bytes = pa.array(entries, pa.binary())

    def tokens(self, texts: pa.Array) -> Tokens:
        return self.encoder.encode(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))

    def forget(self) -> None:
        """Let go of the words met so far."""
        self.encoder._forget()


class Pieces:
    """Side of a sentence-piece model, which puts its own space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        entries = []
        for k in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(k)
            entries.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode())
        self.bytes = pa.array(entries, pa.binary())

    def tokens(self, texts: pa.Array) -> Tokens:
        lists = self.model.encode(texts.to_pylist(), num_threads=1)
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.empty(int(counts.sum()), np.uint32)
        at = 0
        for each in lists:
            flat[at:at + len(each)] = each
            at += len(each)
        return flat, counts

    def forget(self) -> None:
        """Nothing is kept of the texts."""


@lru_cache(maxsize=2)
def loaded(kind: type, path: str):
    """A side that a worker process keeps from task to task: memory that tokenizers have used is not all given back with them."""
    return kind(path)


def _offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def _whole(side, tokens: Tokens, want: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts the bytes of their tokens spell out; `want` holds what should be spelt, text by text."""
    ids, counts = tokens
    spelt, ends = text_column(side.bytes.take(pa.array(ids)))
    size = np.diff(ends[_offsets(counts)])
    good = size == np.diff(at)
    here = np.repeat(good, size)
    there = np.repeat(good, np.diff(at))
    differ = spelt[here] != want[there]
    owner = np.repeat(np.flatnonzero(good), size[good])
    good[owner[differ]] = False
    return good


def _ends(side, tokens: Tokens, name: str) -> pa.Table:
    """(doc, end, name): the tokens of all texts with the byte at which each ends in its text."""
    ids, counts = tokens
    lists = pa.LargeListArray.from_arrays(pa.array(_offsets(counts)), pa.array(ids.astype(np.int64)))
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    reach = pc.cumulative_sum(pc.cast(pc.binary_length(side.bytes).take(flat), pa.int64()))
    before = np.r_[0, reach.to_numpy()][_offsets(counts)[:-1]]
    end = pc.subtract(reach, pa.array(before).take(doc))
    return pa.table({"doc": doc, "end": end, name: flat})


def _same(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of equal values in two ascending lists, in the order of the first one."""
    first = np.searchsorted(right, left)
    times = np.searchsorted(right, left, side="right") - first
    own = np.repeat(np.arange(len(left)), times)
    return own, np.arange(len(own)) + np.repeat(first - np.cumsum(times) + times, times)


def _written(groups: int, left: np.ndarray, right: np.ndarray, a: pa.Array, b: pa.Array, doc_of_group: np.ndarray,
             docs: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of every text. `left`, `right`: the group of each token."""
    part = np.concatenate([left * 2, right * 2 + 1])
    order = np.argsort(part, kind="stable")
    part = part[order]
    last = np.ones(len(part), bool)
    last[:-1] = part[1:] != part[:-1]
    closes = last & (part % 2 == 1)
    ends_doc = np.ones(groups, bool)
    ends_doc[:-1] = doc_of_group[1:] != doc_of_group[:-1]
    mark = np.where(closes, np.where(ends_doc[part // 2], 3, 2), np.where(last, 1, 0))
    signs = pa.array([",", "|", ";", ""]).take(pa.array(mark))
    ids = pa.concat_arrays([a, b]).cast(pa.string()).take(pa.array(order))
    pieces = pc.cast(pc.binary_join_element_wise(ids, signs, ""), pa.large_string())
    raw, at = text_column(pieces)
    stops = np.searchsorted(doc_of_group[part // 2], np.arange(docs + 1))
    data = memoryview(np.ascontiguousarray(raw))
    return [bytes(data[at[x]:at[y]]) for x, y in zip(stops[:-1].tolist(), stops[1:].tolist())]


def align(texts: pa.Array, a_side, b_side) -> tuple[pa.Table, pa.Array, pa.Array, pa.Array]:
    """(figures and written groups per text, each link's pair by number, the pairs, their counts) of a chunk of texts."""
    raw, at = text_column(texts)
    size = np.diff(at)
    plain = texts.fill_null("") if texts.null_count else texts
    tokens = [side.tokens(plain) for side in (a_side, b_side)]
    places = at + np.arange(len(at))
    want = np.full(places[-1], 0x20, np.uint8)
    want[np.arange(len(raw)) + np.repeat(np.arange(1, len(at)), size)] = raw
    good = (size > 0) & _whole(a_side, tokens[0], want, places) & _whole(b_side, tokens[1], want, places)
    tokens = [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in tokens]
    left, right = _ends(a_side, tokens[0], "a"), _ends(b_side, tokens[1], "b")
    wide = int(size.max(initial=0)) + 2
    place = [t["doc"].to_numpy().astype(np.int64) * wide + t["end"].to_numpy() for t in (left, right)]
    own, other = _same(*place)
    doc, cut = left["doc"].to_numpy()[own], place[0][own]
    n_links = np.bincount(doc, minlength=len(texts))
    cuts, firsts = np.unique(cut, return_index=True)
    owner = doc[firsts]
    group = [np.searchsorted(cuts, p) for p in place]
    written = _written(len(cuts), *group, left["a"].combine_chunks(), right["b"].combine_chunks(), owner, len(texts))
    digests = [hashlib.sha256(w).hexdigest() if ok else "" for w, ok in zip(written, good.tolist())]
    pair = pa.array((left["a"].to_numpy()[own] << _SIDE) | right["b"].to_numpy()[other])
    counted = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
    pairs = counted["pair"].combine_chunks()
    figures = pa.table({"n_a": tokens[0][1], "n_b": tokens[1][1], "n_groups": np.bincount(owner, minlength=len(texts)),
                        "n_links": n_links, "groups_sha256": pa.array(digests, pa.string())})
    return figures, pc.index_in(pair, value_set=pairs), pairs, counted["count_all"].combine_chunks()


def _list_of(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _chunk(number: int, parts: list[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> pa.RecordBatch:
    """One row of the (docs, links, pairs, counts) of several slices, whose links then point into one list of pairs."""
    docs, links, pairs, counts = zip(*parts)
    summed = pa.table({"pair": pa.concat_arrays(pairs), "n": pa.concat_arrays(counts)}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    merged = summed["pair"].combine_chunks()
    links = [pc.index_in(own, value_set=merged).take(link) for own, link in zip(pairs, links)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number]), *[_list_of(x) for x in (pa.concat_arrays(docs), pa.concat_arrays(links), merged, summed["n_sum"].combine_chunks())]],
        names=["chunk", "docs", "links", "pairs", "counts"])


def _chunk_rows(sides: Callable[[], tuple]):
    def over(batches) -> Iterator[pa.RecordBatch]:
        a_side, b_side = sides()
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                figures, links, pairs, counts = align(part.column("text"), a_side, b_side)
                keys = [n for n in part.schema.names if n != "text"]
                docs = pa.StructArray.from_arrays([part.column(k) for k in keys] + [c.combine_chunks() for c in figures.columns],
                                                  names=[*keys, *figures.column_names])
                held.append((docs, links, pairs, counts))
                size += part.column("text").nbytes
                if size >= CHUNK_BYTES:
                    yield _chunk(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _chunk(number, held)
        for side in (a_side, b_side):
            side.forget()
        del a_side, b_side, held
        pa.default_memory_pool().release_unused()  # the worker process lives on

    return over


def _sum_rows(told):
    def over(batches) -> Iterator[pa.RecordBatch]:
        known, total, best_of = told.value
        for batch in batches:
            for row in range(batch.num_rows):
                docs, links, pairs = (batch.column(c)[row].values for c in ("docs", "links", "pairs"))
                place = np.searchsorted(known, pairs.to_numpy())
                totals, best = pa.array(total[place]), pa.array(best_of[place])
                own = np.repeat(np.arange(len(docs)), docs.field("n_links").to_numpy(zero_copy_only=False))
                each = pa.table({"doc": own, "n": totals.take(links), "best": best.take(links)})
                summed = each.group_by("doc", use_threads=False).aggregate([("n", "sum"), ("best", "sum")])
                found = pc.index_in(pa.array(np.arange(len(docs))), value_set=summed["doc"].combine_chunks())
                more = [pc.fill_null(summed[c].combine_chunks().take(found), 0) for c in ("best_sum", "n_sum")]
                names = [docs.type.field(i).name for i in range(docs.type.num_fields)]
                yield pa.RecordBatch.from_arrays([docs.field(i) for i in range(len(names))] + more, names=[*names, "n_best", "count_sum"])

    return over


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, total, best): links of each pair in all chunks, and whether no pair with the same second token has more.

    The counts of the chunks are added before and after one shuffle. The window holds at most one row per token of the
    first vocabulary for each token of the second.
    """
    counted = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.counts").alias("total"))
    same_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << _SIDE) - 1)))
    return counted.withColumn("best", F.col("total") == F.max("total").over(same_b))


def _by_pair(counted: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs in ascending order, their totals, 1 where best else 0)."""
    table = counted.select("pair", "total", F.col("best").cast("bigint")).toArrow().sort_by("pair")
    return tuple(c.combine_chunks().to_numpy() for c in table.columns)


def align_corpus(docs: DataFrame, keys: Sequence[str], sides: Callable[[], tuple], text: str = "text") -> DataFrame:
    """Per row of `docs`: `keys`, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum.

    `sides` returns the two tokenizers of a task, which may be `loaded` once for many tasks. The byte offsets at which tokens of both end cut a text into groups;
    links are the pairs of tokens that end together. n_best counts the links whose pair is the most frequent of its second
    token in the whole corpus, ties included; count_sum adds up the corpus counts of all links. Null and empty texts, and
    texts that the tokens of a side do not spell out with a space before them, have no tokens: all figures are 0 and the
    digest is empty. Every row counts, repeated rows as often as they occur; an empty table gives no rows. Keys may be null,
    of any type, but not bear one of the new names. A chunk is a run of texts of about CHUNK_BYTES bytes, or one longer text
    that ends it. Chunks are stored once with their links and never shuffled, so texts are encoded once and a lost executor
    repeats only its own part.
    """
    clash = {*_FIGURES, "groups_sha256", "n_best", "count_sum"} & set(keys)
    if clash:
        raise ValueError(f"keys bear names of results: {sorted(clash)}")
    plain = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(f"`{text}`").cast("string").alias("text"))
    of_doc = T.StructType([*plain.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in _FIGURES],
                           T.StructField("groups_sha256", T.StringType())])
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("docs", T.ArrayType(of_doc)),
        T.StructField("links", T.ArrayType(T.IntegerType())), T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType()))])
    spark = docs.sparkSession
    batches = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with setting(spark, batches, str(_TEXTS)):
        chunks = stored(plain.mapInArrow(_chunk_rows(sides), schema), "aligned")
    done = T.StructType([*of_doc.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    with setting(spark, "spark.sql.parquet.columnarReaderBatchSize", str(_CHUNKS)):  # a chunk is a large row
        told = spark.sparkContext.broadcast(_by_pair(pair_counts(chunks)))
        with setting(spark, batches, str(_CHUNKS)):
            out = stored(chunks.select("docs", "links", "pairs").mapInArrow(_sum_rows(told), done), "sums")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *_FIGURES, "n_best", "count_sum", "groups_sha256")
