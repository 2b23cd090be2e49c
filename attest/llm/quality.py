"""Quality classifier: random-indexing word vectors, pooled per text, and a two-layer network with calibrated probabilities.

Every word has a fixed sparse index vector of -1, 0 and 1 from its hash. A word's vector is the sum of the index vectors
of its neighbours over the whole corpus, so one pass with integer sums, in any order, gives the same vectors. Words are
kept in a fixed number of hash buckets: the table has a proven size, whatever the corpus. A text is the mean of its word
vectors and the mean product of neighbouring ones (repetition shows there). A network is fitted on a bounded sample of
labelled texts, its temperature on another part of that sample.

Sums over words are made dimension by dimension: one dimension of all buckets stays in a core's cache while the words of a
slice look it up, and nothing holds a row of all dimensions for every word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import arrow_map, stored
from attest.llm.hashing import coded_hashes, scramble, slices, text_column

BUCKETS = 1 << 14  # words by hash
DIMS = 48
NONZERO = 4
REACH = 2  # neighbours on either side
CHUNK = 256  # buckets per row of a partial table
SAMPLE = 20_000  # labelled texts the network is fitted on, at most about this many
HIDDEN = 32
SLICE_BYTES = 1 << 20  # texts whose words are looked up at a time
SPLIT_BYTES = 1 << 16  # texts that are split into words at a time: their eight bytes a byte are reused, not given back and asked for again


def _kinds() -> np.ndarray:
    """0 white space, 1 letters and all bytes beyond ASCII, 2 digits, 3 every other sign."""
    kind = np.full(256, 3, np.uint8)
    kind[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    kind[65:91] = kind[97:123] = kind[128:] = 1
    kind[48:58] = 2
    return kind


_KIND = _kinds()
_CODES = scramble(np.arange(1, 257, dtype=np.uint64))


def index_vectors() -> np.ndarray:
    """The sparse random vector of each bucket."""
    draw = scramble(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, NONZERO)
    out = np.zeros((BUCKETS, DIMS), np.int32)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(BUCKETS), (draw[:, k] % np.uint64(DIMS)).astype(np.int64)),
                  np.where(draw[:, k] >> np.uint64(63), 1, -1))
    return out


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of each word: a run of letters, of digits or of other signs."""
    found, before = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for part in slices(pa.record_batch([column], names=["text"]), "text", SPLIT_BYTES):
        doc, word = _split(part.column("text"))
        found.append((doc + before, word))
        before += part.num_rows
    doc, word = map(np.concatenate, zip(*found))
    return doc, word


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = text_column(column)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], len(raw)]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    code = coded_hashes(_CODES[raw], starts, ends)
    return np.searchsorted(at, starts, side="right") - 1, (code % np.uint64(BUCKETS)).astype(np.int64)


def _table_rows(batches):
    """One partial table of sums per task, in rows of CHUNK buckets."""
    # a word's neighbours add up to 2 * REACH * NONZERO at most, which a byte holds; sums are whole numbers below 2^53
    index, total = np.ascontiguousarray(index_vectors().T, np.int8), np.zeros((DIMS, BUCKETS))
    some = False
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            doc, word = words(part.column("text"))
            if not len(doc):
                continue
            some = True
            same = [(doc[k:] == doc[:-k]).view(np.int8) for k in range(1, REACH + 1)]
            for d in range(DIMS):
                own = index[d].take(word, mode="clip")  # faster than with a check of bounds; no bucket is beyond them
                near = np.zeros_like(own)
                for k, inside in enumerate(same, 1):
                    near[k:] += own[:-k] * inside
                    near[:-k] += own[k:] * inside
                total[d] += np.bincount(word, near, BUCKETS)
    if some:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS // CHUNK, dtype=np.int32)),
             pa.array([TaskContext.get().partitionId() % 32] * (BUCKETS // CHUNK), pa.int32()),
             pa.array([total[:, k:k + CHUNK].T.astype("<i8").tobytes() for k in range(0, BUCKETS, CHUNK)], pa.binary())],
            names=["chunk", "part", "sums"])


def _merged(batches):
    """Sums of equal chunks, one row at a time."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, sums in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
            more = np.frombuffer(sums, "<i8")
            held[chunk] = held[chunk] + more if chunk in held else more
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()),
             pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["chunk", "part", "sums"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The table of word vectors (BUCKETS x DIMS) of `texts` (text), of fixed size, centred and of length one, stored by columns."""
    shape = "chunk int, part int, sums binary"
    parts = texts.mapInArrow(_table_rows, shape)
    some = parts.repartition("chunk", "part").mapInArrow(_merged, shape)
    done = some.repartition("chunk").mapInArrow(_merged, shape)
    table = np.zeros((BUCKETS, DIMS), np.float64)
    for r in done.collect():  # BUCKETS / CHUNK rows
        table[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] += np.frombuffer(r.sums, "<i8").reshape(CHUNK, DIMS)
    size = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.divide(table, size, out=np.zeros_like(table), where=size > 0)
    seen = size[:, 0] > 0
    if seen.any():
        table[seen] -= table[seen].mean(0)
    return np.asfortranarray(table, np.float32)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """A row per text: mean word vector, mean product of neighbours, log of the number of words."""
    docs = len(column)
    out = np.zeros((docs, 2 * DIMS + 1), np.float32)
    doc, word = words(column)
    if not len(doc):
        return out
    counts = np.bincount(doc, minlength=docs)
    heads = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    rows = doc[heads]
    beside = np.zeros(len(word), np.float32)
    for d in range(DIMS):
        own = table[:, d].take(word, mode="clip")
        out[rows, d] = np.add.reduceat(own, heads)
        np.multiply(own[1:], own[:-1], out=beside[1:])
        beside[heads] = 0  # the first word of a text has none before it
        out[rows, DIMS + d] = np.add.reduceat(beside, heads)
    out[rows, :2 * DIMS] /= counts[rows, None]
    out[:, -1] = np.log1p(counts)
    return out


@dataclass
class Network:
    """Two layers over standardised features; score = 1 / (1 + exp(-logit / temperature))."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _constant(features: int, share: float) -> Network:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Network(np.zeros(features), np.ones(features), np.zeros((features, 1)), np.zeros(1), np.zeros(1),
                   float(np.log(share / (1 - share))))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, decay: float = 1e-4) -> Network:
    """Adam on the cross entropy; every fifth row is kept for the temperature. One class alone gives its share."""
    x = x.astype(np.float64)
    if len(y) < 10 or y.min() == y.max():
        return _constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
    random = np.random.default_rng(1)
    own = np.arange(len(y)) % 5 != 4
    centre, scale = x[own].mean(0), x[own].std(0) + 1e-6
    tx, ty = (x[own] - centre) / scale, y[own].astype(float)
    w = [random.normal(0, 1 / np.sqrt(tx.shape[1]), (tx.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 0.2, HIDDEN), np.zeros(1)]
    first, second, turn = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = random.permutation(len(ty))
        for k in range(0, len(order), batch):
            rows = order[k:k + batch]
            hidden = np.tanh(tx[rows] @ w[0] + w[1])
            miss = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3], -60, 60))) - ty[rows]) / len(rows)
            back = miss[:, None] * w[2] * (1 - hidden ** 2)
            grads = [tx[rows].T @ back + decay * w[0], back.sum(0), hidden.T @ miss + decay * w[2], np.array([miss.sum()])]
            turn += 1
            for p, g, m, v in zip(w, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g ** 2 - v)
                p -= 0.005 * (m / (1 - 0.9 ** turn)) / (np.sqrt(v / (1 - 0.99 ** turn)) + 1e-8)
    net = Network(centre, scale, w[0], w[1], w[2], float(w[3][0]))
    logit, truth = net.logits(x[~own]), y[~own]
    loss = lambda t: float(np.logaddexp(0, np.where(truth == 1, -logit, logit) / t).mean())
    net.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 60)), key=loss)
    return net


def _sample_rows(table):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, "text", SLICE_BYTES):
            x = pooled(part.column("text"), table.value)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["id", "label", "features"])

    return rows


def _score_rows(columns: list[str], table, network: Network):
    def rows(batch: pa.RecordBatch):
        for part in slices(batch, "__text", SLICE_BYTES):
            score = network.scores(pooled(part.column("__text"), table.value).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(score)], names=[*columns, "__score"])

    return rows


def classify(docs: DataFrame, labels: DataFrame, columns: list[str], learn_from: Column | None = None, doc_id: str = "doc_id",
             text: str = "text", label: str = "quality", most: int = SAMPLE, score: str = "score") -> DataFrame:
    """`columns` of every row and its score from 0 to 1: the chance that `label` is 1.

    `learn_from` is a condition on the id (column "id") that labelled rows must meet to be learnt from; of several labels of
    one id the smallest counts, null ids and labels are left out, and about `most` rows at most, drawn by a hash of the id,
    are used. Word vectors are made of all texts, scores only of the text. Null and empty texts have no words and get the
    score of that; repeated rows get equal scores; an empty table gives no rows; without labels every score is 0.5.
    """
    spark = docs.sparkSession
    body = F.col(f"`{text}`").cast("string")
    table = spark.sparkContext.broadcast(word_vectors(docs.select(body.alias("text"))))  # BUCKETS x DIMS floats
    marks = labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isin(0, 1)).groupBy(
        F.col(f"`{doc_id}`").alias("id")).agg(F.min(f"`{label}`").cast("int").alias("label"))
    if learn_from is not None:
        marks = marks.where(learn_from)
    share = F.lit(min(1.0, most / max(1, marks.count())))
    drawn = stored(marks.where(F.xxhash64("id", F.lit("quality")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53)) < share),
                   "drawn")
    # one text per drawn id, so that an id with very many rows counts once and the sample stays bounded
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), body.alias("text")).join(F.broadcast(drawn), "id").groupBy("id").agg(
        F.first("label").alias("label"), F.min("text").alias("text"))
    sample = arrow_map(texts, _sample_rows(table), f"id {texts.schema['id'].dataType.simpleString()}, label int, features binary").collect()
    sample.sort(key=lambda r: r.id)
    x = np.array([np.frombuffer(r.features, np.float32) for r in sample], np.float32).reshape(-1, 2 * DIMS + 1)
    network = fit(x, np.array([r.label for r in sample]))
    inner = [f"__{k}" for k in range(len(columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(columns, inner)], body.alias("__text"))
    kinds = ", ".join(f"{i} {rows.schema[i].dataType.simpleString()}" for i in inner)
    return arrow_map(rows, _score_rows(inner, table, network), f"{kinds}, __score double").toDF(*columns, score)
