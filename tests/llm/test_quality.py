import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attest.llm import quality
from attest.llm.quality import classify, fit, index_vectors, pooled, word_vectors, words


def data(seed=1, n=240):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(15, 60)))
    junk = [lambda: prose().replace(" ", "### "), lambda: prose().upper().replace(" ", "!! "), lambda: " | ".join(prose().split()),
            lambda: " ".join(w for w in prose().split()[:4] for _ in range(9))]
    return [(i, r.choice(junk)() if i % 3 == 0 else prose(), "x") for i in range(n)]


def test_words():
    doc, word = words(pa.array(["ab ab12##ab", None, "", "é!! é"], pa.string()))
    assert doc.tolist() == [0] * 5 + [3] * 3
    assert word[0] == word[1] == word[4] and word[5] == word[7] and len(set(word.tolist())) == 5


def test_vectors_are_sums_over_neighbours(spark):
    texts = [t for _, t, _ in data(2, 40)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = word_vectors(df)
    index, want = index_vectors(), np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        own = words(pa.array([t], pa.string()))[1].tolist()
        for i, w in enumerate(own):
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if j != i:
                    want[w] += index[own[j]]
    size = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, size, out=np.zeros_like(want), where=size > 0)
    want[size[:, 0] > 0] -= want[size[:, 0] > 0].mean(0)
    assert np.allclose(got, want, atol=1e-6)
    x = pooled(pa.array(texts, pa.string()), got)
    own = words(pa.array([texts[0]], pa.string()))[1]
    assert np.allclose(x[0, :quality.DIMS], got[own].mean(0), atol=1e-5)
    assert np.allclose(x[0, quality.DIMS:-1], (got[own][1:] * got[own][:-1]).sum(0) / len(own), atol=1e-5)
    assert not x[-1].any() and not x[-2].any()


def test_held_out_accuracy(spark):
    rows = data()
    docs = spark.createDataFrame(rows + [(None, "a b", "x"), (5000, None, "x"), (5001, "", "x"), (1, rows[1][1], "x")],
                                 "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = classify(docs, labels, ["doc_id", "score"], F.col("id") % 4 != 2, score="p").collect()
    assert len(got) == 244 and all(0 <= x.p <= 1 for x in got)
    by = {x.doc_id: x.p for x in got}
    held = [i for i in range(240) if i % 4 == 2]
    assert np.mean([(by[i] >= 0.5) == (i % 3 > 0) for i in held]) >= 0.9
    again = {x.doc_id: x.p for x in classify(docs.repartition(7), labels, ["doc_id"], F.col("id") % 4 != 2, score="p").collect()}
    assert all(abs(by[i] - again[i]) < 1e-6 for i in range(240))


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert classify(none, labels, ["doc_id"]).collect() == []
    docs = spark.createDataFrame([(1, "a " * 200_000), (2, None)], "doc_id long, text string")
    assert [x.score for x in classify(docs, labels, ["doc_id"]).collect()] == [0.5, 0.5]
    assert fit(np.zeros((20, 3)), np.ones(20)).scores(np.zeros((1, 3)))[0] > 0.9


def test_words_of_blocks():
    texts = ["ab ## c1" * 3, None, "x" * (quality.SPLIT_BYTES + 5), "", "ab 12"] * 3 + ["ab cd " * (quality.SPLIT_BYTES // 4)] + ["", "é!"]
    doc, word = words(pa.array(texts, pa.string()))
    each = [words(pa.array([t], pa.string()))[1].tolist() for t in texts]
    assert doc.tolist() == [i for i, own in enumerate(each) for _ in own]
    assert word.tolist() == [w for own in each for w in own]
    assert [len(x) for x in words(pa.array([], pa.string()))] == [0, 0]


def test_no_row_of_dimensions_for_each_word(monkeypatch):
    """48 floats a word are 192 bytes, and sums and products of such rows are several times that."""
    class Task:
        get, partitionId = classmethod(lambda cls: cls), staticmethod(lambda: 0)

    monkeypatch.setattr(quality, "TaskContext", Task)
    texts = pa.array([t for _, t, _ in data(3, 2500)], pa.string())
    n = len(words(texts)[0])
    assert texts.nbytes < quality.SLICE_BYTES and n > 100_000
    table = np.asfortranarray(np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.DIMS)), np.float32)
    fixed = quality.BUCKETS * quality.DIMS * 8 * 3 + len(texts) * quality.DIMS * 2 * 4 * 3
    for work in (lambda: pooled(texts, table), lambda: list(quality._table_rows([pa.record_batch([texts], names=["text"])]))):
        work()
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < fixed + 128 * n
