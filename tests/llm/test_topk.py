import math
import random

import pytest

from attest.llm.topk import top_k


def brute(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b) and a)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("k,block_bytes,dims", [(20, 1 << 20, 16), (3, 500, 16), (7, 64, 1), (400, 1 << 20, 4)])
def test_top_k(spark, k, block_bytes, dims):
    r = random.Random(k)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(dims)], "x") for i in range(300)]
    rows += [(400 + i, [0.5] * dims, "x") for i in range(30)] + [(440, [0.25] * dims, "x"), (460, [float("inf")] * dims, "x")]
    rows += [(480, None, "x"), (500, [None] * dims, "x"), (None, [1.0] * dims, "x"), (520, [1.0] * (dims + 1), "x"),
             (521, [2.0] * (dims + 1), "x"), (540, [], "x"), (560, [-100.0] * dims, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cells string").repartition(4)
    exact = [(i, v and [x if x is None else x for x in v], c) for i, v, c in df.collect()]
    got = {tuple(x) for x in top_k(df, df.where("vec_id % 20 = 0"), k, block_bytes=block_bytes).collect()}
    assert got == brute(exact, k)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, df).collect() == []


def test_rows_that_share_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (21, [0.5, 0.5]), (40, [0.25, 0.0]), (40, [0.25, 0.0]), (40, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(x) for x in top_k(df, df.where("vec_id % 20 = 0"), k=3).collect())
    scaled = [(i, [int(64 * x) for x in v]) for i, v in rows]
    want = []
    for a in {(i, tuple(v)) for i, v in scaled if i % 20 == 0}:  # equal query rows are asked once
        others = list(scaled)
        others.remove((a[0], list(a[1])))
        best = sorted((-sum(x * y for x, y in zip(a[1], v)), i) for i, v in others)[:3]
        want += [(a[0], r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)
