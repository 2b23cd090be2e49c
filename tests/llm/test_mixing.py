import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from attest.llm.mixing import mix, mix_plan


def brute_targets(sizes, weights=(5, 2, 1), factor=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = factor * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {**capped, **share}
        capped |= {s: most * sizes[s] for s in above}


def rows(seed, hot=0):
    r = random.Random(seed)
    out = [(i, None if i % 41 == 0 else " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60))),
            r.choice(["a", "b", "ä", "Z", None, ""]), "extra") for i in range(400)]
    return out + [(900, "a b\tc d\x0be", "hot", "extra")] * hot + [(None, "x y", None, None)] * 3


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 150)])
def test_targets_and_takes(spark, seed, hot):
    data = rows(seed, hot)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size string")
    plan = mix_plan(df).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter({(x.doc_id, x.source, x.size): x.n for x in plan}) == Counter((i, s, words(t)) for i, t, s, _ in data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s, _ in data:
        sizes[s] += words(t)
    want = brute_targets(sizes)
    for x in plan:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(want[x.source])
        assert x.epochs * x.n + x.extra <= 2 * x.n
        taken[x.source] += (x.epochs * x.n + x.extra) * x.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mix_plan(df.repartition(7)).collect()
    assert Counter(map(tuple, plan)) == Counter(map(tuple, again))


@pytest.mark.parametrize("weight", ["1.0", "0.01", "if(doc_id % 3 = 0, 0.001, 5.0)", "cast(null as double)"])
def test_the_smallest_keys_are_taken(spark, weight):
    data = rows(11, 60)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, rank string").repartition(9)
    own = defaultdict(list)
    for x in mix_plan(df, quality=F.expr(weight)).collect():
        own[x.source].append(x)
    for plan in own.values():
        plan.sort(key=lambda x: (x.rank, x.doc_id is not None, x.doc_id or 0, x.key, x.key2))
        before = 0
        for x in plan:
            assert x.epochs == (int(x.target / x.source_size + 1e-9) if x.source_size else 0)
            rest = x.target - x.epochs * x.source_size - before
            assert x.extra == (max(0, min(x.n, int(rest / x.size + 0.5))) if x.size and rest > 0 else 0)
            before += x.size * x.n


def test_rows_are_taken_as_planned(spark):
    data = rows(5, 20)
    df = spark.createDataFrame(data, "doc_id long, text string, source string, __times string")
    df = df.withColumnRenamed("__times", "n")
    got = Counter(tuple(x) for x in mix(df).collect())
    want = Counter()
    for x in mix_plan(df).collect():
        times = x.epochs * x.n + x.extra
        if times:
            want[(x.doc_id, x.source, x.size)] += times
    seen = Counter()
    for (i, t, s, _), n in got.items():
        seen[(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))] += n
    assert seen == want


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_plan(empty).collect() == [] and mix(empty).collect() == []
