import random
import zlib
from collections import Counter, defaultdict

import pytest

from attest.llm.sharding import shard


@pytest.mark.parametrize("shards,rows_per_range", [(24, 20_000), (5, 7), (1, 3)])
def test_shards_are_even(spark, shards, rows_per_range):
    r = random.Random(3)
    texts = [None, "", "é" * 400] + ["".join(r.choice("abcé ") for _ in range(r.randint(0, 300))) for _ in range(400)]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(1000 + i, "hot text", "y", 1, 2) for i in range(200)]
    rows += [(7, "same row", None, 0, 0)] * 300 + [(None, None, None, 0, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, size int, range int").repartition(5)
    got = shard(df, shards=shards, rows_per_range=rows_per_range).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == want
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x)
    for own in by.values():
        assert sorted(x.slot for x in own) == list(range(len(own)))
    totals = [sum(x.size for x in by[s]) for s in range(shards)]
    assert max(totals) - min(totals) <= 2 * max(x.size for x in got)
    again = shard(df.repartition(2), shards=shards, rows_per_range=rows_per_range).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    held = {x.shard for x in got if x.text_crc32 == zlib.crc32(b"hot text")}
    assert held == set(range(min(held), max(held) + 1))


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
