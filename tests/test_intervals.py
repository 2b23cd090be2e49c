import random

import pytest
from pyspark.sql import functions as F

from attest.functions.frames import declared, ranked, ranked_within
from attest.functions.intervals import stab_join


@pytest.mark.parametrize("top", [0, 3, 16, 62])
def test_blocks_against_brute_force(spark, top):
    rng = random.Random(top)
    spans = [(a, a + rng.randint(-2, 200)) for a in (rng.randint(-50, 50) for _ in range(50))]
    points = list(range(-80, 280))
    got = stab_join(declared(spark, "p bigint", [(p,) for p in points]), F.col("p"),
                    declared(spark, "lo bigint, hi bigint", spans), F.col("lo"), F.col("hi"), top=top)
    assert sorted(map(tuple, got.collect())) == sorted((p, a, b) for p in points for a, b in spans if a <= p <= b)


def test_blocks_at_the_ends_of_the_integers(spark):
    big = 2**63 - 1
    got = stab_join(declared(spark, "p bigint", [(big,), (-big - 1,), (5,)]), F.col("p"),
                    declared(spark, "lo bigint, hi bigint", [(-big - 1, big), (big, big), (0, big)]), F.col("lo"),
                    F.col("hi"), top=62)
    assert got.count() == 6


def test_wide_intervals_take_few_blocks(spark):
    from attest.functions.intervals import cover, top_level

    big = 2**63 - 1
    for spans in ([(3, 3)], [(5, 1)], [], [(0, 10**18), (7, 9)], [(-big - 1, big), (None, 4), (-(2**62), 2**62)]):
        df = declared(spark, "lo bigint, hi bigint", spans)
        placed = df.withColumnsRenamed({"lo": "__lo", "hi": "__hi"})
        sizes = [r[0] for r in placed.filter("__hi >= __lo").select(F.size(cover("__lo", "__hi", top_level(placed)))).collect()]
        assert all(n <= 2 * 63 for n in sizes)
        points = [(p,) for p in (-big - 1, -1, 0, 3, 8, 10**18, 10**18 + 1, big)]
        got = stab_join(declared(spark, "p bigint", points), F.col("p"), df, F.col("lo"), F.col("hi"))
        assert sorted(map(tuple, got.collect())) == sorted(
            (p, a, b) for (p,) in points for a, b in spans if a is not None and a <= p <= b)


@pytest.mark.parametrize("wide_key", [0, 5, 1000])
def test_keys_of_any_width_give_the_same_rows(spark, wide_key):
    rng = random.Random(7)
    key = lambda: "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}"
    spans = [(key(), a, a + rng.randint(0, 40)) for a in (rng.randint(0, 100) for _ in range(80))]
    points = [(key(), rng.randint(0, 150)) for _ in range(120)]
    got = stab_join(declared(spark, "k string, p bigint", points), F.col("p"),
                    declared(spark, "k string, lo bigint, hi bigint", spans), F.col("lo"), F.col("hi"), ["k"],
                    wide_key=wide_key)
    want = [(k, p, lo, hi) for k, p in points for j, lo, hi in spans if j == k and lo <= p <= hi]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ranks_are_gapless_and_within_groups(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") < 700, "a").otherwise("b").alias("g"))
    assert [r["n"] for r in ranked(df, "n", "v").orderBy("v").collect()] == list(range(1, 1001))
    inside = ranked_within(df, "n", ["g"], "v").groupBy("g").agg(F.min("n"), F.max("n"), F.count_distinct("n")).orderBy("g").collect()
    assert [tuple(r) for r in inside] == [("a", 1, 700, 700), ("b", 1, 300, 300)]
