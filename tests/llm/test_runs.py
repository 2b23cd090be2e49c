"""Periodic runs against a direct scan of every lag, and the collapsed texts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm.runs import find_runs, runs_of, strongest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, copies=4, least=6):
    found = {}
    for period in range(1, len(words) // copies + 1):
        i = 0
        while i + period < len(words):
            start = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            if i > start and i + period - start >= max(least, copies * period):
                found.setdefault((start, i + period), period)
            i += 1
    return sorted(((b, e - b, p) for (b, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for b, n, p in runs for i in range(b + p, b + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(r, size, letters):
    words = [r.randint(0, letters) for _ in range(size)]
    for _ in range(r.randint(0, 4)):
        if size > 8:
            begin = r.randrange(size)
            period = r.randint(1, max(1, (size - begin) // r.randint(3, 9)))
            for i in range(begin, r.randint(begin, size)):
                words[i] = words[begin + (i - begin) % period]
    return words


@pytest.mark.parametrize("copies, least", [(4, 6), (3, 3), (6, 10)])
@pytest.mark.parametrize("seed", range(40))
def test_all_runs_of_all_scales(seed, copies, least):
    r = random.Random(seed)
    docs = [repetitive(r, r.choice([0, 1, 5, 6, 8, 20, 60, 300, 900]), r.choice([1, 2, 5, 200])) for _ in range(6)]
    code = np.array([hash(("w", w)) & (1 << 64) - 1 for d in docs for w in d], np.uint64)
    counts = np.array([len(d) for d in docs], np.int64)
    first = np.cumsum(counts) - counts
    start, end, period = runs_of(code, counts, copies, least)
    own = np.searchsorted(np.cumsum(counts), start, side="right")
    got = [[] for _ in docs]
    for b, e, p, o in zip(start.tolist(), end.tolist(), period.tolist(), own.tolist()):
        got[o].append((b - int(first[o]), e - b, p))
    assert got == [brute(d, copies, least) for d in docs]


def test_long_periods():
    r = random.Random(5)
    unit = [r.randint(0, 10**6) for _ in range(1777)]
    words = [1, 2, 3] + unit * 5 + [4] + unit[:50] * 30
    code = np.array([hash(("w", w)) & (1 << 64) - 1 for w in words], np.uint64)
    found = list(zip(*(x.tolist() for x in runs_of(code, np.array([len(words)])))))
    assert found == [(3, 3 + 5 * 1777, 1777), (4 + 5 * 1777, len(words), 50)]


def test_rows(spark):
    r = random.Random(2)
    text = lambda size, letters: " ".join(f"w{w}" for w in repetitive(r, size, letters))
    texts = [text(r.choice([0, 7, 40, 200]), r.choice([1, 3, 50])) for _ in range(60)]
    texts += [None, "", " \t\n\x0b ", "  " * 9, "a\x0bb\tc " * 8, "é " * 7 + "ê", texts[0], texts[0], "x y " * 200_000]
    rows = [(i if i % 9 else None, t, "n", 1) for i, t in enumerate(texts)] + [(3, texts[3], "other", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, runs int").repartition(5)
    got = sorted(map(repr, ((x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in find_runs(df, ["doc_id"]).collect())))
    want = []
    for i, t, _, _ in rows:
        words = WORD.findall(t or "")
        runs = brute(words) if len(words) < 10**5 else [(0, len(words), 2)]
        want.append(repr((i, len(words), runs, collapsed(words, runs))))
    assert got == sorted(want)


def test_names_and_empty_tables(spark):
    df = spark.createDataFrame([("a a a a a a b", 7, None)], "body string, n_words int, runs string")
    out = find_runs(df, ["n_words", "runs"], text="body", prefix="found_")
    assert out.columns == ["n_words", "runs", "found_n_words", "found_runs", "found_collapsed"]
    assert out.first() == (7, None, 7, [(0, 6, 1)], "a b")
    assert find_runs(df.limit(0), ["n_words"], text="body").count() == 0
    with pytest.raises(ValueError):
        find_runs(df, ["n_words"], text="body", copies=2)


def test_strongest_run_is_exact(spark):
    sets = [[], [(0, 8, 2), (9, 4, 1)], [(5, 8, 2), (0, 9, 2)], [(0, 3 * 10**9 + 1, 10**9), (4, 3 * 10**9, 10**9 - 1)]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, runs array<struct<start:long,length:long,period:long>>")
    best = {x.i: x.best and tuple(x.best) for x in df.select("i", strongest(F.col("runs")).alias("best")).collect()}
    assert best == {0: None, 1: (0, 8, 2), 2: (0, 9, 2), 3: (4, 3 * 10**9, 10**9 - 1)}
