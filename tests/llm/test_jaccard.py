import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from attest.llm import jaccard
from attest.llm.common import components
from attest.llm.jaccard import runs_for, similar_groups, survival, whole_groups


def brute(rows, width=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a], links[b] = links[a] + 1, links[b] + 1
            root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        least.setdefault(find(x), []).append(i)
    return sorted((i, min(least[find(x)]), links[x]) for x, (i, _) in enumerate(rows))


def corpus(seed, copies, edits=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [[r.choice(vocabulary) for _ in range(r.randint(1, 120))] for _ in range(120)]
    base = [r.choice(vocabulary) for _ in range(100)]
    for t in [base] * copies + texts[:60] * 2:
        t = list(t)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        texts.append(t)
    out = [" ".join(t) for t in texts] + [" ".join(base)] * 40 + ["", None, " \n", "a b", "a  b", "a b c d", "x"]
    return list(enumerate(out))


@pytest.mark.parametrize("seed,copies,edits,small", [(1, 20, 3, 256), (2, 400, 3, 256), (3, 300, 9, 8)])
def test_against_brute_force(spark, monkeypatch, seed, copies, edits, small):
    monkeypatch.setattr("attest.llm.jaccard.SMALL", small)
    rows = corpus(seed, copies, edits)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, key string, class int").repartition(3)
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in similar_groups(df).collect())
    assert got == brute(rows)


def test_runs_follow_the_depth_that_is_reached(spark, monkeypatch):
    """Texts of one template, alike but mostly below the threshold: nodes stay large and are walked deep."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in r.sample(range(100), r.choice([2, 6, 8])):
            words[k] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    walks, plain = [], jaccard._walk

    def seen(*args):
        out = plain(*args)
        walks.append((args[2], args[3], bool(out[1]), out[2]))
        return out

    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "CLOSE", 2.0)  # pivots let everything walk on
    monkeypatch.setattr(jaccard, "_walk", seen)
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
    assert walks[0][:2] == (0, runs_for(0.999, 0.8)) and len(walks) > 1
    assert [w[0] for w in walks[1:]] == [w[1] for w in walks[:-1]]
    assert not walks[-1][2] or walks[-1][1] >= runs_for(0.999, 0.8, max(w[3] for w in walks))


def test_empty_and_repeated_rows(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(3, "a b c d e f")] * 3 + [(None, "a b c d e f"), (1, "q")], "doc_id long, text string")
    got = sorted(((x.doc_id, x.class_id, x.n_links) for x in similar_groups(df).collect()), key=str)
    assert got == [(1, 1, 0), (3, 3, 3), (3, 3, 3), (3, 3, 3), (None, 3, 3)]


def test_components(spark):
    r = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 160)]
    edges = chain + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(500, 500)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[node] == min(seen)
    assert set(got) == set(near)


def test_groups_stay_whole():
    values = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    for step in range(1, 12):
        batches = [pa.record_batch({"g": pa.array(values[k:k + step])}) for k in range(0, len(values), step)]
        tables = [t.column("g").to_pylist() for t in whole_groups(iter(batches), ["g"])]
        assert sum(tables, []) == values
        assert all(not set(a) & set(b) for a, b in combinations(tables, 2))


def test_runs():
    assert survival(0.8, 0) == 1 and survival(0.8, 1) == pytest.approx(0.84)
    assert (1 - survival(0.8, 4)) ** runs_for(0.999, 0.8) <= 0.001
    assert np.isfinite(survival(0.6, 10))
