import hashlib
import random
from collections import Counter

import pytest

from attest.llm.suffix_dedup import remove_repeats


def brute(texts, length):
    """Every window of every text, counted."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abé c") for _ in range(n))
    shared = [word(length * 3 // 2) for _ in range(3)]
    texts = [word(r.randint(0, 4 * length)) for _ in range(25)]
    texts += [word(r.randint(0, length)) + r.choice(shared) + word(r.randint(0, length)) for _ in range(25)]
    texts += [texts[3]] * 4 + [None, "", "a" * (3 * length), "ab" * (2 * length), texts[30] + texts[31], word(length)]
    near = list(shared[0] + word(2 * length))
    for _ in range(8):
        near[r.randrange(len(near))] = "z"
        texts.append("".join(near))
    return texts


@pytest.mark.parametrize("length", [2, 7, 24, 33, 400])
def test_against_brute_force(spark, length):
    texts = corpus(length, length)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, gram int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())
           for r in remove_repeats(df, ["doc_id", "gram"], length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty, ["doc_id"]).collect() == []
    twice = spark.createDataFrame([(None, "x" * 10), (None, "x" * 10), (1, "y" * 3)], "doc_id long, text string")
    rows = sorted((r.n_removed, r.n_bytes) for r in remove_repeats(twice, ["doc_id"], length=5).collect())
    assert rows == [(0, 3), (10, 10), (10, 10)]
