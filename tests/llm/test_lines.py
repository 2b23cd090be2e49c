import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from attest.llm.lines import DEFAULT, FEATURES, fit, judge, learn, lines_of, viterbi


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def texts(seed):
    r = random.Random(seed)
    out = ["", None, "\n\n", "a", "a\r\na\r\na", " a\na ", "é é é é é é", "x\x0bx\x0cx\x1cx", "\na\n\na\n", "|<>#", "a b c d e " * 5]
    for _ in range(150):
        out.append("".join(r.choice(["a", "b", "é", " ", "\n", "##", "\t", " a b a b a", " "]) for _ in range(r.randint(0, 80))))
    return out


def test_counts():
    data = texts(1)
    f = lines_of(pa.array(data, pa.string()))
    got = list(zip(f.n_words.tolist(), f.word_chars.tolist(), f.n_symbols.tolist(), f.n_dup_lines.tolist(), f.n_repeat_words.tolist()))
    assert got == [brute(t) for t in data]
    assert f.features.shape == (len(f.doc), len(FEATURES)) and np.isfinite(f.features).all()
    assert np.bincount(f.doc, weights=f.words, minlength=len(data)).tolist() == f.n_words.tolist()


def test_viterbi_is_the_best_labelling():
    r = np.random.default_rng(2)
    sizes = np.array([3, 1, 7, 2, 7])
    scores, step = r.normal(size=sizes.sum()), r.normal(size=(2, 2))
    got, at = viterbi(scores, sizes, step), 0
    for n in sizes:
        value = lambda y: sum(s * k for s, k in zip(scores[at:at + n], y)) + sum(step[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=int(n)), key=value)
        assert tuple(got[at:at + n].astype(int)) == best
        at += n
    assert len(viterbi(np.zeros(0), np.zeros(0, np.int64), step)) == 0


def test_fit_learns_the_sign_of_a_feature():
    r = np.random.default_rng(1)
    chains = []
    for k in range(200):
        x = np.zeros((r.integers(1, 90), len(FEATURES)))
        x[:, 0], x[:, 3] = 1, (k % 2) * r.random(len(x))
        chains.append((x, 1 - k % 2))
    field = fit(chains, rounds=120)
    assert field.emission[3] < 0 < field.emission[0] and field.step[0, 0] > field.step[0, 1]
    assert fit(chains[:1]) is DEFAULT


def test_judge(spark):
    prose = "The quiet river turns south beyond the old mill and carries its stories to the sea.\n"
    rows = [(0, prose * 1, 1), (1, "Ab Ab Ab Ab Ab Ab cd cd cd cd cd cd ef ef ef ef", 2), (2, "one### two*** three$$$ four&&& five### six%%% "
             "seven### eight*** nine%%% ten$$$ eleven###", 3), (3, None, 4), (4, "few words", 5),
            (5, "one | two | three | four | five | six | seven | eight | nine | ten | eleven", 6), (6, prose + " " * 9 + "x" * 100_000, 7)]
    rows += [(0, prose, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {x[0]: x for x in judge(df, ["doc_id", "n_words"], prefix="r_").collect()}
    assert {i: got[i].r_kept for i in got} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert got[3].r_base_failed and got[4].r_base_failed and not got[5].r_base_failed and got[0].n_words == 1
    assert judge(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


def test_learn(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdef") for _ in range(6))
    good = [" ".join(word() for _ in range(30)) + "\n" + " ".join(word() for _ in range(30)) for _ in range(80)]
    bad = [" ".join(word() + "!!" for _ in range(30)).upper() for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(good + bad)) + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)] + [(None, 1), (3, None)], "doc_id long, quality int")
    field = learn(docs, labels)
    kept = {x.doc_id: x.kept for x in judge(docs, ["doc_id"], field).collect()}
    assert all(kept[i] == (i < 80) for i in range(160))
    assert learn(docs, labels.where("false")) is DEFAULT
