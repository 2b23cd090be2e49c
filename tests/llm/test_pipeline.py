"""Each stage of the pipeline against a plain version over what the stage before it kept."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from attest.llm.lines import learn, lines_of, viterbi
from tests.llm.test_jaccard import brute as near_brute
from tests.llm.test_mixing import brute_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(9)
    vocabulary = ["".join(r.choice("aeinorst") for _ in range(r.randint(2, 8))) for _ in range(500)]
    line = lambda: " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 25))) + "."
    texts = ["\n".join(line() for _ in range(r.randint(1, 5))) for _ in range(100)]
    texts += [t.replace("a", "b", 1) for t in texts[:20]] + texts[:10]
    texts += [line() + " password=b7db7aa4a5fcc78305 " + line() for _ in range(10)]
    texts += ["\n".join(line().upper().replace(" ", "!! ") for _ in range(3)) for _ in range(40)] + [None, "", "too short"]
    docs = [(i, t, "en", r.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    docs += [docs[5]] * 3 + [(None, texts[7], None, None, None)]
    labels = [(i, int(not (t or "!!").count("!!"))) for i, t in enumerate(texts)]
    return docs, labels


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{place}/labels.parquet")
    out = [spark.read.parquet(f"{place}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        df = stage(spark, out[-1], place)
        if k < len(cp.STAGES) - 1:
            assert df.schema.names == COLUMNS and df.dtypes == out[0].dtypes
        df.write.parquet(f"{place}/{k}")
        out.append(spark.read.parquet(f"{place}/{k}"))
    return place, [[tuple(r) for r in df.collect()] for df in out], out


def test_quality_rules(spark, kept):
    place, (before, after, *_), frames = kept
    field = learn(frames[0], spark.read.parquet(f"{place}/labels.parquet"))
    want = Counter()
    for row in before:
        f = lines_of(pa.array([row[1]], pa.string()))
        n = int(f.n_words[0])
        content = viterbi(f.features @ field.emission, np.array([len(f.doc)] if len(f.doc) else [], np.int64), field.step)
        if n >= 10 and 100 * f.n_repeat_words[0] <= 20 * n and (f.words * content).sum() >= 0.5 * n:
            want[row] += 1
    assert Counter(after) == want and 0 < len(after) < len(before)
    assert not any("!!" in r[1] for r in after)


def test_near_duplicates(kept):
    before, after = kept[1][1:3]
    numbered = [(k, r[1]) for k, r in enumerate(sorted(before, key=lambda r: (r[0] is None, r[0] or 0)))]
    rows = sorted(before, key=lambda r: (r[0] is None, r[0] or 0))
    stay = {c for _, c, _ in near_brute(numbered)}
    assert Counter(after) == Counter(rows[k] for k in stay) and len(after) < len(before)


def test_secret_scans(kept):
    before, after = kept[1][2:4]
    cut = lambda t: re.sub("b7db7aa4a5fcc78305", "[SECRET]", t)
    assert Counter(after) == Counter((r[0], cut(r[1]), r[2], r[3], len(cut(r[1]))) for r in before)
    assert any("[SECRET]" in r[1] for r in after)


def test_source_mix(kept):
    before, after = kept[1][3:5]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = Counter()
    for r in before:
        sizes[r[3]] += words(r[1])
    want, got = brute_targets(dict(sizes)), Counter()
    for r in after:
        got[r[3]] += words(r[1])
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    assert all(abs(got[s] - want[s]) <= 150 for s in sizes)


def test_packing(kept):
    before, after = kept[1][4:6]
    tokenizer = Tokenizer.from_file(cp.TOKENIZER)
    lengths = Counter((r[0], len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1) for r in before)
    whole, filled = Counter(), Counter()
    for doc_id, piece, start, length, _, sequence, offset in after:
        filled[sequence] += length
        assert offset + length <= 1024
        if piece == 0 and start == 0:
            whole[doc_id] += 1
    assert whole == Counter(r[0] for r in before)
    assert sum(filled.values()) == sum(n * c for (_, n), c in lengths.items()) and max(filled.values()) <= 1024


def test_run(spark, kept):
    place, rows, _ = kept
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.length) for r in cp.run(spark, place).collect()) == sorted(
        (r[0] is None, r[0] or 0, r[1], r[3]) for r in rows[5])
