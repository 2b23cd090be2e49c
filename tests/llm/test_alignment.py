"""Tokenizer alignment against plain loops over the tokenizers' own ids."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attest.llm import alignment
from attest.llm.queries import PIECES, TOKENIZER


@pytest.fixture(scope="module")
def plain_tokenizers():
    a = Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    import base64
    ranks = dict(map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")))
    spelt = {int(k): base64.b64decode(v) for v, k in ranks.items()}
    return a, spelt, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(texts, plain_tokenizers):
    a, spelt, b = plain_tokenizers
    out, links_of, counts = [], [], Counter()
    for text in texts:
        full = (" " + (text or "")).encode()
        ids = a.encode(" " + text, add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        parts = [spelt[i] for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else
                                             b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(p) != full for p in parts):
            out.append([0, 0, 0, 0, ""])
            links_of.append([])
            continue
        ends = [[sum(map(len, p[:i + 1])) for i in range(len(p))] for p in parts]
        links = [(i, j) for e, i in zip(ends[0], ids[0]) for f, j in zip(ends[1], ids[1]) if e == f]
        groups, before = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(i) for e, i in zip(ends[s], ids[s]) if before < e <= cut) for s in (0, 1)))
            before = cut
        counts.update(links)
        links_of.append(links)
        out.append([len(ids[0]), len(ids[1]), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()])
    best = {}
    for (i, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [tuple(row[:4]) + (sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), row[4])
            for row, links in zip(out, links_of)]


def odd_texts():
    r = random.Random(3)
    bits = ["the ", "don't ", "  ", "\n", "é", "▁", "数据", "🙂", "<|endoftext|>", "<s>", "<0x41>", "a1b2", "\x00", "ｆｕｌｌ", "ing", " "]
    return [None, "", " ", "  ", "▁", "x", "<unk>", "x" * 400] + ["".join(r.choices(bits, k=r.randint(1, 40))) for _ in range(120)] + ["the the the"] * 9


def sides():
    return alignment.ByteLevel(TOKENIZER), alignment.Pieces(PIECES)


def test_against_plain_loops(spark, plain_tokenizers):
    texts = odd_texts()
    rows = [(i if i % 11 else None, t, 5, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a_ int, chunk string").repartition(6)
    out = alignment.align_corpus(df, ["doc_id", "chunk"], sides)
    assert out.columns == ["doc_id", "chunk", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], r[3], *w) for r, w in zip(rows, brute(texts, plain_tokenizers))]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))


def test_slices_of_a_chunk_share_their_pairs():
    texts = [t for t in odd_texts() if t]
    parts, both = [], sides()
    for i in range(0, len(texts), 7):
        figures, links, pairs, counts = alignment.align(pa.array(texts[i:i + 7]), *both)
        docs = pa.StructArray.from_arrays([c.combine_chunks() for c in figures.columns], names=figures.column_names)
        parts.append((docs, links, pairs, counts))
    row = alignment._chunk(5, parts).to_pylist()[0]
    figures, links, pairs, counts = alignment.align(pa.array(texts), *both)
    assert row["chunk"] == 5 and row["docs"] == figures.to_pylist()
    assert [row["pairs"][k] for k in row["links"]] == [pairs[k].as_py() for k in links.to_pylist()]
    assert dict(zip(row["pairs"], row["counts"])) == dict(zip(pairs.to_pylist(), counts.to_pylist()))


def test_chunks_do_not_matter(plain_tokenizers):

    texts = [t for t in odd_texts() if t]
    both = sides()
    whole = alignment.align(pa.array(texts), *both)[0].to_pylist()
    single = [alignment.align(pa.array([t]), *both)[0].to_pylist()[0] for t in texts]
    assert whole == single


def test_long_text_and_documents(spark, plain_tokenizers):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 2000")
    long = "Sentence with words. " * 60_000
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align_corpus(df, ["doc_id"], sides).collect()}
    assert got == dict(zip([i for i, _ in rows], brute([t for _, t in rows], plain_tokenizers)))
    one = alignment.align_corpus(spark.createDataFrame([(1, long)], "doc_id long, text string"), ["doc_id"], sides).first()
    assert one.n_links > 240_000 and one.n_best == one.n_links and one.n_groups == one.n_links


def test_empty_table_and_clashing_keys(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_corpus(df, ["doc_id"], sides).count() == 0
    with pytest.raises(ValueError):
        alignment.align_corpus(df.withColumnRenamed("doc_id", "n_a"), ["n_a"], sides)


def test_pairs_of_equal_places():
    import numpy as np

    from attest.llm.alignment import _same

    left, right = np.array([1, 1, 3, 4, 7]), np.array([0, 1, 1, 4, 4, 8])
    assert list(zip(*(x.tolist() for x in _same(left, right)))) == [(0, 1), (0, 2), (1, 1), (1, 2), (3, 3), (3, 4)]
    assert [len(x) for x in _same(left[:0], right)] == [0, 0]


def test_chunks_are_not_shuffled(spark, monkeypatch):
    """What is shuffled are pairs and their counts, which the vocabularies bound; rows of chunks stay where they are."""
    plans, real = {}, alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda df, name: plans.update({name: df._jdf.queryExecution().toString()}) or real(df, name))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string").repartition(6)
    alignment.align_corpus(df, ["doc_id"], sides)
    assert "MapInArrow" in plans["sums"]
    assert not any(step in plans["sums"] for step in ("Exchange", "Join", "Aggregate"))


def test_linked_tokens_spell_an_end_of_one_another():
    both = sides()
    pairs = alignment.align(pa.array([t for t in odd_texts() if t]), *both)[2].to_numpy()
    a, b = (side.bytes.take(pa.array(ids)).to_pylist() for side, ids in zip(both, (pairs >> 32, pairs & (1 << 32) - 1)))
    assert pairs.size and all(x.endswith(y) or y.endswith(x) for x, y in zip(a, b))


def test_worker_keeps_tokenizers_but_no_words():
    a, b = (alignment.loaded(kind, path) for kind, path in ((alignment.ByteLevel, TOKENIZER), (alignment.Pieces, PIECES)))
    assert alignment.loaded(alignment.ByteLevel, TOKENIZER) is a and alignment.loaded(alignment.Pieces, PIECES) is b
    texts = pa.array([t for t in odd_texts() if t])
    first = alignment.align(texts, a, b)[0]
    assert len(a.encoder.known) and len(a.encoder.pool)
    for side in (a, b):
        side.forget()
    assert not len(a.encoder.known) and not len(a.encoder.pool)
    assert alignment.align(texts, a, b)[0] == first
