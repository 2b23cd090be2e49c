import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attest.llm.packing import best_fit_decreasing, lower_bound, pack
from attest.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True
ENCODER = Encoder(PATH)

TEXTS = ["", None, "a", " ", "  ", "\n", "it's we'll they've I'm he'd 're 'sx ''s x'", "a  b\n\n c \t\n", "ünï 你好 12ab ٣ ½ ²",
         "x 's", "\n's", "end'", "'l 'll", "<|endoftext|>    b", "é \U0001F600\U0001F600 ok", "a'sb 'tis"]


def expected(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_of_odd_texts():
    ids, counts = ENCODER.encode(pa.array(TEXTS, pa.string()))
    at = np.r_[0, np.cumsum(counts)]
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(TEXTS))] == [expected(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'srevlmdt\n\t.,1é²你 ́ "), max_size=40), min_size=1, max_size=5))
def test_ids_of_any_texts(texts):
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()))
    at = np.r_[0, np.cumsum(counts)]
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == [expected(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=1, max_size=9))
def test_bound_never_exceeds_the_optimum(lengths):
    capacity = 20

    def optimum(rest, bins):
        if not rest:
            return len(bins)
        best = len(lengths)
        for k in range(len(bins)):
            if bins[k] >= rest[0] and bins[k] not in bins[:k]:
                best = min(best, optimum(rest[1:], bins[:k] + [bins[k] - rest[0]] + bins[k + 1:]))
        return min(best, optimum(rest[1:], bins + [capacity - rest[0]]))

    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    bins, offsets, room = best_fit_decreasing(np.array(lengths), capacity)
    assert bound <= optimum(sorted(lengths, reverse=True), []) <= len(room)


@pytest.mark.parametrize("per_partition", [30, 100_000])
def test_pack(spark, per_partition):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice(["to", "ba", "12", "é"]) for _ in range(r.randint(0, 90))) for _ in range(200)]
    rows = [(i, t, i, 0) for i, t in enumerate(texts)] + [(5, TEXTS[5], 5, 0), (None, "x y", 1, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, turn long, bins int")
    got = pack(df, ["doc_id", "turn"], PATH, capacity=32, per_partition=per_partition).collect()
    ids = {i: [*expected(t), 2] for i, t, _, _ in rows}
    sequences, pieces = defaultdict(list), defaultdict(list)
    for x in got:
        sequences[x.sequence_id].append((x.offset, x.length))
        pieces[x.doc_id].append((x.piece, x.start, x.length, x.ids_crc32))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    for i, own in pieces.items():
        if i == 5:
            assert len(own) == 2
            continue
        at = 0
        for piece, start, length, crc in sorted(own):
            assert start == at and (piece == 0 or length == 32)
            assert crc == zlib.crc32(np.array(ids[i][start:start + length], "<u4").tobytes())
            at += length
        assert at == len(ids[i]) and (at > 32 or len(own) == 1)
    lengths = np.array([x.length for x in got])
    assert len(sequences) <= lower_bound(np.bincount(lengths, minlength=33), 32) * 1.1 + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], PATH).collect() == []
