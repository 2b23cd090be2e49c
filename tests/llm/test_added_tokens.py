import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

import corpus_pipeline
from attest.llm import queries
from attest.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", None, "", "<|endoftext|>", "x<|endoftext|><|endoftext|>'s  y", "<|endoftext|", "plain", "é <|endoftext|>\n\n你"]


def ids_of(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    at = np.r_[0, np.cumsum(counts)]
    return [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))]


def test_ids_equal_an_unchanged_tokenizer():
    plain = Tokenizer.from_file(PATH)
    got = ids_of(Encoder(PATH, marks=True), TEXTS)
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert got[0] == [64, 220, 50256, 275]


@pytest.mark.parametrize("options", [{}, {"lstrip": True}, {"rstrip": True}, {"single_word": True}])
def test_other_added_tokens(folder, options):
    plain = Tokenizer.from_file(PATH)
    plain.add_tokens([AddedToken("<|end", normalized=False), AddedToken("<m>", normalized=False, **options)])
    path = str(folder / "t.json")
    plain.save(path)
    texts = [*TEXTS, "a <m> b", "a<m>b<|end <|endoftext|>", "  <m>  <m>"]
    assert ids_of(Encoder(path, marks=True), texts) == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("run", ["query", "stage"])
def test_registered_packing(spark, folder, run):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(str(folder / "documents.parquet"))
    got = (queries.QUERIES["op2_best_fit_packing"](spark, str(folder)) if run == "query" else
           corpus_pipeline.packing(spark, docs, str(folder))).collect()
    plain = Tokenizer.from_file(PATH)
    for x in got:
        ids = [*plain.encode(TEXTS[x.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (x.length, x.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert len(got) == len(TEXTS)
