"""The registered corpus queries over the smallest tables: equal to their SQL, or of the promised form."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from attest.llm.queries import ORACLES, QUERIES
from tests.llm.test_lines import brute as line_counts

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(tables):
    return {i: (t, s) for i, t, s in tables.execute("select doc_id, text, source from documents").fetchall()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    found = tables.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(found.fetchall())


def test_every_query_is_named_after_its_operator():
    assert sorted(int(re.match(r"op(\d+)_\w+$", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_packing(spark, documents):
    df = QUERIES["op2_best_fit_packing"](spark, FOLDER)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows, filled = df.collect(), defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in rows} == set(documents)
    for parts in filled.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(filled) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_secrets(spark, documents):
    rows = QUERIES["op3_secret_scans"](spark, FOLDER).collect()
    found = defaultdict(set)
    for r in rows:
        if r.is_secret:
            found[r.doc_id].add(documents[r.doc_id][0][r.start:r.end])
    plain = {i: set(re.findall(r"password=([0-9a-f]{18})|token = \"([0-9a-f]{40})\"|(AKIA[0-9A-Z]{16})", t or "")) for i, (t, _) in documents.items()}
    assert {i: v for i, v in found.items()} == {i: {next(filter(None, m)) for m in v} for i, v in plain.items() if v}


def test_sharding(spark, documents):
    rows = QUERIES["op4_sharding"](spark, FOLDER).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes") for i, (t, _) in documents.items())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert set(sizes) <= set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_classifier(spark, tables, documents):
    rows = QUERIES["op5_quality_classifier"](spark, FOLDER).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in documents}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_mixing(spark, documents):
    rows = QUERIES["op6_mixing"](spark, FOLDER).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (t, _) in documents.items()}
    taken, target = Counter(), {}
    for r in rows:
        taken[documents[r.doc_id][1]] += r.taken
        target[documents[r.doc_id][1]] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= max(r.size for r in rows) for s in target)


def test_line_labelling(spark, documents):
    rows = QUERIES["op7_line_labelling"](spark, FOLDER).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == line_counts(documents[r.doc_id][0])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert len(rows) == len(documents)
