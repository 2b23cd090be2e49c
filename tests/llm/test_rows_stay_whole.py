"""Operators that return whole rows: columns of any name keep their values, and only equal rows count as equal."""

from collections import Counter

import pytest

from attest.llm.common import components
from attest.llm.jaccard import one_of_each
from attest.llm.mixing import mix
from attest.llm.secrets import redact

TAKEN = "doc_id long, text string, __key string, __size string, key int, row string, spans string, times int, body string"


def rows(spark):
    data = [(i, f"word{i} " * 12 + f"tail{i} of text {i * 7}", f"k{i}", f"s{i}", i, f"r{i}", "x", 5, "b") for i in range(12)]
    data += [(20, 'key = "x" password=0123456789abcdef01', None, "s", None, None, "y", 6, None), (None, None, "k", None, 1, "r", None, None, "b")]
    return data, spark.createDataFrame(data, TAKEN)


def test_clashing_names_keep_their_values(spark):
    data, df = rows(spark)
    known = {r[0]: r for r in data}
    for out in (one_of_each(df), redact(df)):
        assert out.columns == df.columns
        got = out.collect()
        assert len(got) == len(data) and all(tuple(r)[2:] == known[r.doc_id][2:] for r in got)
    assert {r.doc_id: r.text for r in redact(df).collect()}[20] == 'key = "x" password=[SECRET]'
    assert redact(df.limit(0)).count() == one_of_each(df.limit(0)).count() == 0
    mixed = mix(df.selectExpr("*", "'a' AS source"))
    assert mixed.columns == [*df.columns, "source"] and all(tuple(r)[2:-1] == known[r.doc_id][2:] for r in mixed.collect())


def test_mix_never_gives_a_row_for_another(spark):
    text = "some words of a text"
    df = spark.createDataFrame([(1, text, "x", None, {"a": 1}, ["p", None], (None, "q")), (1, text, None, "x", {"a": 1}, ["p", None], (None, "q")),
                                (1, text, "x", "x", {"a": 1}, ["p", None], (None, "q")), (1, text, "x", "x", {"a": 2}, ["p", None], (None, "q")),
                                (1, text, "x", "x", {"a": 2}, [None, "p"], (None, "q")), (1, text, "x", "x", {"a": 2}, [None, "p"], ("q", None))],
                               "doc_id long, text string, lang string, source string, m map<string,int>, l array<string>, s struct<a:string,b:string>")
    out = Counter(map(repr, mix(df, factor=2.0, weights=(1.0,)).collect()))
    assert set(out) == set(map(repr, df.collect())) and set(out.values()) == {2}


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, "chain", rounds=1)
    assert {r.root for r in components(chain, "chain").collect()} == {0}
