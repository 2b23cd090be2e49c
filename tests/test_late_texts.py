"""Long texts are counted by digest; what profiles and matrix say stays the same."""

import random
from collections import Counter

import pytest

from attest.functions.frames import declared
from attest.operators import overlap as O
from attest.operators import profile as P
from attest.operators.values import HEAD, settled_counts


def texts(seed):
    rng = random.Random(seed)
    same = "<html>" + "x" * HEAD
    long = [same + str(rng.randint(0, 60)) for _ in range(400)] + [rng.choice("abc") * rng.randint(HEAD - 2, HEAD + 3) for _ in range(200)]
    return long + [f"s{i % 70}" for i in range(200)] + [None, "", " ", "7" * 400, same, same[:HEAD], "Ä1 " * 200, "Ä2 " * 200]


def canonical(v):
    return None if v is None or not v.strip(" ") else v.strip(" ")


def mask(v):
    return "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in v)


@pytest.mark.parametrize("seed", range(2))
def test_profiles_of_long_texts(spark, seed):
    data = texts(seed)
    views = {"t": declared(spark, "v string, n bigint", [(v, i) for i, v in enumerate(data)]).repartition(6)}
    counts = settled_counts(views)
    n = Counter(v for v in map(canonical, data) if v is not None)
    order = lambda v: v.encode()
    cid = 1
    top = [(r["value"], r["n"]) for r in P.top_values(counts).filter(f"cid = {cid}").orderBy("rank").collect()]
    assert top == sorted(n.items(), key=lambda x: (-x[1], order(x[0])))[:10]
    sample = [r["value"] for r in P.value_sample(counts, 90).filter(f"cid = {cid}").orderBy("rank").collect()]
    assert sample == sorted(n, key=order)[:90]
    shapes = Counter(map(mask, n))
    got = [(r["mask"], r["n"]) for r in P.top_patterns(counts).filter(f"cid = {cid}").orderBy("rank").collect()]
    assert got == sorted(shapes.items(), key=lambda x: (-x[1], order(x[0])))[:5]
    row = P.profile_views(views, counts).filter("column = 'v'").first()
    sizes = [len(v) for v in n.elements()]
    assert (row["row_count"], row["null_count"], row["distinct_count"]) == (len(data), len(data) - sum(n.values()), len(n))
    assert (row["min"], row["max"], row["len_min"], row["len_max"]) == (min(n, key=order), max(n, key=order), min(sizes), max(sizes))
    assert row["len_avg"] == round(sum(sizes) / len(sizes), 1) and row["value_class"] == "text"
    assert [t["value"] for t in row["top_values"]] == [v for v, _ in top]


def test_class_of_long_numbers(spark):
    views = {"t": declared(spark, "v string, w string", [("1" * 300, "2" * 300 + ".5"), ("12", "3" * 300)])}
    assert {r["column"]: r["value_class"] for r in P.profile_views(views).collect()} == {"v": "integer_like", "w": "decimal_like"}


def test_matrix_of_long_texts(spark):
    long = ["y" * HEAD + str(i) for i in range(40)]
    views = {"a": declared(spark, "v string", [(v,) for v in long[:30]]), "b": declared(spark, "v string", [(v,) for v in long[10:] + ["z"]])}
    pair = O.candidate_matrix(views).first()
    assert (pair["left"], pair["right"], pair["overlap"], pair["left_distinct"], pair["right_distinct"]) == ("a.v", "b.v", 20, 30, 31)


def test_no_long_text_is_shuffled(spark):
    views = {"t": declared(spark, "v string", [("y" * 5000 + str(i),) for i in range(2000)]).repartition(4)}
    counts = settled_counts(views, masks=False)
    late = counts.frame.filter("late IS NOT NULL").selectExpr("max(length(late.head)) AS n", "count(value) AS v").first()
    assert (late["n"], late["v"]) == (HEAD, 0)
