import random
import re

from pyspark.sql import functions as F

from attest.functions.frames import declared
from attest.operators import overlap as O
from attest.operators import profile as P
from attest.operators.values import column_list, settled_counts, value_counts
from tests.conftest import rows


def shop(spark):
    return {
        "customers": declared(spark, "id bigint, name string", [(i, f"n{i}") for i in range(1, 11)]),
        "invoices": declared(spark, "ref string, amount double", [(str(i), i * 1.5) for i in range(1, 9)] + [(None, 7.0)]),
        "noise": declared(spark, "code string", [("A-1",), ("B-2",)]),
    }


def test_profile_of_one_column(spark):
    got = P.profile_views(shop(spark)).filter("column = 'ref'").first()
    assert (got["row_count"], got["null_count"], got["distinct_count"]) == (9, 1, 8)
    assert (got["min"], got["max"], got["len_min"], got["len_avg"], got["len_max"]) == ("1", "8", 1, 1.0, 1)
    assert got["value_class"] == "integer_like"
    assert got["top_values"][0] == ("1", 1) and len(got["top_values"]) == 8
    assert [tuple(p) for p in got["patterns"]] == [("9", 8)]


def test_empty_tables_still_have_profiles(spark):
    got = P.profile_views({"t": declared(spark, "a bigint, b array<int>", [])}).collect()
    assert [(r["column"], r["row_count"], r["distinct_count"], r["value_class"], r["min"]) for r in got] == [("a", 0, 0, "empty", None)]


def test_top_values_and_sample_are_bounded_and_ordered(spark):
    views = {"t": declared(spark, "v string", [(f"{i:04d}",) for i in range(500)] + [("0007",)] * 3)}
    counts = settled_counts(views)
    top = [(r["value"], r["n"]) for r in P.top_values(counts).orderBy("rank").collect()]
    assert top[:3] == [("0007", 4), ("0000", 1), ("0001", 1)] and len(top) == 10
    sample = [r["value"] for r in P.value_sample(counts).orderBy("rank").collect()]
    assert sample == [f"{i:04d}" for i in range(200)]


def test_matrix_meets_across_types(spark):
    got = {(r["left"], r["right"]): r for r in O.candidate_matrix(shop(spark)).collect()}
    pair = got[("customers.id", "invoices.ref")]
    assert (pair["overlap"], pair["left_distinct"], pair["right_distinct"], pair["containment"], pair["jaccard"]) == (8, 10, 8, 1.0, 0.8)
    assert not any("noise" in key for pair in got for key in pair)


def test_matrix_against_brute_force(spark):
    rng = random.Random(3)
    data = {f"t{i}": [(str(rng.randint(0, 30)), str(rng.randint(0, 8))) for _ in range(40)] for i in range(4)}
    views = {t: declared(spark, "a string, b string", v) for t, v in data.items()}
    distinct = {f"{t}.{c}": {r[i] for r in v} for t, v in data.items() for i, c in enumerate("ab")}
    want = []
    for x in sorted(distinct):
        for y in sorted(distinct):
            n = len(distinct[x] & distinct[y])
            if x < y and x[:2] != y[:2] and n / min(len(distinct[x]), len(distinct[y])) >= 0.5:
                want.append((x, y, n))
    got = [(r["left"], r["right"], r["overlap"]) for r in O.candidate_matrix(views).collect()]
    assert sorted(got) == sorted(want)


def test_class_and_masks_come_from_all_values(spark):
    codes = [(f"K{i:04d}",) for i in range(1000)]
    views = {"mixed": declared(spark, "v string", [(str(i),) for i in range(300)] + codes), "codes": declared(spark, "c string", codes)}
    got = {r["column"]: r for r in P.profile_views(views).collect()}
    assert got["v"]["value_class"] == "text" and [tuple(p) for p in got["v"]["patterns"]] == [
        ("A9999", 1000), ("999", 200), ("99", 90), ("9", 10)]
    pair = O.candidate_matrix(views).first()
    assert (pair["left"], pair["right"], pair["overlap"], pair["containment"]) == ("codes.c", "mixed.v", 1000, 1.0)


def test_header_counts_pairs_that_share_a_value(spark):
    pairs = O.overlapping_pairs(shop(spark))
    assert O.matrix_header(pairs).first().asDict() == {"threshold": 0.5, "pairs_examined": pairs.count()}


def test_matrix_does_not_depend_on_column_order(spark):
    views = shop(spark)
    turned = {t: df.select(*reversed(df.columns)) for t, df in reversed(views.items())}
    assert rows(O.candidate_matrix(views)) == rows(O.candidate_matrix(turned))


def test_candidates_are_seen_from_both_sides(spark):
    matrix = O.candidate_matrix(shop(spark))
    assert O.candidates_by_column(matrix).count() == 2 * matrix.count()


def test_profiles_keep_their_id(spark):
    stored = declared(spark, "id string, source_id string, table string, column string", [("p1", "s", "t", "a")])
    fresh = declared(spark, "source_id string, table string, column string", [("s", "t", "a"), ("s", "t", "b")])
    got = {r["column"]: r["id"] for r in P.upsert_profiles(stored, fresh).collect()}
    assert got["a"] == "p1" and got["b"] not in (None, "p1")
    assert got == {r["column"]: r["id"] for r in P.upsert_profiles(stored, fresh.orderBy(F.desc("column"))).collect()}


def test_cells_are_counted_in_their_own_types(spark):
    """Values that share a text are counted together again; numbers become text after the count, not cell by cell."""
    rows = spark.sql("""SELECT * FROM VALUES
        (1Y, 7L, 7.0D, float('nan'), 1.50BD, TIMESTAMP_NTZ '2024-01-01 00:00:00', true, ' a '),
        (1Y, 7L, -0.0D, float('nan'), 1.50BD, TIMESTAMP_NTZ '2024-01-01 00:00:00.5', null, 'a'),
        (2Y, null, 0.0D, null, 2.00BD, TIMESTAMP_NTZ '2024-01-01 00:00:00.7', false, '  '),
        (null, 8L, 1e300D, float(2.5), null, null, true, null) AS t(b, l, d, f, x, m, o, s)""")
    counts = value_counts({"t": rows})
    names = {cid: column for cid, _, column, _ in column_list({"t": rows})}
    got = {}
    for r in counts.frame.collect():
        got.setdefault(names[r["cid"]], []).append((r["value"], r["n"]))
    assert {c: sorted(v, key=str) for c, v in got.items()} == {c: sorted(v, key=str) for c, v in {
        "b": [("1", 2), ("2", 1), (None, 1)], "l": [("7", 2), ("8", 1), (None, 1)], "d": [("7", 1), ("0", 2), ("1e+300", 1)],
        "f": [("nan", 2), ("2.5", 1), (None, 1)], "x": [("1.50", 2), ("2", 1), (None, 1)],
        "m": [("2024-01-01", 1), ("2024-01-01 00:00:00", 2), (None, 1)], "o": [("true", 2), ("false", 2)], "s": [("a", 2), (None, 2)]}.items()}
    plan = counts.frame._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[cid#\d+, cell#\d+L?\]", plan)
