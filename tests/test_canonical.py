from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions import canonical as C
from attest.functions.frames import declared
from attest.functions.names import clean_columns, column_slug, slug, unique_names, view_name

CASES = [
    (T.LongType(), 1101, "1101"),
    (T.DoubleType(), 1101.0, "1101"),
    (T.DoubleType(), 3.14, "3.14"),
    (T.DoubleType(), 12345678.5, "12345678.5"),
    (T.DoubleType(), 1e20, "100000000000000000000"),
    (T.DoubleType(), 0.0001, "0.0001"),
    (T.DoubleType(), 0.00001, "1e-05"),
    (T.DoubleType(), -0.0, "0"),
    (T.DateType(), date(2025, 1, 15), "2025-01-15"),
    (T.TimestampType(), datetime(2025, 1, 15), "2025-01-15"),
    (T.TimestampNTZType(), datetime(2025, 1, 15, 9, 30), "2025-01-15 09:30:00"),
    (T.TimestampNTZType(), datetime(2025, 1, 15, 9, 30, 1, 500000), "2025-01-15 09:30:01"),
    (T.StringType(), "0001042", "0001042"),
    (T.StringType(), "  x ", "x"),
    (T.StringType(), "   ", None),
    (T.StringType(), None, None),
    (T.BooleanType(), True, "true"),
    (T.BooleanType(), None, "false"),
]


@pytest.mark.parametrize(("kind", "value", "want"), CASES)
def test_typed_columns(spark, kind, value, want):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    assert df.select(C.canonical(F.col("v"), kind)).first()[0] == want


def test_decimals_keep_their_scale_unless_whole(spark):
    kind = T.DecimalType(18, 2)
    df = spark.sql("SELECT CAST(1.50 AS DECIMAL(18,2)) a, CAST(3.00 AS DECIMAL(18,2)) b")
    got = df.select(C.canonical(F.col("a"), kind), C.canonical(F.col("b"), kind)).first()
    assert tuple(got) == ("1.50", "3")


def test_float_text_is_the_shortest_rendering(spark):
    values = [1e-5, 1.5e-7, 0.00099, 1e7 + 0.5, 1e15, 1e16, 1e22, 0.1 + 0.2, 123.0, -2.5, float("inf"), 4503599627370495.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(C.float_text(F.col("v"))).collect()] == [repr(v) for v in values]


def test_canonical_text_is_stable(spark):
    df = spark.createDataFrame([(v,) for v in ("0001042", "1101", "1.5", "2025-01-15", "x y")], "v string")
    once = df.select(C.canonical(F.col("v"), T.StringType()).alias("v"))
    assert once.collect() == once.select(C.canonical(F.col("v"), T.StringType()).alias("v")).collect()


CELLS = [
    ("text", "1.234,56", ("1234.56", "decimal_comma_to_dot")),
    ("text", "-12,5", ("-12.5", "decimal_comma_to_dot")),
    ("text", "1,234.56", ("1,234.56", None)),
    ("text", "0001042", ("0001042", None)),
    ("text", "\t x ", ("x", "trimmed_whitespace")),
    ("text", " \t ", (None, None)),
    ("text", None, (None, None)),
    ("int", "1042", ("1042", "numeric_to_text")),
    ("float", "99.0", ("99", "integral_float_to_text")),
    ("float", "1.5", ("1.5", "numeric_to_text")),
    ("bool", "True", ("true", "numeric_to_text")),
    ("date", "2025-01-15", ("2025-01-15", "date_to_iso")),
    ("datetime", "2025-01-15 00:00:00", ("2025-01-15", "date_to_iso")),
    ("datetime", "2025-01-15 09:30:00", ("2025-01-15 09:30:00", "datetime_to_iso")),
]


@pytest.mark.parametrize(("kind", "text", "want"), CELLS)
def test_cells(spark, kind, text, want):
    df = declared(spark, "kind string, text string", [(kind, text)])
    assert tuple(df.select(C.canonical_cell(F.col("text"), F.col("kind")).alias("x")).first()["x"]) == want


@pytest.mark.parametrize(("values", "want"), [
    ([], "empty"), (["1", "-2"], "integer_like"), (["1", "2.5"], "decimal_like"),
    (["2025-01-01", "2025-01-01 10:00:00"], "date_like"), (["1", "x"], "text"), (["1", "2025-01-01"], "text"),
])
def test_value_class(spark, values, want):
    assert declared(spark, "v string", [(v,) for v in values]).agg(C.value_class(F.col("v"))).first()[0] == want


def test_pattern_mask_covers_all_scripts(spark):
    df = declared(spark, "v string", [("DE-12 Köln_ж²",)])
    assert df.select(C.pattern_mask(F.col("v"))).first()[0] == "AA-99 AAAA_AA"


def test_lenient_bigint_rounds_and_reads_exponents(spark):
    df = declared(spark, "v string", [("12.5",), ("1e3",), ("x",), ("-7",), (None,)])
    assert [r[0] for r in df.select(C.lenient_bigint(F.col("v"))).collect()] == [13, 1000, None, -7, None]


def test_comparison_key_refuses_unknown_and_quoted_names(spark):
    df = declared(spark, "v string", [("a",)])
    for name in ("w", 'v"', "v`"):
        with pytest.raises(ValueError):
            C.comparison_key(df, name)


def test_nested_columns_have_no_canonical_text():
    with pytest.raises(ValueError):
        C.canonical(None, T.ArrayType(T.FloatType()))


def test_names(spark):
    assert slug(" Kunden Liste! ") == "kunden_liste"
    assert column_slug("!!") == "column"
    assert view_name("DE ERP", "gl_postings") == "de_erp__gl_postings"
    assert unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]
    assert clean_columns(spark.createDataFrame([(1, 2)], ["Nr.", "nr"])).columns == ["nr", "nr_2"]
