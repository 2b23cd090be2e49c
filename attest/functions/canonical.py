"""Column expressions that give every value one text, so that columns of different types can be compared.

`canonical` turns a typed column into text: whole numbers look alike whatever type holds them (a ``SMALLINT`` 7 and a
``DOUBLE`` 7.0 are both ``'7'``), days have one form, text loses its outer blanks and keeps everything inside them.
`canonical_cell` does the same for a cell of a sheet and says which rule changed it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the normalisation rules, as they appear in declarations.
RULE_NUMERIC_TO_TEXT = "numeric_to_text"
RULE_INTEGRAL_FLOAT = "integral_float_to_text"
RULE_DATE_TO_ISO = "date_to_iso"
RULE_DATETIME_TO_ISO = "datetime_to_iso"
RULE_DECIMAL_COMMA = "decimal_comma_to_dot"
RULE_TRIMMED = "trimmed_whitespace"

# Patterns that decide rules and value classes ((?d) = only \n ends a line, (?U) = Unicode digits).
DECIMAL_COMMA_PATTERN = r"(?dU)^-?\d{1,3}(\.\d{3})*,\d+$|^-?\d+,\d+$"
INTEGER_PATTERN = r"(?dU)^-?\d+$"
DECIMAL_PATTERN = r"(?dU)^-?\d+\.\d+$"
DATE_PATTERN = r"(?dU)^\d{4}-\d{2}-\d{2}([ T].*)?$"
EDGE_SPACE_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Value classes and the two that may be compared with each other.
CLASS_EMPTY = "empty"
CLASS_INTEGER = "integer_like"
CLASS_DECIMAL = "decimal_like"
CLASS_DATE = "date_like"
CLASS_TEXT = "text"
NUMERIC_CLASSES = (CLASS_INTEGER, CLASS_DECIMAL)

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BINARY_FLOAT = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType)
_NOT_COMPARABLE = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def is_comparable(data_type: T.DataType) -> bool:
    """Nested and binary columns have no canonical text and stay out of profiles and matrices."""
    return not isinstance(data_type, _NOT_COMPARABLE)


def float_text(c: Column) -> Column:
    """Shortest text of a float: plain digits from 1e-4 up to 1e16, exponent form outside."""
    raw = c.cast("string")
    size = F.abs(c)
    # Every double below 1e16 fits 17 whole and 21 fraction digits.
    digits = F.rtrim(raw.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    tiny = F.regexp_replace(F.regexp_replace(raw, r"(\.0)?E-(\d)$", "e-0$2"), r"(\.0)?E-", "e-")
    return (
        F.when((c == 0) | ((size >= F.lit(1e-3)) & (size < F.lit(1e7))), raw)
        .when((size >= F.lit(1e-4)) & (size < F.lit(1e16)), plain)
        .when(size < F.lit(1e-4), tiny)
        .when(F.isnan(c), "nan")
        .when(raw.endswith("Infinity"), F.replace(raw, F.lit("Infinity"), F.lit("inf")))
        .otherwise(F.regexp_replace(raw, r"(\.0)?E", "e+"))
    )


def canonical(c: Column, data_type: T.DataType) -> Column:
    """Canonical text of a typed column.

    NULL stays NULL, except that a NULL boolean reads as ``'false'``. Integral floats and decimals lose their fraction,
    midnight timestamps collapse to a date, other timestamps are cut to seconds, blank text becomes NULL.
    """
    if isinstance(data_type, _WHOLE):
        return c.cast("string")
    if isinstance(data_type, _BINARY_FLOAT):
        size = F.abs(c.cast("double"))
        whole = (c == F.floor(c)) | (size >= F.lit(4503599627370496.0))
        return (
            F.when(whole & (size < F.lit(9.0e18)), c.try_cast("bigint").cast("string"))
            .when(whole & (size < F.lit(9.9e37)), c.try_cast("decimal(38,0)").cast("string"))
            .otherwise(float_text(c))
        )
    if isinstance(data_type, T.DecimalType):
        if data_type.scale == 0:
            return c.cast("string")
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    if isinstance(data_type, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(data_type, _TIMES):
        return F.when(c == F.date_trunc("day", c), F.date_format(c, "yyyy-MM-dd")).otherwise(
            F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    if isinstance(data_type, T.BooleanType):
        return F.when(c, "true").otherwise("false")
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return F.nullif(F.trim(c), F.lit(""))
    if not is_comparable(data_type):
        raise ValueError(f"no canonical text for type {data_type.simpleString()}")
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def raw_text(c: Column, data_type: T.DataType) -> Column:
    """Plain text rendering without normalisation: ``1101.0`` stays ``'1101.0'``, blanks stay blanks."""
    return float_text(c) if isinstance(data_type, _BINARY_FLOAT) else c.cast("string")


def comparison_key(df: DataFrame, column: str, canonical_form: bool = True) -> Column:
    """Comparison expression of a column of `df`; an unknown or quoted name is refused."""
    if "`" in column or '"' in column:
        raise ValueError(f"illegal identifier: {column!r}")
    if column not in df.columns:
        raise ValueError(f"unknown column: {column!r}")
    data_type = df.schema[column].dataType
    build = canonical if canonical_form else raw_text
    return build(df[column], data_type)


def plain_key(df: DataFrame, column: str) -> Column | None:
    """The values of a whole-number column as bigint, None for any other type: their canonical and raw text is their cast."""
    comparison_key(df, column)
    return df[column].cast("bigint") if isinstance(df.schema[column].dataType, _WHOLE) else None


def canonical_cell(text: Column, kind: Column | None = None) -> Column:
    """Canonical text of a grid cell and the rule that produced it, as ``struct(text, rule)``.

    `kind` names the cell type where the grid carries one: ``text`` (default), ``int``, ``float``, ``bool``, ``date``,
    ``datetime``. Text cells know two rewrites: decimal comma and surrounding whitespace.
    """
    kind = F.lit("text") if kind is None else F.coalesce(kind, F.lit("text"))
    stripped = F.regexp_replace(text, EDGE_SPACE_PATTERN, "")
    number = text.try_cast("double")
    moment = text.try_cast("timestamp_ntz")
    fraction = F.date_format(moment, "SSSSSS")
    moment_text = F.concat(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"),
                           F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)))

    def tagged(value: Column, rule: str | None) -> Column:
        return F.struct(value.cast("string").alias("text"), F.lit(rule).cast("string").alias("rule"))

    integral = number.isNotNull() & ~F.isnan(number) & (number == F.floor(number))
    return (
        F.when(text.isNull() | (stripped == ""), tagged(F.lit(None), None))
        .when(kind == "bool", tagged(F.lower(stripped), RULE_NUMERIC_TO_TEXT))
        .when(kind == "int", tagged(stripped, RULE_NUMERIC_TO_TEXT))
        .when((kind == "float") & integral, tagged(canonical(number, T.DoubleType()), RULE_INTEGRAL_FLOAT))
        .when(kind == "float", tagged(float_text(number), RULE_NUMERIC_TO_TEXT))
        .when((kind == "datetime") & (moment != F.date_trunc("day", moment)),
              tagged(moment_text, RULE_DATETIME_TO_ISO))
        .when(kind.isin("date", "datetime"), tagged(F.date_format(moment, "yyyy-MM-dd"), RULE_DATE_TO_ISO))
        .when(stripped.rlike(DECIMAL_COMMA_PATTERN),
              tagged(F.replace(F.replace(stripped, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
                     RULE_DECIMAL_COMMA))
        .when(stripped != text, tagged(stripped, RULE_TRIMMED))
        .otherwise(tagged(text, None))
    )


def pattern_mask(value: Column) -> Column:
    """Shape of a value: digits become ``9``, letters of any script ``A``, the rest stays."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{Nd}", "9"), r"[\p{L}\p{Nl}\p{No}]", "A")


def value_kinds(value: Column) -> Column:
    """What a single value looks like: ``struct(integer, decimal, date)``."""
    integer = value.rlike(INTEGER_PATTERN)
    return F.struct(integer.alias("integer"), (integer | value.rlike(DECIMAL_PATTERN)).alias("decimal"),
                    value.rlike(DATE_PATTERN).alias("date"))


def class_of_kinds(kinds: Column) -> Column:
    """Aggregate over `value_kinds`, NULL where there is no value: the narrowest class all values belong to."""
    return (
        F.when(F.count(kinds) == 0, CLASS_EMPTY)
        .when(F.bool_and(kinds["integer"]), CLASS_INTEGER)
        .when(F.bool_and(kinds["decimal"]), CLASS_DECIMAL)
        .when(F.bool_and(kinds["date"]), CLASS_DATE)
        .otherwise(CLASS_TEXT)
    )


def value_class(samples: Column) -> Column:
    """Aggregate over values: the narrowest class all of them belong to."""
    return class_of_kinds(F.when(samples.isNotNull(), value_kinds(samples)))


def class_family(value_class_column: Column) -> Column:
    """Classes of one family may be compared: both numeric classes form one family."""
    return F.when(value_class_column.isin(*NUMERIC_CLASSES), "numeric").otherwise(value_class_column)


def lenient_bigint(text: Column) -> Column:
    """Whole number of a text, rounding fractions and reading exponents; NULL when it is no number."""
    return F.round(text.try_cast("decimal(38,10)"), 0).try_cast("bigint")
