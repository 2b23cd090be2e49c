"""Identity of what was read: type names, schema hashes, table fingerprints as expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# SQL names of the types, as they enter schema hashes and profiles.
_TYPE_NAMES = {
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.BinaryType: "BLOB",
}


def sql_type_name(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return f"{sql_type_name(data_type.elementType)}[]"
    if isinstance(data_type, T.DecimalType):
        return f"DECIMAL({data_type.precision},{data_type.scale})"
    return _TYPE_NAMES.get(type(data_type), data_type.simpleString().upper())


def schema_hash(df: DataFrame) -> str:
    """SHA-256 over the ordered ``name<TAB>type`` lines of a schema."""
    lines = "\n".join(f"{field.name}\t{sql_type_name(field.dataType)}" for field in df.schema.fields)
    return hashlib.sha256(lines.encode("utf-8")).hexdigest()


def schema_hash_table(columns: DataFrame, table: str = "table", position: str = "position") -> DataFrame:
    """The same hash over a table of column descriptions ``(table, position, name, type)``."""
    line = F.concat(F.col("name"), F.lit("\t"), F.col("type"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), line.alias("line"))))
    text = F.array_join(F.transform(ordered, lambda item: item["line"]), "\n")
    return columns.groupBy(table).agg(F.sha2(text, 256).alias("schema_hash"))


def moment_text(c: Column, data_type: T.DataType) -> Column:
    """ISO text of a date or of a timestamp with its microseconds where there are any."""
    if isinstance(data_type, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"),
                    F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count, schema hash and the latest date or timestamp of any column, as text."""
    moments = [
        moment_text(F.max(df[field.name]), field.dataType)
        for field in df.schema.fields
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    ]
    latest = F.lit(None).cast("string")
    if len(moments) == 1:
        latest = moments[0]
    elif moments:
        latest = F.greatest(*moments)
    return df.agg(F.count(F.lit(1)).alias("row_count"), latest.alias("max_date")).select(
        "row_count", F.lit(schema_hash(df)).alias("schema_hash"), "max_date")


def fingerprint_text(row_count: Column, schema_hash_column: Column, max_date: Column) -> Column:
    """A fingerprint as one comparable text."""
    return F.concat_ws("|", row_count.cast("string"), schema_hash_column, F.coalesce(max_date, F.lit("-")))
