"""The catalogue: every declared source becomes views named ``<source>__<table>``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.frames import declared, union_all
from attest.functions.names import slug, view_name
from attest.sources import specs as S
from attest.sources.grid import normalize_grid, read_grid

# The rule declared for text files.
RULE_CSV_TEXT = "csv_read_all_varchar"


@dataclass
class Catalog:
    """Views of all sources, where each came from, and the normalisation decisions taken on the way."""

    spark: SparkSession
    views: dict[str, DataFrame] = field(default_factory=dict)
    source_of: dict[str, str] = field(default_factory=dict)
    decisions: list[DataFrame] = field(default_factory=list)

    def add(self, source: str, view: str, df: DataFrame) -> None:
        self.views[view] = df
        self.source_of[view] = source
        df.createOrReplaceTempView(view)

    def query(self, sql: str) -> DataFrame:
        """Any SQL over the views."""
        return self.spark.sql(sql)

    def decision_table(self) -> DataFrame:
        schema = "source string, table string, column string, rule string, before string, after string"
        return union_all([declared(self.spark, schema, []), *self.decisions])


def _folder_tables(spark: SparkSession, location: str) -> list[tuple[str, str]]:
    """(table, path) of a folder with one Parquet file or one subfolder per table; only paths are read."""
    files = S.list_files(spark, location, "*.parquet").select(S.plain_path(F.col("path")).alias("path"))
    root = S.plain_path(F.lit(location.rstrip("/") + "/"))
    first = F.split_part(F.substring(F.col("path"), F.length(root) + 1, F.length("path")), F.lit("/"), F.lit(1))
    names = [r[0] for r in files.select(first.alias("t")).distinct().collect()]
    return sorted((n.removesuffix(".parquet"), f"{location.rstrip('/')}/{n}") for n in names)


def _jdbc_tables(spark: SparkSession, spec: S.SourceSpec) -> list[tuple[str, DataFrame]]:
    """Tables named by the source option ``tables``; partitioned reads when the JDBC options ask for them."""
    options = {k: v for k, v in spec.options.items() if k != "tables"}
    names = sorted(t.strip() for t in spec.options["tables"].split(","))
    return [(t, spark.read.format("jdbc").options(url=spec.location, dbtable=t, **options).load()) for t in names]


def build_catalog(spark: SparkSession, specs: Sequence[S.SourceSpec]) -> Catalog:
    """Register all sources; running it again replaces the views with equal ones."""
    catalog = Catalog(spark)
    for spec in specs:
        if spec.kind == S.TABLES:
            for table, path in _folder_tables(spark, spec.location):
                catalog.add(spec.name, view_name(spec.name, table), spark.read.parquet(path))
        elif spec.kind == S.JDBC:
            for table, df in _jdbc_tables(spark, spec):
                catalog.add(spec.name, view_name(spec.name, table), df)
        elif spec.kind == S.CSV:
            stem = spec.location.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
            view = view_name(spec.name, stem)
            catalog.add(spec.name, view, spark.read.options(
                **{"header": "true", "inferSchema": "false", **spec.options}).csv(spec.location))
            catalog.decisions.append(declared(
                spark, "source string, table string, column string, rule string, before string, after string",
                [(spec.name, view, "*", RULE_CSV_TEXT, "sniffed types", "all VARCHAR")]))
        elif spec.kind == S.SHEET:
            title = spec.options.get("sheet", "sheet1")
            options = {k: v for k, v in spec.options.items() if k not in ("sheet", "spans")}
            spans = [tuple(int(x) for x in part.split("-")) for part in spec.options.get("spans", "").split(",") if part]
            sheet = normalize_grid(read_grid(spark, spec.location, **options), spans)
            view = f"{slug(spec.name)}__{slug(title) or 'column'}"
            catalog.add(spec.name, view, sheet.table)
            catalog.decisions.append(sheet.decisions.select(
                F.lit(spec.name).alias("source"), F.lit(view).alias("table"), "column", "rule", "before", "after"))
        # A document is fingerprinted as a source and yields no view.
    return catalog


def row_counts(views: Mapping[str, DataFrame]) -> DataFrame:
    """``(view, n)`` of all views in one job."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("view"), "n")
                      for v, df in sorted(views.items())])


def export_snapshot(views: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write every view as a Parquet table and count what can be read back: ``(view, n)``."""
    spark = next(iter(views.values())).sparkSession
    for name, df in sorted(views.items()):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return row_counts({name: spark.read.parquet(f"{folder}/{name}") for name in views})


def write_matrix(matrix: DataFrame, header: DataFrame, folder: str) -> None:
    """Candidates and header as JSON, plus the candidates as a readable table, all in report order."""
    order = [F.col("containment").desc(), F.col("overlap").desc(), F.col("left"), F.col("right")]
    matrix.orderBy(*order).write.mode("overwrite").json(f"{folder}/candidate_matrix")
    header.write.mode("overwrite").json(f"{folder}/candidate_matrix_header")
    cell = [F.lit("| "), F.col("left"), F.lit(" | "), F.col("right"), F.lit(" | "), F.col("overlap").cast("string"),
            F.lit(" | "), F.col("containment").cast("string"), F.lit(" | "), F.col("jaccard").cast("string"), F.lit(" |")]
    head = declared(matrix.sparkSession, "line int, value string", [
        (0, "| left | right | overlap | containment | jaccard |"), (1, "|---|---|---|---|---|")])
    body = matrix.select(F.lit(2).alias("line"), F.concat(*cell).alias("value"), *matrix.columns)
    head.unionByName(body, allowMissingColumns=True).orderBy("line", *order).select("value").write.mode("overwrite").text(
        f"{folder}/candidate_matrix_readable")


def read_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The stored candidates; a missing matrix is an error that names the folder."""
    schema = ("left string, right string, overlap bigint, left_distinct bigint, right_distinct bigint, "
              "containment double, jaccard double")
    return spark.read.schema(schema).json(f"{folder}/candidate_matrix")
