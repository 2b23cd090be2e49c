"""Profiles, overlap matrix, canonical forms, catalogue and fingerprints over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.evidence.runner import view_fingerprints
from attest.functions import canonical as C
from attest.functions.fingerprints import schema_hash_table, sql_type_name
from attest.functions.frames import declared, union_all
from attest.functions.names import name_table
from attest.operators import overlap as O
from attest.operators import profile as P
from attest.operators.values import columns_frame, settled_counts, value_counts
from attest.plans.scan import scan
from attest.sources.catalog import build_catalog, row_counts
from attest.sources.grid import normalize_grid
from attest.sources.specs import SourceSpec
from workload.base import TABLES, query, table, tables

# Columns of the star schema with their canonical SQL form.
DOUBLE = ("CASE WHEN {c} = trunc({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END")
STAMP = ("CASE WHEN {c} = date_trunc('day', {c}) THEN strftime({c}, '%Y-%m-%d') "
         "ELSE strftime({c}, '%Y-%m-%d %H:%M:%S') END")
WHOLE = "CAST({c} AS VARCHAR)"
TEXT = "NULLIF(trim({c}), '')"
STAR = {
    "customer": {"c_custkey": WHOLE, "c_name": TEXT, "c_nationkey": WHOLE, "c_acctbal": DOUBLE, "c_mktsegment": TEXT},
    "orders": {"o_orderkey": WHOLE, "o_custkey": WHOLE, "o_orderstatus": TEXT, "o_totalprice": DOUBLE,
               "o_orderdate": STAMP, "o_orderpriority": TEXT},
    "part": {"p_partkey": WHOLE, "p_name": TEXT, "p_brand": TEXT, "p_type": TEXT, "p_size": WHOLE, "p_retailprice": DOUBLE},
    "supplier": {"s_suppkey": WHOLE, "s_name": TEXT, "s_nationkey": WHOLE, "s_acctbal": DOUBLE},
    "nation": {"n_nationkey": WHOLE, "n_name": TEXT, "n_regionkey": WHOLE},
    "region": {"r_regionkey": WHOLE, "r_name": TEXT},
    "lineitem": {"l_orderkey": WHOLE, "l_partkey": WHOLE, "l_suppkey": WHOLE, "l_linenumber": WHOLE, "l_quantity": DOUBLE,
                 "l_extendedprice": DOUBLE, "l_discount": DOUBLE, "l_tax": DOUBLE, "l_returnflag": TEXT, "l_linestatus": TEXT,
                 "l_shipdate": STAMP},
    "documents": {"doc_id": WHOLE, "text": TEXT, "lang": TEXT, "source": TEXT, "n_chars": WHOLE},
    "embeddings": {"vec_id": WHOLE, "label": WHOLE},
    "pages": {"page_id": WHOLE, "url": TEXT, "html": TEXT},
    "benchmark": {"item_id": WHOLE, "text": TEXT},
    "labels": {"doc_id": WHOLE, "quality": WHOLE, "toxic": WHOLE},
    "conversations": {"conv_id": WHOLE, "turn": WHOLE, "role": TEXT, "text": TEXT},
    "events": {"event_id": WHOLE, "ts": STAMP, "user_id": WHOLE, "event_type": TEXT, "value": DOUBLE, "props": TEXT},
}
def star_cte(names) -> str:
    return "vals AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{c}' AS col, {form.format(c=c)} AS v FROM {t}"
        for t in names for c, form in STAR[t].items()) + ")"


CLASS_SQL = """CASE WHEN count(v) = 0 THEN 'empty'
    WHEN bool_and(regexp_matches(v, '^-?[0-9]+$')) THEN 'integer_like'
    WHEN bool_and(regexp_matches(v, '^-?[0-9]+$') OR regexp_matches(v, '^-?[0-9]+\\.[0-9]+$')) THEN 'decimal_like'
    WHEN bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T].*)?$')) THEN 'date_like' ELSE 'text' END"""
SAMPLE_CTE = """sample AS (SELECT tbl, col, v FROM (SELECT tbl, col, v, row_number() OVER (PARTITION BY tbl, col ORDER BY v) AS r
    FROM (SELECT DISTINCT tbl, col, v FROM vals WHERE v IS NOT NULL)) WHERE r <= 200)"""


def profiled(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return tables(spark, sf)


@query("profile_columns", f"""
    WITH {star_cte(TABLES)},
    cls AS (SELECT tbl, col, {CLASS_SQL} AS value_class FROM vals GROUP BY 1, 2)
    SELECT tbl AS "table", col AS "column", count(*) AS row_count, count(*) - count(v) AS null_count,
           count(DISTINCT v) AS distinct_count, md5(min(v)) AS min, md5(max(v)) AS max, min(length(v)) AS len_min,
           round(avg(length(v)), 1) AS len_avg, max(length(v)) AS len_max, any_value(value_class) AS value_class
    FROM vals JOIN cls USING (tbl, col) GROUP BY 1, 2""")
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile_views(profiled(spark, sf), lists=False).drop("type").withColumns(
        {"min": F.md5("min"), "max": F.md5("max")})


def named(views: dict[str, DataFrame], frame: DataFrame) -> DataFrame:
    return frame.join(columns_frame(views).select("cid", "table", "column"), "cid").drop("cid")


@query("profile_topk", f"""
    WITH {star_cte(TABLES)}
    SELECT tbl AS "table", col AS "column", v AS value, n, CAST(r AS INTEGER) AS rank FROM (
      SELECT tbl, col, v, n, row_number() OVER (PARTITION BY tbl, col ORDER BY n DESC, v) AS r
      FROM (SELECT tbl, col, v, count(*) AS n FROM vals WHERE v IS NOT NULL GROUP BY ALL)) WHERE r <= 10""")
def profile_topk(spark: SparkSession, sf: str) -> DataFrame:
    views = profiled(spark, sf)
    return named(views, P.top_values(settled_counts(views, masks=False)))


@query("profile_sample", f"""
    WITH {star_cte(TABLES)}, {SAMPLE_CTE} SELECT tbl AS "table", col AS "column", v AS value FROM sample""")
def profile_sample(spark: SparkSession, sf: str) -> DataFrame:
    views = profiled(spark, sf)
    return named(views, P.value_sample(settled_counts(views, masks=False))).select("table", "column", "value")


@query("profile_masks", f"""
    WITH {star_cte(TABLES)},
    m AS (SELECT tbl, col, regexp_replace(regexp_replace(v, '\\p{{Nd}}', '9', 'g'), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]', 'A', 'g') AS mask,
          count(*) AS n FROM (SELECT DISTINCT tbl, col, v FROM vals WHERE v IS NOT NULL) GROUP BY 1, 2, 3)
    SELECT tbl AS "table", col AS "column", mask, n, CAST(r AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY n DESC, mask) AS r FROM m) WHERE r <= 5""")
def profile_masks(spark: SparkSession, sf: str) -> DataFrame:
    views = profiled(spark, sf)
    return named(views, P.top_patterns(settled_counts(views)))


@query("profile_class", f"""
    WITH {star_cte(TABLES)}
    SELECT tbl AS "table", col AS "column", {CLASS_SQL} AS value_class FROM vals GROUP BY 1, 2""")
def profile_class(spark: SparkSession, sf: str) -> DataFrame:
    views = profiled(spark, sf)
    return named(views, P.value_classes(value_counts(views, masks=False)))


@query("text_masks", r"""
    SELECT mask, count(*) AS n FROM (
      SELECT regexp_replace(regexp_replace(text, '\p{Nd}', '9', 'g'), '[\p{L}\p{Nl}\p{No}]', 'A', 'g') AS mask FROM benchmark
      UNION ALL SELECT regexp_replace(regexp_replace(text, '\p{Nd}', '9', 'g'), '[\p{L}\p{Nl}\p{No}]', 'A', 'g') FROM conversations)
    GROUP BY 1""")
def text_masks(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "benchmark").select("text").unionByName(table(spark, sf, "conversations").select("text"))
    return texts.groupBy(C.pattern_mask(F.col("text")).alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@query("scan_profiles", f"""
    WITH {star_cte(TABLES)},
    cls AS (SELECT tbl, col, {CLASS_SQL} AS value_class FROM vals GROUP BY 1, 2)
    SELECT 'test__' || tbl AS "table", col AS "column", count(*) AS row_count, count(*) - count(v) AS null_count,
           count(DISTINCT v) AS distinct_count, md5(min(v)) AS min, md5(max(v)) AS max, min(length(v)) AS len_min,
           round(avg(length(v)), 1) AS len_avg, max(length(v)) AS len_max, any_value(value_class) AS value_class,
           any_value(top) AS top_values
    FROM vals JOIN cls USING (tbl, col) LEFT JOIN (SELECT tbl, col, md5(string_agg(v || '=' || n, ';' ORDER BY r)) AS top FROM (
      SELECT tbl, col, v, n, row_number() OVER (PARTITION BY tbl, col ORDER BY n DESC, v) AS r
      FROM (SELECT tbl, col, v, count(*) AS n FROM vals WHERE v IS NOT NULL GROUP BY ALL)) WHERE r <= 10 GROUP BY 1, 2) USING (tbl, col) GROUP BY 1, 2""")
def scan_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline over the folder: catalogue, fingerprints, value counts, profiles, matrix."""
    found = scan(spark, [SourceSpec("Test", "tables", sf)], content=False).profiles
    return found.select("table", "column", "row_count", "null_count", "distinct_count", F.md5("min").alias("min"),
                        F.md5("max").alias("max"), "len_min", "len_avg", "len_max", "value_class",
                        F.md5(F.array_join(F.transform("top_values", lambda t: F.concat_ws("=", t["value"], t["count"])), ";")).alias("top_values"))


PAIRS_CTE = f"""{star_cte(TABLES)},
    cls AS (SELECT tbl, col, {CLASS_SQL} AS cl FROM vals GROUP BY 1, 2),
    dist AS (SELECT DISTINCT tbl, col, v FROM vals WHERE v IS NOT NULL),
    cols AS (SELECT tbl, col, tbl || '.' || col AS k, count(*) AS d, any_value(CASE WHEN cl IN ('integer_like', 'decimal_like')
             THEN 'numeric' ELSE cl END) AS fam FROM dist JOIN cls USING (tbl, col) GROUP BY 1, 2 HAVING count(*) >= 2),
    pairs AS (SELECT a.k AS lk, b.k AS rk, a.d AS ld, b.d AS rd, a.tbl lt, a.col lc, b.tbl rt, b.col rc FROM cols a JOIN cols b
              ON a.k < b.k AND a.tbl <> b.tbl AND a.fam = b.fam),
    ov AS (SELECT a.tbl || '.' || a.col AS lk, b.tbl || '.' || b.col AS rk, count(*) AS n FROM dist a JOIN dist b
           ON a.v = b.v AND a.tbl || '.' || a.col < b.tbl || '.' || b.col GROUP BY 1, 2),
    cand AS (SELECT lk, rk, n AS overlap, ld, rd, n * 1.0 / least(ld, rd) AS cont, n * 1.0 / (ld + rd - n) AS jac
             FROM pairs JOIN ov USING (lk, rk) WHERE n * 1.0 / least(ld, rd) >= 0.5)"""


@query("overlap_matrix", f"""
    WITH {PAIRS_CTE}
    SELECT lk AS "left", rk AS "right", overlap, ld AS left_distinct, rd AS right_distinct,
           CAST(round(cont, 4) AS DOUBLE) AS containment, CAST(round(jac, 4) AS DOUBLE) AS jaccard FROM cand""")
def overlap_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return O.candidate_matrix(tables(spark, sf))


@query("overlap_by_column", f"""
    WITH {PAIRS_CTE}
    SELECT lk AS column_key, rk AS other, CAST(round(cont, 4) AS DOUBLE) AS containment, overlap FROM cand
    UNION ALL SELECT rk, lk, CAST(round(cont, 4) AS DOUBLE), overlap FROM cand""")
def overlap_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return O.candidates_by_column(O.candidate_matrix(tables(spark, sf)))


@query("overlap_pairs", f"""
    WITH {PAIRS_CTE} SELECT lk AS "left", rk AS "right", ld AS left_distinct, rd AS right_distinct, n AS overlap
    FROM pairs JOIN ov USING (lk, rk)""")
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return O.overlapping_pairs(tables(spark, sf)).select("left", "right", "left_distinct", "right_distinct", "overlap")


@query("overlap_header", f"""
    WITH {PAIRS_CTE} SELECT 0.5 :: DOUBLE AS threshold, count(*) AS pairs_examined FROM pairs JOIN ov USING (lk, rk)""")
def overlap_header(spark: SparkSession, sf: str) -> DataFrame:
    return O.matrix_header(O.overlapping_pairs(tables(spark, sf)))


@query("canonical_forms", f"""
    SELECT 'events' AS t, {WHOLE.format(c='event_id')} AS a, {STAMP.format(c='ts')} AS b, {DOUBLE.format(c='value')} AS c,
           {TEXT.format(c='event_type')} AS d, CASE WHEN value > 100 THEN 'true' ELSE 'false' END AS e,
           strftime(CAST(ts AS DATE), '%Y-%m-%d') AS f,
           CASE WHEN CAST(value AS DECIMAL(18,2)) = trunc(CAST(value AS DECIMAL(18,2)))
                THEN CAST(CAST(CAST(value AS DECIMAL(18,2)) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS g,
           {DOUBLE.format(c='(value * 1000000)')} AS h, {DOUBLE.format(c='(value / 10000000)')} AS i,
           {DOUBLE.format(c='CAST(value AS FLOAT)')} AS j FROM events""")
def canonical_forms(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    dec = T.DecimalType(18, 2)
    value = F.col("value")
    return ev.select(
        F.lit("events").alias("t"),
        C.canonical(F.col("event_id"), T.LongType()).alias("a"),
        C.canonical(F.col("ts"), ev.schema["ts"].dataType).alias("b"),
        C.canonical(value, T.DoubleType()).alias("c"),
        C.canonical(F.col("event_type"), T.StringType()).alias("d"),
        C.canonical(value > 100, T.BooleanType()).alias("e"),
        C.canonical(F.col("ts").cast("date"), T.DateType()).alias("f"),
        C.canonical(value.cast(dec), dec).alias("g"),
        C.canonical(value * 1000000, T.DoubleType()).alias("h"),
        C.canonical(value / 10000000, T.DoubleType()).alias("i"),
        C.canonical(value.cast("float"), T.FloatType()).alias("j"))


CELL_SQL = """
    cells AS (
      SELECT 'documents' AS src, text AS v, doc_id AS id FROM documents
      UNION ALL SELECT 'prices', replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '.', ','), o_orderkey FROM orders
      UNION ALL SELECT 'padded', '  ' || p_name || chr(9), p_partkey FROM part
      UNION ALL SELECT 'blank', CASE WHEN n_nationkey > 10 THEN '   ' ELSE NULL END, n_nationkey FROM nation
      UNION ALL SELECT 'names', c_name, c_custkey FROM customer),
    stripped AS (SELECT *, regexp_replace(regexp_replace(v, '^[\\s\\x1c-\\x1f]+', ''), '[\\s\\x1c-\\x1f]+$', '') AS s FROM cells),
    ruled AS (SELECT src, id, v, CASE
        WHEN v IS NULL OR s = '' THEN NULL
        WHEN regexp_matches(s, '^-?[0-9]{1,3}(\\.[0-9]{3})*,[0-9]+$|^-?[0-9]+,[0-9]+$') THEN 'decimal_comma_to_dot'
        WHEN s <> v THEN 'trimmed_whitespace' END AS rule,
        CASE WHEN v IS NULL OR s = '' THEN NULL
        WHEN regexp_matches(s, '^-?[0-9]{1,3}(\\.[0-9]{3})*,[0-9]+$|^-?[0-9]+,[0-9]+$') THEN replace(replace(s, '.', ''), ',', '.')
        ELSE s END AS text FROM stripped)"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    price = F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return union_all([
        table(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("text").alias("v"), F.col("doc_id").alias("id")),
        table(spark, sf, "orders").select(F.lit("prices").alias("src"), price.alias("v"), F.col("o_orderkey").alias("id")),
        table(spark, sf, "part").select(F.lit("padded").alias("src"), F.concat(F.lit("  "), "p_name", F.lit("\t")).alias("v"),
                                        F.col("p_partkey").alias("id")),
        table(spark, sf, "nation").select(F.lit("blank").alias("src"), F.when(F.col("n_nationkey") > 10, "   ").alias("v"),
                                          F.col("n_nationkey").cast("bigint").alias("id")),
        table(spark, sf, "customer").select(F.lit("names").alias("src"), F.col("c_name").alias("v"), F.col("c_custkey").alias("id")),
    ])


@query("cell_rules", f"WITH {CELL_SQL} SELECT src, id, rule, text FROM ruled")
def cell_rules(spark: SparkSession, sf: str) -> DataFrame:
    form = C.canonical_cell(F.col("v"))
    return cells(spark, sf).withColumn("form", form).select("src", "id", "form.rule", "form.text")


@query("cell_decisions", f"""
    WITH {CELL_SQL} SELECT src AS "table", rule, count(*) AS n, arg_min(v, id) AS before, arg_min(text, id) AS after
    FROM ruled WHERE rule IS NOT NULL GROUP BY 1, 2""")
def cell_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """One declaration per table and rule, with the first example."""
    ruled = cells(spark, sf).withColumn("form", C.canonical_cell(F.col("v"))).filter(F.col("form.rule").isNotNull())
    return ruled.groupBy(F.col("src").alias("table"), F.col("form.rule").alias("rule")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct(F.col("v").alias("before"), F.col("form.text").alias("after")), "id").alias("x")
    ).select("table", "rule", "n", "x.before", "x.after")


@query("clean_names", r"""
    WITH s AS (SELECT page_id, url, trim(lower(regexp_replace(url, '[^0-9a-zA-Z]+', '_', 'g')), '_') AS b FROM pages),
    n AS (SELECT page_id, CASE WHEN b = '' THEN 'column' ELSE b END AS b FROM s)
    SELECT page_id, CASE WHEN r = 1 THEN b ELSE b || '_' || r END AS clean_name
    FROM (SELECT page_id, b, row_number() OVER (PARTITION BY b ORDER BY page_id) AS r FROM n)""")
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    return name_table(table(spark, sf, "pages").withColumn("scope", F.lit("pages")), ["scope"], "url", "page_id").select(
        "page_id", "clean_name")


@query("catalog_counts", " UNION ALL ".join(
    f"SELECT 'test__{t}' AS \"view\", count(*) AS n FROM {t}" for t in TABLES))
def catalog_counts(spark: SparkSession, sf: str) -> DataFrame:
    return row_counts(build_catalog(spark, [SourceSpec("Test", "tables", sf)]).views)


@query("catalog_sql", """
    SELECT c_mktsegment AS segment, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def catalog_sql(spark: SparkSession, sf: str) -> DataFrame:
    return build_catalog(spark, [SourceSpec("Test", "tables", sf)]).query(
        "SELECT c_mktsegment AS segment, count(*) AS orders FROM test__orders JOIN test__customer "
        "ON o_custkey = c_custkey GROUP BY 1")


FINGERPRINTED = TABLES
MOMENTS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@query("fingerprints", "WITH h AS (SELECT table_name, sha256(string_agg(column_name || chr(9) || data_type, chr(10) ORDER BY "
       "ordinal_position)) AS schema_hash FROM information_schema.columns GROUP BY 1), " + "f AS (" + " UNION ALL ".join(
           f"SELECT '{t}' AS \"view\", count(*) AS row_count, "
           + (f"CASE WHEN max({MOMENTS[t]}) = date_trunc('second', max({MOMENTS[t]})) THEN strftime(max({MOMENTS[t]}), "
              f"'%Y-%m-%d %H:%M:%S') ELSE strftime(max({MOMENTS[t]}), '%Y-%m-%d %H:%M:%S.%f') END" if t in MOMENTS
              else "CAST(NULL AS VARCHAR)") + f" AS max_date FROM {t}" for t in FINGERPRINTED)
       + ") SELECT \"view\", row_count, schema_hash, max_date FROM f JOIN h ON table_name = \"view\"")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return view_fingerprints(tables(spark, sf, *FINGERPRINTED)).select("view", "row_count", "schema_hash", "max_date")


@query("schema_hashes", """
    SELECT table_name AS "table", sha256(string_agg(column_name || chr(9) || data_type, chr(10) ORDER BY ordinal_position))
           AS schema_hash FROM information_schema.columns
    WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents',
                         'embeddings', 'pages', 'benchmark', 'labels', 'conversations') GROUP BY 1""")
def schema_hashes(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(t, i, f.name, sql_type_name(f.dataType)) for t in TABLES
            for i, f in enumerate(table(spark, sf, t).schema.fields)]
    return schema_hash_table(declared(spark, "table string, position int, name string, type string", rows))


def customer_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet as people keep them: a parent header over sub-headers, blank rows, decimal commas, padded text."""
    comma = F.replace(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    blank = F.col("c_mktsegment") == "MACHINERY"
    cell = lambda c: F.when(~blank, c)
    body = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 10).alias("row_no"),
        F.array(cell(F.col("c_custkey").cast("string")), cell(F.concat(F.lit(" "), "c_name")), cell(comma)).alias("cells"))
    head = declared(spark, "row_no bigint, cells array<string>", [
        (0, [None, None, None]), (1, ["Kunde", None, "Saldo EUR"]), (2, ["Nr", "Name", None])])
    return head.unionByName(body)


@query("normalize_grid", """
    SELECT CAST(c_custkey AS VARCHAR) AS kunde_nr, c_name AS kunde_name,
           CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS saldo_eur
    FROM customer WHERE c_mktsegment <> 'MACHINERY'""")
def grid_table(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_grid(customer_grid(spark, sf), spans=[(0, 1)]).table


@query("grid_decisions", """
    WITH b AS (SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY')
    SELECT 'kunde_name' AS "column", 'trimmed_whitespace' AS rule, arg_min(''' ' || c_name || '''', c_custkey) AS before,
           arg_min(c_name, c_custkey) AS after FROM b
    UNION ALL SELECT 'saldo_eur', 'decimal_comma_to_dot',
           arg_min('''' || replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || '''', c_custkey),
           arg_min(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), c_custkey) FROM b
    UNION ALL SELECT '*', 'blank_rows_skipped', count(*) || ' blank rows', 'dropped' FROM customer WHERE c_mktsegment = 'MACHINERY'
    UNION ALL SELECT '*', 'merged_header_resolved', '[''Kunde'', None, ''Saldo EUR'']', '[''Kunde_Nr'', ''Kunde_Name'', ''Saldo EUR'']'""")
def grid_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_grid(customer_grid(spark, sf), spans=[(0, 1)]).decisions
