"""Sources, sinks and upserts: the test tables are written to the shared folder and read back through the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.evidence import claims as L
from attest.evidence import status as S
from attest.evidence.runner import build_check, probe_counts
from attest.evidence.tables import Probe
from attest.evidence.templates import merged_tolerances
from attest.functions.frames import declared, union_all
from attest.operators import overlap as O
from attest.operators import profile as P
from attest.operators.values import columns_frame
from attest.plans.rescan import kept_counts, view_stamps
from attest.session import shared_folder
from attest.sources import catalog as K
from attest.sources import fingerprint as G
from attest.sources import grid
from attest.sources.specs import SourceSpec, read_specs, undeclared_files
from workload.base import ORACLES, TABLES, query, table, tables
from workload.bookkeeping import EV, evidence
from workload.probes import EVENTS_CTE, signed_events
from workload.profiling import customer_grid


def place(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("specs_from_file", """
    SELECT s_name AS name, CASE s_nationkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'tables' ELSE 'document' END AS kind,
           '/data/' || s_suppkey AS location, CASE WHEN s_nationkey % 3 = 0 THEN ';' END AS sep FROM supplier""")
def specs_from_file(spark: SparkSession, sf: str) -> DataFrame:
    """Declared sources, one per supplier, from the file that lists them."""
    kind = F.when(F.col("s_nationkey") % 3 == 0, "csv").when(F.col("s_nationkey") % 3 == 1, "tables").otherwise("document")
    entries = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), kind.alias("kind"), F.concat(F.lit("/data/"), "s_suppkey").alias("location"),
        F.when(kind == "csv", F.create_map(F.lit("sep"), F.lit(";"))).alias("options"))
    path = place(spark, "specs")
    entries.write.json(path)
    return declared(spark, "name string, kind string, location string, sep string",
                    [(s.name, s.kind, s.location, s.options.get("sep")) for s in read_specs(spark, path)])


@query("csv_all_text", """
    SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS "key", o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
           CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, 'csv_read_all_varchar' AS rule FROM orders""")
def csv_all_text(spark: SparkSession, sf: str) -> DataFrame:
    """A text file stays text: leading zeros and trailing zeros are kept, nothing is inferred."""
    path = place(spark, "report")
    table(spark, sf, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority")).write.option("header", True).csv(path)
    catalog = K.build_catalog(spark, [SourceSpec("Report", "csv", path)])
    rows = next(iter(catalog.views.values()))
    rule = catalog.decision_table().select(F.col("rule"))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(rule.withColumn("one", F.lit(1))), "one").drop("one")


def page_files(spark: SparkSession, sf: str) -> str:
    """A folder with one file per page, named by its page and ended by a line feed. Each task writes the files of its own pages."""
    path = place(spark, "files")

    def written(batches):
        store, folder = G.store_of(path)
        store.create_dir(folder)
        for batch in batches:
            for page_id, value in zip(batch["page_id"].to_pylist(), batch["value"].to_pylist()):
                with store.open_output_stream(f"{folder}/page_id={page_id}") as out:
                    out.write(value.encode() + b"\n")
            yield batch.select(["page_id"])

    pages = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("value"))
    spread = pages.repartition(4 * spark.sparkContext.defaultParallelism, "page_id")
    spread.mapInArrow(written, "page_id bigint").write.format("noop").mode("overwrite").save()
    return path


@query("file_digests", """
    SELECT page_id, octet_length(encode(coalesce(html, '') || chr(10)))::BIGINT AS size, sha256(coalesce(html, '') || chr(10)) AS sha256 FROM pages""")
def file_digests(spark: SparkSession, sf: str) -> DataFrame:
    """One opaque file per page: size and digest of its bytes. Documents like these are fingerprinted and give no view."""
    path = page_files(spark, sf)
    found = G.file_fingerprints(spark, path)
    return found.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint").alias("page_id"), "size", "sha256")


@query("file_digests_streamed", ORACLES["file_digests"])
def file_digests_streamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same files, those above 2 KB as streams."""
    path = page_files(spark, sf)
    found = G.file_fingerprints(spark, path, one_value=2048)
    return found.select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint").alias("page_id"), "size", "sha256")


@query("sheet_in_file_order", """
    SELECT CAST(o_orderkey AS VARCHAR) AS nr, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority,
           CASE WHEN o_orderkey % 3 > 1 THEN o_orderstatus END AS status FROM orders""")
def sheet_in_file_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a sheet with a header in its first file; rows have more or fewer cells, and some end early."""
    path = place(spark, "sheet")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws(
        ";", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")),
        F.when(F.col("o_orderkey") % 3 > 1, F.col("o_orderstatus"))).alias("value"))
    head = declared(spark, "k bigint, value string", [(None, "Nr;Priority;Status")])
    orders.unionByName(head).orderBy(F.col("k").asc_nulls_first()).select("value").write.text(path)
    return grid.normalize_grid(grid.read_grid(spark, path, sep=";")).table


@query("document_source", """
    SELECT 0 AS views, count(*) AS files, sum(octet_length(encode(text || chr(10))))::BIGINT AS size FROM benchmark WHERE text IS NOT NULL""")
def document_source(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of opaque files is one source with one fingerprint and without a view."""
    path = place(spark, "documents")
    table(spark, sf, "benchmark").filter("text IS NOT NULL").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy(
        "item_id").text(path)
    views = K.build_catalog(spark, [SourceSpec("Policy", "document", path)]).views
    return G.source_fingerprint(spark, path).select(F.lit(len(views)).alias("views"), "files", "size")


@query("undeclared_files", """
    SELECT c_nationkey, CAST(CASE WHEN min(c_custkey) % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM customer GROUP BY 1""")
def undeclared(spark: SparkSession, sf: str) -> DataFrame:
    """One file per nation; the nations whose first customer has an odd number are declared, the files of the others are listed."""
    path = place(spark, "customers")
    customers = table(spark, sf, "customer")
    customers.select("c_nationkey", "c_custkey").repartition("c_nationkey").write.partitionBy("c_nationkey").parquet(path)
    nations = [r[0] for r in customers.groupBy("c_nationkey").agg(F.min("c_custkey").alias("m")).filter("m % 2 = 1").select("c_nationkey").collect()]
    listed = undeclared_files(spark, path, [SourceSpec(f"n{k}", "tables", f"{path}/c_nationkey={k}") for k in nations])
    left = listed.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).alias("k")).filter("k <> ''").groupBy("k").agg(F.lit(1).alias("n"))
    all_nations = customers.select("c_nationkey").distinct()
    return all_nations.join(left, F.col("c_nationkey").cast("string") == F.col("k"), "left").select("c_nationkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("snapshot_export", " UNION ALL ".join(f"SELECT '{t}' AS \"view\", count(*) AS n FROM {t}" for t in TABLES))
def snapshot_export(spark: SparkSession, sf: str) -> DataFrame:
    """Every view as a table of its own, counted from what was written."""
    return K.export_snapshot(tables(spark, sf), place(spark, "snapshot"))


@query("matrix_stored", ORACLES["overlap_matrix"])
def matrix_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix as its sink stores it, read back."""
    views, folder = tables(spark, sf), place(spark, "matrix")
    pairs = O.overlapping_pairs(views)
    K.write_matrix(O.score_pairs(pairs), O.matrix_header(pairs), folder)
    return K.read_matrix(spark, folder)


@query("sheet_stored", ORACLES["normalize_grid"])
def sheet_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet written as all-text Parquet and read back."""
    return grid.write_sheet(grid.normalize_grid(customer_grid(spark, sf), spans=[(0, 1)]), place(spark, "sheet"))


@query("source_upsert", """
    WITH old AS (SELECT s_name AS name, 'S' || s_suppkey AS id FROM supplier),
    fresh AS (SELECT s_name AS name, CAST(s_acctbal AS DECIMAL(18,2)) AS stamp FROM supplier WHERE s_acctbal > 0
      UNION ALL SELECT c_name, CAST(c_acctbal AS DECIMAL(18,2)) FROM customer)
    SELECT coalesce(old.name, fresh.name) AS name, coalesce(id, sha256(fresh.name)) AS id,
           coalesce(CAST(stamp AS VARCHAR), 'old') AS stamp FROM old FULL JOIN fresh ON old.name = fresh.name""")
def source_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Sources scanned again: known names keep their id and take the new fingerprint, others are added."""
    kind = lambda name, key, stamp: [F.col(name).alias("name"), F.lit("tables").alias("kind"), F.concat(F.lit("/"), key).alias("location"),
                                     F.create_map(F.lit("sha256"), stamp).alias("fingerprint")]
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    suppliers, customers = table(spark, sf, "supplier"), table(spark, sf, "customer")
    stored = suppliers.select(F.concat(F.lit("S"), "s_suppkey").alias("id"), *kind("s_name", "s_suppkey", F.lit("old")))
    fresh = suppliers.filter("s_acctbal > 0").select(F.lit(None).cast("string").alias("id"), *kind("s_name", "s_suppkey", money("s_acctbal"))).unionByName(
        customers.select(F.lit(None).cast("string").alias("id"), *kind("c_name", "c_custkey", money("c_acctbal"))))
    return G.upsert_sources(stored, fresh).select("name", "id", F.col("fingerprint")["sha256"].alias("stamp"))


@query("profile_upsert", """
    WITH d AS (SELECT DISTINCT coalesce(source, '') AS source_id, coalesce(lang, '') AS "table", CAST(n_chars AS VARCHAR) AS "column" FROM documents WHERE n_chars IS NOT NULL)
    SELECT source_id, "table", "column", CASE WHEN CAST("column" AS BIGINT) % 2 = 0 THEN 'known ' || source_id || "table" || "column"
           ELSE sha256(source_id || chr(31) || "table" || chr(31) || "column") END AS id FROM d""")
def profile_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles scanned again: what (source, table, column) knows already keeps its id."""
    part = lambda c: F.coalesce(c, F.lit(""))
    fresh = table(spark, sf, "documents").filter("n_chars IS NOT NULL").select(
        part("source").alias("source_id"), part("lang").alias("table"), F.col("n_chars").cast("string").alias("column")).distinct()
    stored = fresh.filter(F.col("column").cast("bigint") % 2 == 0).withColumn("id", F.concat(F.lit("known "), "source_id", "table", "column"))
    return P.upsert_profiles(stored, fresh)


@query("tolerances", f"""
    WITH {EVENTS_CTE}, b AS (SELECT abs(sum(amount)) AS a FROM ev GROUP BY user_id)
    SELECT 'default' AS setting, 0.01::DOUBLE AS absolute, count(*) FILTER (a > 0.01) AS n FROM b
    UNION ALL SELECT 'number', 50, count(*) FILTER (a > 50) FROM b UNION ALL SELECT 'mapping', 200, count(*) FILTER (a > 200) FROM b
    UNION ALL SELECT 'other template', 0.01, count(*) FILTER (a > 0.01) FROM b""")
def tolerances(spark: SparkSession, sf: str) -> DataFrame:
    """Configured tolerances replace the defaults of their own template only; a plain number is the absolute one."""
    views = {"signed_events": signed_events(spark, sf)}
    settings = {"default": None, "number": {"balance": 50}, "mapping": {"balance": {"absolute": 200}}, "other template": {"reconciliation": 9}}
    probe = Probe("p", "balance", {"journal": "signed_events", "amount": "amount", "group_column": "user_id"})
    return union_all([
        probe_counts({name: build_check(views, probe, chosen)}).select(
            F.lit(name).alias("setting"), F.lit(float(merged_tolerances("balance", chosen)["absolute"])).alias("absolute"),
            F.col("exceptions_found").cast("bigint").alias("n")) for name, chosen in settings.items()])


@query("evidence_attached", f"""
    WITH {EV}, said AS (SELECT DISTINCT claim_id FROM ev WHERE type = 'testimonial' AND NOT stale)
    SELECT id, NOT (type = 'confirmation' AND NOT scoped AND claim_id IN (SELECT claim_id FROM said)) AS admitted FROM ev""")
def evidence_attached(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmations attached to stored records: those without a scope are refused on claims that rest on statements."""
    known = evidence(spark, sf)
    kept, refused = S.attach_evidence(known.filter("type <> 'confirmation'"), known.filter("type = 'confirmation'"))
    return kept.select("id", F.lit(True).alias("admitted")).unionByName(refused.select("id", F.lit(False).alias("admitted")))


@query("evidence_appended", f"""
    WITH {EV} SELECT type, count(*) AS n, 'refused' AS again FROM ev GROUP BY 1""")
def evidence_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Records are added once; adding one of them again is refused."""
    known = evidence(spark, sf)
    stored = L.append_evidence(known.filter("type = 'declaration'"), known.filter("type <> 'declaration'"))
    try:
        L.append_evidence(stored, known.filter("type = 'testimonial'"))
        again = "taken"
    except ValueError:
        again = "refused"
    return stored.groupBy("type").agg(F.count(F.lit(1)).alias("n")).withColumn("again", F.lit(again))


RESCANNED = ("customer", "supplier", "part", "documents")


@query("rescan", "WITH " + ", ".join([
    "c2 AS (SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier)",
    "v AS (SELECT 'customer' AS t, 'c_custkey' AS c, CAST(c_custkey AS VARCHAR) AS v FROM c2 UNION ALL SELECT 'customer', 'c_name', NULLIF(trim(c_name), '') FROM c2"
    " UNION ALL SELECT 'supplier', 's_suppkey', CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 'supplier', 's_name', NULLIF(trim(s_name), '') FROM supplier"
    " UNION ALL SELECT 'part', 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT 'part', 'p_name', NULLIF(trim(p_name), '') FROM part"
    " UNION ALL SELECT 'documents', 'doc_id', CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 'documents', 'text', NULLIF(trim(text), '') FROM documents)"]) + """
    SELECT 'kept__' || t AS "table", c AS "column", t = 'customer' AS counted_again, count(*) AS row_count, count(DISTINCT v) AS distinct_count,
           max(length(v)) AS len_max FROM v GROUP BY 1, 2, 3""")
def rescan(spark: SparkSession, sf: str) -> DataFrame:
    """Four tables are scanned, one of them grows, and the second scan counts that one only."""
    path, keep = place(spark, "source"), place(spark, "kept")
    pick = {"customer": ["c_custkey", "c_name"], "supplier": ["s_suppkey", "s_name"], "part": ["p_partkey", "p_name"], "documents": ["doc_id", "text"]}
    for name in RESCANNED:
        table(spark, sf, name).select(*pick[name]).write.parquet(f"{path}/{name}")
    spec = [SourceSpec("Kept", "tables", path)]
    first = kept_counts(K.build_catalog(spark, spec), view_stamps(spark, spec), keep, masks=False)
    if first.counted != sorted(f"kept__{name}" for name in RESCANNED):
        raise RuntimeError(f"the first scan counted {first.counted}")
    more = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"))
    more.select(F.col("c_custkey").cast(table(spark, sf, "customer").schema["c_custkey"].dataType), "c_name").write.mode("append").parquet(f"{path}/customer")
    catalog = K.build_catalog(spark, spec)
    second = kept_counts(catalog, view_stamps(spark, spec), keep, masks=False)
    found = P.column_statistics(second.counts).join(columns_frame(catalog.views), "cid")
    return found.select("table", "column", F.col("table").isin(second.counted).alias("counted_again"), "row_count", "distinct_count", "len_max")
