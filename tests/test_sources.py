import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attest.functions.fingerprints import schema_hash, schema_hash_table, sql_type_name, table_fingerprint
from attest.functions.frames import declared
from attest.plans.scan import scan
from attest.sources import catalog as K
from attest.sources import fingerprint as G
from attest.sources import grid, specs
from tests.conftest import rows
from workload.stores import page_files


@pytest.fixture
def landscape(spark, folder):
    """A table folder, a text file, a sheet and a document, plus a file nobody declared."""
    erp = folder / "erp"
    declared(spark, "customer_id bigint, customer_name string", [(1001, "Alpha"), (1002, "Beta")]).write.parquet(str(erp / "customers"))
    declared(spark, "order_id string, customer_id double, day date", []).unionByName(
        spark.sql("SELECT 'o1' order_id, 1001.0D customer_id, DATE '2024-03-01' day")).write.parquet(str(erp / "Orders"))
    (folder / "report.csv").write_text("id,amount\n0001,1.5\n0002,\n", encoding="utf-8")
    (folder / "migration.csv").write_text("Kunde,,Umsatz 2025\nNr,Ort,\n1001,Köln,\"1.234,56\"\n,,\n1002, Bonn ,99\n", encoding="utf-8")
    (folder / "policy.pdf").write_bytes(b"%PDF rules")
    (folder / "notes.txt").write_text("not listed", encoding="utf-8")
    return folder, specs.load_specs([
        {"name": "ERP", "kind": "tables", "location": str(erp)},
        {"name": "report", "kind": "csv", "location": str(folder / "report.csv")},
        {"name": "migration", "kind": "sheet", "location": str(folder / "migration.csv"), "options": {"sheet": "Kunden Liste", "spans": "0-1"}},
        {"name": "policy", "kind": "document", "location": str(folder / "policy.pdf")},
    ])


def test_specs_are_declared_and_checked(spark, folder):
    with pytest.raises(ValueError):
        specs.SourceSpec("a", "zz", "x")
    with pytest.raises(ValueError):
        specs.load_specs([{"name": "a", "kind": "csv", "location": "x"}] * 2)
    path = folder / "sources.jsonl"
    path.write_text('{"name": "a", "kind": "csv", "location": "x", "options": {"sep": ";"}}\n', encoding="utf-8")
    assert specs.read_specs(spark, str(path)) == [specs.SourceSpec("a", "csv", "x", {"sep": ";"})]


def test_catalog(spark, landscape):
    _, listed = landscape
    catalog = K.build_catalog(spark, listed)
    assert sorted(catalog.views) == ["erp__customers", "erp__orders", "migration__kunden_liste", "report__report"]
    assert rows(K.row_counts(catalog.views)) == [("erp__customers", 2), ("erp__orders", 1), ("migration__kunden_liste", 2), ("report__report", 2)]
    assert rows(catalog.views["report__report"]) == [("0001", "1.5"), ("0002", None)]
    assert catalog.query("SELECT count(*) FROM erp__customers").first()[0] == 2
    sheet = catalog.views["migration__kunden_liste"]
    assert sheet.columns == ["kunde_nr", "kunde_ort", "umsatz_2025"]
    assert rows(sheet) == [("1001", "Köln", "1234.56"), ("1002", "Bonn", "99")]
    rules = {(r["table"], r["rule"]) for r in catalog.decision_table().collect()}
    assert rules == {("report__report", K.RULE_CSV_TEXT), ("migration__kunden_liste", "merged_header_resolved"), ("migration__kunden_liste", "blank_rows_skipped"),
                     ("migration__kunden_liste", "decimal_comma_to_dot"), ("migration__kunden_liste", "trimmed_whitespace")}


def test_undeclared_files_are_listed(spark, landscape):
    folder, listed = landscape
    names = [r["path"].rsplit("/", 1)[1] for r in specs.undeclared_files(spark, str(folder), listed).collect()]
    assert names == ["notes.txt"]


def test_fingerprints(spark, landscape, folder):
    place, _ = landscape
    row = G.source_fingerprint(spark, str(place / "policy.pdf")).first()
    assert (row["files"], row["size"], row["sha256"]) == (1, 10, hashlib.sha256(b"%PDF rules").hexdigest())
    many = G.source_fingerprint(spark, str(place / "erp"))
    before = many.first()["sha256"]
    assert before == G.source_fingerprint(spark, str(place / "erp")).first()["sha256"]
    declared(spark, "x bigint", [(1,)]).write.parquet(str(place / "erp" / "extra"))
    assert G.source_fingerprint(spark, str(place / "erp")).first()["sha256"] != before
    assert G.source_fingerprint(spark, str(place / "erp"), content=False).first()["sha256"] != before
    table = spark.sql("SELECT 1 a, DATE '2024-01-05' b, TIMESTAMP_NTZ '2024-01-05 10:00:00.25' c UNION ALL SELECT 2, DATE '2023-01-01', NULL")
    got = table_fingerprint(table).first()
    assert (got["row_count"], got["max_date"]) == (2, "2024-01-05 10:00:00.250000")
    listed = declared(spark, "table string, position int, name string, type string",
                      [("t", i, f.name, sql_type_name(f.dataType)) for i, f in enumerate(table.schema.fields)])
    assert schema_hash_table(listed).first()["schema_hash"] == got["schema_hash"] == schema_hash(table)
    assert schema_hash(table) == hashlib.sha256(b"a\tINTEGER\nb\tDATE\nc\tTIMESTAMP").hexdigest()


def test_sources_keep_their_id(spark):
    stored = declared(spark, "id string, name string, kind string, location string, fingerprint map<string,string>", [("i1", "a", "csv", "x", {"sha256": "1"}), ("i2", "gone", "csv", "y", None)])
    fresh = declared(spark, "name string, kind string, location string, fingerprint map<string,string>", [("a", "csv", "x", {"sha256": "2"}), ("b", "csv", "z", None)])
    got = {r["name"]: r for r in G.upsert_sources(stored, fresh).collect()}
    assert got["a"]["id"] == "i1" and got["a"]["fingerprint"] == {"sha256": "2"} and got["gone"]["id"] == "i2" and got["b"]["id"]


def test_typed_grid_with_gaps_and_short_rows(spark):
    cells = "row_no bigint, cells array<struct<kind:string,text:string>>"
    rows_in = [(1, [None, None]), (3, [{"kind": "text", "text": "Id"}, None, {"kind": "text", "text": "id"}]),
               (4, [{"kind": "int", "text": "7"}]), (5, [{"kind": None, "text": None}]), (9, [{"kind": "float", "text": "99.0"}, {"kind": "text", "text": "0042"}, {"kind": "text", "text": "x"}])]
    sheet = grid.normalize_grid(declared(spark, cells, rows_in))
    assert sheet.table.columns == ["id", "col2", "id_2"]
    assert rows(sheet.table) == [("7", None, None), ("99", "0042", "x")]
    assert {(r["column"], r["rule"], r["before"], r["after"]) for r in sheet.decisions.collect()} == {
        ("id", "numeric_to_text", "7", "7"), ("id", "integral_float_to_text", "99.0", "99"), ("*", "blank_rows_skipped", "1 blank rows", "dropped")}
    assert grid.normalize_grid(declared(spark, "row_no bigint, cells array<string>", [(1, [None])])).table.count() == 0


def test_sheet_is_stored_as_text(spark, landscape, folder):
    _, listed = landscape
    sheet = grid.normalize_grid(grid.read_grid(spark, listed[2].location), [(0, 1)])
    back = grid.write_sheet(sheet, str(folder / "sheet"))
    assert {f.dataType.simpleString() for f in back.schema} == {"string"} and rows(back) == rows(sheet.table)


def test_scan_is_idempotent(spark, landscape, folder):
    _, listed = landscape
    first = scan(spark, listed, folder=str(folder / "out"))
    profiles = spark.read.parquet(str(folder / "out" / "profiles"))
    assert profiles.count() == 10 and first.profiles.count() == 10
    pairs = {(r["left"], r["right"]) for r in first.matrix.collect()}
    assert ("erp__customers.customer_id", "migration__kunden_liste.kunde_nr") in pairs
    assert rows(K.read_matrix(spark, str(folder / "out"))) == rows(first.matrix)
    parts = sorted((folder / "out" / "candidate_matrix_readable").glob("part-*.txt"))
    readable = "".join(p.read_text(encoding="utf-8") for p in parts).splitlines()
    assert readable[0].startswith("| left") and readable[1].startswith("|---") and len(readable) == 2 + first.matrix.count()
    assert first.header.first()["pairs_examined"] >= first.matrix.count()
    stored = (first.sources, first.declarations, first.profiles)
    again = scan(spark, listed, *stored)
    assert again.declarations.count() == 0 and first.declarations.count() == 5
    key = ["id", "source_id", "table", "column"]
    assert rows(again.profiles.select(*key)) == rows(first.profiles.select(*key))
    assert rows(again.sources.select("id", "name")) == rows(first.sources.select("id", "name"))


def test_large_files_are_digested_as_streams(spark, folder):
    files = {"a b.bin": b"y" * 4, "ü%20.bin": b"x" * 5000, "deep/one.bin": bytes(range(256)) * 40, "small": b"abc"}
    (folder / "deep").mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    want = sorted((len(d), hashlib.sha256(d).hexdigest()) for d in files.values())
    for limit in (0, 3, 5000, G.ONE_VALUE):
        assert sorted(tuple(r) for r in G.file_fingerprints(spark, str(folder), one_value=limit).select("size", "sha256").collect()) == want
    one = [G.source_fingerprint(spark, str(folder), one_value=limit).first() for limit in (0, G.ONE_VALUE)]
    assert one[0] == one[1]


def test_a_file_above_what_one_value_holds(spark, folder):
    size, state = (1 << 31) + 5, hashlib.sha256()
    with open(folder / "huge.bin", "wb") as file:
        file.truncate(size)
    for _ in range(1 << 9):
        state.update(bytes(1 << 22))
    state.update(bytes(5))
    row = G.source_fingerprint(spark, str(folder)).first()
    assert (row["files"], row["size"], row["sha256"]) == (1, size, state.hexdigest())


def test_grid_rows_stay_in_order_when_the_cuts_move(spark, folder):
    lines = ["Nr,Text"] + [f"{i},t{i}" for i in range(3000)]
    (folder / "long.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for cut in ("700b", "9000b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
            read = grid.read_grid(spark, str(folder / "long.csv"))
            assert [r["cells"] for r in read.orderBy("row_no").select("cells").collect()] == [x.split(",") for x in lines]
            sheet = grid.normalize_grid(read)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
            assert sheet.table.columns == ["nr", "text"] and sheet.table.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_grid_keeps_cells_beyond_the_first_row(spark, folder):
    (folder / "title.csv").write_text('Bericht\nNr;Ort;Betrag\n1;"a;b";2,5\n2;c\n', encoding="utf-8")
    read = grid.read_grid(spark, str(folder / "title.csv"), sep=";")
    assert [r["cells"] for r in read.orderBy("row_no").collect()] == [
        ["Bericht", None, None], ["Nr", "Ort", "Betrag"], ["1", "a;b", "2,5"], ["2", "c", None]]
    (folder / "breaks.csv").write_text('Nr,Text\n1,"a\nb"\n2,c\n', encoding="utf-8")
    read = grid.read_grid(spark, str(folder / "breaks.csv"), multiLine="true")
    assert rows(grid.normalize_grid(read).table) == [("1", "a\nb"), ("2", "c")]
    (folder / "empty.csv").write_text("", encoding="utf-8")
    assert grid.normalize_grid(grid.read_grid(spark, str(folder / "empty.csv"))).table.count() == 0


def test_snapshot_stands_alone(spark, landscape, folder):
    _, listed = landscape
    views = K.build_catalog(spark, listed).views
    assert rows(K.export_snapshot(views, str(folder / "snapshot"))) == rows(K.row_counts(views))
    assert spark.read.parquet(str(folder / "snapshot" / "erp__orders")).filter(F.col("order_id") == "o1").count() == 1


def test_a_run_leaves_nothing_behind(spark):
    from pathlib import Path

    from attest.session import run_folder, settle

    with run_folder(spark) as outer:
        kept = settle(spark.range(3), "kept")
        with run_folder(spark) as inner:
            assert settle(spark.range(5), "inner").count() == 5
            assert inner != outer
        assert not Path(inner.removeprefix("file:")).exists() and kept.count() == 3
    assert not Path(outer.removeprefix("file:")).exists()
    assert settle(spark.range(2), "later").count() == 2


def test_many_folders_are_listed_by_few_tasks(spark, folder):
    for i in range(80):
        (folder / f"f{i}").mkdir()
        (folder / f"f{i}" / "a.txt").write_text(str(i))
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.sparkContext.setJobGroup("listing", "")
    files = G.file_fingerprints(spark, str(folder))
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks, default=1) <= 4 * spark.sparkContext.defaultParallelism and spark.conf.get(name) == before
    assert files.count() == 80


def test_page_files_are_one_per_page_in_one_folder(spark, folder):
    declared(spark, "page_id bigint, html string", [(1, "é"), (2, None), (3, "x\ny")]).write.parquet(f"{folder}/pages.parquet")
    place = G.store_of(page_files(spark, str(folder)))[1]
    assert {p.name: p.read_bytes() for p in Path(place).iterdir()} == {"page_id=1": "é\n".encode(), "page_id=2": b"\n", "page_id=3": b"x\ny\n"}
