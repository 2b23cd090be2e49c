"""Counts kept between scans: unchanged tables are not read again, results stay those of a full scan."""

import pytest

from attest.functions.frames import declared
from attest.operators import profile as P
from attest.operators.values import settled_counts
from attest.plans.rescan import kept_counts, view_stamps
from attest.plans.scan import scan
from attest.sources.catalog import build_catalog
from attest.sources.specs import SourceSpec
from tests.conftest import rows


@pytest.fixture
def source(spark, folder):
    place = folder / "erp"
    for name in ("a", "b"):
        declared(spark, "v string, n bigint", [(f"{name}{i % 7}", i) for i in range(40)] + [("x" * 300, None), (None, 1)]).write.parquet(str(place / name))
    (folder / "r.csv").write_text("id,t\n1,x\n2,\n", encoding="utf-8")
    return place, [SourceSpec("erp", "tables", str(place)), SourceSpec("r", "csv", str(folder / "r.csv"))]


def test_only_changed_tables_are_counted(spark, folder, source):
    place, specs = source
    keep = str(folder / "keep")
    run = lambda masks=True: kept_counts(build_catalog(spark, specs), view_stamps(spark, specs), keep, masks)
    same = lambda found: rows(found.counts.frame.selectExpr("cid", "value", "late.a", "late.mask_a", "n")) == rows(
        settled_counts(found.counts.views).frame.selectExpr("cid", "value", "late.a", "late.mask_a", "n"))
    first = run()
    assert first.counted == ["erp__a", "erp__b", "r__r"] and same(first)
    again = run()
    assert again.counted == [] and same(again)
    assert run(masks=False).counted == ["erp__a", "erp__b", "r__r"]  # counts without shapes do not serve where shapes are asked
    declared(spark, "v string, n bigint", [("new", 99)]).write.mode("append").parquet(str(place / "b"))
    third = run()
    assert third.counted == ["erp__b"] and same(third)
    (folder / "r.csv").write_text("id,t\n1,x\n2,y\n", encoding="utf-8")
    assert run().counted == ["r__r"]
    declared(spark, "z bigint", [(1,)]).write.parquet(str(place / "c"))
    fourth = run()
    assert fourth.counted == ["erp__c"] and same(fourth)


def test_a_broken_scan_leaves_nothing_that_is_used(spark, folder, source):
    _, specs = source
    catalog, stamps, keep = build_catalog(spark, specs), view_stamps(spark, specs), str(folder / "keep")
    kept_counts(catalog, stamps, keep)
    declared(spark, "view string, stamp string", []).write.mode("overwrite").parquet(f"{keep}/list")
    fresh = kept_counts(catalog, stamps, f"{keep}-other")
    assert fresh.counted == ["erp__a", "erp__b", "r__r"]
    # what was counted but never listed is counted again
    assert kept_counts(catalog, stamps, keep).counted == ["erp__a", "erp__b", "r__r"]
    again = kept_counts(catalog, stamps, keep)
    assert again.counted == [] and rows(again.counts.frame.groupBy("cid").sum("n")) == rows(settled_counts(catalog.views).frame.groupBy("cid").sum("n"))


def test_scan_with_kept_counts(spark, folder, source):
    _, specs = source
    key = ["table", "column", "row_count", "distinct_count", "min", "max", "value_class"]
    plain = scan(spark, specs)
    assert plain.counted == ["erp__a", "erp__b", "r__r"]
    for counted in (["erp__a", "erp__b", "r__r"], []):
        kept = scan(spark, specs, keep=str(folder / "keep"))
        assert kept.counted == counted and rows(kept.profiles.select(*key)) == rows(plain.profiles.select(*key))
        assert rows(kept.matrix) == rows(plain.matrix)
    assert P.value_classes(settled_counts(plain.catalog.views)).count() == 6
