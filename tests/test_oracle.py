"""Queries against their SQL on the smallest tables.  ORACLE=all runs them all;
otherwise one of each family."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle
from checks import registry

SF = "/root/testdata/sf0.001"
SAMPLE = ["f3_date_zone", "f9_amount_usd", "z1_cleanse_customer", "z2_cleanse_report", "z5_active_customers", "p1_column_profile",
          "p14_issues", "c3_all_dedupes", "c12_abs_long", "c8_median_long", "f9_amount_fine", "p18_long_samples", "c18_clean_twice", "c10_cap", "c16_change_log", "c20_auto_clean", "q7_all_tables",
          "g3_catalog_upsert", "z3_any_cleanse", "s1_mixed_folder", "s1_dropped_cells", "x5_clean_sheet", "x5_sheet_medians", "c8_fill_groups", "c10_cap_groups",
          "s4_file_report", "s9_clean_table", "q4_any_file", "p19_value_dist", "r1_runs"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES) if os.environ.get("ORACLE") == "all" else SAMPLE)
def test_query(spark, name):
    result = check_oracle.compare(registry.QUERIES[name](spark, SF), check_oracle.duck(SF), registry.ORACLE[name])
    assert result.startswith("ok"), result


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_samples_are_whole_texts(spark):
    found = registry.QUERIES["p18_whole_samples"](spark, SF)
    assert check_oracle.compare(found, check_oracle.duck(SF), registry.ORACLE["p18_whole_samples"]).startswith("ok")
    assert max(len(r.value) for r in found.collect()) > 300
