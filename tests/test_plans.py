"""What the physical plans must and must not contain."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


LAZY = ["c1_full_dedupe", "c2_near_dedupe", "c3_pk_dedupe", "c5_trim", "z1_cleanse_txn", "z2_cleanse_report",
        "z5_active_customers", "z7_headcount", "p1_column_profile", "p11_near_dup", "q7_all_tables", "x4_blocks", "x1_unmerge"]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas"):
        assert bad not in text, (name, bad)


@pytest.mark.parametrize("name", ["c1_full_dedupe", "c2_near_dedupe", "c3_pk_dedupe", "z1_cleanse_customer"])
def test_dedupe_limits_groups_before_the_shuffle(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_transactions_are_reduced_before_the_join(spark):
    text = plan(entry.queries()["z5_active_customers"](spark, SF))
    assert "partial_count(txn_id" in text and "txn_id" not in text.split("Join", 1)[0].split("HashAggregate", 1)[0]


def test_queries_are_listed_without_a_session():
    code = ("import __spark_entry__ as e; from pyspark import SparkContext; "
            "print(len(e.queries()), len(e.oracle_sql()), SparkContext._active_spark_context)")
    folder = os.path.dirname(os.path.abspath(entry.__file__))
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-2000:]
    assert said.stdout.split() == [str(len(entry.queries())), str(len(entry.oracle_sql())), "None"]
