"""Plans hold no product of tables, and scans read the columns that are asked for alone."""

import re

import pytest

from spanloom.plans import registry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_product(spark, name):
    assert not re.search("CartesianProduct|NestedLoopJoin", plan_of(registry.queries()[name](spark, SF)))


def test_scan_reads_two_columns(spark):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", registry.queries()["text_key"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert found == ["doc_id:bigint,text:string"]
