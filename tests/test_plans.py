"""How often the fact table is read, counted in executed plans."""

import re

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["mkt03_carried_pairs", "mkt04_kpis", "mkt05_period_delta", "mkt24_brand_cards"])
def test_facts_are_scanned_once(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet [^\n]*lineitem\.parquet", final)
    # The bounds of mkt05 are a pass of their own, before this plan.
    assert len(scans) == 1
