"""Queries with a SQL twin give its rows; every operator number has a query."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

TWINS = ["op3_quality_rules", "op6_source_mix", "op7_decontamination", "op10_warc", "op11_collocations", "op12_hard_negatives"]


@pytest.mark.parametrize("name", TWINS)
def test_equal_to_sql(spark, folder, name):
    assert compare(entry.queries()[name](spark, folder), duck(folder), entry.oracle_sql()[name]) == []


def test_all_operators_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()
