"""The queries against the SQL of those that have one, and what every one of them leaves behind."""

import os

import duckdb
import pytest

from tidemark.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall())


def test_intermediate_tables_go_before_the_result(spark):
    """What a query no longer reads is removed at once; the rest goes with the session."""
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    had = set(os.listdir(at)) if os.path.isdir(at) else set()
    for name, most in (("op1_line_dedup", 1), ("op3_near_dedup", 3), ("op9_suffix_dedup", 1), ("op10_license_scan", 0)):
        registry.queries()[name](spark, DIR).count()
        new = {x for x in os.listdir(at) if x not in had and os.listdir(f"{at}/{x}")}
        assert len(new) <= most, (name, new)
        had |= set(os.listdir(at))
