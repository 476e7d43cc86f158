"""Every registered query of the engine against its SQL."""

import pytest

from cidrloom import queries as core

from .oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, name):
    df = core.QUERIES[name](spark, SF)
    if name in core.ORACLE_SQL:
        assert_same(df, connect(SF), core.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_roundtrip_keeps_every_record(spark):
    got = {(r.network, r.value) for r in core.QUERIES["s10_file_roundtrip"](spark, SF).collect()}
    from cidrloom.functions.addr import ipv4_prefix_text
    from pyspark.sql import functions as F

    want = core.QUERIES["i14_coalesce_ranges"](spark, SF).select(ipv4_prefix_text(F.col("lo"), F.col("plen")).alias("n"), F.to_json(F.struct("v")).alias("v"))
    assert got == {(r.n, r.v) for r in want.collect()}
