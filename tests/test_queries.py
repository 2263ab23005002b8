import pytest

from differential import assert_same
from strandloom.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, SF, QUERIES[name], ORACLES[name])


def test_partition_covers_every_file_once(spark):
    from strandloom.operators import packing, setops
    from strandloom.plans.ledger import part_files

    files = part_files(spark, SF)
    units = packing.partition(files, "module", "path", "loc", most_files=20, most_loc=3000)
    got = units.selectExpr("explode(files) AS path")
    assert setops.exactly_once(files, got, "path").count() == 0
    assert units.where("NOT oversized AND (n_files > 20 OR loc > 3000) AND node NOT LIKE '%(files)'").count() == 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
