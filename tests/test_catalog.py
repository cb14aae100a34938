import pytest

import __spark_entry__
from ferrule.plans import catalog

from .oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_are_those_of_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name])


def test_pick_and_negatives(spark):
    picked = catalog.QUERIES["stratified_pick"](spark, SF).collect()
    assert len({r.c_custkey for r in picked}) == len(picked) > 0
    rows = catalog.QUERIES["training_negatives"](spark, SF)
    assert {tuple(r) for r in rows.collect()} == {tuple(r) for r in rows.collect()}
    assert rows.where("label = 0").groupBy("cust").count().where("count > 5").isEmpty()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "score", "hits", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
