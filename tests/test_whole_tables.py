import os

import pytest
from helpers import SMALL

from ledgerloom.plans import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


def test_an_invoice_for_every_order(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey")
    found = queries.QUERIES["service_invoices_all"](spark, SMALL)
    assert sorted(r[0] for r in found.select("o_orderkey").collect()) == sorted(r[0] for r in orders.collect())


def test_numbers_of_every_line_item(spark):
    items = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    assert items.where("l_extendedprice < 1000").count() > 0
    keys = ["l_orderkey", "l_linenumber"]
    found = queries.QUERIES["numeric_tokens_all"](spark, SMALL)
    assert found.where("n = 3").select(*keys).exceptAll(items.select(*keys).distinct()).count() == 0
    assert found.count() == items.select(*keys).distinct().count()
