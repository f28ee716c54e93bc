"""Lines of whole documents are matched as rows by compiled code; these failed while higher-order functions did it."""

from helpers import SMALL
from pyspark.sql import functions as F

from ledgerloom.operators import extract
from ledgerloom.plans import fiscal, queries  # noqa: F401


def matched_in_lambda(frame, pattern):
    found = [x for x in frame._jdf.queryExecution().executedPlan().toString().split("\n") if pattern in x]
    assert found
    return any("lambda" in x for x in found)


def test_goods_rows_are_matched_as_rows(spark):
    found = queries.QUERIES["goods_rows"](spark, SMALL)
    assert not matched_in_lambda(found, r"\d{4}\.\d{2}\.\d{2}")
    # numbers are dealt, not texts; the section is cut once, not in a filter beneath as well
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Filter ((size(slice(" not in plan


def test_goods_item_rows_are_goods_items(spark):
    row = "C{} PECA - 8481.80.99 060 5102 UN {} 1,00 2,00"
    documents = [
        ["DANFE", row.format(0, 1), "Dados dos produtos", row.format(1, "2,000"), "outra", " " + row.format(2, "0,000"), "Dados adicionais", row.format(3, 1)],
        ["D.A D-O S  dó prodúto", row.format(1, "0,005"), row.format(2, "7x")],
        ["DADOS DO PRODUTO", "INFORMAÇÕES COMPLEMENTARES", row.format(1, 1)],
        ["DADOS DO PRODUTO"], ["DADOS DOS PRODUTO", row.format(1, 1)], [row.format(1, 1)], [], [None, "DADOS DO PRODUTO", None, row.format(5, 1)], None,
    ]
    frame = spark.createDataFrame(list(enumerate(documents)), "d int, lines array<string>")
    rows = sorted(tuple(r) for r in extract.goods_item_rows(frame, ["d"]).collect())
    assert [(r[0], r[1], r[2], r[6]) for r in rows] == [(0, 3, "C1", "2,000"), (0, 5, "C2", ""), (1, 1, "C1", "0,005"), (7, 3, "C5", "1")]
    arrays = frame.select("d", F.inline(extract.goods_items("lines"))).collect()
    assert sorted(tuple(r) for r in arrays) == sorted((r[0], *r[2:]) for r in rows)
