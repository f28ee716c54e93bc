import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_description
from ledgerloom.operators import resolve, topmatch

CATALOG = "idx int, code string, description string, description_extra string, ncm string"
NOUNS = "PARAFUSO PORCA ARRUELA VALVULA ROLAMENTO CORREIA FILTRO SENSOR CABO TUBO FLANGE JUNTA MOTOR BOMBA CHAVE RELE".split()


def rows(seed=2, n=500):
    rng = random.Random(seed)
    named = lambda: " ".join(["COMUM", rng.choice(NOUNS), rng.choice(NOUNS), *(str(rng.randint(1, 40)) for _ in range(rng.randint(0, 2)))])
    catalog = [(i, f"C{i}", named(), named() if i % 3 == 0 else "", rng.choice(["", "84818099", "73181500"])) for i in range(n)]
    catalog += [(n, "X", None, None, ""), (n + 1, "Y", "", "", None), (n + 2, "Z", catalog[3][2], "", "84818099")]
    misspelt = lambda t: t.replace("A", "4", 1) if rng.random() < 0.5 else t[:-1]
    items = [(f"i{i}", misspelt(rng.choice(catalog[:n])[2]), rng.choice(["", "84818099", None])) for i in range(24)]
    items += [("same", items[0][1], items[0][2]), ("none", None, None), ("blank", "", ""), ("tax", "??", "73181500"), ("odd", "COMUM", ""), ("one", "7", "")]
    return catalog, items


def every_pair(items, catalog, points, k):
    """All pairs that share a block."""
    asked = items.select("item_id", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("ncm", F.lit("")).alias("ncm"))
    a = asked.select("item_id", topmatch._blocks("ncm", "description").alias("x"))
    b = catalog.withColumn("t", F.coalesce("row_ncm", F.lit(""))).select("idx", topmatch._blocks("t", "d1", "d2").alias("y"))
    return a.crossJoin(b).where(F.arrays_overlap("x", "y")).select("item_id", "idx")


@pytest.mark.parametrize("kind", ["product", "budget"])
def test_the_best_rows_are_those_of_all_pairs(spark, monkeypatch, kind):
    catalog_rows, item_rows = rows()
    catalog = spark.createDataFrame(catalog_rows, CATALOG)
    for name, c in (("match_text", "description"), ("match_text_extra", "description_extra")):
        catalog = catalog.withColumn(name, normalize_description(F.coalesce(c, F.lit(""))))
    catalog, items = catalog.cache(), spark.createDataFrame(item_rows, "item_id string, description string, ncm string").cache()
    find = resolve.product_candidates if kind == "product" else resolve.budget_candidates

    def best():
        return {r.item_id: [(x.idx, x.score) for x in r.ranked] for r in resolve.ranked(find(items, catalog), catalog).collect()}

    counted = []

    def dealt(*args):
        pairs = topmatch.best_pairs(*args, block_rows=200, task_texts=9).cache()
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(resolve, "best_pairs", dealt)
    found = best()
    monkeypatch.setattr(resolve, "best_pairs", every_pair)
    expected = best()
    assert found == expected and len(found) >= 26
    # "COMUM" is in every row, so all pairs share a block
    assert counted[0] < (0.3 if kind == "product" else 0.5) * len(catalog_rows) * len(item_rows)


def test_no_rows_on_either_side(spark):
    catalog_rows, item_rows = rows(n=5)
    facts = spark.createDataFrame(catalog_rows, CATALOG).select("idx", F.col("description").alias("d1"), F.col("description_extra").alias("d2"), F.col("ncm").alias("row_ncm"))
    items = spark.createDataFrame(item_rows, "item_id string, description string, ncm string")
    assert topmatch.best_pairs(items.limit(0), facts, topmatch.PRODUCT, 8).count() == 0
    assert topmatch.best_pairs(items, facts.limit(0), topmatch.PRODUCT, 8).count() == 0
