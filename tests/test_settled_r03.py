"""What a reviewer found in the third round: each of these failed before."""

from pyspark.sql import functions as F

from ledgerloom.llm import similar
from ledgerloom.operators import assemble, extract
from ledgerloom.sources.scratch import spread


def test_reading_score_is_rounded_once(spark):
    words = spark.createDataFrame([("a", 1, 1, 1, i, i, "x" * 60, c) for i, c in enumerate((49.0, 49.993))], "f string, block int, par int, line int, left int, top int, text string, confidence double")
    assert assemble.reader_lines(words, ["f"]).first()["score"] == 49.5
    assert assemble.reader_lines(words, ["f"], decimals=0).first()["score"] == 49.0


def test_groups_of_a_row_are_matched_once(spark):
    lines = ["Dados dos produtos", "A1 peça - azul 8481.80.99 060 5102 un 1.5 9,00", "A2 x 84818099 060 5102 UN 0,000", "no row", "Dados adicionais"]
    row = spark.createDataFrame([(lines,)], "g array<string>").select(F.explode(extract.goods_items("g")).alias("i")).select("i.*").collect()
    assert [tuple(r) for r in row] == [("A1", "peça - azul", "84818099", "UN", "1.5"), ("A2", "x", "84818099", "UN", "")]
    assert spark.createDataFrame([("COD-1 a  b 84818099 UN 2,00 3,00 5,00 12,00 6,00",), ("COD-1 a",), (None,)], "t string").select(extract.budget_line("t")["total"].alias("t")).collect() == [(6.0,), (None,), (None,)]


def test_lines_are_not_computed_again_for_every_use(spark):
    """The lines of a service invoice stand in its expression once: each further use would compute them anew."""
    made = F.array(F.concat(F.lit("made "), F.col("id")), F.lit("DANFSE"))
    for field in (extract.service_invoice, extract.service_number, extract.service_provider, extract.service_description, extract.service_order, extract.service_total, extract.goods_invoice_issuer, extract.goods_items):
        plan = spark.range(1).select(field(made).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("concat(made ") == 1, field.__name__


def test_few_rows_are_spread_over_tasks(spark):
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_sets_of_one_small_key_give_fewer_links_than_sets(spark):
    lanes = [f"f{i}" for i in range(similar.LANES)]
    sets = spark.createDataFrame([(1, r, 50, *[7] * similar.LANES, 12) for r in range(12)], f"key long, rep long, n long, {', '.join(f'{c} long' for c in lanes)}, size long")
    assert sorted(map(tuple, similar._tile_rows(sets, 0.8).collect())) == [(r, 0) for r in range(1, 12)]
