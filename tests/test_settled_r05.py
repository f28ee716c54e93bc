"""What a reviewer found in the fourth round: each of these failed before."""

from pyspark.sql import functions as F

from ledgerloom.operators import assemble, extract, segment


def test_a_mean_of_half_a_unit_is_rounded_up_in_any_order(spark):
    """Added as doubles in this order, these confidences come to 664.9999999999999, and their mean to less than 66.5."""
    sure = [70.7, 92.77, 42.37, 82.34, 66.69, 30.73, 58.58, 87.48, 83.93, 49.41]
    for values in (sure, sorted(sure)):
        words = spark.createDataFrame([("a", 1, 1, 1, i, i, 1, "word of many letters", c) for i, c in enumerate(values)], "file_id string, page int, block int, par int, left int, top int, line int, text string, confidence double").coalesce(1)
        assert [r.score for r in assemble.reader_lines(words, decimals=0).collect()] == [67.0]
    odd = words.withColumn("confidence", F.when(F.col("left") == 1, float("inf")).otherwise(1e300))
    assert [r.score for r in assemble.reader_lines(odd).collect()] == [float("inf")]


def test_a_service_invoice_makes_its_lines_compact_once(spark):
    lines = spark.createDataFrame([(["DANFSe", "PRESTADOR DO SERVIÇO", "Nome / Razão Social", "MARCENARIA", "SÃO JOSÉ LTDA", "OUTRA LTDA"],)], "lines array<string>")
    found = lines.select(extract.service_invoice("lines").alias("s"))
    assert found._jdf.queryExecution().analyzed().toString().count("[^A-Z0-9]+") < 20
    assert found.first().s.company == "MARCENARIA SÃO JOSÉ LTDA"


def test_what_follows_the_first_found_is_not_computed(spark):
    stop = lambda x: F.when(x == 3, F.raise_error(F.lit("computed")).cast("int")).when(x > 1, x)
    assert spark.range(1).select(extract.first_found(F.array(*map(F.lit, (1, 2, 3))), "int", stop).alias("x")).first().x == 2


def test_grey_rows_are_added_up_in_batches(spark):
    """No function is interpreted for every byte of a raster; the means are those of the bytes, odd rasters' are null."""
    rasters = [bytes(range(200)), None, b"", b"short", bytes([255] * 39)]
    found = spark.createDataFrame([(i, r) for i, r in enumerate(rasters)], "i int, r binary").coalesce(1).withColumn("p", segment.row_profile("r"))
    assert "lambdafunction" not in found._jdf.queryExecution().analyzed().toString()
    assert [r.p for r in found.orderBy("i").collect()] == [[20 * i + 9 for i in range(10)], None, None, None, [255]]
