import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators import route, scanned, segment
from ledgerloom.streaming import progress, runs


def test_a_file_of_most_pages_in_ranges_is_grouped_as_without(spark):
    rng = random.Random(1)
    texts = ["CODIGO NCM CFOP QUANTIDADE PECA AZUL", "LISTA DE EMBARQUE caixas", "alfa beta gama", "NOTA DE DEBITO"]
    rows = [("hot" if i % 3 else f"f{i % 7}", i * rng.randint(1, 3) + 40 * i, rng.choice(texts)) for i in range(120)] + [(None, 1, texts[0]), (None, 9000, texts[0]), ("hot", None, texts[1])]
    pages = segment.page_signatures(spark.createDataFrame(rows, "file_id string, page int, text string")).cache()
    number = lambda df: {(r.file_id, r.page): (r.starts, r.doc_index) for r in df.collect()}
    assert number(segment.group_pages(pages.where("page IS NOT NULL"), range_pages=500)) == number(segment.group_pages(pages.where("page IS NOT NULL")))
    assert segment.group_pages(pages.limit(0), range_pages=5).count() == 0


def test_profiles_of_rasters(spark):
    raster = bytes(range(40)) + bytes([255] * 20)
    found = spark.createDataFrame([(raster,), (None,), (b"",), (b"short",)], "r binary").select(segment.row_profile("r").alias("p")).collect()
    assert [r.p for r in found] == [[9, 29, 255], None, None, None]


def test_of_several_edits_the_last_counts(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, code string, note string")
    edits = spark.createDataFrame([(1, "x", None, 1), (1, "y", None, 3), (1, None, "n", 2), (9, "z", None, 1)], "id int, code string, note string, seq int")
    assert sorted(map(tuple, route.edit_rows(rows, edits, "id", ["code", "note"], "seq").collect())) == [(1, "y", "n"), (2, "c", "d")]
    assert route.edit_rows(rows, edits, "id", ["code"]).count() == 2
    scored = rows.withColumns({"catalog_description": F.lit("t"), "confidence": F.lit(1.0), "confidences": F.create_map(F.lit("code"), F.lit(5.0))})
    picked = spark.createDataFrame([(1, "p", "d", 80.0, 2), (1, "q", "e", 70.0, 1)], "id int, code string, description string, score double, seq int")
    assert [(r.id, r.code, r.confidence) for r in route.accept_candidates(scored, picked, "id", "seq").orderBy("id").collect()] == [(1, "p", 80.0), (2, "c", 1.0)]
    found = picked.withColumn("cost_centre", F.lit("k"))
    assert route.apply_catalog(scored, found, "id", 90.0, order="seq").count() == 2


START = datetime(2024, 1, 1)


def attempts(*rows):
    return [(page, START + timedelta(seconds=s), ok) for page, s, ok in rows]


def test_queue_rows_do_not_depend_on_batches(spark, tmp_path):
    rows = attempts(("a", 0, False), ("a", 10, False), ("a", 400, False), ("a", 500, True), ("b", 5, False), ("b", 7 * 3600, True), ("c", 20, True), ("d", 30 * 3600, False))
    kinds = "page_key string, ts timestamp, ok boolean"
    for i, part in enumerate((rows[:2] + rows[4:5], rows[2:4], rows[5:])):
        spark.createDataFrame(part, kinds).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    whole = tmp_path / "whole"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(whole))

    def run(path, files=None):
        stream = runs.read_files(spark, path, files)
        return sorted(((r.page_key, r.kind, (r.at - START).total_seconds(), r.failures) for r in runs.appended(progress.retry_queue(stream), "queue").collect()))

    found = run(str(whole))
    assert [x for x in found if x[0] == "a"] == sorted([("a", "deferred", 0.0, 1), ("a", "deferred", 10.0, 2), ("a", "due", 70.0, 2), ("a", "deferred", 400.0, 3), ("a", "completed", 500.0, 3)])
    assert ("b", "dropped", 6 * 3600.0 + 5, 1) in found and ("b", "completed", 7 * 3600.0, 0) in found and ("c", "completed", 20.0, 0) in found
    assert ("d", "deferred", 30 * 3600.0, 1) in found and ("d", "due", 30 * 3600.0 + 30, 1) not in found


def word(row, left, text, confidence=90.0, width=10):
    return ("p", row, text, left, width, confidence)


def test_scanned_rows_of_odd_pages(spark):
    def items(words, readings=None):
        frame = spark.createDataFrame(words, "page string, row_no int, text string, left int, width int, confidence double")
        rows = scanned.row_words(frame, ["page"]).withColumn("page_width", F.lit(1000))
        return [(r.code, r.description, r.unit, r.quantity, r.quantity_confidence) for r in scanned.scanned_items(rows, ["page"], readings).orderBy("row_no").collect()]

    row = [word(5, 40, "12345"), word(5, 100, "PECA"), word(5, 150, "AZUL"), word(5, 300, "PC")]
    assert items([*row, word(5, 400, "7", 40.0), word(5, 600, "9,50")]) == [("12345", "PECA AZUL", "PC", "7", 55.0)]
    # of two numbers in the cell the surer one, decimals first; the total is out of the cell
    heads = [word(1, 300, "UND"), word(1, 395, "QTD"), word(1, 495, "V"), word(1, 510, "UNIT"), word(1, 695, "VTOTAL")]
    assert items([*heads, *row, word(5, 390, "3", 60.0), word(5, 400, "4,5", 55.0), word(5, 600, "80,00")]) == [("12345", "PECA AZUL", "PC", "4,5", 60.0)]
    # no unit, no description, no code: no item
    assert items([word(5, 40, "12345"), word(5, 100, "PECA")]) == [] and items([word(5, 40, "12345"), word(5, 300, "PC")]) == [] and items([word(5, 40, "PECA"), word(5, 300, "PC")]) == []
    assert items([]) == []


def test_an_export_that_fails_leaves_the_former_one(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, code string")
    route.export_tables({"nfe": rows, "outros": rows.where("false")}, str(tmp_path))
    failing = rows.select("k", F.raise_error(F.lit("broken")).cast("string").alias("code"))
    try:
        route.export_tables({"nfe": rows.limit(1), "outros": failing}, str(tmp_path))
        raise AssertionError("the export should fail")
    except Exception as error:  # noqa: BLE001
        assert "broken" in str(error)
    found = route.exported(spark, str(tmp_path))
    assert sorted(found) == ["nfe", "outros"] and found["nfe"].count() == 2
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_staged")]
