import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import resolve, route
from ledgerloom.sources import files
from ledgerloom.streaming import progress


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [("700", "Parafuso aço 10mm", "Parafuso sextavado aço inox 10mm", "84818099", "CC1"), ("701", "Porca latão 5mm", "x", "73181600", "CC1"), ("702", "Válvula esfera 1 pol", None, None, None), (None, "sem código", None, None, None), ("780007", "Serviço transporte", None, None, "CC2"), (None, None, None, None, None)]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, `Código` string, `Descrição` string, `Descrição longa` string, `Pos.IPI/NCM` string, `Centro de Custo` string")
    return files.prepare_catalog(raw, order="n").cache()


def items(spark, *rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "item_id string, description string, ncm string, ocr_confidence double")


def test_catalog(catalog):
    rows = {r.code: r for r in catalog.collect()}
    assert sorted(rows) == ["700", "701", "702", "780007"]
    assert (rows["701"].description_extra, rows["700"].match_text, rows["700"].ncm) == ("", "PARAFUSO ACO 10MM", "84818099")
    assert files.resolve_columns(["Barras", "Cod", "D"], ["CODIGO DE BARRAS", "SUB CODIGO", "DESCRICAO CURTA"]) == ("Cod", "D", None, None)
    with pytest.raises(ValueError):
        files.resolve_columns(["a"], ["A"])


def test_products(spark, catalog):
    asked = items(spark, ("parafuso aço 10mm", "", 0.0), ("Parafuso aco 10m", "84818099", 90.0), ("coisa nenhuma", "", 90.0), ("Valvula esfera 1", "", 90.0))
    found = {r.item_id: r for r in resolve.correlate_products(asked, catalog, "CC9").collect()}
    assert (found["0"].code, found["0"].confidence, found["0"].notes, len(found["0"].candidates)) == ("700", 99.3, "", 1)
    assert found["1"].code == "700" and found["1"].confidence < 100
    assert (found["2"].code, found["2"].catalog_description) == ("", "-") and found["2"].notes.startswith("REVISAR: não foi possível")
    assert found["3"].code == "702" and found["3"].confidences["cost_centre"] == 100.0 and found["3"].cost_centre == "CC9"


def test_alternatives(spark):
    ranks = [(i, i, str(100 + i % 5), "d", s) for i, s in enumerate([60.0, 50.0, 49.0, 30.0, 20.0])]
    frame = spark.createDataFrame([(ranks,)], "ranked array<struct<pos:int,idx:int,code:string,description:string,score:double>>")
    forced, strict = frame.select(resolve.alternatives("ranked", F.lit(True)), resolve.alternatives("ranked", F.lit(False))).first()
    assert (forced, strict) == (["101", "102"], [])


def test_services(spark, catalog):
    rows = spark.createDataFrame([("a", "700-", 90.0, "motivo IA"), ("b", "999999", 80.0, None), ("c", "", 80.0, None)], "item_id string, service_code string, ocr_confidence double, service_code_reason string")
    found = {r.item_id: r for r in resolve.correlate_services(rows, catalog).collect()}
    assert (found["a"].code, found["a"].confidence, found["a"].notes) == ("700", 90.0, "Classificação automática: motivo leitura automática")
    assert (found["b"].code, found["b"].confidence) == ("", 69.0) and "inexistente 999999" in found["b"].notes
    assert found["c"].notes.endswith("não definiu um código do catálogo de serviços.")


def test_fixed_vendor_rule(spark):
    rows = spark.createDataFrame([("ACME Andaimes LTDA", "1", None), ("Outra", "2", "r")], "company string, service_code string, service_code_reason string")
    found = resolve.override_services(rows, [("ACME ANDAIMES", "715237", "Regra fixa")]).collect()
    assert [(r.service_code, r.service_code_reason) for r in found] == [("715237", "Regra fixa"), ("2", "r")]


def test_transport(spark, catalog):
    docs = spark.createDataFrame([("d", ["CT-e Nº 123456", "EMITENTE", "Transportes Beta LTDA"], 80.0, "f")], "document_id string, lines array<string>, confidence double, file string")
    row = resolve.correlate_transport(docs, catalog).first()
    assert (row.number, row.company, row.code, row.catalog_description) == ("123456", "Transportes Beta LTDA", "780007", "Serviço transporte")
    with pytest.raises(Exception, match="780007"):
        resolve.correlate_transport(docs, catalog.where("code <> '780007'")).collect()


def test_budget_needs_equal_texts(spark, catalog):
    rows = spark.createDataFrame([("x", "F1", "Parafuso aço 10mm", "84818099", 2.0, 3.0, 6.0, 10.0), ("y", "F2", "Parafuso aço 11mm", "", 2.0, 3.0, 9.0, None)], "item_id string, code string, description string, ncm string, quantity double, unit_price double, total double, order_total double")
    found = {r.item_id: r for r in resolve.correlate_budget(rows, catalog).collect()}
    assert (found["x"].code, found["x"].score, found["x"].review, found["x"].order_total) == ("700", 100.0, False, "10")
    assert (found["y"].code, found["y"].review, found["y"].confidences["total"]) == ("", True, 78.0)


def test_lookup_and_search(spark, catalog):
    asked = spark.createDataFrame([("7-0-0",), ("zz",)], "code string")
    assert [r.row.idx if r.row else None for r in resolve.lookup_codes(asked, catalog).orderBy("code").collect()] == [0, None]
    found = resolve.search_catalog(catalog, "parafuso inox", 2).collect()
    assert len(found) == 2 and found[0].code == "700"
    with pytest.raises(ValueError):
        resolve.search_catalog(catalog, "x")
    assert resolve.catalog_lines(catalog).first().line.startswith("- 700: Parafuso sextavado")
    assert {r.service_code for r in resolve.catalog_codes(catalog).collect()} == {"700", "701", "702", "780007"}


def test_routing(spark, catalog):
    item = "struct<product_code:string,description:string,quantity:string,ncm:string,unit_value:string,total_value:string>"
    schema = f"file_id string, pages array<int>, document_type string, confidence double, number string, provider_name string, total_value string, service_description string, service_code string, service_code_reason string, items array<{item}>, notes string"
    one = [("A-1", "Parafuso aço 10mm", "8.0000", "", "-", "-")]
    docs = spark.createDataFrame([("f", [1], "NFE", 90.0, "1", "ACME", "-", "", "", "", one, ""), ("f", [2], "NFE", 90.0, "2", "ACME", "-", "", "", "", [], "n"), ("f", [3, 4], "NFSE", 90.0, "3", "ACME", "1,00", "serviço", "701", "", [], ""), ("f", [5], "CTE", 90.0, "5", "ACME LTDA", "-", "", "", "", [], ""), ("f", [6], "BOLETO", 90.0, "", "", "-", "", "", "", [], ""), ("f", [], "NFE", 1.0, "", "", "", "", "", "", [], "")], schema)
    tables = route.route_documents(docs, catalog, catalog, "CC")
    goods, service, transport = tables["nfe"].first(), tables["nfse"].first(), tables["cte"].first()
    assert (goods.code, goods.issuer_code, goods.quantity) == ("700", "A-1", "8.0000")
    assert (service.code, service.file, service.total) == ("701", "f (página 3–4)", "1,00")
    assert (transport.number, transport.company) == ("5", "ACME LTDA")
    assert sorted(r.detected_type for r in tables["outros"].collect()) == ["Boleto", "NF-e"]
    assert set(route.sanitize(goods_frame := tables["nfe"], export=True).columns).isdisjoint({"confidences", "candidates", "confidence", "file", "notes"})
    assert "notes" in route.sanitize(goods_frame).columns


def test_review_edits(spark):
    rows = spark.createDataFrame([(1, "a", "d", 50.0, "CC", {"code": 40.0, "number": 9.0}), (2, "b", "d", 50.0, "CC", {"code": 97.0})], "row_id int, code string, catalog_description string, confidence double, cost_centre string, confidences map<string,double>")
    edits = spark.createDataFrame([(1, "new", None)], "row_id int, code string, cost_centre string")
    assert [(r.code, r.cost_centre) for r in route.edit_rows(rows, edits, "row_id", ["code", "cost_centre"]).orderBy("row_id").collect()] == [("new", "CC"), ("b", "CC")]
    picked = spark.createDataFrame([(1, "z", "zd", 88.0)], "row_id int, code string, description string, score double")
    first = route.accept_candidates(rows, picked, "row_id").orderBy("row_id").first()
    assert (first.code, first.confidence, first.confidences) == ("z", 88.0, {"number": 9.0, "code": 88.0, "catalog_description": 88.0})
    found = spark.createDataFrame([(1, "q", "qd", "CC7"), (2, "w", "wd", "")], "row_id int, code string, description string, cost_centre string")
    done = route.apply_catalog(rows, found, "row_id", 95.0).orderBy("row_id").collect()
    assert [(r.code, r.cost_centre, r.confidences["code"]) for r in done] == [("q", "CC7", 95.0), ("w", "CC", 97.0)]


def test_summaries_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("nfe",), ("cte",), ("nfe",)], "kind string")
    counts = route.active_tab(route.summary(rows, "kind", ["nfe", "nfse", "cte"]), ["nfse", "nfe", "cte"]).first()
    assert (counts.nfe, counts.nfse, counts.active) == (2, 0, "nfe")
    empty = rows.where("false")
    assert [r.notice for r in route.or_placeholder(empty).collect()] == ["Sem registros"]
    assert route.or_placeholder(rows).where("notice IS NOT NULL").count() == 0
    route.export_tables({"nfe": rows.withColumn("code", F.lit("1")), "outros": empty}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "nfe")).columns == ["code", "notice"]
    assert route.column_widths(spark.createDataFrame([("x" * 99, "y")], "a string, b string")).first().asDict() == {"a": 55, "b": 12}
    native, read = (spark.createDataFrame([("f", i, x) for i, x in enumerate(v)], "f string, line_no int, line string") for v in (["Ação"], ["acao", "novo"]))
    assert sorted((r.part, r.line) for r in route.merge_lines(native, read, ["f"], F.lower(F.translate("line", "çã", "ca"))).collect()) == [(0, "Ação"), (1, "novo")]


def test_uploads_and_pages(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("dir/a.pdf", b"one|two")
        z.writestr("b.txt", b"x")
    uploads = spark.createDataFrame([("1", "x.ZIP", buffer.getvalue()), ("2", "c.pdf", b"three"), ("3", "d.zip", b"broken"), ("4", "e.doc", b"")], "file_id string, name string, content binary")
    found = files.expand_uploads(uploads)
    assert sorted(r.name for r in found.where("error IS NULL").collect()) == ["a.pdf", "c.pdf"]
    assert sorted(r.file for r in files.rejected_rows(found).collect()) == ["b.txt", "d.zip", "e.doc"]
    small = files.expand_uploads(uploads, most_bytes=5)
    assert sorted((r.name, r.content is None) for r in small.where("name LIKE '%.pdf'").collect()) == [("a.pdf", True), ("c.pdf", False)]

    def split(content):
        if content == b"three":
            raise ValueError("no pages")
        return content.split(b"|")

    pages = files.split_pages(found, split).cache()
    assert sorted((r.page, bytes(r.content)) for r in pages.collect()) == [(1, b"one"), (1, b"three"), (2, b"two")]

    def read(content):
        if content == b"two":
            raise RuntimeError("unreadable")
        return content.decode().upper()

    texts = files.read_where_needed(pages.withColumn("text", F.lit("native")), F.col("page") == 2, read).collect()
    assert sorted((r.text or "", r.error or "") for r in texts) == [("", "unreadable"), ("native", ""), ("native", "")]
    docs = spark.createDataFrame([("d", "1", [2, 3])], "document_id string, file_id string, pages array<int>")
    assert files.subset_pages(pages, docs).count() == 1
    assert {r.file_id: r.page_count for r in files.page_counts(pages).collect()} == {"1": 2, "2": 1}


def test_schedules(spark):
    row = spark.range(1).select(progress.parse_delays(F.lit("5,x,-1")).alias("a"), progress.parse_delays(F.lit("")).alias("b"), progress.model_candidates("models/m1", "m2, m1,,m3").alias("c"), progress.retry_delay(F.lit(9)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ([5.0, 0.0], [30.0, 60.0, 120.0, 180.0], ["m1", "m2", "m3"], 180.0)
    pages = spark.createDataFrame([("f", p) for p in (1, 2, 3)], "file_id string, page int")
    failures = spark.createDataFrame([("f", 2, 1)], "file_id string, page int, n int")
    assert [r.page for r in progress.queue_order(pages, failures).orderBy("place").collect()] == [1, 2, 3, 2]
    done = spark.createDataFrame([("read", 1, 2), ("organise", 1, 1), ("process", 0, 0)], "phase string, d int, t int")
    assert [r[0] for r in done.select(progress.progress_percent(F.col("phase"), F.col("d"), F.col("t"))).collect()] == [45, 100, 30]


def test_jobs_hide_results_until_done(spark):
    jobs = spark.createDataFrame([("a", "done", "r", "me", 1), ("b", "running", "r", "me", 1), ("c", "done", "r", "you", 1)], "job string, status string, result string, owner string, created_at int")
    assert [(r.job, r.result) for r in progress.job_view(jobs, "me").orderBy("job").collect()] == [("a", "r"), ("b", None)]


def test_retry_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("p", 1, False), ("p", 2, False), ("q", 1, False), ("q", 2, True)], "page_key string, s int, ok boolean").select("page_key", F.timestamp_seconds("s").alias("ts"), "ok")
    rows.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    query = progress.retry_stream(stream).writeStream.format("memory").queryName("retries").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    found = {r.page_key: (r.failures, r.done, r.next_try) for r in spark.table("retries").collect()}
    assert found["q"] == (0, True, None) and found["p"][:2] == (2, False) and found["p"][2].second == 2


def test_progress_stream(spark, tmp_path):
    rows = spark.createDataFrame([("j", 10, 1), ("j", 40, 2)], "job string, progress int, s int").select("job", "progress", F.timestamp_seconds("s").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = progress.stream_progress(stream, "job", "ts").writeStream.format("memory").queryName("jobs").option("checkpointLocation", str(tmp_path / "state")).outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("jobs").first().progress == 40
