from pyspark.sql import functions as F

from ledgerloom.operators import extract


def one(spark, expression, value, kind="array<string>"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


def test_identifiers(spark):
    key = "3524 0112 3456 7800 0195 5500 1000 0012 3410 0001 2345"
    assert one(spark, extract.tax_ids, "a 12.345.678/0001-95 b 12345678000195 c 1", "string") == ["12345678000195"]
    assert one(spark, extract.access_keys, f"chave {key} fim", "string") == [key.replace(" ", "")]


def test_number_candidates_keep_numbers_written_with_zeros_twice(spark):
    assert one(spark, extract.number_candidates, "Nº 0012 e NUMERO 0012 NF-e 7", "string") == ["12", "12", "7"]


def test_goods_items(spark):
    lines = ["cabecalho", "DADOS DOS PRODUTOS", "ABC-001/XP PECA INDUSTRIAL 8481.80.99 060 5102 UN 2,000 10,00 20,00", "B2 OUTRA PECA 84818099 060 5102 PC 0,000 1,00", "DADOS ADICIONAIS", "C3 FORA 84818099 060 5102 UN 1 1"]
    found = one(spark, extract.goods_items, lines)
    assert [(r.code, r.description, r.ncm, r.unit, r.quantity) for r in found] == [("ABC-001/XP", "PECA INDUSTRIAL", "84818099", "UN", "2,000"), ("B2", "OUTRA PECA", "84818099", "PC", "")]
    assert one(spark, extract.goods_items, ["sem tabela"]) == []


def test_goods_items_keep_quantities_as_written(spark):
    row = "COD{} PECA 84818099 060 5102 UN {} 10,00 20,00"
    found = one(spark, extract.goods_items, ["DADOS DO PRODUTO", row.format(1, "8.0000"), row.format(2, "0,0080")])
    assert [r.quantity for r in found] == ["8.0000", "0,0080"]


def test_goods_invoice_fields(spark):
    assert one(spark, extract.goods_invoice_number, ["x", "Nº 000.335.546"]) == "335546"
    assert one(spark, extract.goods_invoice_number, ["nada"]) == extract.NO_NUMBER
    assert one(spark, extract.goods_invoice_issuer, ["RECEBEMOS DE ACME LTDA OS PRODUTOS"]) == "ACME LTDA"


def test_transport_document(spark):
    found = one(spark, extract.transport_document, ["CT-e Nº 000123456", "EMITENTE", "Transportes Beta LTDA"])
    assert (found.number, found.company) == ("123456", "Transportes Beta LTDA")
    found = one(spark, extract.transport_document, ["CT-E 1.234", "EMITENTE", "Sem sufixo"])
    assert (found.number, found.company) == ("1", extract.NO_COMPANY)


def test_service_invoice_number_ladder(spark):
    assert one(spark, extract.service_number, ["Número da NFS-e", "57684 01/02/2025"]) == "57684"
    key = "1" * 23 + "0000000032924" + "2" * 14
    assert one(spark, extract.service_number, [key]) == "32924"
    assert one(spark, extract.service_number, ["00093 / A"]) == "93"
    assert one(spark, extract.service_number, ["Número da Nota Fiscal", "1363"]) == "1363"
    assert one(spark, extract.service_number, []) == extract.NO_NUMBER


def test_service_provider_is_never_the_customer(spark):
    lines = ["PRESTADOR DE SERVIÇOS", "Nome/Razão Social: ALFA ENGENHARIA LTDA", "TOMADOR DE SERVIÇOS", "BETA INDUSTRIA LTDA"]
    assert one(spark, extract.service_provider, lines) == "ALFA ENGENHARIA LTDA"
    split = ["PRESTADOR DE SERVIÇOS", "GAMA SERVICOS E INSTALACOES", "INDUSTRIAIS LTDA", "TOMADOR DO SERVIÇO", "BETA LTDA"]
    assert one(spark, extract.service_provider, split) == "GAMA SERVICOS E INSTALACOES INDUSTRIAIS LTDA"


def test_service_description_follows_its_label(spark):
    lines = ["SERVIÇO PRESTADO", "Código de tributação", "Descrição do Serviço", "manutenção preventiva industrial", "manutenção preventiva  industrial", "TRIBUTAÇÃO MUNICIPAL", "outra linha qualquer"]
    assert one(spark, extract.service_description, lines) == "manutenção preventiva industrial"
    assert one(spark, extract.service_description, ["nada"]) == ""


def test_service_totals_and_hours(spark):
    assert one(spark, extract.service_total, ["Valor Liquido: R$ 2.730,62"]) == "2.730,62"
    assert one(spark, extract.service_total, ["VALOR TOTAL DA NFS-E", "R$ 3.902,00"]) == "3.902,00"
    assert one(spark, extract.service_total, ["nada"]) == "-"
    assert one(spark, extract.service_hours, ["total de 12,5 horas"]) == 12.5
    assert one(spark, extract.service_hours, ["nada"]) == 1.0


def test_service_order(spark):
    lines = ["ACME MONTAGENS Emissão: 01/01/2025", "PRESTAÇÃO DE SERVIÇOS Nº 4321", "SERVIÇOS ALOCADOS", "01/01/2025 10 Solda 2,5 1,00 2,00 3,00 4,00", "02/01/2025 11 Pintura 1 1,00 2,00 3,00 4,00", "TOTAL DOS SERVIÇOS: 2 99,00", "VALOR TOTAL DA OS: R$ 1.099,00"]
    found = one(spark, extract.service_invoice, lines)
    assert (found.number, found.company, found.description, found.quantity, found.total) == ("4321", "ACME MONTAGENS", "Solda; Pintura", 3.5, "1.099,00")


def test_budget_lines(spark):
    found = one(spark, extract.budget_line, "ABCD-10 TUBO INOX 73064000 M 1,00 6,00 12,50 5,00 0,00 75,00", "string")
    assert (found.code, found.quantity, found.unit_price, found.total, found.pieces) == ("ABCD-10", 6.0, 12.5, 75.0, 1.0)
    assert one(spark, extract.budget_line, "linha comum", "string") is None
    assert one(spark, extract.budget_line, None, "string") is None
    assert one(spark, extract.order_total, "Total do Pedido 1.234,50", "string") == 1234.5
    pages = spark.createDataFrame([("f", 1, "ABCD-10 TUBO 73064000 M 2,00 3,00 0,50 1,00 6,00\nx"), ("f", 2, "TOTAL DO PEDIDO 6,00")], "file_id string, page int, text string")
    rows = extract.budget_lines(pages, ["file_id"]).collect()
    assert [(r.code, r.line_no, r.order_total) for r in rows] == [("ABCD-10", 0, 6.0)]


def test_nearest_value_prefers_below_then_beside(spark):
    words = spark.createDataFrame([("p", "LIQUIDO", 100, 100), ("p", "9,00", 120, 130), ("p", "8,00", 100, 150), ("p", "7,00", 500, 110), ("q", "1,00", 0, 0)], "page string, text string, cx int, cy int")
    assert [tuple(r) for r in extract.nearest_value(words, ["page"]).collect()] == [("p", "9,00")]


def test_section_rows(spark):
    lines = spark.createDataFrame([("d", i, x) for i, x in enumerate(["a", "BEGIN", "b", "c", "END", "d", "BEGIN", "e"])], "doc string, line_no int, line string")
    found = extract.section_rows(lines, ["doc"], F.col("line") == "BEGIN", F.col("line") == "END")
    assert sorted(r.line for r in found.collect()) == ["b", "c", "e"]
