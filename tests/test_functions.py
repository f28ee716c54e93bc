import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers, similarity, text


def values(spark, expression, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression(F.col("x"))).collect()]


def test_normalisers(spark):
    rows = ["  Ação  nº 1° ", "Peça, 10mm\t(aço)", "", None, "état straße"]
    assert values(spark, text.normalize, rows) == ["ACAO Nº 1°", "PECA, 10MM (ACO)", "", None, "ETAT STRASSE"]
    assert values(spark, text.normalize_description, rows[:2]) == ["ACAO N 1", "PECA 10MM ACO"]
    assert values(spark, text.compact, rows[:2]) == ["ACAON1", "PECA10MMACO"]
    assert values(spark, lambda c: text.clean_text(c, "-"), [" a  b ", "  ", None]) == ["a b", "-", "-"]


def test_public_text_hides_how_it_was_read(spark):
    rows = ["lido por Acme-2.0 e IA", "Inteligência Artificial", "DIA"]
    assert values(spark, lambda c: text.public_text(c, "Acme"), rows) == ["lido por serviço de leitura e leitura automática", "leitura automática", "DIA"]


def test_file_names(spark):
    assert values(spark, text.ascii_filename, ["nota (páginas 20–21).pdf", ""]) == ["nota (paginas 20-21).pdf", "documento.pdf"]


def test_companies(spark):
    rows = ["  ACME COMERCIO LTDA  CNPJ 12", "ACME S/A E-mail: x@y", "MATERIAL ME"]
    assert values(spark, text.clean_company, rows) == ["ACME COMERCIO LTDA", "ACME S/A", "MATERIAL ME"]
    assert values(spark, text.looks_like_company, ["ACME LTDA", "ACME LTDA.", "ME", "NOME", "LOJA ME", None]) == [True, True, False, False, True, False]
    rows = ["Rua das Flores 10", "ENDERECO: AV 1", "12.345.678 MARIA DA SILVA ME", "SOLO", "Consultoria Beta"]
    assert values(spark, text.company_candidate, rows) == ["", "", "MARIA DA SILVA ME", "", "Consultoria Beta"]


def test_tokens_identity_digits_variants(spark):
    assert values(spark, text.tokens, ["Parafuso de aço UN 10 x"]) == [["PARAFUSO", "ACO", "10"]]
    assert values(spark, text.identity, ["Ação nº 1", None]) == ["AON1", ""]
    assert values(spark, lambda c: text.digits(c, 8), ["8481.80.99", None]) == ["84818099", ""]
    assert values(spark, text.code_variants, ["ab-1", "AB1", ""]) == [["AB-1", "AB1"], ["AB1"], []]


def test_service_lines(spark):
    rows = ["Manutenção de bombas R$ 10,00", "VALOR TOTAL", "12/34", "Locação de andaimes 1234567 / 10", None]
    assert values(spark, text.service_line, rows) == ["Manutenção de bombas", "", "", "Locação de andaimes", ""]
    assert values(spark, text.is_generic_service, ["Serviços", "Pintura"]) == [True, False]


def test_numbers(spark):
    rows = ["1.234,56", "1,234.56", "12,5", "1.234", "x", "", None, " 7 "]
    assert values(spark, numbers.parse_number, rows) == [1234.56, 1234.56, 12.5, 1.234, None, None, None, 7.0]
    assert values(spark, lambda c: numbers.format_number(c, 2), [1234.5, 10.0, None, 0.25], "double") == ["1.234,5", "10", "-", "0,25"]
    rows = ["R$ 2.730,62", "10,00 e 20,00", "1234.5", "", "abc", None]
    assert values(spark, numbers.money, rows) == ["2.730,62", "10,00", "1.234,50", "-", "-", "-"]
    assert values(spark, numbers.numeric_candidates, ["a 1.234,56 b 7 c x9"]) == [["1.234,56", "7", "9"]]


def test_confidences(spark):
    assert values(spark, numbers.confidence_band, [81.0, 70.0, 50.0, 49.9], "double") == ["Alta", "Revisar", "Baixa", "Muito baixa"]
    assert values(spark, numbers.sheet_band, [81.0, 80.0, 60.0, 49.0], "double") == [None, "yellow", "orange", "red"]
    assert values(spark, lambda c: numbers.match_confidence(c, F.lit(0.0)), [100.0, 50.0], "double") == [99.3, 58.3]
    assert values(spark, numbers.page_range, [[3], [3, 4, 5], []], "array<int>") == ["3", "3–5", ""]


def test_similarity_definitions():
    assert similarity.lcs_length("kitten", "sitting") == 4
    assert similarity.indel_ratio("kitten", "sitting") == pytest.approx(61.5385, abs=1e-4)
    assert similarity.indel_ratio("PECA INDUSTRIAL", "PECA INDUSTRAL") == pytest.approx(96.5517, abs=1e-4)
    assert similarity.indel_ratio("", "") == 100.0
    assert similarity.token_set("A B", "A B C") == 100.0
    assert similarity.partial("abc", "xxabcxx") == 100.0
    assert similarity.weighted("abc", "") == 0.0


def test_scores(spark):
    frame = spark.createDataFrame([("Parafuso aço 10mm", "PARAFUSO ACO 10MM"), ("Parafuso aço 10mm", "PORCA LATAO 5MM"), ("", "X"), ("valvula esfera 1", "valvula esfera 1 pol inox")], "a string, b string")
    same, other, blank, inside = [r[0] for r in frame.select(similarity.description_score("a", "b")).collect()]
    assert (same, blank) == (100.0, 0.0)
    assert other < 40 < inside
    equal, far, none, _ = [r[0] for r in frame.select(similarity.budget_score("a", "b")).collect()]
    assert (equal, none) == (100.0, 0.0)
    assert far < 30


def test_budget_numbers_are_matched_once(spark):
    frame = spark.createDataFrame([("TUBO 10 10", "TUBO 10"), ("TUBO 10 20", "TUBO 20 10 5")], "a string, b string")
    half, whole = [r[0] for r in frame.select(similarity.budget_score("a", "b")).collect()]
    assert whole - half > 10
