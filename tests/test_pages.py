from pyspark.sql import functions as F

from ledgerloom.operators import assemble, modeljson, rules, segment

TRANSPORT = "DACTE DOCUMENTO AUXILIAR DO CONHECIMENTO DE TRANSPORTE ELETRÔNICO CT-E Nº 123456 SÉRIE 1"


def test_classifiers(spark):
    rows = [(TRANSPORT, "CTE"), ("Servigos Eletrénica - NFS-o DADOS DA NFS CALCULO DO ISSQN", "NFSE"), ("DANFS0 v2.0 PRESTADOR/FORNECEDOR ISSQN", "NFSE"), ("DANFE NOTA FISCAL ELETRÔNICA CHAVE DE ACESSO", "NFE"), ("Nota de Débito DANFE", "OUTRO"), ("", "OUTRO"), (None, "OUTRO")]
    pages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "page int, text string")
    found = rules.classify_pages(pages).orderBy("page").collect()
    assert [r.kind for r in found] == [k for _, k in rows]
    assert [found[i].kind_confidence for i in (4, 5, 6)] == [98.0, 30.0, 30.0]
    assert spark.createDataFrame([(TRANSPORT,)], "text string").select(rules.simple_class("text")).first()[0] == "CTE"


def test_spellings_of_one_key_count_on_their_own(spark):
    u = spark.createDataFrame([("CHAVE DE ACESSO",)], "u string").withColumn("c", F.lit("CHAVEDEACESSO"))
    assert u.select(rules.RuleSet().score("NFE", F.col("u"), F.col("c"))).first()[0] == 6


def test_header_tokens_hit_inside_words(spark):
    assert spark.createDataFrame([("Conferencia",)], "t string").select(rules.header_tokens("t")).first()[0] == ["NFE"]


def signatures(spark, rows):
    schema = "file_id string, page int, kind string, kind_confidence double, tax_ids array<string>, keys array<string>, numbers array<string>, tokens array<string>, words array<string>, profile array<int>, compact_text string"
    return spark.createDataFrame([tuple(r.get(c) for c in ("file_id", "page", "kind", "conf", "tax_ids", "keys", "numbers", "tokens", "words", "profile", "compact_text")) for r in rows], schema)


def page(n, **fields):
    return {"file_id": "f", "page": n, "kind": "OUTRO", "conf": 50.0, "tax_ids": [], "keys": [], "numbers": [], "tokens": [], "words": [], "profile": None, "compact_text": ""} | fields


def groups(spark, *pages):
    rows = segment.group_pages(signatures(spark, pages)).orderBy("page").collect()
    return [r.doc_index for r in rows]


def test_packing_lists_with_own_headers_stay_apart(spark):
    same = {"tokens": ["LISTADEEMBARQUE"], "tax_ids": ["1"], "profile": [10] * 28}
    assert groups(spark, page(20, numbers=["225059460"], **same), page(21, numbers=["225059461"], **same)) == [1, 2]


def test_page_groups(spark):
    assert groups(spark, page(1, kind="NFE", keys=["k"]), page(2, kind="NFE", keys=["k"]), page(3, kind="NFSE", keys=["k"])) == [1, 1, 2]
    assert groups(spark, page(1, kind="NFE", numbers=["1"], tax_ids=["a"]), page(2, kind="NFE", numbers=["1"], tax_ids=["a"])) == [1, 1]
    assert groups(spark, page(1, kind="NFE", numbers=["1"], tax_ids=["a"]), page(2, kind="NFE", numbers=["1"], tax_ids=["b"], tokens=["DANFE"])) == [1, 2]
    assert groups(spark, page(1, words=["A", "B"]), page(2, words=["A", "B", "C"]), page(3, words=["X"])) == [1, 1, 2]
    assert groups(spark, page(1, kind="NFE", profile=[5, 5]), page(2, kind="NFE", profile=[6, 5], compact_text="X")) == [1, 1]


def test_segments_carry_label_and_mean_confidence(spark):
    grouped = segment.group_pages(signatures(spark, [page(1, keys=["k"]), page(2, keys=["k"], conf=99.0), page(3, keys=["z"])]))
    rows = segment.segment_documents(grouped).orderBy("doc_index").collect()
    assert [(r.pages, r.confidence, r.label) for r in rows] == [([1, 2], 74.5, "f (página 1–2)"), ([3], 50.0, "f (página 3)")]


def test_whole_signature(spark):
    pages = spark.createDataFrame([("f", 1, "DANFE Nº 123 12.345.678/0001-95"), ("f", 2, None)], "file_id string, page int, text string")
    row = segment.page_signatures(pages).orderBy("page").first()
    assert (row.kind, row.numbers, row.tax_ids) == ("NFE", ["123"], ["12345678000195"])
    assert segment.group_pages(segment.page_signatures(pages)).count() == 2


def merged(spark, *pages):
    schema = "file_id string, page int, document_type string, confidence double, is_continuation boolean, number string, provider_name string, service_code string, service_description string, notes string"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = [tuple(({"file_id": "f", "document_type": "NFSE", "confidence": 90.0, "is_continuation": False} | p).get(n) for n in names) for p in pages]
    return assemble.merge_pages(spark.createDataFrame(rows, schema)).orderBy("pages").collect()


def test_merge_folds_confidence_pairwise(spark):
    (doc,) = merged(spark, {"page": 1, "confidence": 90.0}, {"page": 2, "confidence": 80.0, "is_continuation": True}, {"page": 3, "confidence": 70.0, "is_continuation": True})
    assert (doc.pages, doc.confidence) == ([1, 2, 3], 77.5)


def test_merge_keeps_codes_and_joins_descriptions(spark):
    (doc,) = merged(spark, {"page": 1, "service_code": "700186", "service_description": "A", "notes": "n"}, {"page": 2, "is_continuation": True, "service_code": "1", "service_description": "B", "notes": "n"})
    assert (doc.service_code, doc.service_description, doc.notes) == ("700186", "A; B", "n")


def test_merge_by_number_is_blocked_by_an_unread_provider(spark):
    assert len(merged(spark, {"page": 1, "number": "7", "provider_name": "ACME"}, {"page": 2, "number": "7", "provider_name": "Empresa não identificada"})) == 2
    assert len(merged(spark, {"page": 1, "number": "7", "provider_name": "ACME"}, {"page": 2, "number": "7", "provider_name": ""})) == 1
    assert len(merged(spark, {"page": 1, "number": "SemNumero"}, {"page": 2, "number": "SemNumero"})) == 2
    assert len(merged(spark, {"page": 1, "document_type": "OUTRO"}, {"page": 2, "document_type": "OUTRO", "is_continuation": True})) == 2


def test_word_rows_and_reader_lines(spark):
    words = spark.createDataFrame([("f", 1, "b", 60, 12, 40, 20), ("f", 1, "a", 0, 10, 40, 20), ("f", 1, "c", 0, 50, 40, 20)], "file_id string, page int, text string, left int, top int, width int, height int")
    assert [(r.row_no, r.text, r.top, r.bottom) for r in assemble.word_rows(words).orderBy("row_no").collect()] == [(0, "a b", 10, 32), (1, "c", 50, 70)]
    read = spark.createDataFrame([("f", 1, 1, 1, 2, 0, 30, "segunda", 80.0), ("f", 1, 1, 1, 1, 50, 10, "linha", 90.0), ("f", 1, 1, 1, 1, 0, 10, "primeira", 100.0), ("f", 1, 1, 1, 1, 9, 9, "x", -1.0)], "file_id string, page int, block int, par int, line int, left int, top int, text string, confidence double")
    row = assemble.reader_lines(read).first()
    assert (row.lines, row.score) == (["primeira linha", "segunda"], round(90 * (0.65 + 0.35 * 20 / 120), 2))


def test_best_reading_column_quantity_distinct_items(spark):
    readings = spark.createDataFrame([("f", 1, "a", 80.0, "xx"), ("f", 1, "b", 80.0, "xxx"), ("f", 1, "c", 70.0, "xxxxx")], "file_id string, page int, variant string, confidence double, text string")
    assert assemble.best_reading(readings).first().variant == "b"
    words = spark.createDataFrame([("f", 1, 0, "3,00", 105.0, 80.0), ("f", 1, 0, "9", 100.0, 85.0), ("f", 1, 0, "77,00", 300.0, 99.0)], "file_id string, page int, row_no int, text string, cx double, confidence double")
    centres = spark.createDataFrame([("f", 1, 60.0, 100.0, 160.0)], "file_id string, page int, unit_x double, quantity_x double, next_x double")
    assert assemble.column_quantity(words, centres).first().quantity == "3,00"
    items = spark.createDataFrame([("f", 1, "1", "Peça A"), ("f", 2, "1", "peca a"), ("f", 3, "2", "x")], "f string, n int, code string, description string")
    assert sorted(r.n for r in assemble.distinct_items(items, ["f"], "n").collect()) == [1, 3]


STEPS = '{"steps": [{"type": "thought"}, {"type": "model_output", "content": [{"type": "text", "text": "{\\"documents\\": []}"}]}]}'
FENCED = '{"candidates": [{"content": {"parts": [{"text": "```json\\n{\\"documents\\": []}\\n```"}]}}]}'


def test_responses(spark):
    rows = spark.createDataFrame([(1, STEPS), (2, FENCED), (3, '{"promptFeedback": {"blockReason": "SAFETY"}}'), (4, '{"candidates": [{"content": {"parts": [{"text": "[1]"}]}}]}'), (5, "no json"), (6, None)], "id int, r string")
    found = {r.id: (r.json, r.error) for r in modeljson.parse_responses(rows, "id", "r").collect()}
    assert found[1][0] == found[2][0] == '{"documents": []}'
    assert found[3] == (None, "no valid analysis. Reason: SAFETY")
    assert found[4][1] == "unexpected form of answer"
    assert found[5][1] == found[6][1] == "no valid analysis."


def test_every_page_is_in_one_document(spark):
    answer = '{"documents": [{"pages": [1, "2"], "document_type": "nf-e", "confidence": "90", "is_continuation": false, "number": " 7 ", "total_value": "R$ 2.730,62", "items": [{"description": " a "}, {"description": ""}], "notes": "IA"}, {"pages": [2, 3, 9], "document_type": "x", "confidence": 150}, {"pages": [3]}]}'
    parsed = spark.createDataFrame([("f", answer)], "file_id string, json string")
    totals = spark.createDataFrame([("f", 4)], "file_id string, total_pages int")
    docs = modeljson.normalize_documents(modeljson.explode_documents(parsed, ["file_id"]), totals, ["file_id"]).orderBy("doc_index").collect()
    assert [(d.pages, d.document_type, d.confidence) for d in docs] == [([1, 2], "NFE", 90.0), ([3], "OUTRO", 100.0), ([4], "OUTRO", 0.0)]
    assert (docs[0].number, docs[0].total_value, len(docs[0]["items"]), docs[0].notes) == ("7", "2.730,62", 1, "leitura automática")


def test_second_stage(spark):
    docs = spark.createDataFrame([(1, "NFSE", "", "r"), (2, "NFSE", "700186", "r"), (3, "NFE", "", "r")], "id int, document_type string, service_code string, service_code_reason string")
    codes = spark.createDataFrame([("700186",)], "service_code string")
    assert [r.id for r in modeljson.needs_second_stage(docs, codes).collect()] == [1]
    answers = spark.createDataFrame([(1, "999", "why")], "id int, new_code string, new_reason string")
    row = modeljson.apply_second_stage(docs, answers, codes, ["id"]).where("id = 1").first()
    assert (row.service_code, row.service_code_reason) == ("", "why")
