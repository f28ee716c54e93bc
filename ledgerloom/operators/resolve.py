"""Entity resolution of items against product and service catalogs.

Exact matches are an equi-join. For the rest `topmatch` finds the catalog rows that share a token, a number or a tax
class with an item and may be among its best; these pairs are scored, and a window keeps the best. Catalog rows carry
`idx`, their place in the catalog, which decides between equal scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import clamp, description_confidence, field_confidence, format_number, match_confidence, ocr_or_default
from ..functions.similarity import budget_score, description_score, numbers_in, token_set_ratio, token_sort_ratio, weighted_ratio
from ..functions.text import code_variants, digits, first_non_blank, normalize, normalize_description, public_text, tokens
from .extract import NO_COMPANY, NO_NUMBER, arithmetic_confidence, transport_document
from .topmatch import BUDGET, PRODUCT, best_pairs

ACCEPT_SCORE = 58.0
TRANSPORT_SERVICE = "780007"
#: Alternatives shown, and ranks kept to find them.
ALTERNATIVES, RANKS = 5, 8


def _texts(catalog: DataFrame) -> DataFrame:
    """(idx, text): both match texts of every catalog row that has them."""
    return catalog.select("idx", F.explode(F.array_distinct(F.array("match_text", "match_text_extra"))).alias("text")).where("text <> ''")


def _token_bonus(item: Column, row: Column, each: float, most: float) -> Column:
    return F.least(F.lit(most), F.size(F.array_intersect(F.array_distinct(item), F.array_distinct(row))) * each)


def _number_bonus(item: Column, row: Column, most: float, both: bool) -> Column:
    a, b = numbers_in(normalize(item)), numbers_in(normalize(F.coalesce(row, F.lit(""))))
    share = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a)) * most
    return F.when((F.size(a) > 0) & ((F.size(b) > 0) | F.lit(not both)), share).otherwise(0.0)


def exact_candidates(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """(item_id, idx): items(item_id, description) whose normalised description is a text of a catalog row."""
    asked = items.select("item_id", normalize_description(F.coalesce("description", F.lit(""))).alias("text")).where("text <> ''")
    return asked.join(_texts(catalog), "text").select("item_id", "idx").distinct()


def product_candidates(items: DataFrame, catalog: DataFrame, service: bool = False, k: int = RANKS) -> DataFrame:
    """(item_id, idx, score) for items(item_id, description, ncm): exact matches alone with 100, else scored pairs that hold the k best."""
    asked = items.select("item_id", "description", F.coalesce("ncm", F.lit("")).alias("ncm"))
    exact = exact_candidates(asked, catalog)
    rest = asked.join(exact.select("item_id").distinct(), "item_id", "left_anti")
    facts = catalog.select("idx", F.col("description").alias("d1"), F.coalesce("description_extra", F.lit("")).alias("d2"), F.col("ncm").alias("row_ncm"))
    both = best_pairs(rest, facts, PRODUCT, k).join(rest, "item_id").join(facts, "idx")
    score = F.greatest(description_score("description", "d1"), F.when(F.col("d2") != "", description_score("description", "d2")).otherwise(0.0))
    row_tokens = F.concat(tokens(F.coalesce("d1", F.lit(""))), tokens("d2"))
    score = score + _token_bonus(tokens(F.col("description")), row_tokens, 3.0, 10.0) + _number_bonus(F.col("description"), F.col("d1"), 8.0, True)
    if not service:
        score = F.when((F.col("ncm") != "") & (F.col("ncm") == F.col("row_ncm")), F.least(F.lit(100.0), score + 6.0)).otherwise(score)
    scored = both.select("item_id", "idx", F.round(F.least(F.lit(100.0), score), 1).alias("score"))
    return exact.select("item_id", "idx", F.lit(100.0).alias("score")).union(scored)


def budget_candidates(items: DataFrame, catalog: DataFrame, k: int = RANKS) -> DataFrame:
    """(item_id, idx, score) for budget items(item_id, description, ncm), the tax class counted for or against; the k best are among them."""
    asked = items.select("item_id", "description", digits("ncm").alias("ncm"))
    facts = catalog.select("idx", F.coalesce("description", F.lit("")).alias("d1"), F.coalesce("description_extra", F.lit("")).alias("d2"), digits("ncm").alias("row_ncm"))
    both = best_pairs(asked, facts, BUDGET, k).join(asked, "item_id").join(facts, "idx")
    score = F.greatest(budget_score("description", "d1"), F.when(F.col("d2") != "", budget_score("description", "d2")).otherwise(0.0))
    score = score + _token_bonus(tokens("description"), tokens("d1"), 2.5, 10.0) + _number_bonus(F.col("description"), F.col("d1"), 6.0, False)
    base = F.round(clamp(score), 1)
    shift = F.when((F.col("ncm") != "") & (F.col("row_ncm") != ""), F.when(F.col("ncm") == F.col("row_ncm"), 6.0).otherwise(-4.0)).otherwise(0.0)
    return both.select("item_id", "idx", F.round(clamp(base + shift), 1).alias("score"))


def ranked(candidates: DataFrame, catalog: DataFrame, k: int = RANKS) -> DataFrame:
    """(item_id, ranked): the k best as array of struct(pos, idx, code, description, score), best first."""
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "idx")
    top = candidates.withColumn("pos", F.row_number().over(order) - 1).where(F.col("pos") < k)
    named = top.join(catalog.select("idx", "code", F.col("description").alias("description")), "idx")
    return named.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "idx", "code", "description", "score"))).alias("ranked"))


def alternatives(ranks: Column | str, forced: Column) -> Column:
    """Up to five other codes within a margin of the best score; forced ones have a wider margin."""
    r = F.col(ranks) if isinstance(ranks, str) else ranks
    best = F.get(r, 0)["score"]
    wide, narrow = F.greatest(F.lit(12.0), F.least(F.lit(25.0), best * 0.30)), F.greatest(F.lit(8.0), F.least(F.lit(15.0), best * 0.12))
    some = F.filter(r, lambda x: (x["pos"] > 0) & ((x["score"] >= F.greatest(F.lit(30.0), best - wide)) | (x["pos"] <= 2)))
    few = F.filter(r, lambda x: (x["pos"] > 0) & (x["score"] >= 65.0) & ((x["score"] >= best - narrow) | (x["score"] >= 82.0)))
    codes = F.transform(F.when(forced, some).otherwise(few), lambda x: F.trim(x["code"]))
    return F.array_distinct(F.slice(F.filter(codes, lambda c: c != ""), 1, ALTERNATIVES))


def _candidates(ranks: Column, k: int) -> Column:
    return F.transform(F.slice(ranks, 1, k), lambda x: F.struct(x["code"].alias("code"), x["description"].alias("description"), x["score"].alias("score")))


def _field_confidences(kind_confidence: Column, extra: dict[str, Column]) -> Column:
    own = {
        "number": field_confidence("number_confidence", "number", "ocr_confidence", 35.0, NO_NUMBER),
        "company": field_confidence("company_confidence", "company", "ocr_confidence", 35.0, NO_COMPANY),
        "description": description_confidence("ocr_confidence", "description"),
        "quantity": field_confidence("quantity_confidence", "quantity", "ocr_confidence", 45.0),
        "code": kind_confidence, "catalog_description": kind_confidence, "cost_centre": F.lit(100.0), "notes": F.lit(100.0),
    } | extra
    return F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("double"))])


ITEM_DEFAULTS = {
    "item_id": "string", "number": "string", "company": "string", "description": "string", "quantity": "string", "ncm": "string", "issuer_code": "string", "total": "string", "file": "string", "document_id": "string", "service_code": "string", "service_code_reason": "string",
    "ocr_confidence": "double", "number_confidence": "double", "company_confidence": "double", "quantity_confidence": "double", "code_confidence": "double", "service_code_confidence": "double", "total_confidence": "double",
}


def with_item_columns(items: DataFrame) -> DataFrame:
    """items with every column of ITEM_DEFAULTS, null where it has none."""
    return items.select(*[(F.col(c) if c in items.columns else F.lit(None)).cast(t).alias(c) for c, t in ITEM_DEFAULTS.items()])


def correlate_products(items: DataFrame, catalog: DataFrame, cost_centre: str = "") -> DataFrame:
    """Review rows of goods items: the accepted catalog row, confidences, up to six candidates and notes."""
    rows = with_item_columns(items)
    found = rows.join(ranked(product_candidates(rows, catalog), catalog), "item_id", "left")
    best = F.get("ranked", 0)
    confidence = F.when(best.isNotNull(), match_confidence(best["score"], "ocr_confidence")).otherwise(0.0)
    found = found.withColumn("confidence", confidence).withColumn("accepted", F.coalesce(best["score"] >= ACCEPT_SCORE, F.lit(False)))
    low = F.col("confidence") < 70
    found = found.withColumn("other_codes", F.coalesce(F.array_join(alternatives("ranked", low | ~F.col("accepted")), ", "), F.lit("")))
    others = F.concat(F.lit("Outras peças viáveis: "), F.col("other_codes"))
    has = F.col("other_codes") != ""
    notes = (
        F.when(F.col("accepted") & has & low, F.concat(others, F.lit(" | Conferência recomendada devido à confiança da correlação.")))
        .when(F.col("accepted") & has, others)
        .when(F.col("accepted") & low, "Conferência recomendada: confiança da correlação abaixo de 70%.")
        .when(F.col("accepted"), "")
        .when(best.isNull(), "REVISAR: não foi possível correlacionar com o cadastro de produtos.")
        .when(has, F.concat(F.lit("REVISAR: nenhuma correspondência atingiu segurança suficiente. "), others))
        .otherwise("REVISAR: correspondência insuficiente para definir o código do produto com segurança.")
    )
    issuer = F.trim(F.coalesce("issuer_code", F.lit("")))
    return found.select(
        "item_id", "document_id", F.lit("NF-E").alias("kind"), "number", "company", issuer.alias("issuer_code"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), F.coalesce("quantity", F.lit("1")).alias("quantity"),
        F.when(F.col("accepted"), best["code"]).otherwise("").alias("code"), F.when(F.col("accepted"), best["description"]).otherwise("-").alias("catalog_description"), F.lit(cost_centre).alias("cost_centre"),
        F.round("confidence", 1).alias("confidence"), notes.alias("notes"), "file", F.coalesce(_candidates(F.col("ranked"), 6), F.array().cast("array<struct<code:string,description:string,score:double>>")).alias("candidates"),
        _field_confidences(F.col("confidence"), {"issuer_code": field_confidence("code_confidence", issuer, "ocr_confidence", 35.0)}).alias("confidences"),
    )


def correlate_services(items: DataFrame, catalog: DataFrame, cost_centre: str = "", vendor: str | None = None) -> DataFrame:
    """Review rows of services: an equi-join on the digits of the code the reading gave.

    An empty code equals any catalog code without digits."""
    rows = with_item_columns(items).withColumn("_code", digits("service_code", 12))
    keyed = catalog.select(digits("code", 12).alias("_code"), F.struct("idx", "code", "description").alias("row")).groupBy("_code").agg(F.min("row").alias("row"))
    found = rows.join(keyed, "_code", "left")
    hit = F.col("row").isNotNull()
    given = F.coalesce(F.nullif("service_code_confidence", F.lit(0.0)), F.nullif("ocr_confidence", F.lit(0.0)), F.lit(85.0))
    confidence = F.round(F.when(hit, clamp(given)).otherwise(clamp(F.coalesce("ocr_confidence", F.lit(0.0)), 0.0, 69.0)), 1)
    reason = public_text("service_code_reason", vendor)
    notes = (
        F.when(hit & (reason != ""), F.concat(F.lit("Classificação automática: "), reason))
        .when(hit, "Classificação automática usando o catálogo de serviços.")
        .when(F.col("_code") != "", F.concat(F.lit("REVISAR: a leitura retornou o código inexistente "), F.col("_code"), F.lit(".")))
        .otherwise("REVISAR: a leitura não definiu um código do catálogo de serviços.")
    )
    one = F.array(F.struct(F.col("row.code").alias("code"), F.col("row.description").alias("description"), confidence.alias("score")))
    return found.select(
        "item_id", "document_id", F.lit("NFS-E").alias("kind"), F.coalesce("number", F.lit(NO_NUMBER)).alias("number"), F.coalesce("company", F.lit(NO_COMPANY)).alias("company"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), F.coalesce("quantity", F.lit("1")).alias("quantity"),
        F.when(hit, F.trim("row.code")).otherwise("").alias("code"), F.when(hit, F.col("row.description")).otherwise("-").alias("catalog_description"), F.lit(cost_centre).alias("cost_centre"), confidence.alias("confidence"), notes.alias("notes"), F.coalesce("total", F.lit("-")).alias("total"), "file",
        F.when(hit, one).otherwise(F.array().cast("array<struct<code:string,description:string,score:double>>")).alias("candidates"),
        _field_confidences(confidence, {"total": F.round(F.coalesce(F.nullif("total_confidence", F.lit(0.0)), ocr_or_default("ocr_confidence")), 1)}).alias("confidences"),
    )


def correlate_transport(documents: DataFrame, services: DataFrame, cost_centre: str = "", code: str = TRANSPORT_SERVICE) -> DataFrame:
    """Review rows of transport documents(document_id, lines, confidence, file): one fixed service.

    Fails where the catalog has no such service."""
    row = services.where(F.trim("code") == code).groupBy().agg(F.min(F.struct("idx", "code", "description")).alias("service"))
    checked = row.select(F.when(F.col("service").isNull(), F.raise_error(F.lit(f"the service catalog has no code {code}")).cast("string")).otherwise(F.col("service.description")).alias("catalog_description"))
    base = clamp(F.coalesce("confidence", F.lit(0.0)))
    found = documents.withColumn("_f", transport_document("lines")).crossJoin(F.broadcast(checked))  # one row
    number, company = F.col("_f.number"), F.col("_f.company")
    own = {
        "number": F.when(number != NO_NUMBER, 95.0).otherwise(35.0), "company": F.when(company != NO_COMPANY, 90.0).otherwise(35.0), "description": F.greatest(F.lit(85.0), base),
        "quantity": F.lit(100.0), "code": F.lit(100.0), "catalog_description": F.lit(100.0), "cost_centre": F.lit(100.0), "notes": F.lit(100.0),
    }
    return found.select(
        F.col("document_id").alias("item_id"), "document_id", F.lit("CT-E").alias("kind"), number.alias("number"), company.alias("company"), F.lit("Serviço de transporte (CT-e)").alias("description"), F.lit("1").alias("quantity"), F.lit(code).alias("code"), "catalog_description",
        F.lit(cost_centre).alias("cost_centre"), F.lit(100.0).alias("confidence"), F.lit("CT-e/DACTE identificado; código definido pela regra de negócio.").alias("notes"), "file", F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("double"))]).alias("confidences"),
    )


def correlate_budget(items: DataFrame, catalog: DataFrame, source_confidence: float = 95.0) -> DataFrame:
    """Review rows of budget items(item_id, code, description, ncm, quantity, unit_price, total, order_total).

    A match is reliable at 94 with a lead of 6, or at 98."""
    ranks = ranked(budget_candidates(items, catalog), catalog)
    found = items.join(ranks, "item_id", "left")
    best, second = F.get("ranked", 0), F.coalesce(F.get("ranked", 1)["score"], F.lit(0.0))
    score = F.coalesce(best["score"], F.lit(0.0))
    reliable = best.isNotNull() & (score >= 94.0) & ((score - second >= 6.0) | (score >= 98.0))
    described, numeric = F.lit(min(99.0, max(80.0, source_confidence))), arithmetic_confidence(F.col("quantity"), F.col("unit_price"), F.col("total"))
    matched = F.when(best.isNotNull(), score).otherwise(35.0)
    own = {
        "code_in_budget": described, "code": matched, "description": described, "catalog_description": matched, "quantity": numeric, "unit_price": numeric, "total": numeric, "order_total": F.when(F.col("order_total").isNotNull(), 98.0).otherwise(40.0),
    }
    return found.select(
        "item_id", F.col("code").alias("code_in_budget"), F.when(reliable, best["code"]).otherwise("").alias("code"), "description", F.when(reliable, best["description"]).otherwise("").alias("catalog_description"),
        format_number("quantity", 3).alias("quantity"), format_number("unit_price", 2).alias("unit_price"), format_number("total", 2).alias("total"), F.col("total").alias("total_number"), format_number("order_total", 2).alias("order_total"),
        F.round(score, 1).alias("score"), (~reliable).alias("review"), F.coalesce(_candidates(F.col("ranked"), 8), F.array().cast("array<struct<code:string,description:string,score:double>>")).alias("candidates"), F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v.cast("double"))]).alias("confidences"),
    )


def lookup_codes(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """asked(code) with the first catalog row that shares a spelling of the code, as `row`; null for none."""
    wanted = asked.withColumn("_id", F.monotonically_increasing_id())
    keys = wanted.select("_id", F.explode(code_variants("code")).alias("v"))
    rows = catalog.select(F.explode(code_variants("code")).alias("v"), F.struct("idx", "code", "description", "cost_centre", "ncm").alias("row"))
    first = keys.join(rows, "v").groupBy("_id").agg(F.min("row").alias("row"))
    return wanted.join(first, "_id", "left").drop("_id")


def search_catalog(catalog: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The catalog rows most like a query of two characters and more: code, description, cost_centre, ncm, score.

    Each of three ratios names its best texts; a row's score is the largest of them and its detailed score."""
    spark = catalog.sparkSession
    term = spark.range(1).select(normalize_description(F.lit(query)).alias("q")).first()["q"]
    if len(term) < 2:
        raise ValueError("a query needs two characters at least")
    hits = max(10, limit)
    texts = _texts(catalog).withColumns({"s1": weighted_ratio("text", F.lit(term)), "s2": token_set_ratio("text", F.lit(term)), "s3": token_sort_ratio("text", F.lit(term))})
    named = reduce(DataFrame.union, [texts.select("idx", F.col(s).alias("score")).orderBy(F.desc("score"), "idx").limit(hits) for s in ("s1", "s2", "s3")])
    best = named.groupBy("idx").agg(F.max("score").alias("named"))
    found = best.join(catalog, "idx")
    extra = F.coalesce("description_extra", F.lit(""))
    detail = F.greatest(description_score(F.lit(query), "description"), F.when(extra != "", description_score(F.lit(query), extra)).otherwise(0.0))
    scored = found.withColumn("score", F.greatest("named", detail)).orderBy(F.desc("score"), "idx").limit(max(1, min(100, limit)))
    return scored.select("code", "description", "cost_centre", "ncm", F.round("score", 1).alias("score"))


def override_services(items: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """items with fixed service codes for companies whose normalised name contains a given one: (name, code, reason)."""
    code, reason = F.col("service_code"), F.col("service_code_reason")
    for name, fixed, why in reversed(rules):
        hit = F.contains(normalize(F.coalesce("company", F.lit(""))), F.lit(name))
        code, reason = F.when(hit, F.lit(fixed)).otherwise(code), F.when(hit, F.lit(why)).otherwise(reason)
    return items.withColumn("service_code", code).withColumn("service_code_reason", reason)


def catalog_lines(catalog: DataFrame) -> DataFrame:
    """(line): the catalog as one text, a bullet per row with code and longer description, in catalog order."""
    described = first_non_blank("description_extra", "description")
    rows = catalog.where((F.trim("code") != "") & (described != ""))
    bullet = F.concat(F.lit("- "), F.trim("code"), F.lit(": "), described)
    return rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", bullet.alias("t")))), lambda x: x["t"]), "\n").alias("line"))


def catalog_codes(catalog: DataFrame) -> DataFrame:
    """(service_code, idx): distinct digit codes with the place of their first row."""
    return catalog.select(digits("code", 12).alias("service_code"), "idx").where("service_code <> ''").groupBy("service_code").agg(F.min("idx").alias("idx"))
