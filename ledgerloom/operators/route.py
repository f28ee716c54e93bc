"""Review tables: routing documents, summaries, corrections and exports."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import clamp, page_range
from ..functions.text import clean_text, first_non_blank
from .extract import NO_COMPANY, NO_NUMBER, order_total, with_budget_line
from .resolve import correlate_products, correlate_services, correlate_transport, override_services

#: Columns that never leave the review, and those that an export leaves out besides.
INTERNAL = ("confidences", "candidates", "document_id", "item_id", "kind", "score", "review", "total_number", "ranked", "evidence", "session_id", "row_id", "pages")
NOT_EXPORTED = ("confidence", "file", "notes")
TABLES = ("nfe", "nfse", "cte", "outros", "orcamento")


def sanitize(rows: DataFrame, export: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """rows without internal columns (and those that start with an underscore)."""
    drop = {*INTERNAL, *(NOT_EXPORTED if export else ())} - set(keep)
    return rows.select(*[c for c in rows.columns if c not in drop and not c.startswith("_")])


def with_labels(documents: DataFrame, name_col: str = "file_id") -> DataFrame:
    """documents with an id and a label of file and pages."""
    label = F.concat(F.col(name_col).cast("string"), F.lit(" (página "), page_range("pages"), F.lit(")"))
    return documents.withColumn("document_id", F.sha2(F.concat_ws("|", F.col(name_col).cast("string"), F.array_join(F.col("pages").cast("array<string>"), ",")), 256)).withColumn("file", label)


def _known(c: str, missing: str) -> Column:
    return F.when(F.col(c) != missing, F.col("base")).otherwise(35.0)


def route_documents(documents: DataFrame, products: DataFrame, services: DataFrame, cost_centre: str = "", vendor_rules: list[tuple[str, str, str]] | None = None) -> dict[str, DataFrame]:
    """The review tables nfe, nfse, cte and outros of normalised documents.

    Goods invoices without items and documents of other types go to outros; documents without pages nowhere."""
    docs = with_labels(documents.where(F.size("pages") > 0)).withColumn("base", clamp(F.coalesce("confidence", F.lit(0.0))))
    docs = docs.withColumn("number", clean_text("number", NO_NUMBER)).withColumn("company", clean_text("provider_name", NO_COMPANY))
    shared = ["document_id", "file", "number", "company", F.col("base").alias("ocr_confidence"), _known("number", NO_NUMBER).alias("number_confidence"), _known("company", NO_COMPANY).alias("company_confidence")]

    service = docs.where("document_type = 'NFSE'").select(
        F.col("document_id").alias("item_id"), *shared, clean_text("service_description", "Prestação de serviço").alias("description"), F.lit("1").alias("quantity"), F.lit(100.0).alias("quantity_confidence"), clean_text("total_value", "-").alias("total"),
        F.when(clean_text("total_value", "-") != "-", F.col("base")).otherwise(35.0).alias("total_confidence"), "service_code", "service_code_reason", F.col("base").alias("service_code_confidence"),
    )
    goods = docs.where("document_type = 'NFE' AND size(items) > 0").select(*shared, F.posexplode("items").alias("_n", "i")).select(
        F.concat_ws("-", "document_id", "_n").alias("item_id"), "document_id", "file", "number", "company", "ocr_confidence", "number_confidence", "company_confidence", F.col("i.product_code").alias("issuer_code"),
        F.col("i.description").alias("description"), F.col("i.quantity").alias("quantity"), F.col("ocr_confidence").alias("quantity_confidence"), F.col("i.ncm").alias("ncm"),
    )
    transport = docs.where("document_type = 'CTE'").select("document_id", "file", F.col("base").alias("confidence"), F.array(F.concat(F.lit("CT-e Nº "), F.col("number")), F.lit("EMITENTE"), F.col("company")).alias("lines"))
    rest = docs.where("document_type NOT IN ('NFSE', 'NFE', 'CTE') OR (document_type = 'NFE' AND size(items) = 0)")
    kind = F.when(F.col("document_type") == "NFE", "NF-e").when(F.col("document_type") == "BOLETO", "Boleto").otherwise("Desconhecido")
    reason = F.when(F.col("document_type") == "NFE", "nota de produtos sem itens legíveis").when(F.col("document_type") == "BOLETO", "boleto: não processado").otherwise("documento não identificado como NF-e ou NFS-e")
    others = rest.select("file", kind.alias("detected_type"), reason.alias("reason"), F.round("base").cast("int").alias("confidence"), F.coalesce("notes", F.lit("")).alias("notes"))
    return {
        "nfe": correlate_products(goods, products, cost_centre),
        "nfse": correlate_services(override_services(service, vendor_rules or []), services, cost_centre),
        "cte": correlate_transport(transport, services, cost_centre),
        "outros": others,
    }


def failed_segment(files: DataFrame) -> DataFrame:
    """One document of type OUTRO with confidence 25 for each file(file_id, page_count) that couldn't be split."""
    return files.select("file_id", F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("page_count"))).alias("pages"), F.lit("OUTRO").alias("document_type"), F.lit(25.0).alias("confidence"))


def deep_budget(native: DataFrame, read: DataFrame, by: Sequence[str]) -> DataFrame:
    """Budget rows of files: native(by, page, text) is a file's own text, read(by, page, text) that of its page images.

    A file's own rows stand if it has some and states the order's total. Else the images' rows replace them where
    there are any, and give the total if the text doesn't. `source_confidence` is 96, else 92."""
    keys = list(by)
    both = native.select(*keys, "page", "text", F.lit(False).alias("_images")).union(read.select(*keys, "page", "text", F.lit(True).alias("_images")))
    totals = both.select(*keys, "page", "_images", order_total("text").alias("_total"), F.explode(F.array(F.split("text", "\n"))).alias("_lines"))
    lines = totals.select(*keys, "page", "_images", "_total", F.posexplode("_lines").alias("line_no", "_line"))
    # a page's first line stays for its total
    parsed = with_budget_line(lines, "_line", "_b").where(F.col("_b").isNotNull() | (F.col("line_no") == 0))
    file = W.partitionBy(*keys)

    def of(images: bool) -> tuple[Column, Column]:
        """Whether a file has rows there, and the total on the first page that states one."""
        mine = F.col("_images") == images
        return F.max(mine & F.col("_b").isNotNull()).over(file), F.min_by("_total", F.when(mine & F.col("_total").isNotNull(), F.col("page"))).over(file)

    (has_own, own), (has_read, other) = of(False), of(True)
    known = parsed.withColumns({"_has_own": has_own, "_own": own, "_has_read": has_read, "_read": other})
    stands = F.col("_has_own") & F.col("_own").isNotNull()
    chosen = known.where((F.col("_images") == (~stands & F.col("_has_read"))) & F.col("_b").isNotNull())
    return chosen.select(*keys, "page", "line_no", "_b.*", F.coalesce("_own", F.when(~stands, F.col("_read"))).alias("order_total"), F.when(stands, 96.0).otherwise(92.0).alias("source_confidence"))


def merge_lines(native: DataFrame, read: DataFrame, by: Sequence[str], norm: Column, line_no: str = "line_no") -> DataFrame:
    """native lines, then read ones that aren't among them by normal form; `part` is 0 or 1."""
    known = native.withColumn("_n", norm).select(*by, "_n").distinct()
    extra = read.withColumn("_n", norm).join(known, [*by, "_n"], "left_anti").drop("_n")
    return native.withColumn("part", F.lit(0)).unionByName(extra.withColumn("part", F.lit(1)))


def summary(rows: DataFrame, kind_col: str, kinds: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Number of rows of each kind, a column per kind, 0 where there are none."""
    return rows.groupBy(*by).agg(*[F.count(F.when(F.col(kind_col) == k, 1)).alias(k) for k in kinds])


def active_tab(counts: DataFrame, tables: Sequence[str] = TABLES) -> DataFrame:
    """counts with `active`: the first table that has rows, else the first."""
    return counts.withColumn("active", F.coalesce(*[F.when(F.col(t) > 0, F.lit(t)) for t in tables], F.lit(tables[0])))


def search_seed(*descriptions: str) -> Column:
    """What a search starts with: the first description that isn't blank."""
    return first_non_blank(*descriptions)


def last_wins(a: Column, b: Column) -> Column:
    """Entries of both maps, b's where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False))), F.coalesce(b, F.create_map().cast("map<string,double>")))


def latest(given: DataFrame, key: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: each column's last value that isn't null, by `order`; the largest value where there is no order."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c) for c in columns]
    return given.groupBy(key).agg(*[x.alias(c) for x, c in zip(last, columns, strict=True)])


def edit_rows(rows: DataFrame, edits: DataFrame, key: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """rows with the columns that edits(key, columns[, order]) gives; null leaves a value as it is.

    Of several edits of a row the last one of each column counts."""
    given = latest(edits, key, columns, order).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(given, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def _latest_row(given: DataFrame, key: str, columns: Sequence[str], order: str | None, name: str) -> DataFrame:
    """(key, name): the columns of each key's last row."""
    row = F.struct(*columns)
    return given.groupBy(key).agg((F.max_by(row, order) if order else F.max(row)).alias(name))


def accept_candidates(rows: DataFrame, accepted: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """rows with the code, description and score of accepted(key, code, description, score[, order]), the last of each key."""
    joined = rows.join(_latest_row(accepted, key, ("code", "description", "score"), order, "_c"), key, "left")
    score = F.create_map(F.lit("code"), F.col("_c.score").cast("double"), F.lit("catalog_description"), F.col("_c.score").cast("double"))
    hit = F.col("_c").isNotNull()
    new = {"code": F.coalesce("_c.code", "code"), "catalog_description": F.coalesce("_c.description", "catalog_description"), "confidence": F.coalesce("_c.score", "confidence"), "confidences": F.when(hit, last_wins(F.col("confidences"), score)).otherwise(F.col("confidences"))}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def apply_catalog(rows: DataFrame, found: DataFrame, key: str, least: float, budget: bool = False, order: str | None = None) -> DataFrame:
    """rows with the code and description of found(key, code, description, cost_centre[, order]), the last of each key.

    Their confidences become `least` at least: 90 for a search's result, 95 for a code that was typed. The
    catalog's cost centre is taken where it has one, but not for budgets."""
    joined = rows.join(_latest_row(found, key, ("code", "description", "cost_centre"), order, "_f"), key, "left")
    hit = F.col("_f").isNotNull()
    raised = F.map_from_arrays(F.array(F.lit("code"), F.lit("catalog_description")), F.array(*[F.greatest(F.lit(least), F.coalesce(F.try_element_at("confidences", F.lit(k)), F.lit(0.0))) for k in ("code", "catalog_description")]))
    new = {"code": F.coalesce("_f.code", "code"), "catalog_description": F.coalesce("_f.description", "catalog_description"), "confidences": F.when(hit, last_wins(F.col("confidences"), raised)).otherwise(F.col("confidences"))}
    if "cost_centre" in rows.columns and not budget:
        new["cost_centre"] = F.coalesce(F.nullif("_f.cost_centre", F.lit("")), "cost_centre")
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def replay_changes(rows: DataFrame, changes: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """rows after a log of changes(key, seq, kind, field, value, description, score): for every field the last change that
    touches it counts, whatever its kind.

    kind `edit` sets `field` to value; `accept` and `search` set code and catalog_description, with a score of their
    own: an accepted candidate's, or 90 at least. Scores of fields that were edited stay as they are. Equal numbers of a
    row's changes are settled by kind and value."""
    field = F.when(F.col("kind") == "edit", F.array(F.struct(F.col("field").alias("f"), F.col("value").alias("v"), F.lit(None).cast("double").alias("s"))))
    both = F.array(*[F.struct(F.lit(f).alias("f"), F.col(c).alias("v"), F.col("score").cast("double").alias("s")) for f, c in (("code", "value"), ("catalog_description", "description"))])
    touched = changes.select(key, "seq", "kind", F.explode(F.coalesce(field, both)).alias("t")).select(key, "seq", "kind", "t.*").where(F.col("f").isin(*fields) & F.col("v").isNotNull())
    order = F.struct("seq", "kind", "v")
    last = touched.groupBy(key).agg(
        *[F.max_by(F.struct("v"), F.when(F.col("f") == f, order)).alias(f"_v_{f}") for f in fields],
        *[F.max_by(F.struct("kind", "s"), F.when((F.col("f") == f) & (F.col("kind") != "edit"), order)).alias(f"_s_{f}") for f in fields],
    )
    joined = rows.join(last, key, "left")
    scores = F.col("confidences")
    for f in fields:
        now = F.when(F.col(f"_s_{f}.kind") == "accept", F.col(f"_s_{f}.s")).otherwise(F.greatest(F.lit(90.0), F.coalesce(F.try_element_at("confidences", F.lit(f)), F.lit(0.0))))
        scores = F.when(F.col(f"_s_{f}").isNotNull(), last_wins(scores, F.create_map(F.lit(f), now))).otherwise(scores)
    return joined.select(*[F.coalesce(f"_v_{c}.v", c).alias(c) if c in fields else scores.alias(c) if c == "confidences" else F.col(c) for c in rows.columns])


def or_placeholder(rows: DataFrame, notice: str = "Sem registros") -> DataFrame:
    """rows, or a single one with `notice` alone where there are none; other rows have a null notice."""
    spark = rows.sparkSession
    flag = spark.range(1).select(F.lit(notice).alias("notice"))
    some = rows.limit(1).select(F.lit(1).alias("_some"))
    empty = flag.join(some, F.lit(True), "left_anti")
    return rows.withColumn("notice", F.lit(None).cast("string")).unionByName(empty, allowMissingColumns=True)


def export_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write each table without its internal columns, a folder each; an empty one has its notice.

    All tables are written beside the export first. Only when the last one is there do they take the places of the former
    ones, and then a manifest names them with their rows; if a table fails, the export stays as it was."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = lambda name: jvm.Path(f"{path}/{name}")
    files = place("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged, counted = f"_staged-{uuid.uuid4().hex}", {}
    try:
        for name, rows in tables.items():
            or_placeholder(sanitize(rows, export=name != "outros")).write.parquet(f"{path}/{staged}/{name}")
            counted[name] = spark.read.parquet(f"{path}/{staged}/{name}").where("notice IS NULL").count()
        files.delete(place("manifest.json"), False)  # while tables change places there is no whole export
        for name in tables:
            files.delete(place(name), True)
            files.rename(place(f"{staged}/{name}"), place(name))
        out = files.create(place("manifest.json"), True)
        try:
            out.write(bytearray(json.dumps({"tables": counted}).encode()))
        finally:
            out.close()
    finally:
        files.delete(place(staged), True)


def exported(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that an export's manifest names; an export that was not finished has none."""
    rows = spark.read.text(f"{path}/manifest.json", wholetext=True).first()
    return {name: spark.read.parquet(f"{path}/{name}") for name in json.loads(rows["value"])["tables"]}


def column_widths(rows: DataFrame, first: int = 100) -> DataFrame:
    """Width of each column of a sheet: the longest of its name and first values plus 2, within 12 to 55."""
    head = rows.limit(first)
    wide = head.agg(*[F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(c) for c in rows.columns])
    return wide.select(*[F.least(F.lit(55), F.greatest(F.lit(12), F.greatest(F.col(c), F.lit(len(c))) + 2)).alias(c) for c in rows.columns])
