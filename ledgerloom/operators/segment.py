"""Pages to documents: gaps and islands over consecutive pages of a file.

Whether a page continues a document depends on the page before it alone, so boundaries come from lag() and
documents from a running sum; files are independent of each other.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import page_range
from ..sources.scratch import written
from ..functions.text import any_contained, compact, let, literal_array, page_words
from .extract import access_keys, number_candidates, tax_ids
from .rules import classify_pages, header_tokens

#: Header tokens that start a document.
STRONG_TOKENS = ("DANFE", "DANFSE", "NFE", "NFSE", "NOTAFISCALDESERVICOS", "CHAVEDEACESSO", "CODIGODEVERIFICACAO", "LISTADEEMBARQUE", "NOTADEDEBITO")
#: Compact words that a continuation page of either kind of invoice has.
CONTINUES = {
    "NFE": ("DADOSDOSPRODUTOS", "CODIGOPRODUTO", "NCM", "CFOP", "VALORUNITARIO", "QUANTIDADE"),
    "NFSE": ("DISCRIMINACAODOSERVICO", "SERVICOPRESTADO", "ISSQN", "VALORDAOPERACAO", "RETENCOES"),
}
#: Points of what two pages have in common, and the points that keep them together.
KEY_POINTS, NUMBER_POINTS, TAX_ID_POINTS, LAYOUT_POINTS, CONTENT_POINTS, NEW_HEADER_POINTS = 80, 36, 24, 16, 18, -55
INVOICE_THRESHOLD, OTHER_THRESHOLD = 54.0, 28.0


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def profile_similarity(a: Column, b: Column, scale: float = 255.0) -> Column:
    """1 less the mean absolute difference of two profiles; 0 if a profile is missing or lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, d: s + d)
    same = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(same, F.greatest(F.lit(0.0), 1 - total / F.size(a) / scale)), F.lit(0.0))


def row_means(rasters: pa.BinaryArray, width: int) -> pa.ListArray:
    """Means of the rows of rasters of `width` bytes a row, rounded down; null for nulls and rasters of less than a row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(rasters), 0), np.int64)
    starts, rows = np.cumsum(lengths) - lengths, lengths // width
    sums = np.concatenate([[0], np.cumsum(np.frombuffer(b"".join(rasters.drop_null().to_pylist()), np.uint8), dtype=np.int64)])
    ends = np.cumsum(rows)
    first = np.repeat(starts, rows) + width * (np.arange(rows.sum()) - np.repeat(ends - rows, rows))
    means = pa.array(((sums[first + width] - sums[first]) // width).astype(np.int32))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(rows == 0, False))
    return pa.ListArray.from_arrays(offsets, means)


def row_profile(raster: Column | str, width: int = 20) -> Column:
    """Mean grey of every row of a raster of bytes, rounded down: a page's look, of its picture scaled to `width` by any height.

    A batch of pages is added up at once: a higher-order function would be interpreted for every byte."""

    @F.arrow_udf("array<int>")
    def means(rasters: pa.Array) -> pa.Array:
        return row_means(rasters, width)

    return means(F.col(raster) if isinstance(raster, str) else raster)


def page_signatures(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """pages(file_id, page, text[, profile]) with kind, confidence, ids, numbers, header tokens and words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = classify_pages(pages, text_col).withColumns(
        {"tax_ids": tax_ids(text), "keys": access_keys(text), "numbers": number_candidates(text), "tokens": header_tokens(text), "words": page_words(text), "compact_text": compact(text)}
    )
    return out if "profile" in pages.columns else out.withColumn("profile", F.lit(None).cast("array<int>"))


def _strong(p: str) -> Column:
    return overlap(F.col(f"{p}tokens"), literal_array(STRONG_TOKENS)) | (F.size(f"{p}keys") > 0)


def _continues(kind: Column) -> Column:
    return F.when(kind == "NFE", F.col("_nfe")).when(kind == "NFSE", F.col("_nfse")).otherwise(F.col("_long"))


def _facts(signatures: DataFrame) -> DataFrame:
    """signatures with what is asked of a page's compact text, so that the text itself need not be dealt and sorted."""
    text = F.col("compact_text")
    return signatures.withColumns({"_nfe": any_contained(text, CONTINUES["NFE"]), "_nfse": any_contained(text, CONTINUES["NFSE"]), "_long": F.length(text) > 100, "_short": F.length(text) < 100})


_FACTS = ("_nfe", "_nfse", "_long", "_short")
_SEEN = ("kind", "tax_ids", "keys", "numbers", "tokens", "words", "profile")


def boundaries(signatures: DataFrame, file_col: str = "file_id", page_col: str = "page") -> DataFrame:
    """signatures with `starts`: whether a page starts a document, and `score` of the link to the page before."""
    order = W.partitionBy(file_col).orderBy(page_col)
    return _linked(_facts(signatures).withColumn("_p", F.lag(F.struct(*_SEEN)).over(order)))


def _linked(paired: DataFrame) -> DataFrame:
    """boundaries() of signatures with `_p`, what is known of the page before."""
    seen = _SEEN
    paired = paired.select("*", *[F.col(f"_p.{c}").alias(f"_p_{c}") for c in seen])
    kind, before = F.col("kind"), F.col("_p_kind")
    same_kind = kind == before
    key, number, tax = (overlap(F.col(f"_p_{c}"), F.col(c)) for c in ("keys", "numbers", "tax_ids"))
    layout, text = jaccard(F.col("_p_tokens"), F.col("tokens")), jaccard(F.col("_p_words"), F.col("words"))
    visual = profile_similarity(F.col("_p_profile"), F.col("profile"))
    strong, goes_on = _strong(""), _continues(F.col("_p_kind"))
    invoice = kind.isin("NFE", "NFSE")
    common = F.array_intersect("_p_tokens", "tokens")

    identity = same_kind & (key | (number & tax))
    other = same_kind & (kind == "OUTRO") & ~strong & (F.array_contains(common, "LISTADEEMBARQUE") | ((F.size(common) >= 1) & (visual >= 0.84) & (text >= 0.10)) | (visual >= 0.93) | (text >= 0.25))
    alike = F.when(invoice & (visual >= 0.88), goes_on | F.col("_short")).otherwise(goes_on & (F.greatest(layout, text) >= 0.18))
    same = same_kind & (kind != "OUTRO") & ~strong & alike
    points = (
        key.cast("int") * KEY_POINTS + number.cast("int") * NUMBER_POINTS + tax.cast("int") * TAX_ID_POINTS + layout * LAYOUT_POINTS + goes_on.cast("int") * CONTENT_POINTS + (strong & ~(key | (number & tax))).cast("int") * NEW_HEADER_POINTS
    )
    score = F.when(same_kind, points).otherwise(-999.0)
    scored = same_kind & ~(invoice & strong) & (score >= F.when(invoice, INVOICE_THRESHOLD).otherwise(OTHER_THRESHOLD))
    starts = F.col("_p").isNull() | ~(identity | other | same | scored)
    return paired.withColumn("score", F.when(F.col("_p").isNotNull(), score)).withColumn("starts", starts).drop("_p", *[f"_p_{c}" for c in seen], *_FACTS)


def islands(pages: DataFrame, starts: Column, file_col: str = "file_id", page_col: str = "page", name: str = "doc_index") -> DataFrame:
    """pages numbered by the document they belong to, from 1 within each file."""
    order = W.partitionBy(file_col).orderBy(page_col)
    return pages.withColumn(name, F.sum(starts.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def group_pages(signatures: DataFrame, file_col: str = "file_id", page_col: str = "page", range_pages: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """signatures, or their columns `keep` beside file and page, with the number of each page's document.

    With range_pages, files are dealt in ranges of so many page numbers, so that a file with a large part of all pages is
    worked on by many tasks; the signatures are written first, as they are read twice."""
    columns = list(dict.fromkeys([file_col, page_col, *keep])) if keep is not None else signatures.columns
    if range_pages is None:
        return islands(boundaries(signatures, file_col, page_col), F.col("starts"), file_col, page_col).select(*columns, "score", "starts", "doc_index")
    needed = list(dict.fromkeys([*columns, *_SEEN, *_FACTS, "_range"]))
    ranged = written(_facts(signatures).withColumn("_range", F.floor(F.col(page_col) / range_pages)).select(*needed), "signatures")
    linked = written(_linked(previous_row(ranged, "_p", _SEEN, file_col, page_col)).select(*columns, "_range", "score", "starts"), "boundaries")
    return running_count(linked, F.col("starts"), file_col, page_col, "doc_index").drop("_range")


def _same_range(left: DataFrame, right: DataFrame, file_col: str) -> DataFrame:
    """left with what right(_f, _r, ...) knows of its range; a null file is a file."""
    return left.join(right, left[file_col].eqNullSafe(right["_f"]) & (left["_range"] == right["_r"]), "left").drop("_f", "_r")


def previous_row(rows: DataFrame, name: str, fields: Sequence[str], file_col: str, page_col: str) -> DataFrame:
    """rows(file, page, _range) with `name`, the fields of the row before in the file: within a range by a window, across
    ranges by each range's last row, of which a file has as many as ranges."""
    row = F.struct(*fields)
    ends = rows.groupBy(F.col(file_col).alias("_f"), F.col("_range").alias("_r")).agg(F.max_by(row, page_col).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(W.partitionBy("_f").orderBy("_r"))).drop("_end")
    here = rows.withColumn(name, F.lag(row).over(W.partitionBy(file_col, "_range").orderBy(page_col)))
    return _same_range(here, before, file_col).withColumn(name, F.coalesce(name, "_before")).drop("_before")


def running_count(rows: DataFrame, flag: Column, file_col: str, page_col: str, name: str) -> DataFrame:
    """rows(file, page, _range) with `name`, the flagged rows of the file so far."""
    sums = rows.groupBy(F.col(file_col).alias("_f"), F.col("_range").alias("_r")).agg(F.sum(flag.cast("int")).alias("_sum"))
    before = sums.withColumn("_so_far", F.sum("_sum").over(W.partitionBy("_f").orderBy("_r").rowsBetween(W.unboundedPreceding, -1))).drop("_sum")
    inside = F.sum(flag.cast("int")).over(W.partitionBy(file_col, "_range").orderBy(page_col).rowsBetween(W.unboundedPreceding, W.currentRow))
    return _same_range(rows.withColumn("_in", inside), before, file_col).withColumn(name, F.col("_in") + F.coalesce("_so_far", F.lit(0))).drop("_in", "_so_far")


def segment_documents(grouped: DataFrame, file_col: str = "file_id", page_col: str = "page", name_col: str | None = None) -> DataFrame:
    """One row per document: pages in order, kind, mean confidence up to 99, and a label of file and pages."""
    found = grouped.groupBy(file_col, "doc_index").agg(
        F.array_sort(F.collect_list(page_col)).alias("pages"),
        F.first("kind").alias("kind"),  # documents are of one kind: another kind starts a document
        F.round(F.least(F.lit(99.0), F.avg("kind_confidence")), 1).alias("confidence"),
        *([F.first(name_col).alias(name_col)] if name_col else []),
    )
    label = F.concat(F.col(name_col or file_col).cast("string"), F.lit(" (página "), page_range("pages"), F.lit(")"))
    return found.withColumn("label", label)
