"""Brazilian numbers, money, confidences and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, let

#: Session lifetime and login throttling, in seconds, and failures allowed in the trailing window.
SESSION_SECONDS, THROTTLE_SECONDS, THROTTLE_FAILURES = 21_600, 900, 10

_MONEY = r"(?:\d{1,3}(?:\.\d{3})+|\d+),\d{2}"
_NUMBER = r"(?<!\d)(?:\d{1,3}(?:\.\d{3})+|\d+)(?:[.,]\d{1,4})?(?!\d)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c: Column | str) -> Column:
    """A number with either decimal sign: of both the last one is it, a comma alone is, a dot alone stays one.

    "1.234" is therefore 1.234. Null for what isn't a number."""

    def plain(s: Column) -> Column:
        decimal_comma = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
        both = F.when(decimal_comma, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))
        return F.when(F.contains(s, F.lit(",")) & F.contains(s, F.lit(".")), both).otherwise(F.replace(s, F.lit(","), F.lit(".")))

    return let(F.replace(F.trim(_col(c)), F.lit(" "), F.lit("")), plain).try_cast("double")


def format_number(c: Column | str, decimals: int = 3) -> Column:
    """Thousands with dots, a decimal comma, zeros at the end trimmed; "-" for null."""
    text = F.translate(F.format_number(_col(c).cast("double"), decimals), ",.", ".,")
    return F.coalesce(let(text, lambda t: F.when(F.contains(t, F.lit(",")), F.regexp_replace(t, ",?0+$", "")).otherwise(t)), F.lit("-"))


def money(c: Column | str) -> Column:
    """The first amount with a decimal comma, else a plain number as one, else "-"."""
    raw = F.replace(F.replace(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"(?U)\s+", ""), F.lit("R$"), F.lit("")), F.lit(" "), F.lit(""))

    def amount(text: Column) -> Column:
        return F.coalesce(filled(F.regexp_extract(text, _MONEY, 0)), F.translate(F.format_number(text.try_cast("double"), 2), ",.", ".,"), F.lit("-"))

    return let(raw, amount)


def numeric_candidates(c: Column | str) -> Column:
    """All numbers of a text, as written."""
    return F.filter(F.regexp_extract_all(_col(c), F.lit(_NUMBER), 0), lambda x: parse_number(x).isNotNull())


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def ocr_or_default(c: Column | str) -> Column:
    """Reading confidence; 96 where there is none."""
    return F.when(F.coalesce(_col(c), F.lit(0.0)) > 0, _col(c)).otherwise(F.lit(96.0))


def match_confidence(score: Column | str, ocr: Column | str) -> Column:
    """Confidence of a catalog match from its score and the reading confidence."""
    return F.round(F.least(F.lit(100.0), _col(score) * 0.82 + ocr_or_default(ocr) * 0.18), 1)


def description_confidence(ocr: Column | str, description: Column | str) -> Column:
    shift = F.when(F.coalesce(_col(description), F.lit("")) != "", 5.0).otherwise(-15.0)
    return F.round(clamp(ocr_or_default(ocr) + shift, 45.0, 100.0), 1)


def field_confidence(given: Column | str, value: Column | str, ocr: Column | str, missing: float, *blanks: str) -> Column:
    """A given confidence, else the reading confidence, else `missing` where the value is blank."""
    known = (F.coalesce(_col(value), F.lit("")) != "") & ~F.coalesce(_col(value).isin(*blanks) if blanks else F.lit(False), F.lit(False))
    return F.round(F.when(F.coalesce(_col(given), F.lit(0.0)) != 0, _col(given)).otherwise(F.when(known, ocr_or_default(ocr)).otherwise(F.lit(missing))), 1)


def confidence_band(c: Column | str) -> Column:
    v = _col(c)
    return F.when(v >= 81, "Alta").when(v >= 70, "Revisar").when(v >= 50, "Baixa").otherwise("Muito baixa")


def sheet_band(c: Column | str) -> Column:
    """Fill of a review sheet's row; null for none."""
    v = _col(c)
    return F.when(v < 50, "red").when(v < 70, "orange").when(v <= 80, "yellow")


def page_range(pages: Column | str) -> Column:
    """ "3" for one page, "3–5" for the first and last of several, "" for none."""
    p = _col(pages)
    first, last = F.element_at(p, 1).cast("string"), F.element_at(p, -1).cast("string")
    return F.when(F.size(p) < 1, "").when(F.size(p) == 1, first).otherwise(F.concat(first, F.lit("–"), last))


def reading_score(mean_confidence: Column, chars: Column, decimals: int = 2) -> Column:
    """Quality of a page's reading: the words' mean confidence, less for pages of under 120 characters."""
    return F.round(mean_confidence * (F.lit(0.65) + F.lit(0.35) * F.least(F.lit(1.0), chars / 120.0)), decimals)


def other_reason(kind: Column | str, error: Column | str, was_ocr: Column | str, ocr_confidence: Column | str, text: Column | str) -> Column:
    """Why a page is left to manual review."""
    return (
        F.when(F.coalesce(_col(error), F.lit("")) != "", _col(error))
        .when(_col(kind) == "BOLETO", "bank slip: not processed")
        .when(_col(kind) == "CTE", "transport document: not processed here")
        .when(_col(was_ocr) & (F.coalesce(_col(ocr_confidence), F.lit(0.0)) < 50), "not legible enough after reading")
        .when(F.length(F.trim(F.coalesce(_col(text), F.lit("")))) < 30, "too little text to tell the document")
        .otherwise("type not recognised")
    )


def is_live(created: Column | str, now: Column, seconds: int = SESSION_SECONDS) -> Column:
    """Whether a session made at `created` hasn't expired at `now`."""
    return F.unix_timestamp(now) - F.unix_timestamp(_col(created)) <= seconds
