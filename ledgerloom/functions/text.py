"""Text normalisation as column expressions; everything stays in the JVM.

Null text gives null from the plain normalisers and the fallback (or an empty string) from the cleaners.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without information in item descriptions (after accents are removed).
STOP_TOKENS = (
    "DE", "DA", "DO", "DAS", "DOS", "PARA", "COM", "SEM", "EM", "NO", "NA", "NOS", "NAS", "E", "A", "O", "AS", "OS",
    "UM", "UMA", "UN", "UND", "UNID", "PC", "PCES", "SV", "SERVICO", "SERVICOS",
)
#: Words without information when page texts are compared.
STOP_WORDS = (
    "DE", "DA", "DO", "DAS", "DOS", "E", "A", "O", "AS", "OS", "EM", "PARA", "COM", "SEM", "POR", "UM", "UMA",
    "NO", "NA", "NOS", "NAS", "AO", "AOS",
)
#: Phrases that say nothing about the service rendered.
GENERIC_SERVICES = (
    "PRESTACAO DE SERVICO", "SERVICO PRESTADO", "SERVICOS PRESTADOS", "SERVICO", "SERVICOS", "PRESTACAO",
    "DESCRICAO SERVICOS", "DESCRICAO DOS SERVICOS",
)
#: What a company name's line must not contain.
NOT_A_COMPANY = (
    "RAZAO SOCIAL", "NOME EMPRESARIAL", "NOME FANTASIA", "PRESTADOR", "TOMADOR", "SIMPLES NACIONAL",
    "DATA DE COMPETENCIA", "REGIME", "ENDERECO", "MUNICIPIO", "TRAVESSA", "AVENIDA", "RODOVIA", "CEP", "INSCRI",
    "TELEFONE", "CPF", "CNPJ", "E-MAIL", "EMAIL", "MUNICI", "CHAVE DE ACESSO", "PORTAL NACIONAL", "SITUACAO DA NFS",
    "NFS-E MEI",
)
#: Labels and totals that are no part of a service description (as compact text).
NOT_A_DESCRIPTION = (
    "SERVICOPRESTADO", "DESCRICAODOSERVICO", "DESCRICAOSERVICOS", "CODIGODETRIBUTACAO", "CODIGODANBS",
    "LOCALDAPRESTACAO", "TRIBUTACAOMUNICIPAL", "TRIBUTACAOFEDERAL", "TRIBUTACAOIBSCBS", "VALORTOTAL",
    "VALORDAOPERACAO", "BCISSQN", "ALIQUOTAAPLICADA", "MUNICIPIODAINCIDENCIA", "RESPONSAVELPELORECOLHIMENTO",
    "EXIGIBILIDADEDOISS", "VALORIMPOST", "RETIDOALIQ",
)

#: Endings of legal company names.
_LEGAL_END = r"(?:LTDA|(?<![A-Z])S\.?A\.?|(?<![A-Z])S/A|EIRELI|MEI|(?<![A-Z])ME|EPP)[.,]?$"


@cache
def _accents() -> tuple[str, str]:
    """All single characters that are a base character with combining marks, and those base characters."""
    pairs = []
    for code in range(0xC0, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
            if len(base) == 1 and base != c and code < 0x10000:
                pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it.

    Higher-order functions compute what they capture for every element anew; a variable they computed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def filled(value: Column) -> Column:
    """value, null where it is an empty string; computed once, unlike by nullif()."""
    return let(value, lambda v: F.when(v != "", v))


def strip_accents(c: Column | str) -> Column:
    """Accented letters without their marks; marks of their own are removed. Text of single bytes has neither."""

    def plain(text: Column) -> Column:
        return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}+", ""))

    return plain(F.col(c)) if isinstance(c, str) else let(c, plain)


def collapse(c: Column | str) -> Column:
    """White space of any kind as single spaces, none at the ends. Plain text with single spaces has them already."""

    def single(text: Column) -> Column:
        return F.trim(F.when(~(F.contains(text, F.lit("  ")) | text.rlike("[^ -~]")), text).otherwise(F.regexp_replace(text, r"(?U)\s+", " ")))

    return single(F.col(c)) if isinstance(c, str) else let(c, single)


def normalize(c: Column | str) -> Column:
    """Upper case without accents, white space collapsed."""
    return F.upper(collapse(strip_accents(c)))


def normalize_description(c: Column | str) -> Column:
    """normalize(), with runs of anything but A-Z and 0-9 as one space."""
    return F.trim(F.regexp_replace(normalize(c), "[^A-Z0-9]+", " "))


def folded(c: Column | str) -> Column:
    """Upper case without accents."""
    return F.upper(strip_accents(c))


def compact(c: Column | str) -> Column:
    """normalize(), with nothing but A-Z and 0-9 left; its spaces need not be collapsed first."""
    return F.regexp_replace(folded(c), "[^A-Z0-9]+", "")


def clean_text(c: Column | str, fallback: str = "") -> Column:
    """White space collapsed; the fallback for null and blank text."""
    return F.coalesce(filled(collapse(_col(c).cast("string"))), F.lit(fallback))


def public_text(c: Column | str, vendor: str | None = None, fallback: str = "") -> Column:
    """clean_text() without words that tell how a text was read; vendor: a product's name to hide as well."""
    text = clean_text(c, fallback)
    if vendor:
        text = F.regexp_replace(text, rf"(?iu)\b{vendor}(?:-[A-Za-z0-9.-]+)?\b", "serviço de leitura")
    text = F.regexp_replace(text, r"(?iuU)\bintelig[êe]ncia artificial\b", "leitura automática")
    return collapse(F.regexp_replace(text, r"(?iuU)\bIA\b", "leitura automática"))


def ascii_filename(c: Column | str, default: str = "documento.pdf") -> Column:
    """Dashes as hyphens, accents dropped, other characters than letters, digits and ._()- as underscores."""
    dashed = F.translate(_col(c), "–—", "--")
    plain = F.regexp_replace(strip_accents(dashed), r"[^\x00-\x7F]", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(plain, r"[^A-Za-z0-9._() -]+", "_")), F.lit("")), F.lit(default))


def clean_company(c: Column | str) -> Column:
    """A company's name without what follows on its line: mail address, tax number, punctuation."""
    text = F.btrim(collapse(_col(c)), F.lit(" :-|_[]()\\"))
    text = F.regexp_replace(text, r"(?is)\b(?:E-?MAIL|EMAIL|CNPJ|CPF)\b.*$", "")
    return F.btrim(text, F.lit(" :-|_[]()"))


def looks_like_company(c: Column | str) -> Column:
    """Whether the text ends like a legal company name."""
    return F.coalesce(let(normalize(c), lambda u: (F.length(u) >= 4) & u.rlike(_LEGAL_END)), F.lit(False))


#: Fixed value: a company's name up to its legal ending.
_NAMED = r"(?iu)([A-ZÀ-Ý0-9&.'\-/ ]{3,}?(?:LTDA|EIRELI|EPP|(?<![A-ZÀ-Ý])S\s*\.?A\s*\.?|(?<![A-ZÀ-Ý])S/A|MEI|(?<![A-ZÀ-Ý])ME))[.,]?(?=\s|$)"
#: What every such name ends with: looked for first, as a name's start is tried at each character.
_ENDING = r"(?iu)(?:LTDA|EIRELI|EPP|S\s*\.?A\s*\.?|S/A|ME|MEI)[.,]?(?=\s|$)"


def company_candidate(c: Column | str) -> Column:
    """The company name on a line of a service document, or an empty string for labels and addresses."""
    line = F.btrim(collapse(_col(c)), F.lit(" :-|_"))
    line = F.regexp_replace(line, r"(?i)^[O0]?\d[\d.\-/]*\d\s+(?=[A-Za-zÀ-ÿ])", "")
    line = F.trim(F.regexp_replace(line, r"(?isu)\s+(?:E-?MAIL|EMAIL|CNPJ|CPF|IM|INSCRI[CÇ][AÃ]O)\s*:?.*$", ""))

    def name(text: Column) -> Column:
        found = F.when(text.rlike(_ENDING), F.regexp_extract(text, _NAMED, 1)).otherwise("")
        named = F.regexp_replace(F.trim(found), r"(?i)^[O0]?\d[\d.\-/() ]*\d\s+(?=[A-Za-zÀ-ÿ])", "")
        return let(named, lambda n: clean_company(F.when(n != "", n).otherwise(text)))

    def accepted(n: Column) -> Column:
        def by_normal(u: Column) -> Column:
            refused = any_contained(u, NOT_A_COMPANY) | (F.length(u) < 4) | n.rlike(r"\b\d{2}/\d{2}/\d{4}\b")
            wordy = (F.size(F.regexp_extract_all(u, F.lit(r"[A-Z]{2,}"), 0)) >= 2) & ~u.rlike(r"@|\bRUA\b|\bPR\b\s*\d{5}")
            return F.when(~refused & (u.rlike(_LEGAL_END) | wordy), n).otherwise("")

        return let(normalize(n), by_normal)

    return let(let(line, name), accepted)


def service_line(c: Column | str) -> Column:
    """What a line says about the service rendered, or an empty string for labels, codes and totals."""

    def cleaned(raw: Column) -> Column:
        text = F.trim(F.regexp_replace(raw, r"\s+\d{3,}(?:[./]\d+)*\s*/.*$", ""))
        address = text.rlike(r"^[\d./\-\s]+$") | text.rlike(r"(?i)\b(?:CEP|CNPJ|CPF|E-MAIL|EMAIL|MUNICIPIO|SIGLA UF)\b")
        return F.when(~address, F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)\s+R\$\s*[\d.,]+.*$", ""), r"(?iu)\s+(?:SIM|NAO|NÃO)\s+\d+[,.]\d+\s+\d.*$", "")))

    def described(text: Column) -> Column:
        coded = text.rlike(r"^\s*(?:\d{2}(?:[./]\d{2}){1,3}|\d{3,}(?:[./]\d+)*)(?:\s*/|\s+-|\s+\d)")
        letters, digits = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ÿ]", "")), F.length(F.regexp_replace(text, "[^0-9]", ""))
        return F.when(~coded & (letters >= 5) & ~((digits > letters * 2) & (digits >= 8)), F.btrim(text, F.lit(" |-")))

    def label(u: Column) -> Column:
        return any_contained(u, NOT_A_DESCRIPTION) | (F.contains(u, F.lit("RETIDO")) & F.contains(u, F.lit("VALORTOTA")))

    def line(raw: Column) -> Column:
        return F.when((F.length(normalize_description(raw)) >= 5) & ~let(compact(raw), label), let(cleaned(raw), described))

    return F.coalesce(let(collapse(F.coalesce(_col(c), F.lit(""))), line), F.lit(""))


def is_generic_service(c: Column | str) -> Column:
    return normalize_description(c).isin(*GENERIC_SERVICES)


def tokens(c: Column | str) -> Column:
    """Informative tokens of a description, in order, repeats included."""
    found = F.regexp_extract_all(normalize(c), F.lit("[A-Z0-9]+"), 0)
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_TOKENS))


def page_words(c: Column | str) -> Column:
    """Distinct words of three letters or digits and more that are no stop words."""
    found = F.regexp_extract_all(normalize(c), F.lit("[A-Z0-9]{3,}"), 0)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*STOP_WORDS)))


def identity(c: Column | str) -> Column:
    """Upper case with nothing but A-Z and 0-9; accented letters are dropped, not replaced."""
    return F.regexp_replace(F.upper(clean_text(c)), "[^A-Z0-9]", "")


def digits(c: Column | str, n: int | None = None) -> Column:
    """The digits of a text, the first n of them."""
    found = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"\D", "")
    return F.substring(found, 1, n) if n else found


def code_variants(c: Column | str) -> Column:
    """A code in upper case, and without anything but letters and digits."""
    upper = F.upper(F.trim(F.coalesce(_col(c).cast("string"), F.lit(""))))
    return F.filter(F.array_distinct(F.array(upper, F.regexp_replace(upper, "[^A-Z0-9]", ""))), lambda v: v != "")


def first_non_blank(*cs: Column | str) -> Column:
    """The first text that isn't null or blank, else an empty string."""
    return F.coalesce(*[F.when(F.trim(_col(c)) != "", _col(c)) for c in cs], F.lit(""))


def any_contained(c: Column, keys: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(k)) for k in keys])


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
