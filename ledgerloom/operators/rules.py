"""Page classification by weighted keyword rules.

Rules are data; they compile to one expression per class, so a page is scored in a single pass without a
join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_contained, compact, let, literal_array, normalize

#: Keywords that make up a page's header tokens, found anywhere in its compact text.
HEADER_KEYWORDS = (
    "DANFE", "DANFSE", "NFE", "NFSE", "NOTAFISCAL", "NOTAFISCALELETRONICA", "NOTAFISCALDESERVICOS",
    "DOCUMENTOAUXILIARDANOTAFISCAL", "DOCUMENTOAUXILIARDANFS", "EMITENTE", "PRESTADOR", "TOMADOR", "DESTINATARIO",
    "REMETENTE", "CHAVEDEACESSO", "CODIGODEVERIFICACAO", "NUMERO", "SERIE", "SERVICOPRESTADO",
    "DISCRIMINACAODOSERVICO", "DADOSDOSPRODUTOS", "DADOSDOPRODUTO", "DADOSDOPRODUTOSERVICO", "VALORTOTALDANOTA",
    "VALORTOTALDANFSE", "LISTADEEMBARQUE", "NOTADEDEBITO", "DACTE", "CTE", "CONHECIMENTODETRANSPORTE",
    "RECIBODOPAGADOR", "LINHADIGITAVEL", "NOSS0NUMERO", "NOSSONUMERO",
)
#: Keywords of each class and their points. A key counts where it is in the text, or without
#: its spaces in the compact text; spellings of one key count on their own.
POINTS: dict[str, tuple[tuple[str, int], ...]] = {
    "NFSE": (
        ("DANFSE", 4), ("NOTAFISCALDESERVICOS", 4), ("NOTA FISCAL DE SERVICOS", 4), ("NFS-E", 3),
        ("PRESTADOR DO SERVICO", 2), ("PRESTADOR / FORNECEDOR", 2), ("TOMADOR DO SERVICO", 1),
        ("VALOR TOTAL DA NFS-E", 2), ("VALORTOTALDANFSE", 2), ("CODIGO DE VERIFICACAO", 1), ("CODIGODEVERIFICACAO", 1),
        ("DISCRIMINACAO DO SERVICO", 1), ("DISCRIMINACAODOSERVICO", 1), ("EMITENTE DA NFS", 3), ("DADOS DA NFS", 2),
        ("SERVICO PRESTADO", 3), ("DETALHAMENTO DO SERVICO", 3), ("CALCULO DO ISSQN", 2), ("ISSQN", 1),
    ),
    "NFE": (
        ("DANFE", 4), ("NOTA FISCAL ELETRONICA", 4), ("NOTAFISCALELETRONICA", 4), ("NF-E", 3), ("CHAVE DE ACESSO", 3),
        ("CHAVEDEACESSO", 3), ("DADOS DOS PRODUTOS", 2), ("DADOSDOSPRODUTOS", 2), ("DESTINATARIO / REMETENTE", 1),
        ("DESTINATARIO/REMETENTE", 1), ("NATUREZA DA OPERACAO", 1), ("RECEBEMOS DE", 1),
    ),
    "BOLETO": (
        ("RECIBO DO PAGADOR", 3), ("LINHA DIGITAVEL", 3), ("NOSSO NUMERO", 2), ("VALOR DO DOCUMENTO", 1),
        ("PAGAVEL EM QUALQUER BANCO", 3), ("FICHA DE COMPENSACAO", 3),
    ),
    "CTE": (("DACTE", 6), ("CT-E", 5), ("CONHECIMENTO DE TRANSPORTE", 6), ("DOCUMENTO AUXILIAR DO CONHECIMENTO", 6)),
}
#: Patterns on the normalised text, for spellings that reading garbles.
PATTERNS: dict[str, tuple[tuple[str, int], ...]] = {
    "NFSE": ((r"(?<![A-Z0-9])NFS\s*[-–]?\s*[E0OC](?![A-Z0-9])", 4), (r"(?<![A-Z0-9])DANFS\s*[E0OC](?![A-Z0-9])", 5)),
    "NFE": ((r"(?<![A-Z0-9])NF\s*-?\s*E(?![A-Z0-9])", 3),),
}
#: The plain classifier's keywords.
SIMPLE_KEYS: dict[str, tuple[str, ...]] = {
    "CTE": ("DACTE", "CT-E", "DOCUMENTO AUXILIAR DO CONHECIMENTO DE TRANSPORTE"),
    "NFSE": ("DANFSE", "NFS-E", "PRESTADOR / FORNECEDOR", "PRESTADOR DO SERVICO", "VALOR TOTAL DA NFS-E"),
    "BOLETO": ("RECIBO DO PAGADOR", "COMPROVANTE DE ENTREGA", "NOSSO NUMERO", "VALOR DO DOCUMENTO", "LINHA DIGITAVEL"),
    "NFE": ("DANFE", "NATUREZA DA OPERACAO", "DADOS DOS PRODUTOS", "NF-E", "RECEBEMOS DE"),
}
#: Titles (as compact text) that tell a page's kind without more, and the characters a page's own text needs.
TITLES = ("DANFE", "DANFSE", "LISTADEEMBARQUE", "NOTADEDEBITO")
LEAST_TEXT = 220
#: Words of transport documents whose title is missing, and words that speak against one.
TRANSPORT_TITLE = ("DOCUMENTO", "AUXILIAR", "TRANSPOR", "ELETR")
TRANSPORT_PARTS, TRANSPORT_ORIGINS = ("DESTE CT", "EMITENTE CT"), "DOCUMENTOS ORIGINARIOS"
NOT_TRANSPORT = ("NOTA FISCAL", "DANFE", "NF-E")
#: Words of item tables and of services, and titles of pages that are other documents whatever else they say.
TABLE_HEADS, TABLE_CODE = ("CODIGO", "NCM", "CFOP"), "CODPRODUTO"
TABLE_COLUMNS = ("QUANTIDADE", "VALORUNITARIO", "VALORTOTAL", "DADOSDOSPRODUTOS", "PRODUTO")
SERVICE_WORDS = ("DISCRIMINACAO", "SERVICOPRESTADO", "ISSQN", "RETENCOES", "VALORTOTALDANFSE", "DADOSDANFSE")
OTHER_TITLES = ("LISTADEEMBARQUE", "NOTADEDEBITO")
#: Order that decides between equal scores.
CLASSES = ("NFSE", "NFE", "BOLETO", "CTE")
DOCUMENT_TYPES = ("NFE", "NFSE", "CTE", "BOLETO", "OUTRO")


@dataclass(frozen=True)
class RuleSet:
    """Keyword and pattern points per class, and what must hold for a class to win."""

    points: Mapping[str, Sequence[tuple[str, int]]] = field(default_factory=lambda: POINTS)
    patterns: Mapping[str, Sequence[tuple[str, int]]] = field(default_factory=lambda: PATTERNS)
    least: int = 3
    lead: int = 1

    @property
    def classes(self) -> tuple[str, ...]:
        """The classes, in the order that decides between equal scores."""
        return CLASSES if set(self.points) <= set(CLASSES) else tuple(self.points)

    def score(self, kind: str, u: Column, c: Column) -> Column:
        keyed = [F.when(F.contains(u, F.lit(k)) | F.contains(c, F.lit(k.replace(" ", ""))), n).otherwise(0) for k, n in self.points.get(kind, ())]
        matched = [F.when(u.rlike(p), n).otherwise(0) for p, n in self.patterns.get(kind, ())]
        return reduce(lambda a, b: a + b, [*keyed, *matched], F.lit(0))


def simple_class(text: Column | str) -> Column:
    """The class by counts of distinct keywords."""
    u = normalize(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    n = {k: reduce(lambda a, b: a + b, [F.contains(u, F.lit(x)).cast("int") for x in keys]) for k, keys in SIMPLE_KEYS.items()}
    return (
        F.when(n["CTE"] > 0, "CTE")
        .when((n["NFSE"] >= 1) & (n["NFSE"] >= F.greatest(n["BOLETO"], n["NFE"])), "NFSE")
        .when((n["BOLETO"] >= 2) & (n["BOLETO"] > n["NFE"]), "BOLETO")
        .when(n["NFE"] >= 1, "NFE")
        .otherwise("OUTRO")
    )


def top_two(scores: Mapping[str, Column]) -> tuple[Column, Column, Column]:
    """(best class, its score, the second score); the first class listed wins ties."""
    names = list(scores)
    best = F.greatest(*scores.values()) if len(names) > 1 else scores[names[0]]
    winner = F.coalesce(*[F.when(scores[n] == best, F.lit(n)) for n in names])
    ordered = F.sort_array(F.array(*scores.values()), asc=False)
    return winner, best, F.get(ordered, 1)


def classify_pages(pages: DataFrame, text_col: str = "text", rules: RuleSet | None = None) -> DataFrame:
    """pages with `kind` and `kind_confidence` by the weighted rules.

    Two kinds of pages are other documents whatever else they say; a class wins with enough points and a
    lead; otherwise table or service words make it a continuation page."""
    rules = rules or RuleSet()
    base = pages.withColumn("_u", normalize(F.coalesce(F.col(text_col), F.lit(""))))
    base = base.withColumn("_c", F.regexp_replace("_u", "[^A-Z0-9]", ""))
    u, c = F.col("_u"), F.col("_c")
    for kind in rules.classes:
        base = base.withColumn(f"_{kind}", rules.score(kind, u, c))
    # without a keyword of its own a transport document is known by its structure only
    titled = reduce(lambda a, b: a & b, [F.contains(u, F.lit(k)) for k in TRANSPORT_TITLE])
    structure = (titled | (any_contained(u, TRANSPORT_PARTS) & F.contains(u, F.lit(TRANSPORT_ORIGINS)))) & ~any_contained(u, NOT_TRANSPORT)
    if "CTE" in rules.classes:
        base = base.withColumn("_CTE", F.when(F.col("_CTE") > 0, F.col("_CTE")).when(structure, 6).otherwise(0))
    winner, best, second = top_two({k: F.col(f"_{k}") for k in rules.classes})
    base = base.withColumn("_best", best).withColumn("_second", second).withColumn("_winner", winner)

    table = (any_contained(u, TABLE_HEADS) | F.contains(c, F.lit(TABLE_CODE))) & any_contained(c, TABLE_COLUMNS)
    service, other = any_contained(c, SERVICE_WORDS), any_contained(c, OTHER_TITLES)
    won = (F.col("_best") >= rules.least) & (F.col("_best") >= F.col("_second") + rules.lead)
    kind = F.when(other, "OUTRO").when(won, F.col("_winner")).when(service & ~table, "NFSE").when(table & ~service, "NFE").otherwise("OUTRO")
    sure = F.least(F.lit(99.0), 55.0 + F.col("_best") * 6.0 + (F.col("_best") - F.col("_second")) * 5.0)
    confidence = F.when(other, 98.0).when(won, sure).when(service != table, 56.0).when(u == "", 30.0).otherwise(42.0)
    return base.withColumn("kind", kind).withColumn("kind_confidence", confidence).drop("_u", "_c", "_best", "_second", "_winner", *[f"_{k}" for k in rules.classes])


def header_tokens(text: Column | str, keywords: Sequence[str] = HEADER_KEYWORDS) -> Column:
    """Keywords within the compact text of a page's first 5000 characters, sorted.

    Keywords are found inside longer words too."""
    c = compact(F.substring(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 1, 5000))
    return let(c, lambda c: F.filter(literal_array(sorted(keywords)), lambda k: F.contains(c, k)))


def _stripped(text: Column | str) -> Column:
    """Text without white space of any kind at its ends; empty for null."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"(?U)^\s+|\s+$", "")


def native_text_is_enough(text: Column | str, confidence: Column | str, titles: Sequence[str] = TITLES) -> Column:
    """Whether a page needs no reading of its image: long enough, and surely classified or with a document's title."""
    sure = (F.col(confidence) if isinstance(confidence, str) else confidence) >= 65
    return let(_stripped(text), lambda t: (F.length(t) >= LEAST_TEXT) & (sure | any_contained(compact(t), titles)))


def needs_reading(text: Column | str, confidence: Column | str) -> Column:
    return (F.length(_stripped(text)) < LEAST_TEXT) | ((F.col(confidence) if isinstance(confidence, str) else confidence) < 65)


def document_type(c: Column | str) -> Column:
    """A model's document type as one of DOCUMENT_TYPES."""
    t = F.replace(F.upper(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))), F.lit("-"), F.lit(""))
    return F.when(t.isin(*DOCUMENT_TYPES), t).otherwise("OUTRO")
