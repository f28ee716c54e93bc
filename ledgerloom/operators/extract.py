"""Identifiers, amounts, line items and fields from text and from arrays of lines.

Line operators take an array<string> column and work on it with higher-order functions, so a document's
lines are never exploded or gathered again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import format_number, parse_number
from ..functions.text import any_contained, clean_company, collapse, compact, company_candidate, digits, filled, folded, is_generic_service, let, looks_like_company, normalize, normalize_description, service_line

NO_NUMBER, NO_COMPANY, NO_SERVICE = "SemNumero", "Empresa não identificada", "Prestacao de servico"
_DATE = r"\d{2}/\d{2}/\d{4}"
#: Units of measure in invoice tables.
UNITS = "UN|UND|UNID|PC|PÇ|KG|G|L|LT|M|M2|M3|CX|FD|SC|HR|H|JG|PAR|TON|RL|ML|SV"
#: Patterns of document numbers in normalised text, in the order in which they are tried.
NUMBER_PATTERNS = (
    r"(?:N[º°O0]|NUMERO)\s*[:.]?\s*(\d{1,3}(?:[.\s]\d{3})+|\d{1,9})\b",
    r"NF[- ]?E\s*(?:N[º°O0]\s*)?[:.]?\s*(\d{1,3}(?:\.\d{3})+|\d{1,9})\b",
    r"NFS[- ]?E\s*(?:N[º°O0]\s*)?[:.]?\s*(\d{1,3}(?:\.\d{3})+|\d{1,9})\b",
    r"ORCAMENTO\s*(?:NO\.?|N[º°O0])?\s*(\d{1,10})\b",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_matches(c: Column | str, pattern: str, length: int, limit: int) -> Column:
    """Digits of each match that has `length` of them: distinct, in order, the first `limit`."""
    found = F.transform(F.regexp_extract_all(_col(c), F.lit(pattern), 0), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) == length)), 1, limit)


def tax_ids(c: Column | str) -> Column:
    return distinct_matches(c, r"(?<!\d)\d{2}[.\s]?\d{3}[.\s]?\d{3}[/\s]?\d{4}[-\s]?\d{2}(?!\d)", 14, 6)


def access_keys(c: Column | str) -> Column:
    return distinct_matches(c, r"(?<!\d)(?:\d[\s./-]?){44}(?!\d)", 44, 3)


def without_leading_zeros(c: Column) -> Column:
    return F.coalesce(filled(F.regexp_replace(c, "^0+", "")), F.lit("0"))


def number_candidates(c: Column | str, patterns: Sequence[str] = NUMBER_PATTERNS, limit: int = 5) -> Column:
    """Document numbers without leading zeros, in the order of the patterns.

    A number is left out if it is there already as it is written, so one written with zeros comes twice."""
    found = let(normalize(c), lambda u: F.flatten(F.array(*[F.regexp_extract_all(u, F.lit(p), 1) for p in patterns])))
    found = F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"\D", "")), lambda x: x != "")
    start = F.array().cast("array<string>")
    kept = F.aggregate(found, start, lambda out, x: F.when(F.array_contains(out, x), out).otherwise(F.array_append(out, without_leading_zeros(x))))
    return F.slice(kept, 1, limit)


def first_of(values: Column) -> Column:
    """The first element that isn't null or empty; null if there is none."""
    return F.get(F.filter(values, lambda x: x.isNotNull() & (x != "")), 0)


def first_match(lines: Column, pattern: str, group: int = 1, norm: bool = False) -> Column:
    """The first match of a pattern among lines, as written or normalised."""
    return first_of(F.transform(lines, lambda x: F.regexp_extract(normalize(x) if norm else x, pattern, group)))


def first_index(values: Column, found) -> Column:
    """0-based place of the first element that fits; null if none does."""
    return F.get(F.filter(F.transform(values, lambda x, i: F.when(found(x), i)), lambda i: i.isNotNull()), 0)


def first_found(values: Column, kind: str, found) -> Column:
    """The first of found(element) of type `kind` that isn't null; those after it are not computed."""
    return F.aggregate(values, F.lit(None).cast(kind), lambda known, x: F.when(known.isNotNull(), known).otherwise(found(x)))


def _groups(line: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that begins at a line's start, by one match; null where it doesn't match.

    The groups must hold no line break, and the first must hold something: a line that doesn't match leaves it empty."""
    return let(_split_groups(line, pattern, n), lambda p: F.when(p[0] != "", p))


def _split_groups(line: Column, pattern: str, n: int) -> Column:
    """_groups() with empty groups where the pattern doesn't match."""
    groups = F.lit("\n".join(f"${g}" for g in range(1, n + 1)))
    return F.split(F.regexp_replace(line, F.lit(rf"(?:{pattern})(?s:.*)|^(?s:.*)"), groups), "\n", -1)


def _compacted(lines: Column) -> Column:
    return F.transform(lines, lambda x: compact(x))


def _from(lines: Column, start: Column, n: int | Column) -> Column:
    """Up to n elements from a 0-based place on; empty where the place is null or beyond the end."""

    def cut(at: Column, size: Column) -> Column:
        return F.when(at.isNotNull() & (at >= 0) & (at < F.size(lines)) & (size > 0), F.slice(lines, at + 1, size)).otherwise(F.array().cast("array<string>"))

    return let(start, lambda at: cut(at, F.lit(n)) if isinstance(n, int) else let(n, lambda size: cut(at, size)))


def _whole(c: Column) -> Column:
    """A digit string as a number without leading zeros."""
    return let(c, lambda x: F.when(x != "", without_leading_zeros(F.regexp_replace(x, r"\D", ""))))


def goods_invoice_number(lines: Column | str) -> Column:
    """Number of a goods invoice from the first 55 lines."""
    head = F.slice(_col(lines), 1, 55)

    def of(u: Column) -> Column:
        labelled = F.regexp_extract(u, r"(?:N[º°]|N[O0]\b)\s*[:.-]?\s*(\d{1,3}(?:[.\s]\d{3})+|\d{1,9})\b", 1)
        typed = F.regexp_extract(u, r"\bNF[- ]?E?\s*(?:N[º°:]?\s*)?(\d{1,3}(?:[.]\d{3})+|\d{1,9})\b", 1)
        return F.coalesce(_whole(labelled), F.when(~F.contains(u, F.lit("CNPJ")), _whole(typed)))

    return F.coalesce(first_of(F.transform(F.transform(head, lambda x: normalize(x)), of)), F.lit(NO_NUMBER))


#: Patterns of the receipt that names the issuer, in the order in which they are tried.
RECEIVED_FROM = (
    r"(?is)RECEBEMOS\s+DE\s+(.+?)\s+(?:OS\s+PRODUTOS(?:\s+E/?OU\s+SERVI[CÇ]OS)?|OS\s+SERVI[CÇ]OS)\s+CONSTANTES",
    r"(?is)RECEBEMOS\s+DE\s+(.+?)(?:\s+OS\s+PRODUTOS|\s+OS\s+SERVI[CÇ]OS)",
)
#: Words of lines that name no issuer: legal names, text before the title, lines beside the title.
NOT_ISSUER = ("DESTINATARIO", "REMETENTE", "TRANSPORTADOR", "DOCUMENTO AUXILIAR", "NOTA FISCAL", "SERIE", "CONTROLE DO FISCO")
NOT_BEFORE_TITLE = ("DOCUMENTO AUXILIAR", "NOTA FISCAL", "CONTROLE DO FISCO")
NOT_BESIDE_TITLE = ("DOCUMENTO AUXILIAR", "NOTA FISCAL", "CHAVE DE ACESSO", "CONTROLE DO FISCO", "SERIE", "IDENTIFICACAO DO EMITENTE")


def _unless(name: Column, refused: Sequence[str] = ()) -> Column:
    """name if it has four letters or digits and more and none of the refused words, else null."""
    ok = lambda u: (F.length(u) >= 4) & (~any_contained(u, refused) if refused else F.lit(True))
    return let(name, lambda n: F.when(let(normalize_description(n), ok), n))


def goods_invoice_issuer(lines: Column | str) -> Column:
    """Issuer of a goods invoice: whom the receipt names, a legal name in the first 45 lines, or the text before or
    beside the title in the first 40."""

    def legal(x: Column) -> Column:
        return let(company_candidate(x), lambda n: F.when(looks_like_company(n) & ~let(normalize(n), lambda u: any_contained(u, NOT_ISSUER)), n))

    def issuer(ls: Column) -> Column:
        received = let(F.array_join(ls, "\n"), lambda full: F.coalesce(*[_unless(clean_company(F.regexp_extract(full, p, 1))) for p in RECEIVED_FROM]))

        def titled(x: Column, i: Column) -> Column:
            before = _unless(clean_company(F.regexp_extract(x, r"(?is)^(.*?)\bDANFE\b", 1)), NOT_BEFORE_TITLE)
            beside = [_unless(clean_company(F.get(ls, at)), NOT_BESIDE_TITLE) for at in (i - 1, i + 1)]
            return F.when(F.contains(normalize(x), F.lit("DANFE")), F.coalesce(before, F.when(i > 0, beside[0]), beside[1]))

        return F.coalesce(received, first_of(F.transform(F.slice(ls, 1, 45), legal)), first_of(F.transform(F.slice(ls, 1, 40), titled)), F.lit(NO_COMPANY))

    return let(_col(lines), issuer)


def transport_document(lines: Column | str) -> Column:
    """struct(number, company) of a transport document: labelled number, legal name under the issuer's label."""
    return let(_col(lines), _transport_document)


def _transport_document(ls: Column) -> Column:
    number = first_match(ls, r"(?:CT-?E|CONHECIMENTO(?:\s+DE\s+TRANSPORTE)?)\s*(?:N[º°O.]*)?\s*[:.-]?\s*(\d{1,12})\b", norm=True)
    spots = F.filter(F.transform(ls, lambda x, i: F.when(normalize(x).isin("EMITENTE", "DADOS DO EMITENTE", "REMETENTE"), i)), lambda i: i.isNotNull())
    names = F.flatten(F.transform(spots, lambda i: F.transform(_from(ls, i + 1, 4), lambda x: let(clean_company(x), lambda n: F.when(looks_like_company(n), n)))))
    return F.struct(F.coalesce(_whole(number), F.lit(NO_NUMBER)).alias("number"), F.coalesce(first_of(names), F.lit(NO_COMPANY)).alias("company"))


#: A row of the product section, and what starts and ends the section (as compact text).
_GOODS_ROW = rf"(?i)^(\S+)\s+(.*?)\s+(\d{{8}}|\d{{4}}\.\d{{2}}\.\d{{2}})\s+[A-Za-z0-9/.\-]+\s+\d{{4}}\s+({UNITS})\s+(\d+(?:[.,]\d+)?)\b"
_GOODS_START = ("DADOSDOSPRODUTOS", "DADOSDOPRODUTO")
_GOODS_END = ("DADOSADICIONAIS", "INFORMACOESCOMPLEMENTARES")


def _goods_item(p: Column) -> Column:
    """An item of the groups of its row."""
    quantity = F.when(p[4].rlike("[1-9]"), p[4]).otherwise("")
    return F.struct(p[0].alias("code"), F.btrim(p[1], F.lit(" -")).alias("description"), F.replace(p[2], F.lit("."), F.lit("")).alias("ncm"), F.upper(p[3]).alias("unit"), quantity.alias("quantity"))


def goods_items(lines: Column | str) -> Column:
    """array of struct(code, description, ncm, unit, quantity): rows of the product section.

    The section runs from its heading to the additional data; quantities that aren't above zero are blank."""
    inside = let(_col(lines), lambda ls: section(ls, lambda u: u.rlike(spelled(*_GOODS_START)), lambda u: u.rlike(spelled(*_GOODS_END)), folded))
    return F.transform(F.filter(F.transform(inside, lambda x: _groups(F.trim(x), _GOODS_ROW, 5)), lambda p: p.isNotNull()), _goods_item)


def goods_item_rows(documents: DataFrame, keep: Sequence[str], lines_col: str = "lines") -> DataFrame:
    """(keep, line_no, item's fields): goods_items() of many documents as rows; line_no is a row's place among the lines.

    Rows are matched as columns of exploded lines, which is compiled; higher-order functions are interpreted and copy
    what they bind."""
    kept = list(keep)
    marked = documents.select(*kept, F.col(lines_col).alias("_ls"), F.transform(lines_col, lambda x: folded(x)).alias("_u"))
    at = marked.select(*kept, "_ls", F.array_position(F.transform("_u", lambda u: u.rlike(spelled(*_GOODS_START))), True).cast("int").alias("_at"), F.transform("_u", lambda u: u.rlike(spelled(*_GOODS_END))).alias("_ends"))
    rest = F.slice("_ends", F.col("_at") + 1, F.size("_ends"))
    cut = at.select(*kept, "_ls", "_at", F.when(F.col("_at") > 0, F.array_position(rest, True).cast("int")).alias("_n"))
    # no end: to the last line; no heading: nothing
    lines = F.slice("_ls", F.col("_at") + 1, F.when(F.col("_n") > 0, F.col("_n") - 1).when(F.col("_n") == 0, F.size("_ls")))
    # generated here and below, so that filters aren't moved beneath and compute it once more
    inside = cut.select(*kept, "_at", F.explode(F.array(lines)).alias("_in"))
    rows = inside.select(*kept, "_at", F.posexplode("_in").alias("_i", "_x"))
    parts = rows.select(*kept, (F.col("_at") + F.col("_i")).alias("line_no"), F.explode(F.array(_split_groups(F.trim("_x"), _GOODS_ROW, 5))).alias("_p")).where(F.col("_p")[0] != "")
    item = _goods_item(F.col("_p"))
    return parts.select(*kept, "line_no", item.alias("_g")).select(*kept, "line_no", "_g.*")


#: What starts and ends the section on the service rendered, and what labels its description.
_SERVICE_START = ("SERVICOPRESTADO", "DETALHAMENTODOSERVICO", "DISCRIMINACAODOSSERVICOS", "DISCRIMINACAODOSERVICO", "DESCRICAODOSSERVICOS", "SERVICOSPRESTADOS")
_SERVICE_END = (
    "TRIBUTACAOMUNICIPAL", "TRIBUTACAOFEDERAL", "CALCULODOISSQN", "CALCULODOISS", "VALORTOTALDANFSE",
    "VALORDAOPERACAOSERVICO", "VALORTOTALDANOTA", "VALORTOTALDOSSERVICOS", "DEDUCOES", "RETENCOESFEDERAIS",
    "INFORMACOESCOMPLEMENTARES", "OUTRASINFORMACOES", "MUNICIPIODAINCIDENCIA", "RESPONSAVELPELORECOLHIMENTO",
    "EXIGIBILIDADEDOISS", "DANFSE", "DOCUMENTOAUXILIAR", "CHAVEDEACESSO", "EMITENTEDANFSE",
)
_SERVICE_LABEL = ("DESCRICAODOSERVICO", "DESCRICAODOSSERVICOS", "DESCRICAOSERVICOS", "DISCRIMINACAODOSERVICO", "DISCRIMINACAODOSSERVICOS")


def distinct_lines(lines: Column) -> Column:
    """Lines whose normalised description wasn't there before, in order: sorted by it, equal ones lie together."""
    norm = F.transform(lines, lambda x: normalize_description(x))
    pairs = F.filter(F.zip_with(lines, norm, lambda x, n: F.struct(n.alias("n"), x.alias("x"))), lambda p: p["n"] != "")
    ordered = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["n"].alias("n"), i.alias("i"), p["x"].alias("x"))))
    first = let(ordered, lambda ps: F.filter(ps, lambda p, j: (j == 0) | (p["n"] != F.get(ps, j - 1)["n"])))
    return F.transform(F.array_sort(F.transform(first, lambda p: F.struct(p["i"].alias("i"), p["x"].alias("x")))), lambda p: p["x"])


def spelled(*keys: str) -> str:
    """A pattern that finds in folded() text what is contained in its compact() form, which need not be made."""
    rest = "|".join(rf"(?<={k[0]})[^A-Z0-9]*" + "[^A-Z0-9]*".join(k[1:]) for k in keys)
    return f"[{''.join(sorted({k[0] for k in keys}))}](?:{rest})"


def section(lines: Column, start, end, form=compact, packed: Column | None = None) -> Column:
    """The lines between the first that fits `start` and the next that fits `end`, both left out; they see a line's form,
    which may be given for all lines."""
    def cut(packed: Column) -> Column:
        def after(first: Column) -> Column:
            return let(F.slice(packed, first + 2, F.size(packed)), lambda rest: _from(lines, first + 1, F.coalesce(first_index(rest, end), F.size(rest))))

        return let(first_index(packed, start), lambda first: F.when(first.isNotNull(), after(first)).otherwise(F.array().cast("array<string>")))

    return let(F.transform(lines, lambda x: form(x)), cut) if packed is None else cut(packed)


def _with_compact(lines: Column | str, body) -> Column:
    """body(lines, their compact forms), both computed once."""
    return let(_col(lines), lambda ls: let(_compacted(ls), lambda packed: body(ls, packed)))


def service_description(lines: Column | str) -> Column:
    """Text of the section on the service rendered: what follows its description label, else what precedes it."""
    return _with_compact(lines, _service_description)


def _service_description(ls: Column, packed: Column) -> Column:
    def starts(u: Column) -> Column:
        return any_contained(u, _SERVICE_START) | (u.startswith("DETALHA") & F.contains(u, F.lit("SERVI")))

    inside = section(ls, starts, lambda u: u.rlike("^TRIBUTA[CG]AO") | any_contained(u, _SERVICE_END), packed=packed)
    heading = F.get(F.filter(packed, starts), 0)

    def text(part: Column) -> Column:
        label = F.when(let(heading, lambda h: any_contained(h, _SERVICE_START[1:])), F.lit(-1)).otherwise(
            first_index(_compacted(part), lambda u: any_contained(u, _SERVICE_LABEL) | (u.startswith("DESCRI") & F.contains(u, F.lit("SERVI"))))
        )

        def chosen(at: Column) -> Column:
            lines = F.filter(F.transform(part, lambda x, i: F.struct(i.alias("i"), service_line(x).alias("x"))), lambda p: p["x"] != "")

            def pick(found: Column) -> Column:
                after = distinct_lines(F.transform(F.filter(found, lambda p: at.isNotNull() & (p["i"] > at)), lambda p: p["x"]))
                before = distinct_lines(F.transform(F.filter(found, lambda p: at.isNull() | (p["i"] <= at)), lambda p: p["x"]))
                own = F.filter(after, lambda x: ~is_generic_service(x))
                return let(own, lambda o: F.trim(F.array_join(F.when(F.size(o) > 0, o).otherwise(before), " ")))

            return let(lines, pick)

        return let(label, chosen)

    return let(inside, text)


#: Fixed value: a row of a service order.
_ORDER_ROW = rf"(?i)^{_DATE}\s+\d+\s+(.*?)\s+(\d+(?:[.,]\d+)?)(?:\s+[\d.]+,\d{{2}}){{4}}\s*$"


def service_order(lines: Column | str) -> Column:
    """struct(number, company, description, quantity, total) of a service order; null for other documents."""
    return let(_col(lines), lambda ls: let(normalize(F.array_join(ls, "\n")), lambda full: F.when(F.contains(full, F.lit("PRESTACAO DE SERVICOS")) & F.contains(full, F.lit("SERVICOS ALOCADOS")), let(F.transform(ls, lambda x: collapse(x)), lambda flat: _service_order(ls, full, flat)))))


def _service_order(ls: Column, full: Column, flat: Column) -> Column:
    """The order's fields, of its lines, its normalised text and its lines with single spaces."""
    number = _whole(F.regexp_extract(full, r"PRESTACAO\s+DE\s+SERVICOS\s+N[º°O0]?\s*:?\s*(\d{3,12})", 1))
    company = first_of(F.transform(F.slice(flat, 1, 15), lambda x: F.btrim(F.regexp_extract(x, r"(?i)^(.{5,}?)\s+Emiss[aã]o\s*:", 1), F.lit(" :-"))))
    rows = F.filter(section(flat, lambda u: F.contains(u, F.lit("SERVICOSALOCADOS")), lambda u: any_contained(u, ("TOTALDOSSERVICOS", "TOTAISDAOS"))), lambda x: x.rlike(_ORDER_ROW))
    total = F.coalesce(first_match(ls, r"(?i)VALOR\s+TOTAL\s+DA\s+OS\s*:\s*R?\$?\s*([\d.]+,\d{2,4})"), first_match(ls, r"(?iu)TOTAL\s+DOS\s+SERVI[CÇ]OS\.*\s*:?\s*\d+\s+([\d.]+,\d{2,4})"), F.lit("-"))

    def fields(rows: Column) -> Column:
        described = F.array_join(F.array_distinct(F.transform(rows, lambda x: F.trim(F.regexp_extract(x, _ORDER_ROW, 1)))), "; ")
        amounts = F.transform(rows, lambda x: let(parse_number(F.regexp_extract(x, _ORDER_ROW, 2)), lambda n: F.when(n != 0, n).otherwise(1.0)))
        quantity = let(F.aggregate(amounts, F.lit(0.0), lambda s, x: s + x), lambda q: F.when(q > 0, q).otherwise(1.0))
        return F.struct(F.coalesce(number, F.lit(NO_NUMBER)).alias("number"), F.coalesce(company, F.lit(NO_COMPANY)).alias("company"), F.coalesce(filled(described), F.lit(NO_SERVICE)).alias("description"), quantity.alias("quantity"), total.alias("total"))

    return let(rows, fields)


#: Labels before the number of a service invoice, misread ones among them (as compact text).
_NUMBER_LABELS = (
    "NUMERODANOTAFISCAL", "NUMERODANOTA", "NUMERODANFSE", "NODANFSE", "NFDANFSE", "NOTAFISCALN", "WIMERODANOTAFISCAL",
    "MIMERODANOTAFISCAL", "NMERODANOTAFISCAL", "NOMERODANOTAFISCAL", "MERODANOTAFISCAL",
)
#: Fixed value: labels before a number on the same or the next lines.
_LABELLED = r"(?iu)(?:N[ÚU]MERO\s+DA\s+(?:NFS-?E|NOTA(?:\s+FISCAL)?)|N[º°O]\s+DA\s+(?:NFS-?E|NOTA)|N[ÚU]MERO|N[º°O]|NOTA(?:\s+FISCAL)?\s*N[º°O]?)\s*[:.\-]?\s*(\d{1,9})\b"


def _pure_number(lines: Column) -> Column:
    """Of lines that are a number alone: the first of two digits and more, else the first."""
    pure = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*(\d{1,9})\s*$", 1)), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)) > 0)
    return let(pure, lambda xs: F.coalesce(F.get(F.filter(xs, lambda x: F.length(x) >= 2), 0), F.get(xs, 0)))


def service_number(lines: Column | str) -> Column:
    """Number of a service invoice: beside or under its label, inside the 50-digit key, as "n / A", or by other labels."""
    return _with_compact(lines, _service_number)


def _service_number(ls: Column, packed: Column) -> Column:
    def dated(x: Column) -> Column:
        plain = F.regexp_extract(x, r"(?<![/\d])(\d{1,8})\s+(?:\d{2}/\d{2}/\d{4}|\d{2}/\d{4})", 1)
        dotted = F.regexp_extract(x, r"(?<![0-9A-Za-z])(\d{2,}\.\d{2,})(?=\s+\d{2}/(?:\d{2}/)?\d{4})", 1)
        return F.coalesce(_whole(plain), _whole(dotted))

    def beside(at: Column) -> Column:
        leading = F.transform(_from(ls, at + 1, 4), lambda x: _whole(F.regexp_replace(F.regexp_extract(x, r"^\s*([0-9.]{2,})\s+", 1), r"\.", "")))
        return F.coalesce(first_of(F.transform(_from(ls, at, 5), dated)), first_of(leading), _whole(_pure_number(_from(ls, at + 1, 10))))

    def inside_key(key: Column) -> Column:
        return F.when(F.coalesce(F.substring(key, 24, 13).try_cast("long"), F.lit(0)) > 0, without_leading_zeros(F.substring(key, 24, 13)))

    def near(i: Column) -> Column:
        text = F.regexp_replace(F.array_join(_from(ls, i, 3), " "), rf"{_DATE}(?:\s+\d{{2}}:\d{{2}}(?::\d{{2}})?)?", " ")
        return let(F.regexp_extract(text, _LABELLED, 1), lambda found: F.when(found != "", let(_whole(found), lambda n: F.when(n != "0", n))).otherwise(_whole(_pure_number(_from(ls, i + 1, 10)))))

    def spots(packed: Column, n: int, keys: Sequence[str]) -> Column:
        return F.filter(F.transform(F.slice(packed, 1, n), lambda u, i: F.when(any_contained(u, keys), i)), lambda i: i.isNotNull())

    def ladder(packed: Column) -> Column:
        labelled = let(first_index(packed, lambda u: any_contained(u, ("NUMERODANFSE", "MERODANFSE"))), beside)
        alone = first_of(F.transform(F.slice(ls, 1, 55), lambda x: let(digits(x), lambda d: F.when(F.length(d) == 50, inside_key(d)))))
        joined = F.transform(spots(packed, 45, ("CHAVEDEACESSO",)), lambda i: F.array_join(F.transform(_from(ls, i + 1, 6), lambda x: digits(x)), ""))
        from_key = F.coalesce(alone, first_of(F.transform(joined, lambda k: F.when(F.length(k) >= 50, inside_key(F.substring(k, 1, 50))))))
        series = _whole(first_match(F.slice(ls, 1, 90), r"(?<!\d)(\d{3,9})\s*/\s*([A-Z])(?![A-Z])", norm=True))
        others = first_of(F.transform(spots(packed, 35, _NUMBER_LABELS), near))
        return let(labelled, lambda n: F.coalesce(F.when(n.isNull() | (F.length(n) <= 1), from_key), n, series, others, F.lit(NO_NUMBER)))

    return ladder(packed)


#: Labels of the provider's block and of its name (as compact text).
_PROVIDER_LABELS = ("EMITENTEDANFSE", "PRESTADORFORNECEDOR", "PRESTADORDESERVICO", "DADOSDOPRESTADOR")
_NAME_LABELS = ("RAZAOSOCIAL", "NOMEEMPRESARIAL", "NOMEDOPRESTADOR")


def _wordy(c: Column) -> Column:
    return F.size(F.regexp_extract_all(normalize(c), F.lit("[A-Z]{2,}"), 0))


#: What the normalised line of every legal company name contains: its ending, which no white space divides.
_MAYBE_LEGAL = r"LTDA|EIRELI|EPP|S/A|(?<![A-Z])(?:S\.?A|ME)"


def service_provider(lines: Column | str) -> Column:
    """Provider of a service invoice, from its own block only; names split over two lines are joined."""
    return _with_compact(lines, _service_provider)


def _service_provider(ls: Column, packed: Column) -> Column:
    none = F.array().cast("array<string>")

    def named() -> Column:
        def block(first: Column) -> Column:
            rest = F.when(F.size(ls) > first + 1, F.slice(packed, first + 2, F.size(ls))).otherwise(none)
            return _from(ls, first, F.least(F.coalesce(first_index(rest, lambda u: F.contains(u, F.lit("TOMADOR"))), F.lit(39)) + 1, F.size(ls)))

        def name(x: Column) -> Column:
            return let(F.regexp_extract(x, r"(?i)NOME\s*/?\s*RAZ\S*\s+SOCI\S*\s*[:|-]?\s*(.+)$", 1), lambda m: F.when(m != "", filled(company_candidate(m))))

        inside = let(F.coalesce(first_index(packed, lambda u: any_contained(u, _PROVIDER_LABELS)), F.lit(0)), block)
        return first_found(inside, "string", name)

    def inner() -> Column:
        def block(start: Column) -> Column:
            after = F.when(start.isNotNull(), F.slice(packed, start + 2, 23)).otherwise(none)
            return _from(ls, start + 1, F.coalesce(first_index(after, lambda u: any_contained(u, ("TOMADORDOSERVICOS", "DADOSDOTOMADOR", "TOMADORADQUIRENTE"))), F.lit(23)))

        return let(first_index(packed, lambda u: F.contains(u, F.lit("PRESTADOR")) | F.contains(u, F.lit("EMITENTEDANFSE"))), block)

    def is_label(x: Column) -> Column:
        return let(compact(x), lambda c: any_contained(c, _NAME_LABELS) | (F.contains(c, F.lit("NOME")) & any_contained(c, ("RAZ", "SOCIAL", "EMPRES"))))

    def lines_of(block: Column) -> Column:
        """A block's lines with what follows them, and whether their own or the pair's candidate can be a legal name."""
        maybe = F.transform(block, lambda x: F.coalesce(normalize(x).rlike(_MAYBE_LEGAL), F.lit(False)))
        return let(maybe, lambda may: F.transform(block, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(block, i + 1).alias("next"), F.get(may, i).alias("may"), (F.get(may, i) | F.coalesce(F.get(may, i + 1), F.lit(False))).alias("pair"))))

    def legal_name(c: Column) -> Column:
        return let(company_candidate(c), lambda n: F.when(looks_like_company(n), n))

    def by_lines(fs: Column) -> Column:
        def legal(f: Column) -> Column:
            """The line's legal name, else the one of it and the next line."""
            name = F.coalesce(F.when(f["may"], legal_name(f["x"])), F.when(f["pair"], legal_name(F.concat_ws(" ", f["x"], f["next"]))))
            return let(name, lambda n: F.when(n.isNotNull(), F.struct(f["i"].alias("i"), n.alias("name"))))

        def whole(f: Column) -> Column:
            # no line before the first legal name is one
            before = F.reverse(F.slice(fs, F.greatest(F.lit(1), f["i"] - 6), F.least(f["i"], F.lit(7))))
            prefix = first_found(before, "string", lambda y: let(company_candidate(y["x"]), lambda n: F.when((n != "") & (_wordy(n) >= 2), n)))
            joined = company_candidate(F.concat_ws(" ", F.when((_wordy(f["name"]) <= 2) & (f["i"] > 0), prefix), f["name"]))
            return let(joined, lambda j: F.when(looks_like_company(j), j).otherwise(f["name"]))

        def labelled() -> Column:
            marked = F.transform(fs, lambda f: is_label(f["x"]))
            near = lambda marks, f: F.exists(F.slice(marks, F.greatest(F.lit(1), f["i"] - 2), F.least(f["i"], F.lit(3))), lambda m: m)
            return let(marked, lambda marks: first_found(fs, "string", lambda f: F.when(near(marks, f), filled(company_candidate(f["x"])))))

        found = first_found(F.filter(fs, lambda f: f["pair"]), "struct<i:int,name:string>", legal)
        return let(found, lambda f: F.coalesce(F.when(f.isNotNull(), whole(f)), labelled()))

    return F.coalesce(named(), let(let(inner(), lines_of), by_lines), F.lit(NO_COMPANY))


def nearest_value(words: DataFrame, by: Sequence[str], label: str = "LIQUID", up: float = 10.0, down: float = 180.0, aside: float = 280.0) -> DataFrame:
    """(by, value): the amount nearest under the word that has `label`, of words(by, text, cx, cy).

    A band join within one page: downwards first, then sideways."""
    first = words.where(F.contains(normalize("text"), F.lit(label))).groupBy(*by).agg(F.min(F.struct("cy", "cx")).alias("at"))
    token = F.btrim(F.col("text"), F.lit("R$|:;()[]"))
    amounts = words.withColumn("value", token).where(token.rlike(r"^\d{1,3}(?:\.\d{3})*,\d{2}$"))
    dy, dx = F.col("cy") - F.col("at.cy"), F.abs(F.col("cx") - F.col("at.cx"))
    near = amounts.join(first, list(by)).where((dy >= -up) & (dy <= down) & (dx <= aside))
    return near.groupBy(*by).agg(F.min_by("value", F.struct(F.greatest(F.lit(0.0), dy.cast("double")), dx)).alias("value"))


def service_total(lines: Column | str, positioned: Column | None = None) -> Column:
    """Total of a service invoice: by position, as net value, on the service's row, or under a label of totals."""
    return _with_compact(lines, lambda ls, packed: _service_total(ls, packed, positioned))


def _service_total(ls: Column, packed: Column, positioned: Column | None) -> Column:
    net = first_match(ls, r"(?i)(?:VLR\s+LIQ(?:UIDO)?(?:\s+DUP)?|VALOR\s+LIQUIDO)\s*[:=]?\s*(?:R\$\s*)?([\d.]+[,.]\d{2})")
    net = let(net, lambda n: F.when(n.isNotNull(), format_number(parse_number(n), 2)))
    amounts = r"(?<!\d)(\d{1,3}(?:\.\d{3})*,\d{2})(?!\d)"
    on_row = first_of(F.transform(ls, lambda x: F.when(F.contains(normalize(x), F.lit("SERVICOS")), F.try_element_at(F.regexp_extract_all(x, F.lit(amounts), 1), F.lit(-1)))))

    def labelled() -> Column:
        def under(keys: Sequence[str], n: int) -> Column:
            spots = F.filter(F.transform(packed, lambda u, i: F.when(any_contained(u, keys), i)), lambda i: i.isNotNull())
            return first_of(F.transform(spots, lambda i: F.regexp_extract(F.array_join(_from(ls, i, n), " "), r"R\$\s*([\d.]+,\d{2,4})", 1)))

        def last(at: Column) -> Column:
            rest = F.when(at.isNotNull(), F.slice(packed, at + 2, F.size(ls))).otherwise(F.array().cast("array<string>"))
            block = _from(ls, at + 1, F.coalesce(first_index(rest, lambda u: F.contains(u, F.lit("INFORMACOESCOMPLEMENTARES"))), F.lit(17)))
            return F.try_element_at(F.flatten(F.transform(block, lambda x: F.regexp_extract_all(x, F.lit(amounts), 1))), F.lit(-1))

        return F.coalesce(under(("VALORDAOPERACAOSERVICO", "VALORDOSERVICO"), 7), under(("VALORTOTALDANFSE",), 10), let(first_index(packed, lambda u: F.contains(u, F.lit("VALORTOTALDANOTA"))), last))

    given = F.nullif(positioned, F.lit("")) if positioned is not None else F.lit(None).cast("string")
    return F.coalesce(given, net, on_row, labelled(), F.lit("-"))


def service_hours(lines: Column | str) -> Column:
    """Hours or quantity of a service invoice; 1 if it states none."""
    patterns = (r"(?<!\d)(\d+(?:[.,]\d+)?)\s*(?:HORAS|HORA|HRS|HR)(?![A-Z])", r"QUANTIDADE\s*[:=]?\s*(\d+(?:[.,]\d+)?)", r"(\d+(?:[.,]\d+)?)\s*(?:H|HH)\b")
    some = lambda n: F.when(n != 0, n)
    return let(normalize(F.array_join(_col(lines), " ")), lambda full: F.coalesce(*[let(parse_number(F.regexp_extract(full, p, 1)), some) for p in patterns], F.lit(1.0)))


def service_invoice(lines: Column | str, positioned: Column | None = None) -> Column:
    """struct(number, company, description, quantity, total): a service order's fields if it is one, else the invoice's."""
    return let(_col(lines), lambda ls: F.coalesce(service_order(ls), let(_compacted(ls), lambda packed: _service_invoice(ls, packed, positioned))))


def _service_invoice(ls: Column, packed: Column, positioned: Column | None) -> Column:
    labelled = F.array_join(
        F.slice(F.filter(section(ls, lambda u: any_contained(u, _SERVICE_LABEL + ("DETALHAMENTODOSERVICO",)), lambda u: any_contained(u, ("TRIBUTACAOMUNICIPAL", "TRIBUTACAOFEDERAL", "TRIBUTACAOIBSCBS", "VALORTOTALDANFSE", "VALORDAOPERACAOSERVICO")), packed=packed), lambda x: F.trim(x) != ""), 1, 7),
        " ",
    )
    named = lambda u: F.contains(u, F.lit("SERVICOS")) & ~F.contains(u, F.lit("NOTA FISCAL")) & (F.length(F.regexp_replace(u, "[^A-Z]", "")) >= 12)
    row = first_of(F.transform(ls, lambda x: F.when(let(normalize(x), named), F.btrim(F.regexp_replace(x, r"(?iu)\s+(?:SIM|N[AÃ]O)\s+\d+[,.]\d+\s+\d.*$", ""), F.lit(" |-_")))))
    described = collapse(F.coalesce(filled(_service_description(ls, packed)), filled(collapse(labelled)), row, F.lit(NO_SERVICE)))
    described = let(described, lambda d: F.when(d.rlike(r"(?i)\bRETIDO\b") & d.rlike(r"(?i)VALOR\s+TOTA"), F.trim(F.regexp_replace(d, r"(?is)^.*?VALOR\s+TOTA(?:L)?\s+", ""))).otherwise(d))
    described = collapse(F.regexp_replace(described, r"(?iu)^servi[cç]os?de", "serviço de "))
    return F.struct(_service_number(ls, packed).alias("number"), _service_provider(ls, packed).alias("company"), described.alias("description"), service_hours(ls).alias("quantity"), _service_total(ls, packed, positioned).alias("total"))


#: A budget's row, and the numbers at its end.
_BUDGET_ROW = r"(?iu)^([A-Z0-9][A-Z0-9._/-]{3,24})\s+(.+?)\s+(\d{8})\s+([A-ZÇ0-9²³]+)\s+(.+)$"
_BUDGET_NUMBER = r"\d(?<![\d/]\d)(?:\d{0,2}(?:\.\d{3})+|\d*)(?:,\d{2,4})(?!\d)"
#: Where quantity and price stand, cheapest first: the first two cost nothing, all others 1 at least.
_BUDGET_PLACES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (2, 5))


#: Rows of up to so many numbers are fitted without a higher-order function, if quantity and price stand in front.
_FEW_NUMBERS = 7


def _budget_fit(v: Column, q: int, u: int, total: Column, t: Column) -> Column:
    """What is wrong with a choice of quantity, price and total, and the choice; null where they don't fit."""
    quantity, price = F.get(v, q), F.get(v, u)
    diff = F.abs(quantity * price - total)
    good = (quantity > 0) & (price >= 0) & (diff <= F.greatest(F.lit(0.05), F.abs(total) * 0.003))
    cost = diff * 100 + q * 3 + max(0, u - 2)
    return F.when(good, F.struct(cost.alias("cost"), F.lit(q).alias("q"), F.lit(u).alias("u"), t.alias("t"), quantity.alias("quantity"), price.alias("unit_price"), total.alias("total"), F.get(v, 0).alias("pieces")))


def _budget_near(v: Column) -> Column:
    """The best choice of the places that cost nothing, of rows of few numbers; others may beat it if it costs 1 or more."""
    return F.least(*[_budget_fit(v, q, u, F.get(v, t), F.lit(t)) for q, u in _BUDGET_PLACES[:2] for t in range(u + 1, _FEW_NUMBERS)])


def _budget_best(v: Column) -> Column:
    """The best choice of a budget row's numbers; null where none fit."""

    def fits(q: int, u: int) -> Column:
        return F.array_min(F.transform(F.slice(v, u + 2, F.size(v)), lambda total, i: _budget_fit(v, q, u, total, i + u + 1)))

    near = F.least(*[fits(q, u) for q, u in _BUDGET_PLACES[:2]])
    return let(near, lambda b: F.when(b["cost"] < 1, b).otherwise(F.least(b, *[fits(q, u) for q, u in _BUDGET_PLACES[2:]])))


def _budget_numbers(found: Column) -> Column:
    """The numbers at a row's end, where there are enough. All have a decimal comma, and dots before it alone."""
    plain = F.replace(F.replace(F.array_join(found, " "), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(F.size(found) >= 5, F.split(plain, " ").cast("array<double>"))


def _budget_row(part: Column, b: Column) -> Column:
    fields = F.struct(part[0].alias("code"), F.trim(part[1]).alias("description"), part[2].alias("ncm"), part[3].alias("unit"), b["quantity"].alias("quantity"), b["unit_price"].alias("unit_price"), b["total"].alias("total"), b["pieces"].alias("pieces"))
    return F.when(b.isNotNull(), fields)


def budget_line(line: Column | str) -> Column:
    """struct(code, description, ncm, unit, quantity, unit_price, total, pieces) of a budget's row, else null.

    Of the row's numbers, quantity, price and total are the three in that order whose product fits best;
    quantity and price stand near the front. The first of equally good choices is taken."""

    def fields(part: Column) -> Column:
        numbers = let(F.regexp_extract_all(part[4], F.lit(_BUDGET_NUMBER), 0), _budget_numbers)
        return F.when(part.isNotNull(), let(let(numbers, _budget_best), lambda b: _budget_row(part, b)))

    return let(_groups(collapse(F.coalesce(_col(line), F.lit(""))), _BUDGET_ROW, 5), fields)


def with_budget_line(rows: DataFrame, line_col: str, name: str) -> DataFrame:
    """rows with budget_line() of a column in its place.

    Each step is a column of its own: compiled, where a Column's bound values are interpreted and copied."""
    kept = [c for c in rows.columns if c != line_col]
    flat = rows.select(*kept, F.coalesce(line_col, F.lit("")).alias("_line")).select(*kept, collapse("_line").alias("_line"))
    parts = flat.select(*kept, _split_groups(F.col("_line"), _BUDGET_ROW, 5).alias("_p"))
    found = parts.select(*kept, "_p", F.when(F.col("_p")[0] != "", F.regexp_extract_all(F.col("_p")[4], F.lit(_BUDGET_NUMBER), 0)).alias("_v"))
    near = found.select(*kept, "_p", _budget_numbers(F.col("_v")).alias("_v")).select(*kept, "_p", "_v", _budget_near(F.col("_v")).alias("_near"))
    near_best = (F.size("_v") <= _FEW_NUMBERS) & (F.col("_near")["cost"] < 1)
    fitted = near.select(*kept, "_p", F.when(near_best, F.col("_near")).when(F.col("_v").isNotNull(), _budget_best(F.col("_v"))).alias("_b"))
    # generated, so that filters aren't moved below and match once more
    return fitted.select(*kept, F.explode(F.array(_budget_row(F.col("_p"), F.col("_b")))).alias(name))


def order_total(text: Column | str) -> Column:
    """The amount labelled as the order's total; few texts have the label, and only those are matched."""
    amount = r"(?U)TOTAL\s+DO\s+PEDIDO\s+((?:[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+),[0-9]{2})"
    return let(folded(text), lambda u: F.when(F.contains(u, F.lit("PEDIDO")), parse_number(F.regexp_extract(u, amount, 1))))


def order_totals(pages: DataFrame, by: Sequence[str], text_col: str = "text") -> DataFrame:
    """(by, order_total): the order's total on the first page that states one."""
    return pages.select(*by, order_total(text_col).alias("t"), "page").where("t IS NOT NULL").groupBy(*by).agg(F.min_by("t", "page").alias("order_total"))


def budget_rows(pages: DataFrame, by: Sequence[str], text_col: str = "text") -> DataFrame:
    """(by, page, line_no, item's fields): all budget rows of some pages."""
    rows = pages.select(*by, "page", F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    return with_budget_line(rows, "line", "_b").where("_b IS NOT NULL").select(*by, "page", "line_no", "_b.*")


def budget_lines(pages: DataFrame, by: Sequence[str], text_col: str = "text") -> DataFrame:
    """budget_rows() with the order's total."""
    return budget_rows(pages, by, text_col).join(order_totals(pages, by, text_col), list(by), "left")


def arithmetic_confidence(quantity: Column, price: Column, total: Column) -> Column:
    """98 where quantity times price is the total, within five cents or three per mille, else 78."""
    return F.when(F.abs(quantity * price - total) <= F.greatest(F.lit(0.05), total * 0.003), 98.0).otherwise(78.0)


def section_rows(lines: DataFrame, by: Sequence[str], starts: Column, ends: Column, order: str = "line_no") -> DataFrame:
    """lines within sections, as rows: between a line that starts one and the next that ends it, both left out."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    last_start, last_end = F.max(F.when(starts, F.col(order))).over(w), F.max(F.when(ends, F.col(order))).over(w)
    marked = lines.withColumn("_s", last_start).withColumn("_e", last_end).withColumn("_here", starts | ends)
    return marked.where(F.col("_s").isNotNull() & ~F.col("_here") & (F.coalesce(F.col("_e"), F.lit(-1)) < F.col("_s"))).drop("_s", "_e", "_here")
