"""Queries over the star-schema and document tables, each with equivalent SQL.

The tables hold no fiscal text, so every operator runs with patterns and rules that fit them; the operators'
own fiscal patterns are covered by tests.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers, similarity, text
from ..operators import assemble, extract, modeljson, resolve, route, rules, segment
from ..sources import files
from ..sources.scratch import shared_folder, spread, tasks_for
from ..streaming import progress, runs

#: Narrow rows of a table that become pages, texts or documents in a task.
ROWS_PER_TASK = 100_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL of normalize() and normalize_description() for DuckDB, {} being the text.
_NORM = r"upper(trim(regexp_replace(replace(strip_accents(coalesce({}, '')), 'ß', 'SS'), '\s+', ' ', 'g')))"
_DESC = "trim(regexp_replace(" + _NORM + ", '[^A-Z0-9]+', ' ', 'g'))"
_STOPS = "(" + ", ".join(f"'{w}'" for w in text.STOP_TOKENS) + ")"
_TOKENS = "list_filter(regexp_extract_all(" + _NORM + ", '[A-Z0-9]+'), lambda t: len(t) >= 2 AND t NOT IN " + _STOPS + ")"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5, length({_NORM.format('text')}) AS norm_len, md5({_DESC.format('text')}) AS desc_md5, md5(replace({_DESC.format('text')}, ' ', '')) AS compact_md5 FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    n = text.normalize(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("norm_len"), F.md5(text.normalize_description("text")).alias("desc_md5"), F.md5(text.compact("text")).alias("compact_md5"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY token")
def informative_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens("text")).alias("token"))
    per_doc = found.groupBy("token", "doc_id").count()
    return per_doc.groupBy("token").agg(F.sum("count").alias("n"), F.count("*").alias("docs"))


@query(r"SELECT doc_id, array_to_string(ids[1:6], '|') AS ids, len(ids[1:6]) AS n FROM (SELECT doc_id, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS ids FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '\d+'), lambda x: len(x) = 16) AS ids FROM documents)) WHERE len(ids) > 0")
def id_extract_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "documents").select("doc_id", extract.distinct_matches("text", r"(?<!\d)\d{16}(?!\d)", 16, 6).alias("ids")).where(F.size("ids") > 0)
    return found.select("doc_id", F.array_join("ids", "|").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(r"""
WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS s FROM lineitem),
t AS (SELECT *, regexp_replace(s, ',?0+$', '') AS br FROM b)
SELECT l_orderkey, l_linenumber, br, replace(replace(s, '.', ''), ',', '.')::DOUBLE AS back, s AS money FROM t
""")
def money_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    full = F.translate(F.format_number(price, 2), ",.", ".,")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.format_number(price, 2).alias("br"), numbers.parse_number(full).alias("back"), numbers.money(F.concat(F.lit("R$ "), full)).alias("money"))


_NUMERIC_SQL = "SELECT l_orderkey, l_linenumber, 3::BIGINT AS n, round(sum(l_quantity + l_extendedprice + l_discount), 4) AS total FROM lineitem GROUP BY ALL"


@query(_NUMERIC_SQL)
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers found again in a line of text that was made from them."""
    price = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    line = F.concat(F.lit("QTD "), F.col("l_quantity").cast("int"), F.lit(" VALOR "), price, F.lit(" DESC 0,"), F.lpad((F.round(F.col("l_discount") * 100)).cast("int").cast("string"), 2, "0"))
    found = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.numeric_candidates(line).alias("v"))
    found = found.select("l_orderkey", "l_linenumber", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda s, x: s + numbers.parse_number(x)).alias("t"))
    return found.groupBy("l_orderkey", "l_linenumber", "n").agg(F.round(F.sum("t"), 4).alias("total"))


@query(_NUMERIC_SQL)
def numeric_tokens_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numeric_tokens under the name it had while that query left prices out."""
    return numeric_tokens(spark, sf_dir)


_LANGUAGE_RULES = rules.RuleSet(points={"EN": (("THE", 2), ("ION", 1), ("AND", 1)), "DE": (("SCH", 2), ("KEIT", 2), ("UND", 1)), "FR": (("EAU", 2), ("LES", 1), ("QUE", 1)), "ES": (("CION", 2), ("MENTE", 1), ("ADO", 1))}, patterns={"DE": ((r"\bDER\b", 2),)})


def _points(kind: str) -> str:
    keyed = " + ".join(f"CASE WHEN contains(u, '{k}') OR contains(c, '{k}') THEN {n} ELSE 0 END" for k, n in _LANGUAGE_RULES.points[kind])
    return keyed + "".join(f" + CASE WHEN regexp_matches(u, '{p}') THEN {n} ELSE 0 END" for p, n in _LANGUAGE_RULES.patterns.get(kind, ()))


def _holds(text_sql: str, keys) -> str:
    return "(" + " OR ".join(f"contains({text_sql}, '{k}')" for k in keys) + ")"


@query(f"""
WITH t AS (SELECT doc_id, u, replace({_DESC.format('text')}, ' ', '') AS c FROM (SELECT doc_id, text, {_NORM.format('text')} AS u FROM documents)),
s AS (SELECT *, {', '.join(f"{_points(k)} AS {k}" for k in _LANGUAGE_RULES.points)} FROM t),
b AS (SELECT *, greatest(EN, DE, FR, ES) AS best, list_sort([EN, DE, FR, ES], 'DESC')[2] AS second, {_holds('c', rules.OTHER_TITLES)} AS other, {_holds('c', rules.SERVICE_WORDS)} AS service,
             ({_holds('u', rules.TABLE_HEADS)} OR contains(c, '{rules.TABLE_CODE}')) AND {_holds('c', rules.TABLE_COLUMNS)} AS tab FROM s)
SELECT doc_id, CASE WHEN other THEN 'OUTRO' WHEN best >= 3 AND best >= second + 1 THEN CASE best WHEN EN THEN 'EN' WHEN DE THEN 'DE' WHEN FR THEN 'FR' ELSE 'ES' END
                    WHEN service AND NOT tab THEN 'NFSE' WHEN tab AND NOT service THEN 'NFE' ELSE 'OUTRO' END AS kind,
       CASE WHEN other THEN 98.0 WHEN best >= 3 AND best >= second + 1 THEN least(99.0, 55.0 + best * 6 + (best - second) * 5) WHEN service <> tab THEN 56.0 WHEN u = '' THEN 30.0 ELSE 42.0 END::DOUBLE AS confidence FROM b
""")
def rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages classified by rules of one's own: languages by their word parts."""
    found = rules.classify_pages(_table(spark, sf_dir, "documents").select("doc_id", "text"), rules=_LANGUAGE_RULES)
    return found.select("doc_id", "kind", F.col("kind_confidence").alias("confidence"))


_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in sorted(rules.HEADER_KEYWORDS)) + "]"


@query(f"""
SELECT doc_id, array_to_string(list_filter({_KEYWORDS}, lambda k: contains(c, k)), '|') AS tokens
FROM (SELECT doc_id, replace({_DESC.format('left(text, 5000)')}, ' ', '') AS c FROM documents)
""")
def header_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(rules.header_tokens("text"), "|").alias("tokens"))


@query("""
WITH b AS (SELECT source, doc_id, lang, coalesce(lang <> lag(lang) OVER w, true) AS starts FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
g AS (SELECT source, doc_id, lang, sum(starts::INT) OVER (PARTITION BY source ORDER BY doc_id) AS doc_index FROM b)
SELECT source, doc_index::BIGINT AS doc_index, min(lang) AS lang, count(*) AS pages, min(doc_id) AS first_page, max(doc_id) AS last_page FROM g GROUP BY source, doc_index
""")
def page_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    before = F.lag("lang").over(W.partitionBy("source").orderBy("doc_id"))
    grouped = segment.islands(docs.withColumn("starts", F.coalesce(F.col("lang") != before, F.lit(True))), F.col("starts"), "source", "doc_id")
    return grouped.groupBy("source", "doc_index").agg(F.min("lang").alias("lang"), F.count("*").alias("pages"), F.min("doc_id").alias("first_page"), F.max("doc_id").alias("last_page"))


_WORDS = "list_distinct(list_filter(regexp_extract_all(" + _NORM + ", '[A-Z0-9]{{3,}}'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")))"


@query(f"""
WITH t AS (SELECT source, doc_id, {_WORDS.format('text')} AS words FROM documents),
p AS (SELECT *, lag(words) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM t)
SELECT doc_id, round(CASE WHEN len(words) > 0 AND len(before) > 0 THEN len(list_intersect(words, before))::DOUBLE / len(list_distinct(list_concat(words, before))) ELSE 0 END, 6) AS similarity FROM p
""")
def jaccard_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", text.page_words(F.coalesce("text", F.lit(""))).alias("words"))
    before = docs.withColumn("before", F.lag("words").over(W.partitionBy("source").orderBy("doc_id")))
    return before.select("doc_id", F.round(F.coalesce(segment.jaccard(F.col("words"), F.col("before")), F.lit(0.0)), 6).alias("similarity"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, lag(list_transform(embedding, lambda x: x::DOUBLE)) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(CASE WHEN b IS NULL THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) / len(a)) END, 6) AS similarity FROM v
""")
def profile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    paired = rows.withColumn("b", F.lag("a").over(W.partitionBy("label").orderBy("vec_id")))
    return paired.select("vec_id", F.round(segment.profile_similarity(F.col("a"), F.col("b"), 1.0), 6).alias("similarity"))


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("doc_ix"), F.array(F.col("l_quantity").cast("int") % 6 + 1, F.col("l_linenumber").cast("int")).cast("array<string>").alias("pages"))
    return items, items.select("l_orderkey").distinct().withColumn("total_pages", F.lit(6))


_CLAIM_SQL = """
l AS (SELECT l_orderkey, l_linenumber AS doc_ix, 0 AS pos, l_quantity::INT % 6 + 1 AS page FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, l_linenumber FROM lineitem),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, page ORDER BY doc_ix, pos) AS n FROM l WHERE page BETWEEN 1 AND 6) WHERE n = 1)
"""


@query(f"WITH {_CLAIM_SQL} SELECT l_orderkey, doc_ix::INT AS doc_ix, page::INT AS page FROM c")
def page_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, totals = _claims(spark, sf_dir)
    return modeljson.claim_pages(items, totals, ["l_orderkey"]).select("l_orderkey", F.col("doc_ix").cast("int"), "page")


@query(f"WITH {_CLAIM_SQL} SELECT o.l_orderkey, p.page::INT AS page FROM (SELECT DISTINCT l_orderkey FROM lineitem) o, range(1, 7) AS p(page) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.l_orderkey = o.l_orderkey AND c.page = p.page)")
def unclaimed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, totals = _claims(spark, sf_dir)
    return modeljson.unclaimed_pages(modeljson.claim_pages(items, totals, ["l_orderkey"]), totals, ["l_orderkey"])


@query("""
WITH RECURSIVE p AS (SELECT conv_id, turn, (length(text) % 25 * 4)::DOUBLE AS c, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f(conv_id, n, doc, first_page, pages, conf) AS (
  SELECT conv_id, n, turn, turn, 1, c FROM p WHERE n = 1
  UNION ALL
  SELECT p.conv_id, p.n, CASE WHEN p.turn % 3 <> 0 THEN f.doc ELSE p.turn END, CASE WHEN p.turn % 3 <> 0 THEN f.first_page ELSE p.turn END,
         CASE WHEN p.turn % 3 <> 0 THEN f.pages + 1 ELSE 1 END, CASE WHEN p.turn % 3 <> 0 THEN (f.conf + p.c) / 2 ELSE p.c END
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.n = f.n + 1)
SELECT conv_id::VARCHAR AS file_id, first_page::INT AS first_page, max(pages)::INT AS pages, arg_max(conf, n) AS confidence FROM f GROUP BY conv_id, doc, first_page
""")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("int").alias("page"), (F.length("text") % 25 * 4).cast("double").alias("confidence"), F.lit("NFE").alias("document_type"), (F.col("turn") % 3 != 0).alias("is_continuation"),
    )
    merged = assemble.merge_pages(turns)
    return merged.select("file_id", F.col("pages")[0].alias("first_page"), F.size("pages").alias("pages"), "confidence")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("Código"), F.concat_ws(" ", "p_type", "p_name").alias("Descrição"), F.col("p_name").alias("Descrição longa"), F.col("p_brand").alias("Centro de Custo"), F.lpad(F.col("p_size").cast("string"), 8, "0").alias("Pos.IPI/NCM"))
    return files.prepare_catalog(raw, order="p_partkey")


@query("""
SELECT p_partkey AS idx, p_partkey::VARCHAR AS code, p_type || ' ' || p_name AS description, p_name AS description_extra, p_brand AS cost_centre, lpad(p_size::VARCHAR, 8, '0') AS ncm, upper(p_type || ' ' || p_name) AS match_text FROM part
""")
def catalog_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).select("idx", "code", "description", "description_extra", "cost_centre", "ncm", "match_text")


@query("""
WITH w AS (SELECT DISTINCT l_partkey FROM lineitem), i AS (SELECT l_partkey, upper(p_type || ' ' || p_name) AS q FROM w JOIN part ON p_partkey = l_partkey)
SELECT l_partkey::VARCHAR AS item_id, min(p_partkey) AS idx, count(DISTINCT p_partkey) AS n FROM i JOIN part ON q = upper(p_type || ' ' || p_name) OR q = upper(p_name) GROUP BY l_partkey
""")
def catalog_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose description is a catalog text: the equi-join that comes before any fuzzy one."""
    sold = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct().join(_table(spark, sf_dir, "part"), "p_partkey")
    items = sold.select(F.col("p_partkey").cast("string").alias("item_id"), F.concat_ws(" ", "p_type", "p_name").alias("description"), F.lit("").alias("ncm"))
    # equal descriptions meet equal texts: match each distinct one once
    kinds = items.select("description", "ncm").distinct().withColumn("item_id", F.col("description"))
    found = resolve.exact_candidates(kinds, _catalog(spark, sf_dir)).groupBy(F.col("item_id").alias("description")).agg(F.min("idx").alias("idx"), F.count("*").alias("n"))
    return items.join(found, "description").select("item_id", "idx", "n")


_LCS = """
WITH RECURSIVE n AS (SELECT DISTINCT p_name AS a FROM part), c AS (SELECT DISTINCT p_type || ' ' || p_name AS b FROM part),
p AS (SELECT upper(a) AS a, upper(b) AS b FROM n, c WHERE len(list_intersect(string_split(upper(a), ' '), string_split(upper(b), ' '))) > 0),
s AS (SELECT a, b, string_split(a, '') AS x, string_split(b, '') AS y FROM p UNION ALL
      SELECT a, b, string_split(array_to_string(list_sort(string_split(a, ' ')), ' '), ''), string_split(array_to_string(list_sort(string_split(b, ' ')), ' '), '') FROM p),
d AS (SELECT a, b, x, y, row_number() OVER () AS id FROM s),
r(id, a, b, x, y, i, v) AS (
  SELECT id, a, b, x, y, 0, list_transform(y, lambda z: 0) FROM d
  UNION ALL
  SELECT id, a, b, x, y, i + 1, list_transform(range(1, len(y) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(v[k], CASE WHEN y[k] = x[i + 1] THEN 1 + CASE WHEN k > 1 THEN v[k - 1] ELSE 0 END ELSE 0 END))))
  FROM r WHERE i < len(x))
"""


@query(_LCS + "SELECT a, b, round(max(score), 4) AS best, round(min(score), 4) AS least FROM (SELECT a, b, 200.0 * v[len(y)] / (len(x) + len(y)) AS score FROM r WHERE i = len(x)) GROUP BY a, b")
def catalog_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and sorted-token ratio of all names and catalog texts that share a token."""
    part = _table(spark, sf_dir, "part")
    names, rows = part.select(F.upper("p_name").alias("a")).distinct(), part.select(F.upper(F.concat_ws(" ", "p_type", "p_name")).alias("b")).distinct()
    left, right = names.select("a", F.explode(F.split("a", " ")).alias("block")), rows.select("b", F.explode(F.split("b", " ")).alias("block"))
    pairs = left.join(right, "block").select("a", "b").distinct()
    plain, by_token = similarity.ratio("a", "b"), similarity.token_sort_ratio("a", "b")
    scored = pairs.select("a", "b", plain.alias("r"), by_token.alias("t"))
    return scored.select("a", "b", F.round(F.greatest("r", "t"), 4).alias("best"), F.round(F.least("r", "t"), 4).alias("least"))


@query("""
SELECT o_orderkey::VARCHAR AS item_id, CASE WHEN c_custkey IS NULL THEN '' ELSE c_custkey::VARCHAR END AS code, coalesce(c_name, '-') AS catalog_description,
       CASE WHEN c_custkey IS NULL THEN 69.0 ELSE 90.0 END AS confidence FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2
""")
def service_code_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.concat(F.lit("cod. "), F.col("o_custkey") * 2).alias("service_code"), F.lit(90.0).alias("ocr_confidence"))
    catalog = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_custkey").cast("string").alias("code"), F.col("c_name").alias("description"))
    return resolve.correlate_services(items, catalog).select("item_id", "code", "catalog_description", "confidence")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity * p_retailprice - l_extendedprice) <= greatest(0.05, l_extendedprice * 0.003) THEN 98.0 ELSE 78.0 END AS confidence
FROM lineitem JOIN part ON p_partkey = l_partkey
""")
def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", extract.arithmetic_confidence(F.col("l_quantity"), F.col("p_retailprice"), F.col("l_extendedprice")).alias("confidence"))


@query("""
SELECT l_orderkey, l_linenumber, 'COD-' || l_partkey AS code, 'PECA ' || l_suppkey AS description, '84818099' AS ncm, 'UN' AS unit, l_quantity AS quantity, round(p_retailprice, 2) AS unit_price, round(l_quantity * round(p_retailprice, 2), 2) AS total
FROM lineitem JOIN part ON p_partkey = l_partkey
""")
def budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a budget's table, written as text and read again."""
    rows = spread(_table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p_retailprice"))
    br = lambda c: F.translate(F.format_number(c, 2), ",.", ".,")
    price = F.round("p_retailprice", 2)
    line = F.concat_ws(" ", F.concat(F.lit("COD-"), F.col("l_partkey")), F.concat(F.lit("PECA "), F.col("l_suppkey")), F.lit("84818099 UN"), br(F.col("l_quantity")), br(price), F.lit("5,00 12,00"), br(F.round(F.col("l_quantity") * price, 2)))
    # a generator computes the row once, however many of its fields are used
    return rows.select("l_orderkey", "l_linenumber", F.inline(F.array(extract.budget_line(line)))).where("code IS NOT NULL").drop("pieces")


@query("""
WITH w AS (SELECT user_id, min({'cy': epoch_us(ts) / 1e6, 'cx': value}) AS a FROM events WHERE event_type = 'error' GROUP BY user_id),
p AS (SELECT e.user_id, e.event_id % 1000 AS v, epoch_us(ts) / 1e6 - a.cy AS dy, abs(value - a.cx) AS dx FROM events e JOIN w ON e.user_id = w.user_id WHERE event_type = 'purchase')
SELECT user_id, min_by(v || ',00', {'a': greatest(0, dy), 'b': dx}) AS value FROM p WHERE dy BETWEEN -36000 AND 360000 AND dx <= 28 GROUP BY user_id
""")
def nearest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band join on events: for each user the purchase soonest after the first error, with a value near it."""
    events = _table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    words = events.select("user_id", seconds.alias("cy"), F.col("value").alias("cx"), F.when(F.col("event_type") == "error", "Valor líquido").otherwise(F.concat(F.lit("R$"), F.col("event_id") % 1000, F.lit(",00;"))).alias("text"))
    return extract.nearest_value(words, ["user_id"], up=36_000.0, down=360_000.0, aside=28.0)


@query("""
WITH r AS (SELECT p_brand, p_partkey, p_retailprice AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS pos FROM part),
b AS (SELECT *, max(score) OVER (PARTITION BY p_brand) AS best FROM r)
SELECT p_brand, array_to_string(list(p_partkey::VARCHAR ORDER BY pos)[1:5], ', ') AS codes
FROM b WHERE pos BETWEEN 1 AND 7 AND (score >= greatest(30, best - greatest(12, least(25, best * 0.30))) OR pos <= 2) GROUP BY p_brand
""")
def top_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    candidates = part.select(F.col("p_brand").alias("item_id"), F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("score"))
    catalog = part.select(F.col("p_partkey").alias("idx"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("description"))
    ranks = resolve.ranked(candidates, catalog)
    return ranks.select(F.col("item_id").alias("p_brand"), F.array_join(resolve.alternatives("ranked", F.lit(True)), ", ").alias("codes"))


_KINDS = ("view", "click", "purchase", "signup", "error")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY user_id")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.summary(_table(spark, sf_dir, "events"), "event_type", _KINDS, ["user_id"])


@query("""
WITH r AS (SELECT event_id, user_id, ts, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM events WHERE event_type IN ('error', 'purchase'))
SELECT event_id, user_id, (sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts RANGE BETWEEN INTERVAL 900 SECONDS PRECEDING AND CURRENT ROW))::BIGINT AS recent,
       sum((event_type = 'error')::INT) OVER (PARTITION BY user_id, run ORDER BY ts RANGE BETWEEN INTERVAL 900 SECONDS PRECEDING AND CURRENT ROW) < 10 AS allowed FROM r
""")
def throttle_900s(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = _table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase')")
    return progress.throttle(logins, "user_id", "ts", F.col("event_type") == "error").select("event_id", "user_id", F.col("recent").cast("long"), "allowed")


@query("SELECT event_id, floor(epoch(TIMESTAMP '2024-01-15 12:00:00')) - floor(epoch(ts)) <= 21600 AS live FROM events")
def ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz").cast("timestamp")
    return _table(spark, sf_dir, "events").select("event_id", numbers.is_live(F.col("ts").cast("timestamp"), now).alias("live"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS visit FROM conversations")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.round_robin(_table(spark, sf_dir, "conversations").withColumnRenamed("turn", "page"), "conv_id", "page").select("conv_id", F.col("page").alias("turn"), F.col("turn").alias("visit"))


@query("""
WITH f AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN turn % 8 ELSE 0 END AS n FROM conversations),
t AS (SELECT conv_id, turn, unnest(range(1, n + 2)) AS attempt FROM f)
SELECT conv_id, turn, attempt::INT AS attempt, row_number() OVER (PARTITION BY conv_id ORDER BY attempt, turn)::INT AS place,
       CASE WHEN attempt <= 5 THEN [0.0, 30.0, 90.0, 210.0, 390.0][attempt] ELSE 390.0 + 180.0 * (attempt - 5) END::DOUBLE AS not_before FROM t
""")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    failed = turns.where("role = 'assistant'").select("conv_id", "turn", (F.col("turn") % 8).alias("n"))
    return progress.queue_order(turns.select("conv_id", "turn"), failed, "conv_id", "turn")


@query("""
WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events WHERE event_type = 'error')
SELECT user_id, event_id, k::INT AS attempt, least(60.0, 5 * pow(2.0, k)) AS pause, ([30.0, 60.0, 120.0, 180.0])[least(k, 3) + 1]::DOUBLE AS requeue_delay,
       sum(([30.0, 60.0, 120.0, 180.0])[least(k, 3) + 1]) OVER (PARTITION BY user_id ORDER BY k)::DOUBLE AS elapsed FROM f
""")
def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses and delays of every user's errors in order."""
    errors = _table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", "ts")
    return progress.retry_schedule(errors, "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS since, max(value) AS progress, max(ts) AS at, count(*) AS events FROM events GROUP BY ALL")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily progress of every user, of the events read as a stream in update mode."""
    events = runs.read_files(spark, f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("progress"))
    return runs.updated(progress.progress_by_span(events, "user_id", "ts"), ["user_id", "since"], "progress")


@query("""
WITH a AS (SELECT user_id, date_trunc('millisecond', ts) AS ts, event_type = 'purchase' AS ok, event_id FROM events WHERE event_type IN ('error', 'purchase')),
b AS (SELECT *, lag(ok) OVER w AS ok_before, lag(ts) OVER w AS before, lead(ts) OVER w AS next FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum((before IS NULL OR ok_before OR ts - before >= INTERVAL 3 DAY)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b),
n AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id)::BIGINT AS failures FROM c),
d AS (SELECT *, ts + ([30, 60, 120, 180])[least(failures, 4)] * INTERVAL 1 SECOND AS due, coalesce(next, (SELECT max(ts) - INTERVAL 10 MINUTE FROM a)) AS seen FROM n)
SELECT user_id::VARCHAR AS page_key, CASE WHEN ok THEN 'completed' ELSE 'deferred' END AS kind, ts AS at, failures::INT AS failures, CASE WHEN NOT ok THEN due END AS due FROM d
UNION ALL SELECT user_id::VARCHAR, 'due', due, failures::INT, due FROM d WHERE NOT ok AND due <= seen
UNION ALL SELECT user_id::VARCHAR, 'dropped', ts + INTERVAL 3 DAY, failures::INT, NULL FROM d WHERE NOT ok AND ts + INTERVAL 3 DAY <= seen
""")
def retry_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases as failed and successful attempts of a user's page: deferred, due, dropped and completed."""
    events = runs.read_files(spark, f"{sf_dir}/events.parquet").where("event_type IN ('error', 'purchase')")
    attempts = events.select(F.col("user_id").cast("string").alias("page_key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("ok"))
    return runs.appended(progress.retry_queue(attempts, given_up=3 * 86_400_000), "queue")


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""
SELECT page_id, '{"documents": [{"pages": ["' || page_id || '"]}]}' AS json, NULL::VARCHAR AS error FROM pages WHERE page_id % 3 < 2
UNION ALL SELECT page_id, NULL, 'no valid analysis. Reason: LIMIT' FROM pages WHERE page_id % 3 = 2
""")
def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of both forms, one with code fences, and blocked ones."""
    answer = F.concat(F.lit('{"documents": [{"pages": ["'), F.col("page_id"), F.lit('"]}]}'))
    part = F.struct(F.lit("text").alias("type"), answer.alias("text"))
    steps = F.to_json(F.struct(F.array(F.struct(F.lit("model_output").alias("type"), F.array(part).alias("content"))).alias("steps")))
    fenced = F.struct(F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("text"))
    candidates = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(fenced).alias("parts")).alias("content"))).alias("candidates")))
    rows = _table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, steps).when(F.col("page_id") % 3 == 1, candidates).otherwise('{"promptFeedback": {"blockReason": "LIMIT"}}').alias("response"))
    return modeljson.parse_responses(rows, "page_id", "response")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def progress_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest_state(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value", "ts"])


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
n AS (SELECT *, {_DESC.format('line')} AS norm FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY line_no) AS r FROM n WHERE norm <> '')
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY line_no)) AS lines_md5, count(*) AS n FROM k WHERE r = 1 GROUP BY doc_id
""")
def line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _table(spark, sf_dir, "documents").select("doc_id", extract.distinct_lines(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines")).where(F.size("lines") > 0)
    return kept.select("doc_id", F.md5(F.array_join("lines", "\n")).alias("lines_md5"), F.size("lines").cast("long").alias("n"))


@query(r"""
WITH t AS (SELECT page_id, string_split(replace(replace(html, '</p>', chr(10)), '<p>', chr(10)), chr(10)) AS ls FROM pages),
b AS (SELECT page_id, ls, list_position(list_transform(ls, lambda x: contains(x, '<article>')), true) AS s FROM t),
e AS (SELECT page_id, ls, s, list_position(list_transform(ls[s + 1:], lambda x: contains(x, '</article>')), true) AS n FROM b)
SELECT page_id, len(ls[s + 1:s + coalesce(n, len(ls)) - 1]) AS n, md5(array_to_string(ls[s + 1:s + coalesce(n, len(ls)) - 1], chr(10))) AS body_md5 FROM e WHERE s > 0
""")
def section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page between the start and the end of its article."""
    lines = F.split(F.regexp_replace("html", "</?p>", "\n"), "\n")
    pages = _table(spark, sf_dir, "pages").select("page_id", lines.alias("ls")).where(F.exists("ls", lambda x: F.contains(x, F.lit("<article>"))))
    body = extract.section(F.col("ls"), lambda u: F.contains(u, F.lit("ARTICLE")) & ~F.contains(u, F.lit("DIVARTICLEEND")), lambda u: F.contains(u, F.lit("ARTICLEFOOTER")))
    return pages.select("page_id", F.size(body).cast("long").alias("n"), F.md5(F.array_join(body, "\n")).alias("body_md5"))


@query("SELECT conv_id, round(avg(length(role) * 10) * (0.65 + 0.35 * least(1.0, sum(length(text)) / 120.0)), 2) AS score FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def ocr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "conversations").where(F.trim("text") != "")
    return words.groupBy("conv_id").agg(numbers.reading_score(F.avg(F.length("role") * 10), F.sum(F.length("text"))).alias("score"))


@query("""
WITH c AS (SELECT d.doc_id, (d.n_chars % 101)::DOUBLE AS ocr, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN ocr >= 81 THEN 'Alta' WHEN ocr >= 70 THEN 'Revisar' WHEN ocr >= 50 THEN 'Baixa' ELSE 'Muito baixa' END AS band,
       CASE WHEN ocr < 50 THEN 'red' WHEN ocr < 70 THEN 'orange' WHEN ocr <= 80 THEN 'yellow' END AS fill,
       least(100, greatest(45, CASE WHEN ocr > 0 THEN ocr ELSE 96 END + CASE WHEN quality IS NULL THEN -15 ELSE 5 END)) AS described FROM c
""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("ocr", (F.col("n_chars") % 101).cast("double"))
    return docs.select("doc_id", numbers.confidence_band("ocr").alias("band"), numbers.sheet_band("ocr").alias("fill"), numbers.description_confidence("ocr", F.col("quality").cast("string")).alias("described"))


@query("""
SELECT doc_id, lang, source, NULL::VARCHAR AS notice FROM documents WHERE lang = 'de'
UNION ALL SELECT NULL, NULL, NULL, 'Sem registros' WHERE NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'xx')
""")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without internal columns, and the notice that stands for a table without rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit("x").alias("notes"), F.lit(1).alias("_hidden"))
    some, none = (route.or_placeholder(route.sanitize(docs.where(F.col("lang") == lang), export=True)) for lang in ("de", "xx"))
    return some.unionByName(none)


@query("""
WITH t(name, k) AS (VALUES ('nfe', 0), ('nfse', 1), ('cte', 2), ('outros', 3), ('orcamento', 9)),
o AS (SELECT o_orderkey % 4 AS k, o_orderkey, o_totalprice FROM orders)
SELECT t.name AS "table", count(o_orderkey) AS n_rows, CASE WHEN t.name = 'outros' THEN 4 ELSE 3 END AS n_columns, CASE WHEN count(o_orderkey) = 0 THEN 'Sem registros' END AS notice, sum(o_orderkey)::BIGINT AS keys
FROM t LEFT JOIN o ON o.k = t.k GROUP BY t.name
""")
def export_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five review tables exported together and read back by the manifest; one of them has no rows."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("kind"), "o_totalprice", F.lit("n").alias("notes"), F.lit(1).alias("_hidden"))
    path = shared_folder(spark, "export")
    route.export_tables({name: orders.where(F.col("kind") == k) for k, name in ((0, "nfe"), (1, "nfse"), (2, "cte"), (3, "outros"), (9, "orcamento"))}, path)
    found = [
        rows.agg(F.count("o_orderkey").alias("n_rows"), F.max("notice").alias("notice"), F.sum("o_orderkey").alias("keys")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(rows.columns)).alias("n_columns"), "notice", "keys")
        for name, rows in route.exported(spark, path).items()
    ]
    return reduce(DataFrame.union, found)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' || c_nationkey ELSE c_mktsegment END AS code, CASE WHEN c_custkey % 10 = 0 THEN n_name ELSE c_name END AS catalog_description,
       CASE WHEN c_custkey % 10 = 0 THEN 90.0 ELSE 50.0 END AS code_confidence, 77.0 AS number_confidence
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results applied to review rows: codes replaced, confidences raised, other confidences kept."""
    customers = _table(spark, sf_dir, "customer")
    rows = customers.select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("code"), F.col("c_name").alias("catalog_description"), F.create_map(F.lit("code"), F.lit(50.0), F.lit("number"), F.lit(77.0)).alias("confidences"))
    nations = _table(spark, sf_dir, "nation")
    found = rows.where(F.col("c_custkey") % 10 == 0).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit("NEW"), F.col("c_nationkey")).alias("code"), F.col("n_name").alias("description"), F.lit("").alias("cost_centre"))
    done = route.apply_catalog(rows, found, "c_custkey", 90.0)
    return done.select("c_custkey", "code", "catalog_description", F.col("confidences")["code"].alias("code_confidence"), F.col("confidences")["number"].alias("number_confidence"))


@query("SELECT p_brand || ' x' AS asked, min(p_partkey) AS idx FROM part GROUP BY p_brand UNION ALL SELECT 'none', NULL")
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes found whatever their punctuation."""
    part = _table(spark, sf_dir, "part")
    catalog = part.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("code"), F.col("p_name").alias("description"), F.lit("").alias("cost_centre"), F.lit("").alias("ncm"))
    asked = part.select(F.concat("p_brand", F.lit(" x")).alias("asked"), F.lower(F.regexp_replace("p_brand", "#", "-")).alias("code")).distinct().union(spark.range(1).select(F.lit("none"), F.lit("none")))
    return resolve.lookup_codes(asked, catalog).select("asked", F.col("row.idx").alias("idx"))


@query("""
WITH w AS (SELECT conv_id, turn, role, length(text) AS x, (turn * 7) AS y FROM conversations)
SELECT conv_id::VARCHAR AS file_id, count(*) AS n_rows, max(m) AS widest FROM (SELECT conv_id, turn // 2 AS r, count(*) AS m FROM w GROUP BY ALL) GROUP BY conv_id
""")
def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns laid out as words, two to a row."""
    words = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), F.lit(1).alias("page"), F.concat(F.lit("w"), F.col("turn")).alias("text"), (F.col("turn") % 2 * 50).cast("int").alias("left"), F.expr("cast(turn div 2 AS int) * 40").alias("top"), F.lit(30).alias("width"), F.lit(10).alias("height"))
    rows = assemble.word_rows(words)
    return rows.groupBy("file_id").agg(F.count("*").alias("n_rows"), F.max(F.size(F.split("text", " "))).cast("long").alias("widest"))


@query("SELECT token, username, name FROM (SELECT o_orderkey AS token, o_custkey AS username, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate > TIMESTAMP '2001-01-01')")
def signed_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("username"), F.col("o_orderdate").alias("expires_at"))
    users = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("username"), F.col("c_name").alias("name"))
    return files.signed_in(sessions, users, F.lit("2001-01-01").cast("timestamp_ntz"))


@query()
def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages classified, signed, grouped and labelled from end to end."""
    pages = _table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").cast("int").alias("page"), "text")
    # few sources have all pages: files are dealt in ranges
    grouped = segment.group_pages(segment.page_signatures(pages), range_pages=1000, keep=["kind", "kind_confidence"])
    return segment.segment_documents(grouped).select("file_id", "doc_index", F.size("pages").alias("n_pages"), "kind", "confidence", "label")


# Round trips: documents are written as text from the tables' rows, read again, and compared with the rows.


def _br(c: str) -> Column:
    return F.translate(F.format_number(c, 2), ",.", ".,")


_TAX = "lpad((c_custkey + 10000000)::VARCHAR, 14, '7')"


@query(f"SELECT c_custkey, {_TAX} AS tax_id, lpad((c_custkey + 5)::VARCHAR, 44, '3') AS access_key, (c_custkey + 1000)::VARCHAR AS number FROM customer")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax, key = F.lpad((F.col("c_custkey") + 10_000_000).cast("string"), 14, "7"), F.lpad((F.col("c_custkey") + 5).cast("string"), 44, "3")
    written = F.regexp_replace(tax, r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", "$1.$2.$3/$4-$5")
    line = F.concat(F.lit("NF-e Nº: "), F.col("c_custkey") + 1000, F.lit(" CNPJ "), written, F.lit(" CHAVE "), F.regexp_replace(key, r"(\d{4})(?=\d)", "$1 "), F.lit(" ."))
    found = _table(spark, sf_dir, "customer").select("c_custkey", line.alias("t"))
    return found.select("c_custkey", extract.tax_ids("t")[0].alias("tax_id"), extract.access_keys("t")[0].alias("access_key"), F.get(F.filter(extract.number_candidates("t"), lambda x: F.length(x) >= 4), F.lit(0)).alias("number"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS number, c_name || ' LTDA' AS company FROM orders JOIN customer ON c_custkey = o_custkey")
def transport_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    lines = F.array(F.lit("DACTE"), F.concat(F.lit("CT-e Nº "), F.col("o_orderkey")), F.lit("Dados do emitente"), F.lit("Rua 1"), F.concat("c_name", F.lit(" LTDA  CNPJ 1")))
    return rows.select("o_orderkey", F.inline(F.array(extract.transport_document(lines))))


@query("SELECT l_orderkey, l_linenumber, 'C' || l_partkey AS code, 'PECA ' || l_suppkey AS description, '84818099' AS ncm, 'UN' AS unit, l_quantity::INT || ',000' AS quantity FROM lineitem")
def goods_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item rows of whole invoices, an invoice per order."""
    line = F.concat_ws(" ", F.concat(F.lit("C"), F.col("l_partkey")), F.concat(F.lit("PECA "), F.col("l_suppkey")), F.lit("8481.80.99 060 5102 UN"), F.concat(F.col("l_quantity").cast("int"), F.lit(",000")), _br("l_extendedprice"))
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # numbers are dealt, not texts, and over tasks that grow with them; then an order's rows lie together
    dealt = items.repartition(tasks_for(items, ROWS_PER_TASK), "l_orderkey")
    # written by compiled code: what is inside collect_list() is interpreted
    written = dealt.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.explode(F.array(line)).alias("t"))
    orders = written.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "t"))).alias("items"))
    head, tail = F.array(F.lit("DANFE"), F.lit("X1 FORA 84818099 060 5102 UN 1,000"), F.lit("Dados dos produtos")), F.array(F.lit("Dados adicionais"), F.lit("X2 FORA 84818099 060 5102 UN 1,000"))
    invoices = orders.select("l_orderkey", F.col("items.l_linenumber").alias("numbers"), F.concat(head, F.col("items.t"), tail).alias("lines"))
    found = extract.goods_item_rows(invoices, ["l_orderkey", "numbers"])
    return found.select("l_orderkey", F.get("numbers", F.col("line_no") - F.size(head)).alias("l_linenumber"), "code", "description", "ncm", "unit", "quantity")


_SERVICE_SQL = """
SELECT o_orderkey, (o_orderkey + 1000)::VARCHAR AS number, replace(c_name, '#', ' ') || ' SERVICOS LTDA' AS company, 'manutencao ' || lower(c_mktsegment) AS description,
       (1 + o_orderkey % 9)::DOUBLE AS quantity, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS total
FROM orders JOIN customer ON c_custkey = o_custkey
"""


@query(_SERVICE_SQL)
def service_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _service_invoices(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer"))


@query(_SERVICE_SQL)
def service_invoices_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service_invoices under the name it had while that query left orders out."""
    return service_invoices(spark, sf_dir)


def _service_invoices(orders: DataFrame, customers: DataFrame) -> DataFrame:
    # texts are written and read in a task: over tasks that grow with the table
    named = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")
    rows = named.repartition(tasks_for(orders, ROWS_PER_TASK))
    lines = F.array(
        F.lit("DANFSe v1.0"), F.lit("Número da NFS-e"), F.concat(F.col("o_orderkey") + 1000, F.lit(" 01/02/2025")), F.lit("PRESTADOR DO SERVIÇO"), F.lit("Nome / Razão Social"), F.concat(F.translate("c_name", "#", " "), F.lit(" SERVICOS LTDA")), F.lit("TOMADOR DO SERVIÇO"), F.lit("OUTRA EMPRESA LTDA"),
        F.lit("SERVIÇO PRESTADO"), F.lit("Descrição do Serviço"), F.concat(F.lit("manutencao "), F.lower("c_mktsegment")), F.lit("TRIBUTAÇÃO MUNICIPAL"), F.concat(F.lit("Quantidade: "), 1 + F.col("o_orderkey") % 9), F.lit("VALOR TOTAL DA NFS-E"), F.concat(F.lit("R$ "), _br("o_totalprice")),
    )
    return rows.select("o_orderkey", F.inline(F.array(extract.service_invoice(lines))))


@query("SELECT p_partkey, upper(p_brand) AS raw_code, upper(replace(p_brand, '#', '')) AS plain_code, upper(replace(p_brand, '#', '')) AS identity, regexp_replace(p_brand, '\\D', '', 'g') AS digits, 'nota_' || p_partkey || '-1.pdf' AS file FROM part")
def code_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    forms = text.code_variants("p_brand")
    return part.select("p_partkey", forms[0].alias("raw_code"), forms[1].alias("plain_code"), text.identity("p_brand").alias("identity"), text.digits("p_brand", 8).alias("digits"), text.ascii_filename(F.concat(F.lit("nota#"), F.col("p_partkey"), F.lit("–1.pdf"))).alias("file"))


@query("SELECT c_custkey, c_name AS cleaned, c_custkey % 2 = 0 AS legal, CASE c_custkey % 3 WHEN 0 THEN 'lido: leitura automática ' || c_name WHEN 1 THEN 'leitura automática, ' || c_name ELSE '-' END AS public FROM customer")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("c_custkey") % 2 == 0
    line = F.concat(F.lit("  : "), "c_name", F.lit(" | CNPJ: 12.345 x"))
    n = F.col("c_custkey") % 3
    public = text.public_text(F.when(n == 0, F.concat(F.lit(" lido:   IA\n"), "c_name")).when(n == 1, F.concat(F.lit("Inteligência Artificial, "), "c_name")), fallback="-")
    named = F.concat("c_name", F.when(even, F.lit(" S/A.")).otherwise(F.lit(" COMERCIO")))
    return _table(spark, sf_dir, "customer").select("c_custkey", text.clean_company(line).alias("cleaned"), text.looks_like_company(named).alias("legal"), public.alias("public"))


@query("SELECT conv_id, arg_max(role, (length(text), turn)) AS role, max(length(text)) AS n FROM conversations GROUP BY conv_id")
def best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of several readings, all equally sure but for their number."""
    readings = _table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role").alias("variant"), F.lit(80.0).alias("confidence"), "text", "turn")
    longest = readings.withColumn("text", F.concat("text", F.lit(" ")))  # all alike longer
    best = assemble.best_reading(longest, ["conv_id"])
    return best.select("conv_id", F.col("variant.role").alias("role"), (F.length("text") - 1).cast("long").alias("n"))


@query("""
WITH w AS (SELECT user_id, event_id, value, epoch_us(ts) // 86400000000 AS line FROM events WHERE value >= 0),
l AS (SELECT user_id, line, min(event_id) AS top, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) AS t, sum(value) AS c, count(*) AS n, sum(length(event_id::VARCHAR)) AS chars FROM w GROUP BY user_id, line)
SELECT user_id, count(*) AS n_lines, md5(string_agg(t, chr(10) ORDER BY top)) AS lines_md5, round(sum(c) / sum(n) * (0.65 + 0.35 * least(1.0, sum(chars) / 120.0)), 0) AS score FROM l GROUP BY user_id
""")
def reader_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as words: a line per user and day, in order of their identifiers."""
    day = F.expr("cast(unix_micros(cast(ts AS timestamp)) div 86400000000 AS int)")
    words = _table(spark, sf_dir, "events").where("value >= 0").select("user_id", F.lit(1).alias("block"), F.lit(1).alias("par"), day.alias("line"), F.col("event_id").alias("left"), F.col("event_id").alias("top"), F.col("event_id").cast("string").alias("text"), F.col("value").alias("confidence"))
    read = assemble.reader_lines(words, ["user_id"], decimals=0)
    return read.select("user_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("lines_md5"), "score")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "orders").select("o_orderkey", F.lit("NFSE").alias("document_type"), F.col("o_custkey").cast("string").alias("service_code"))
    codes = resolve.catalog_codes(_table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("idx"), F.col("c_custkey").cast("string").alias("code")))
    return modeljson.needs_second_stage(documents, codes).select("o_orderkey")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'E' || c_custkey WHEN c_custkey % 3 = 1 THEN 'P' || c_nationkey ELSE 'x' END AS code,
       CASE WHEN c_custkey % 3 = 1 THEN 88.0 ELSE 50.0 END AS confidence FROM customer
""")
def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows edited by hand, then candidates accepted."""
    customers = _table(spark, sf_dir, "customer")
    rows = customers.select("c_custkey", F.lit("x").alias("code"), F.col("c_name").alias("catalog_description"), F.lit(50.0).alias("confidence"), F.create_map(F.lit("number"), F.lit(1.0)).alias("confidences"))
    edits = customers.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("E"), F.col("c_custkey")).alias("code"))
    picked = customers.where("c_custkey % 3 = 1").select("c_custkey", F.concat(F.lit("P"), F.col("c_nationkey")).alias("code"), F.lit("d").alias("description"), F.lit(88.0).alias("score"))
    done = route.accept_candidates(route.edit_rows(rows, edits, "c_custkey", ["code"]), picked, "c_custkey")
    return done.select("c_custkey", "code", "confidence")


@query("""
WITH t AS (SELECT user_id, event_id, value, CASE event_type WHEN 'click' THEN 'edit' WHEN 'signup' THEN 'accept' ELSE 'search' END AS kind FROM events WHERE event_type IN ('click', 'signup', 'view')),
c AS (SELECT user_id, arg_max(CASE kind WHEN 'edit' THEN 'E' WHEN 'accept' THEN 'A' ELSE 'S' END || event_id, event_id) FILTER (kind <> 'edit' OR event_id % 2 = 0) AS code,
             arg_max(CASE kind WHEN 'edit' THEN 'E' ELSE 'D' END || event_id, event_id) FILTER (kind <> 'edit' OR event_id % 2 = 1) AS catalog_description,
             arg_max(CASE kind WHEN 'accept' THEN value ELSE 90.0 END, event_id) FILTER (kind <> 'edit') AS code_score, arg_max(CASE kind WHEN 'accept' THEN value ELSE 95.0 END, event_id) FILTER (kind <> 'edit') AS description_score FROM t GROUP BY user_id)
SELECT u.user_id, coalesce(code, 'x') AS code, coalesce(catalog_description, 'y') AS catalog_description, coalesce(code_score, 50.0) AS code_score, coalesce(description_score, 95.0) AS description_score
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c ON u.user_id = c.user_id
""")
def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows after a log of edits, accepted candidates and search results in which many touch the same row."""
    events = _table(spark, sf_dir, "events")
    rows = events.select("user_id").distinct().select("user_id", F.lit("x").alias("code"), F.lit("y").alias("catalog_description"), F.create_map(F.lit("code"), F.lit(50.0), F.lit("catalog_description"), F.lit(95.0)).alias("confidences"))
    kind = F.when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "signup", "accept").otherwise("search")
    log = events.where("event_type IN ('click', 'signup', 'view')").select(
        "user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, "code").otherwise("catalog_description").alias("field"), F.concat(F.upper(F.substring(kind, 1, 1)), "event_id").alias("value"),
        F.concat(F.lit("D"), "event_id").alias("description"), F.when(kind == "accept", F.col("value")).alias("score"),
    )
    done = route.replay_changes(rows, log, "user_id", ["code", "catalog_description"])
    return done.select("user_id", "code", "catalog_description", F.col("confidences")["code"].alias("code_score"), F.col("confidences")["catalog_description"].alias("description_score"))


@query("""
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'signup') > 20 THEN 'a' ELSE 'b' END AS seed,
       CASE WHEN count(*) FILTER (event_type = 'purchase' AND value > 60) > 0 THEN 'big' WHEN count(*) > 0 THEN 'small' END AS active
FROM events GROUP BY user_id
""")
def active_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when((F.col("event_type") == "purchase") & (F.col("value") > 60), "big").otherwise("small")
    events = _table(spark, sf_dir, "events").withColumn("kind", kinds)
    counts = route.active_tab(route.summary(events, "kind", ["big", "small"], ["user_id"]), ["big", "small"])
    signups = route.summary(events, "event_type", ["signup"], ["user_id"])
    return counts.join(signups, "user_id").select("user_id", route.search_seed(F.when(F.col("signup") > 20, "a").otherwise("  "), F.lit("b")).alias("seed"), "active")


@query("""
WITH n AS (SELECT o_custkey, o_orderpriority AS line FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_custkey, upper(o_orderpriority) AS line FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_custkey, 0 AS part, count(*) AS n FROM n GROUP BY o_custkey
UNION ALL SELECT o_custkey, 1, count(*) FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = r.o_custkey AND n.line = r.line) GROUP BY o_custkey
""")
def merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    native = orders.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderpriority").alias("line"))
    read = orders.where("o_orderkey % 2 = 1").select("o_custkey", F.lower("o_orderpriority").alias("line"))
    merged = route.merge_lines(native, read, ["o_custkey"], text.normalize("line"))
    return merged.groupBy("o_custkey", "part").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_partkey % 5 AS code, l_suppkey % 2 AS kind, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL")
def distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Peça  nº "), F.col("l_suppkey") % 2)).otherwise(F.concat(F.lit("PECA Nº"), F.lit(" "), F.col("l_suppkey") % 2))
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("code"), (F.col("l_suppkey") % 2).alias("kind"), described.alias("description"))
    return assemble.distinct_items(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "code", "kind", "l_linenumber")


@query("SELECT o_custkey, count(*) AS page_count, count(*) FILTER (n <= 2) AS kept FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey")
def subset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two pages of every file, and how many it has."""
    pages = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"))
    counts = files.page_counts(pages)
    wanted = counts.select("file_id", F.col("file_id").alias("document_id"), F.array(F.lit(1), F.lit(2), F.lit(0)).alias("pages"))
    kept = files.subset_pages(pages, wanted).groupBy("file_id").agg(F.count("*").alias("kept"))
    return counts.join(kept, "file_id").select(F.col("file_id").alias("o_custkey"), "page_count", "kept")
