"""Mixing sources to target weights, in DataFrame functions only.

The token budget flows down a domain - language - source tree. At every node the children share their
parent's budget by weight; a child that can't use its share (its tokens times max_epochs) is filled up
and the rest goes to its siblings, so a shortage leaves a subtree only once the whole subtree is used up.
Each leaf then takes whole epochs, plus the token-prefix of one more epoch whose order is seeded.

The prefix is found without sorting a leaf as a whole: tokens are summed per leaf and hash bucket, and
only the bucket in which the budget ends is ordered row by row.

Defined results: null languages or sources form a leaf of their own ("?"); null texts have no tokens; rows
with equal ids (nulls among them) are taken or left together; a leaf without tokens gives no rows; empty
tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, prepare, small, stage

SEED = 42
LEVELS = ("_domain", "_lang", "_source")
_BIG = "decimal(38,0)"
#: Hex digits of the order key that number a leaf's buckets: 4096 of them.
BUCKET_DIGITS = 3

DOMAIN_SQL = "CASE coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'forum' END"
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forum": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}


def _weight(col: Column, weights: Mapping[str, int] | None) -> Column:
    return reduce(lambda rest, kv: F.when(col == kv[0], F.lit(kv[1])).otherwise(rest), (weights or {}).items(), F.lit(1)).cast("long")


def leaf_columns(domain_sql: str, lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("?")).alias(n) for c, n in zip((F.expr(domain_sql), F.col(lang_col), F.col(source_col)), LEVELS, strict=True)]


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes with `alloc`: each parent's `budget` shared among its rows by `weight`, none above its `cap`.

    Rows are filled up in the order of cap / weight until what is left, shared by weight, suits all others."""
    keys = [F.col(c) for c in parent]
    order = W.partitionBy(*keys).orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc())
    filled = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(_BIG)
    waiting = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)).cast("decimal(18,0)")
    judged = nodes.withColumn("_filled", filled).withColumn("_waiting", waiting)
    judged = judged.withColumn("_full", F.expr("cast(cap AS decimal(20,0)) * _waiting <= cast(budget - _filled AS decimal(20,0)) * cast(weight AS decimal(18,0))"))
    whole = W.partitionBy(*keys)
    judged = judged.withColumn("_used", F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole)).withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(whole))
    alloc = F.expr("CASE WHEN _full THEN cap ELSE (cast(budget - _used AS decimal(20,0)) * cast(weight AS decimal(18,0))) div cast(_open AS decimal(18,0)) END").cast("long")
    return judged.withColumn("alloc", alloc).drop("_filled", "_waiting", "_full", "_used", "_open")


def leaf_budgets(leaves: DataFrame, percent: int, max_epochs: int, weights: tuple[Mapping[str, int] | None, ...]) -> DataFrame:
    """leaves(_domain, _lang, _source, tokens) with alloc, full (whole epochs) and rest (tokens of one more)."""
    capped = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    total = leaves.select(F.expr(f"cast(sum(tokens) AS decimal(30,0)) * {percent} div 100").alias("budget"), F.lit(1).alias("_all"))
    parent: list[str] = ["_all"]
    budgets = total
    for depth, level in enumerate(LEVELS):
        down = list(LEVELS[: depth + 1])
        nodes = capped.groupBy(*down).agg(F.sum("cap").alias("cap")).withColumn("_all", F.lit(1)).withColumn("weight", _weight(F.col(level), weights[depth]))
        shared = share_out(nodes.join(budgets, parent), parent, level)
        budgets = shared.select(*down, F.col("alloc").alias("budget"))
        parent = down
    plan = leaves.join(budgets, list(LEVELS)).withColumnRenamed("budget", "alloc").where("tokens > 0 AND alloc > 0")
    return plan.withColumn("full", F.expr("alloc div tokens")).withColumn("rest", F.expr("alloc % tokens"))


def _order_key(seed: int, epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit("null"))))


def mix(
    docs: DataFrame,
    percent: int = 50,
    max_epochs: int = 3,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain_sql: str = DOMAIN_SQL,
    weights: tuple[Mapping[str, int] | None, ...] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, None),
) -> DataFrame:
    """docs, once for each epoch that takes it, with a column `epoch` counted from 0 (one of that name is replaced).

    percent: the budget, in hundredths of the input's tokens (words)."""
    prepare(docs.sparkSession)
    leaf = leaf_columns(domain_sql, lang_col, source_col)
    tokens = stage(docs.select(F.col(id_col).alias("_id"), *leaf, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens")), "tokens")
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = stage(leaf_budgets(stage(leaves, "leaves"), percent, max_epochs, weights), "leaf-budgets")

    rows = tokens.join(small(plan.select(*LEVELS, "full", "rest")), list(LEVELS)).withColumn("key", _order_key(seed, F.col("full"), F.col("_id")))
    rows = rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = rows.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    run = W.partitionBy(*LEVELS).orderBy("bucket")
    ends = buckets.withColumn("upto", F.sum("tokens").over(run)).where("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", F.expr("rest - (upto - tokens) AS left")), "bucket").alias("end"))
    ends = stage(ends.select(*LEVELS, F.col("end.bucket").alias("bucket"), F.col("end.left").alias("left")), "prefix-ends")
    within = rows.join(small(ends), [*LEVELS, "bucket"])
    taken = within.withColumn("upto", F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("key"))).where("upto <= left")
    last = taken.groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    # keys up to the cut are taken; the bucket alone sorts before every key in it
    cuts = plan.join(ends.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last_key", "bucket").alias("cut")), list(LEVELS), "left")
    cuts = stage(cuts.select(*LEVELS, "full", F.coalesce("cut", F.lit("")).alias("cut")), "cuts")

    columns = [f"`{c}`" for c in docs.columns if c != "epoch"]
    fields = [F.col(f"d.{c}") for c in columns]
    keyed = docs.select(F.struct(*columns).alias("d"), *leaf).join(small(cuts), list(LEVELS))
    copies = F.col("full") + F.when(_order_key(seed, F.col("full"), F.col(f"d.{id_col}")) <= F.col("cut"), 1).otherwise(0)
    return keyed.withColumn("copies", copies).where("copies > 0").select(*fields, F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("epoch"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "lang", "source", "epoch")


OP9_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source,
         CASE coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'forum' END AS dom,
         coalesce(lang, '?') AS lg, coalesce(source, '?') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::HUGEINT AS tokens
  FROM documents),
leaf AS (SELECT dom, lg, src, sum(tokens)::HUGEINT AS tokens, (sum(tokens) * 3)::HUGEINT AS cap FROM d GROUP BY ALL),
n1 AS (SELECT dom, sum(cap)::HUGEINT AS cap, (SELECT sum(tokens)::HUGEINT * 50 // 100 FROM leaf) AS budget,
              CASE dom WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END::HUGEINT AS weight FROM leaf GROUP BY dom),
a1 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, dom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS filled,
              sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, dom ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS waiting FROM n1),
b1 AS (SELECT *, cap * waiting <= (budget - filled) * weight AS isfull FROM a1),
c1 AS (SELECT *, sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER ()::HUGEINT AS used, sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER ()::HUGEINT AS open FROM b1),
r1 AS (SELECT dom, CASE WHEN isfull THEN cap ELSE (budget - used) * weight // open END AS budget FROM c1),
n2 AS (SELECT dom, lg, sum(cap)::HUGEINT AS cap, any_value(budget) AS budget,
              CASE lg WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END::HUGEINT AS weight FROM leaf JOIN r1 USING (dom) GROUP BY dom, lg),
a2 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY dom ORDER BY cap::DOUBLE / weight::DOUBLE, lg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS filled,
              sum(weight) OVER (PARTITION BY dom ORDER BY cap::DOUBLE / weight::DOUBLE, lg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS waiting FROM n2),
b2 AS (SELECT *, cap * waiting <= (budget - filled) * weight AS isfull FROM a2),
c2 AS (SELECT *, sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER (PARTITION BY dom)::HUGEINT AS used, sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER (PARTITION BY dom)::HUGEINT AS open FROM b2),
r2 AS (SELECT dom, lg, CASE WHEN isfull THEN cap ELSE (budget - used) * weight // open END AS budget FROM c2),
n3 AS (SELECT dom, lg, src, tokens, cap, budget, 1::HUGEINT AS weight FROM leaf JOIN r2 USING (dom, lg)),
a3 AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY dom, lg ORDER BY cap::DOUBLE / weight::DOUBLE, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS filled,
              sum(weight) OVER (PARTITION BY dom, lg ORDER BY cap::DOUBLE / weight::DOUBLE, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS waiting FROM n3),
b3 AS (SELECT *, cap * waiting <= (budget - filled) * weight AS isfull FROM a3),
c3 AS (SELECT *, sum(CASE WHEN isfull THEN cap ELSE 0 END) OVER (PARTITION BY dom, lg)::HUGEINT AS used, sum(CASE WHEN isfull THEN 0 ELSE weight END) OVER (PARTITION BY dom, lg)::HUGEINT AS open FROM b3),
r3 AS (SELECT dom, lg, src, tokens, CASE WHEN isfull THEN cap ELSE (budget - used) * weight // open END AS alloc FROM c3),
p AS (SELECT dom, lg, src, alloc // tokens AS nfull, alloc % tokens AS rest FROM r3 WHERE tokens > 0 AND alloc > 0),
k AS (SELECT d.*, nfull, rest, md5('{SEED}:' || nfull || ':' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM d JOIN p USING (dom, lg, src)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY dom, lg, src ORDER BY key) AS upto FROM k),
n AS (SELECT *, nfull + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM s)
SELECT doc_id, lang, source, unnest(range(0, copies::BIGINT))::INT AS epoch FROM n WHERE copies > 0
"""
