"""Quality rules judged per document and per host.

Every document is measured once (word, symbol, repeated-line and repeated-window counts). Rule failures
are then aggregated per host, a beta prior is fitted to the hosts' failure rates by moments, every rate
is shrunk towards it, and hosts whose shrunk rate is high reject all their documents.

Defined results: null texts count as empty (no words, so they fail); empty tables give empty results;
repeated rows are judged alike and all returned; documents with a null host are judged by their own
text only; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, small, stage, text_slices

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
#: A host whose shrunk failure rate is above this rejects its remaining documents too.
HOST_RATE = 0.8
#: Bounds of the prior's strength, in documents.
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


def _repeat_words(docs: list[list[bytes]], window: int) -> np.ndarray:
    """Per document, the words inside windows of `window` (a power of two) words found twice or more in it.

    Windows are numbered exactly by doubling: a number for each word, then for each pair of numbers."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    out = np.zeros(len(docs), np.int64)
    total = int(sizes.sum())
    if not total:
        return out
    owner = np.repeat(np.arange(len(docs)), sizes)
    ids = pd.factorize(np.array([w for d in docs for w in d], dtype=object))[0].astype(np.int64)
    step = 1
    while step < window and len(ids) > step:
        ids = pd.factorize(ids[:-step] * (total + 1) + ids[step:])[0].astype(np.int64)
        step *= 2
    n = total - window + 1
    if n <= 0:
        return out
    inside = owner[:n] == owner[window - 1 :]
    keys = pd.factorize(owner[:n] * (total + 1) + ids)[0]
    repeated = inside & (np.bincount(keys[inside], minlength=keys.max() + 1)[keys] > 1)
    at = np.nonzero(repeated)[0]
    cover = np.bincount(at, minlength=total + 1) - np.bincount(at + window, minlength=total + 1)
    return np.bincount(owner[np.cumsum(cover[:total]) > 0], minlength=len(docs))


def measure_texts(texts: list[bytes | None], window: int = REPEAT_WINDOW) -> dict[str, np.ndarray]:
    """The five counts of each UTF-8 text."""
    texts = [t or b"" for t in texts]
    words = [t.split() for t in texts]
    chars, symbols, dup = [], [], []
    for t in texts:
        bare = t.translate(None, _SPACES)
        chars.append(len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace")))
        symbols.append(len(t) - len(t.translate(None, _SYMBOLS)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.fromiter(map(len, words), np.int64, len(words)),
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": _repeat_words(words, window),
    }


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, the five counts, base_failed): one row per input row."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure_texts(part) for part in text_slices(batch.column(2).to_pylist())]
            counts = [pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)) for k in FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts], ["doc_id", "host", *FEATURES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("binary").alias("t"))
    found = rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{k} long" for k in FEATURES))
    return found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def host_counts(marks: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed) of the measured rows whose host is known."""
    return marks.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))


def host_rates(hosts: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): failure rates shrunk by an empirical beta prior.

    The prior's mean is the corpus rate; its strength comes from the spread of the hosts' rates around it
    (method of moments). Hosts that agree, or a single host, give the strongest prior allowed."""
    one = hosts.agg(
        F.sum("n_docs").alias("n"),
        F.sum("n_failed").alias("k"),
        F.count("*").alias("m"),
        F.sum(F.lit(1.0) / F.col("n_docs")).alias("inv"),
        F.sum(F.pow(F.col("n_failed") / F.col("n_docs"), 2)).alias("sq"),
        F.sum(F.col("n_failed") / F.col("n_docs")).alias("sum_rate"),
    ).first()
    n, k, m = one["n"] or 0, one["k"] or 0, one["m"] or 0
    mean = k / n if n else 0.0
    strength = MAX_STRENGTH
    if m > 1 and 0 < mean < 1:
        spread = (one["sq"] - 2 * mean * one["sum_rate"] + m * mean * mean) / (m - 1)
        between = spread - mean * (1 - mean) * one["inv"] / m
        if between > 0:
            strength = min(MAX_STRENGTH, max(MIN_STRENGTH, mean * (1 - mean) / between - 1))
    return hosts.withColumn("rate", (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """(doc_id, host, counts, base_failed, host_rejected, kept): one row per input row."""
    marks = stage(measures(docs, id_col, text_col, host_col), "measures")
    bad = stage(host_rates(stage(host_counts(marks), "host-counts")).where(F.col("rate") > host_rate).select("host", F.lit(True).alias("host_rejected")), "bad-hosts")
    judged = marks.join(small(bad), "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """docs without the rows that the rules reject; rows with a null id are judged through their text alone."""
    spark = docs.sparkSession
    prepare(spark)
    hosts = stage(host_counts(measures(docs, id_col, text_col, host_col)), "host-counts")
    bad = stage(host_rates(hosts).where(F.col("rate") > host_rate).select(F.col("host").alias("_ll_bad_host")), "bad-hosts")
    kept = docs.join(small(bad), F.col(host_col).cast("string") == F.col("_ll_bad_host"), "left_anti")
    fields = kept.columns
    at = fields.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure_texts(part) for part in text_slices(batch.column(at).cast(pa.binary()).to_pylist())]
            if found:
                n = np.concatenate([f["n_words"] for f in found])
                r = np.concatenate([f["n_repeat_words"] for f in found])
                yield batch.filter(pa.array((n >= MIN_WORDS) & (100 * r <= REPEAT_PERCENT * n)))

    return kept.mapInArrow(run, kept.schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", *FEATURES, "base_failed", "kept")


OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
m AS (SELECT *, coalesce(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), []) AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM m),
w AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(ws[i:i + 7], ' ')) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM w, range(0, 8) AS o(k) WHERE w.n > 1 GROUP BY r),
f AS (SELECT m.r, doc_id, host, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM m LEFT JOIN c ON m.r = c.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM b WHERE host IS NOT NULL GROUP BY host),
s AS (SELECT sum(k) / sum(n) AS mu, count(*) AS hosts, sum(1 / n) AS inv, sum((k / n) ** 2) AS sq, sum(k / n) AS rates FROM h),
v AS (SELECT mu, hosts, (sq - 2 * mu * rates + hosts * mu * mu) / greatest(hosts - 1, 1) - mu * (1 - mu) * inv / hosts AS between_hosts FROM s),
a AS (SELECT mu, CASE WHEN hosts > 1 AND mu > 0 AND mu < 1 AND between_hosts > 0
                      THEN least(1000.0, greatest(2.0, mu * (1 - mu) / between_hosts - 1)) ELSE 1000.0 END AS strength FROM v),
bad AS (SELECT host FROM h, a WHERE (k + mu * strength) / (n + strength) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host NOT IN (SELECT host FROM bad), true) AS kept
FROM b
"""
