"""Line dedup: a line that several documents share stays in one of them only.

Every document's lines are exploded with their positions and normalised to a key: ASCII white space is stripped at
both ends and A-Z become lower case. Keys of MIN_CHARS code points or more are hashed to 128 bits, the distinct
documents of every hash are counted, and hashes with MIN_DOCS or more of them are repeated. Their lines are dropped
from all documents but the one with the smallest id. What comes back to a document are the positions of its dropped
lines; its text is split again and put together from the others, in order.

Only hashes, ids and positions are shuffled until then, and texts once, to meet their positions. A line that is in
very many documents is counted by partial aggregates and its verdict reaches its rows by broadcast: there are at
most HUBS such lines, by their definition (`judged`).

Defined results: a null or empty text is one empty line, and a text that loses all its lines becomes empty; lines
shorter than MIN_CHARS always stay; repeats within one document stay if no smaller document has the line; rows with
equal ids are one document, so they never remove each other's lines; rows with a null id are neither counted nor
changed; empty tables give empty results; other columns pass through untouched, except that the two counts replace
columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HUB_ROWS, HUBS, prepare, stage

MIN_CHARS = 10
MIN_DOCS = 2
SEED = 42
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, th, pos, h1, h2): every line long enough to count; doc and th, the text's hash, tell rows apart."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t"))
    lines = rows.select("doc", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "th", "pos", F.translate(F.btrim("line", F.lit(_SPACES)), _UPPER, _UPPER.lower()).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(SEED), "key").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, n_docs, n_rows, first_doc) of the hashes found in `min_docs` documents or more."""
    counts = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n_docs"), F.count("*").alias("n_rows"), F.min("doc").alias("first_doc"))
    return counts.where(F.col("n_docs") >= min_docs)


def judged(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc, th, pos, first_doc) of the lines whose hash is in the written `repeated`.

    A hash with more than its share of the rows, if HUBS hashes shared them, is broadcast; the others meet by shuffle."""
    total = repeated.agg(F.sum("n_rows")).first()[0] or 0
    bound = max(HUB_ROWS, total // HUBS)
    want = ["doc", "th", "pos", "first_doc"]
    common = F.broadcast(repeated.where(F.col("n_rows") > bound).select("h1", "h2", "first_doc"))
    rare = repeated.where(F.col("n_rows") <= bound).select("h1", "h2", "first_doc")
    return lines.join(common, ["h1", "h2"]).select(want).union(lines.join(rare, ["h1", "h2"]).select(want))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, th, gone): positions of the lines that the document loses, one row per document that loses any."""
    lines = stage(keyed_lines(docs, id_col, text_col, min_chars), "lines")
    repeated = stage(repeated_lines(lines, min_docs), "repeated-lines")
    return judged(lines, repeated).where("doc <> first_doc").groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the kept lines as text, n_lines (before dropping) and n_dropped."""
    prepare(docs.sparkSession)
    gone = dropped_lines(docs, id_col, text_col, min_docs, min_chars).select(F.col("doc").alias("_ll_doc"), F.col("th").alias("_ll_th"), F.col("gone").alias("_ll_gone"))
    own = docs.drop("n_lines", "n_dropped")
    met = (F.col(id_col).cast("long") == F.col("_ll_doc")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_ll_th"))
    joined = own.withColumn(text_col, F.col(text_col).cast("string")).join(gone, met, "left").select(*own.columns, "_ll_gone")
    fields = own.columns
    at = fields.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, lost = [], [], []
            for text, places in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(len(fields)).to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                if places:
                    drop = set(places)
                    text = b"\n".join([x for i, x in enumerate(lines) if i not in drop])
                texts.append(text)
                sizes.append(len(lines))
                lost.append(len(places or ()))
            columns = batch.columns[:at] + [pa.array(texts, pa.binary()).cast(pa.string())] + batch.columns[at + 1 : len(fields)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())], [*fields, "n_lines", "n_dropped"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name != "_ll_gone")
    return joined.mapInArrow(run, f"{kinds}, n_lines long, n_dropped long")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
l AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
k AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, doc_id <> coalesce(first_doc, doc_id) AS dropped FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY r, doc_id
"""
