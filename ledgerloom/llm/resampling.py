"""Importance resampling towards a target's distribution of hashed n-grams.

A distinct-feature dictionary comes first. Texts are read in chunks of CHUNK_BYTES; a chunk sends each of its
distinct n-grams once, with its count, to the shard of the dictionary that the n-gram belongs to, and target texts do
the same. A shard counts its strings over all chunks, hashes each distinct one once to its bucket, and adds up the
buckets; what returns to a chunk are the buckets of the n-grams it had sent, in the order it had sent them. Buckets of
the raw and the target side give a gain per bucket. The second reading of the texts counts the features of every
document, in the chunks of the first, and joins the gains back to these counts: a document's weight is the floored mean
of its features' gains. Gumbel noise of a hash of the id is added, and the highest scores are drawn.

A frequent n-gram is one entry per chunk, so no shard has more of it than there are chunks; shards are chosen by a hash
of the string and hold the n-grams of about SHARD_BYTES of text. Strings travel packed, a row for each chunk and shard.

`docs` is read twice and must give the same rows in the same partitions both times, as a table's files do; anything
else is noticed by a checksum of every chunk and is an error (write such rows first).

Defined results: null texts and texts without words have no features and weight 0; rows with a null id get a weight,
but no score and no rank, as the noise is of the id; repeated rows are documents of their own, and ties of equal ids
are settled in any order; without documents or without target texts the formula holds with zero counts; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, small, stage
from .words import FACTORS, mix, word_hashes

BUCKETS = 10_000
MAX_GRAM = 2
SEED = 7
PERCENT = 25
MIN_WORDS = 20
#: Bytes of text that are one chunk, and bytes of text whose n-grams fill a shard of the dictionary.
CHUNK_BYTES, SHARD_BYTES = 4 << 20, 12 << 20
#: Bytes that are part of words, after A-Z are lower-cased: digits, a-z and everything beyond ASCII.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Features:
    """The n-grams of some texts: distinct strings with their counts, and each text's own counts."""

    def __init__(self, texts: list[bytes | None], longest: int = MAX_GRAM):
        raw = b" ".join([t or b"" for t in texts]).translate(_LOWER)
        offsets = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        letters = np.frombuffer(raw, np.uint8) != 32
        edge = np.flatnonzero(np.diff(letters, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        first = np.searchsorted(starts, offsets)
        self.n_words = np.diff(first)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.n_words)
        words = _strings(np.frombuffer(raw, np.uint8)[letters], ends - starts).dictionary_encode()
        ids, single = np.asarray(words.indices).astype(np.int64), words.dictionary
        own = _hashes(single)
        strings, hashes, parts, marks, entries, owners, base = single, own, [single], [own], [ids], [owner], len(single)
        last = ids
        for k in range(2, longest + 1):
            # a run of k words is a run of k - 1 and the word after it, within one text
            inside = owner[k - 1 :] == owner[: max(0, len(owner) - k + 1)]
            number, kinds = pd.factorize((last[: len(inside)] * np.int64(len(single) + 1) + ids[k - 1 :])[inside])
            before, after = kinds // (len(single) + 1), kinds % (len(single) + 1)
            strings = pc.binary_join_element_wise(strings.take(pa.array(before)), single.take(pa.array(after)), pa.scalar(b" ", pa.large_binary()))
            hashes = mix(hashes[before] * FACTORS[0][1] + own[after])
            last = np.full(len(inside), -1, np.int64)
            last[inside] = number
            parts.append(strings)
            marks.append(hashes)
            entries.append(number.astype(np.int64) + base)
            owners.append(owner[k - 1 :][inside])
            base += len(strings)
        self.strings, self._hashes = pa.concat_arrays(parts), np.concatenate(marks)
        self._entry, self._owner, self._texts = np.concatenate(entries), np.concatenate(owners), len(texts)
        self.counts = np.bincount(self._entry, minlength=len(self.strings))
        self.n_features = np.bincount(self._owner, minlength=len(texts))

    def by_shard(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct strings in the order of their dictionary shards, and where each shard begins and the last ends."""
        shard = (self._hashes % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def per_text(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's own counts: how many entries it has, and (place in `order`, count) of all entries, text by text."""
        kinds = max(1, len(self.strings))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = self._owner * np.int64(kinds) + place[self._entry]
        keys.sort()
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        return np.bincount(keys[new] // kinds, minlength=self._texts), keys[new] % kinds, np.diff(new, append=len(keys))


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings of bytes that follow each other."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of strings."""
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2], np.uint8) if strings.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hashes(strings: pa.Array) -> np.ndarray:
    data, offsets = _bytes(strings)
    return word_hashes(data.tobytes(), offsets[:-1], offsets[1:], 1)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, list[int | None], list[bytes | None]]]:
    """(number, checksum, ids, texts) of the task's chunks; a chunk ends with the text that makes it reach `size`."""
    ids, texts, held, chunk = [], [], 0, TaskContext.get().partitionId() << 32
    seen = xxhash.xxh64()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            seen.update(b"%d," % len(text or b""))
            seen.update(text or b"")
            held += len(text or b"") + 1
            if held >= size:
                yield chunk, seen.intdigest() >> 1, ids, texts
                ids, texts, held, chunk = [], [], 0, chunk + 1
                seen.reset()
    if texts:
        yield chunk, seen.intdigest() >> 1, ids, texts


def chunk_features(docs: DataFrame, shards: int, target: bool, longest: int = MAX_GRAM, size: int = CHUNK_BYTES) -> DataFrame:
    """(shard, target, chunk, checksum, size, strings, lengths, counts): the distinct n-grams of each chunk of docs(doc_id, t), packed."""
    kinds = pa.schema([("shard", pa.int64()), ("target", pa.bool_()), ("chunk", pa.int64()), ("checksum", pa.int64()), ("size", pa.int64()), *((c, pa.binary()) for c in ("strings", "lengths", "counts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, checksum, _, texts in _chunks(batches, size):
            found = Features(texts, longest)
            order, cuts = found.by_shard(shards)
            data, offsets = _bytes(found.strings.take(pa.array(order)))
            lengths, counts = np.diff(offsets).astype("<u4"), found.counts[order].astype("<u4")
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[p], cuts[p + 1]
                row = [p, target, chunk, checksum, b - a, *(pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in (data[offsets[a] : offsets[b]], lengths[a:b], counts[a:b]))]
                yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(row, kinds, strict=True)], schema=kinds)

    return docs.mapInArrow(run, "shard long, target boolean, chunk long, checksum long, size long, strings binary, lengths binary, counts binary")


def dictionary(entries: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of two kinds: (bucket, s, t), a shard's features of both sides in each bucket, and (shard, chunk, checksum,
    found), the buckets of a raw chunk's strings in the order it sent them."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        # raw and target chunks share the dictionary, and each distinct string is hashed once
        data, lengths, counts = (np.frombuffer(b"".join([zstandard.decompress(x) for x in part[c]]), kind) for c, kind in (("strings", np.uint8), ("lengths", "<u4"), ("counts", "<u4")))
        coded = _strings(data, lengths).dictionary_encode()
        index, kinds = np.asarray(coded.indices), len(coded.dictionary)
        sizes, of_target = part["size"].to_numpy(np.int64), part["target"].to_numpy(bool)
        bucket = np.fromiter((zlib.crc32(x) for x in coded.dictionary.to_pylist()), np.int64, kinds) % buckets
        sides = np.repeat(of_target, sizes)
        s, t = (np.bincount(bucket, np.bincount(index[side], counts[side], kinds), buckets).astype(np.int64) for side in (~sides, sides))
        held = np.flatnonzero(s + t)
        sums = pd.DataFrame({"bucket": held, "s": s[held], "t": t[held]}, dtype="Int64")
        back = part[["shard", "chunk", "checksum"]].astype("Int64")
        back["found"] = [bucket[index[b - n : b]].astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes() for n, b in zip(sizes, np.cumsum(sizes), strict=True)]
        return pd.concat([sums, back[~of_target]])[["bucket", "s", "t", "shard", "chunk", "checksum", "found"]]

    return entries.groupBy("shard").applyInPandas(run, "bucket long, s long, t long, shard long, chunk long, checksum long, found binary")


def bucket_gains(sums: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from (bucket, s, t): `buckets` rows."""
    per = sums.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    whole = per.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("S"), F.coalesce(F.sum("t"), F.lit(0)).alias("T")).first()
    every = sums.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(per, "bucket", "left").na.fill(0, ["s", "t"])
    ratio = (F.col("t") + 1).cast("double") * float(whole["S"] + buckets) / ((F.col("s") + 1).cast("double") * float(whole["T"] + buckets))
    return every.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of their differences, compressed."""
    steps = np.diff(numbers.astype("<u4"), prepend=np.uint32(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def document_weights(docs: DataFrame, found: DataFrame, gains: np.ndarray, shards: int, longest: int = MAX_GRAM, size: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of docs(doc_id, t); found(shard, chunk, checksum, found) are its chunks' buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    width = "<u2" if len(gains) <= 1 << 16 else "<u4"
    lists = ("ids", "words", "features", "entries")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, checksum, ids, texts in _chunks(batches, size):
            own = Features(texts, longest)
            entries, place, times = own.per_text(own.by_shard(shards)[0])
            arrays = [pa.array([list(x)], pa.list_(pa.int64())) for x in (ids, own.n_words, own.n_features, entries)]
            blobs = [pa.array([_squeezed(x)], pa.binary()) for x in (place, times)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([checksum]), *arrays, *blobs], ["chunk", "checksum", *lists, "place", "times"])

    def weigh(own: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        sent = set(zip(own["chunk"], own["checksum"], strict=True))
        if len(own) != 1 or not set(zip(back["chunk"], back["checksum"], strict=True)) <= sent or (back.empty and sum(own["features"].iat[0])):
            raise RuntimeError("the documents differ between their two readings: write them to a table first")
        row = own.iloc[0]
        place, times = _unsqueezed(row["place"]), _unsqueezed(row["times"]).astype(np.int64)
        features = np.asarray(row["features"], np.int64)
        total = np.zeros(len(features), np.int64)
        if len(place):
            bucket = np.concatenate([np.frombuffer(x, width) for x in back.sort_values("shard")["found"]])
            worth = np.concatenate([[0], np.cumsum(shared.value[bucket[place]] * times)])
            ends = np.cumsum(np.asarray(row["entries"], np.int64))
            total = worth[ends] - worth[np.concatenate([[0], ends[:-1]])]
        weight = total // np.maximum(features, 1)
        return pd.DataFrame({"doc_id": pd.array([None if pd.isna(i) else int(i) for i in row["ids"]], "Int64"), "n_words": np.asarray(row["words"]), "n_features": features, "weight": weight})

    counted = docs.mapInArrow(count, "chunk long, checksum long, " + ", ".join(f"{c} array<long>" for c in lists) + ", place binary, times binary")
    return counted.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(weigh, "doc_id long, n_words long, n_features long, weight long")


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = MAX_GRAM, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_features, weight): one row per row of docs."""
    prepare(docs.sparkSession)
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).cast("binary").alias("t"))
    held = sum(side.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0] for side in (raw, wanted))
    shards = 1 + held // shard_bytes
    entries = chunk_features(raw, shards, False, longest, chunk_bytes).union(chunk_features(wanted, shards, True, longest, chunk_bytes))
    found = stage(dictionary(entries, buckets), "dictionary")
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(found.where("bucket IS NOT NULL").select("bucket", "s", "t"), buckets).collect():  # `buckets` rows
        gains[r["bucket"]] = r["gain"]
    return document_weights(raw, found.where("chunk IS NOT NULL").select("shard", "chunk", "checksum", "found"), gains, shards, longest, chunk_bytes)


def drawn(weighted: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """Written rows with `score` and `rank`: the highest scores of `percent` of the rows with `min_words` words or more.

    Scores are whole numbers within the range of logarithms of doubles, some 100,000 at most, so the rows of each are
    counted and the counts added up in one task; a row's rank among those of its score is a window over these, of which
    noise leaves no score more than a two-thousandth of the ids."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = stage(weighted.withColumn("score", F.col("weight") + noise), "scores")
    able = scored.where((F.col("n_words") >= min_words) & F.col("score").isNotNull())
    per = able.groupBy("score").agg(F.count("*").alias("n"))
    above = stage(per.select("score", "n", F.coalesce(F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("above")), "score-counts")
    draw = percent * (above.agg(F.sum("n")).first()[0] or 0) // 100
    known = F.broadcast(above.where(F.col("above") < draw).select("score", "above"))
    ranked = able.join(known, "score").withColumn("rank", F.col("above") + F.row_number().over(W.partitionBy("score").orderBy("doc_id")))
    reached = F.when(F.col("rank") <= draw, F.col("rank")).alias("rank")
    fields = scored.columns
    in_reach = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    lowest = known.agg(F.min("score")).first()[0]
    rest = scored if lowest is None else scored.where(~F.coalesce(in_reach & (F.col("score") >= lowest), F.lit(False)))
    return ranked.select(*fields, reached.cast("long")).union(rest.select(*fields, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): one row per row of docs."""
    return drawn(weights(docs, target, **options), percent, seed, min_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = r"""
WITH k AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT -row_number() OVER () AS r, NULL::BIGINT AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
f AS (SELECT r, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM (FROM d UNION ALL FROM b)),
g AS (SELECT f, count(*) FILTER (r > 0) AS s, count(*) FILTER (r < 0) AS t FROM f GROUP BY f),
c AS (SELECT f, s, t, xor(list_reduce([4294967295] || list_transform(range(0, strlen(f)), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT),
                                    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM g, k),
a AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM c GROUP BY bucket),
w AS (SELECT sum(s) AS sw, sum(t) AS tw FROM a),
n AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sw + 10000))::DOUBLE / ((s + 1) * (tw + 10000))::DOUBLE)) AS gain FROM a, w),
m AS (SELECT f.r, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN c ON f.f = c.f JOIN n ON n.bucket = c.bucket WHERE f.r > 0 GROUP BY f.r),
q AS (SELECT d.r, doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m ON d.r = m.r),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM q WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM q LEFT JOIN o ON q.r = o.r
"""
