"""Language identification with language-bitmask n-gram filters.

Learning counts letter n-grams per language on a bounded sample of labelled documents and keeps those that
make up a fair share of a language's grams. They go into one Bloom filter per language, stored bit-sliced:
each row of the table is a bitmask over the languages (in words of 64), so the AND of a gram's rows gives all
languages that contain it at once. A text's grams are counted per language by the set bits, the counts are corrected for
the filters' false positives, and the highest decides.

Bounds: FIT_ROWS documents per language are learned from (chosen by a hash of the id), at most 1 / MIN_SHARE
grams are kept per language and gram size, the table has 2**ROW_BITS rows, fewer where more than 256 languages
would make it larger than 128 MB (`row_bits`). Any number of languages works; the model grows with it. Every
document is predicted whole.

Defined results: `und` with score 0 for null texts and texts without a letter, and for all texts when nothing
could be learned; ties go to the language first in alphabetical order; rows with a null id are never learned
from and count as not held out; repeated rows are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, small, stage, text_slices

SIZES = (3, 4)
FIT_ROWS = 10_000
MIN_SHARE = 1e-5
#: A gram counts for a language if its share there is at least this part of its largest share anywhere.
MIN_RATIO = 0.25
ROW_BITS, PROBES = 22, 4
FOLDS, HELD_OUT = 4, 2

_LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def _letter_codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, anything but letters as a space; and each text's length."""
    parts = [(" " + (t or b"").decode("utf-8", "replace").lower() + " ").encode("utf-32-le", "replace") for t in texts]
    codes = np.frombuffer(b"".join(parts), "<u4").astype(np.uint64)
    letter = _LETTERS[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        letter[high] = [chr(int(c)).isalpha() for c in codes[high]]
    return np.where(letter, codes, np.uint64(32)), np.array([len(p) // 4 for p in parts], np.int64)


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each gram, its text's index, whether each text has a letter); runs of spaces give no grams."""
    codes, lengths = _letter_codes(texts)
    owner = np.repeat(np.arange(len(texts)), lengths)
    space = codes == 32
    lettered = np.bincount(owner[~space], minlength=len(texts)) > 0
    keep = ~(space[:-1] & space[1:])
    hashes, owners = [], []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        good = owner[:n] == owner[size - 1 :]
        for i in range(size):
            h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            if i < size - 1:
                good &= keep[i : i + n]
        hashes.append(h[good])
        owners.append(owner[:n][good])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), lettered
    return np.concatenate(hashes), np.concatenate(owners), lettered


def row_bits(languages: int) -> int:
    """The table's rows, as a power of two: halved each time that the words of a row double beyond four."""
    words = -(-languages // 64)
    return max(16, ROW_BITS - max(0, (words - 1).bit_length() - 2))


def _rows(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    x = (h + np.uint64(probe * 0xD1B54A32D192ED03 % (1 << 64))) * np.uint64(0x8CB92BA72F3D8DD7)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


class Filters:
    """The bit-sliced table of all languages' filters and each filter's rate of false positives."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.languages = sorted(grams)
        n = len(self.languages)
        kind = next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if n <= bits), np.uint64)
        self.bits = row_bits(n)
        #: one array of masks per 64 languages
        self.table = [np.zeros(1 << self.bits, kind) for _ in range(max(1, -(-n // 64)))]
        self.false_rates = []
        for i, lang in enumerate(self.languages):
            rows = np.unique(np.concatenate([_rows(grams[lang], p, self.bits) for p in range(PROBES)]))
            self.table[i // 64][rows] |= kind(1 << i % 64)
            self.false_rates.append((len(rows) / (1 << self.bits)) ** PROBES)

    def counts(self, h: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Grams per text, and corrected counts per text and language."""
        rows = [_rows(h, p, self.bits) for p in range(PROBES)]
        total, hits = np.bincount(owner, minlength=n_texts), []
        for word, table in enumerate(self.table):
            masks = table[rows[0]]
            for r in rows[1:]:
                masks &= table[r]
            some = masks != 0
            masks, owners, one = masks[some], owner[some], masks.dtype.type(1)
            hits += [np.bincount(owners[(masks >> masks.dtype.type(i)) & one == 1], minlength=n_texts) for i in range(min(64, len(self.languages) - 64 * word))]
        rate = np.array(self.false_rates)
        return total, np.maximum(0, (np.stack(hits, axis=1) - total[:, None] * rate) / np.maximum(1 - rate, 1e-9))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        h, owner, lettered = _grams(texts)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        _, counts = self.counts(h, owner, len(texts))
        best, top, total = counts.argmax(axis=1), counts.max(axis=1), counts.sum(axis=1)
        score = np.where(lettered & (total > 0), top / np.where(total > 0, total, 1), 0.0)
        return [self.languages[i] if ok else "und" for i, ok in zip(best.tolist(), lettered.tolist(), strict=True)], score.tolist()


def learn(labelled: DataFrame, spark: SparkSession, id_col: str, text_col: str, lang_col: str, fit_rows: int = FIT_ROWS) -> Filters:
    """Filters from labelled(id, text, lang): about fit_rows documents per language, all if there are fewer."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    shares = stage(known.groupBy(F.col(lang_col).alias("_ll_lang")).agg(F.least(F.lit(1.0), fit_rows / F.count("*")).alias("_ll_share")), "label-shares")
    languages = [r["_ll_lang"] for r in shares.collect()]  # the model's labels
    if not languages:
        return Filters({})
    met = known.select(id_col, text_col, lang_col).join(small(shares), F.col(lang_col) == F.col("_ll_lang"))
    sample = met.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1_000_000)) < F.col("_ll_share") * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(0).to_pylist()):
                h, owner, _ = _grams(part)
                langs, codes = np.unique(np.array(batch.column(1).slice(at, len(part)).to_pylist(), dtype=object).astype(str), return_inverse=True)
                at += len(part)
                for i, lang in enumerate(langs):
                    grams, n = np.unique(h[codes[owner] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = sample.select(F.col(text_col).cast("binary"), F.col(lang_col)).mapInArrow(run, "lang string, gram long, n long")
    counts = stage(found.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(small(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= MIN_SHARE)
    top = shares.groupBy("gram").agg(F.max("share").alias("top"))
    kept = shares.join(top, "gram").where(F.col("share") >= MIN_RATIO * F.col("top")).select("lang", "gram")
    # at most 1 / MIN_SHARE grams a language
    rows = kept.toArrow()
    langs, grams = np.array(rows["lang"].to_pylist(), dtype=object), np.asarray(rows["gram"], dtype=np.int64).view(np.uint64)
    order = np.argsort(langs.astype(str), kind="stable")
    langs, grams = langs[order].astype(str), grams[order]
    return Filters({lang: grams[np.searchsorted(langs, lang, "left") : np.searchsorted(langs, lang, "right")] for lang in languages})


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): one row per input row."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for part in text_slices(batch.column(1).to_pylist()):
                found, score = shared.value.predict(part)
                langs += found
                scores += score
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prepare(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    filters = learn(docs.where(fold != HELD_OUT), spark, "doc_id", "text", "lang")
    return predict(docs, filters).select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
