"""SimHash near-dedup by pigeonhole blocks.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints
that differ in at most `distance` bits agree in at least `blocks - distance` of `blocks` blocks, so a
table per choice of that many blocks is sure to hold the pair in one bucket. Buckets are joined on the
blocks and every candidate's Hamming distance is verified.

Defined results: null texts and texts without words get fingerprint zero, which links like any other;
empty tables give empty results; rows with equal ids are equal documents; rows with a null id get a
null component and are never dropped; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, prepare, shuffled, stage

SHINGLE_WORDS = 4
DISTANCE = 4
BLOCKS = 7


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    h = xxhash.xxh64_intdigest
    hashes = np.array(
        [h(joined[a:b], 42) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)],
        dtype=">u8",
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per input row; fp holds the 64 bits as a signed long."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask per choice of blocks - distance blocks; blocks differ in width by one bit at most."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    spans = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(spans, blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(a: Column, b: Column, distance: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def link_fingerprints(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root): the component root of every fingerprint that has a neighbour within `distance` bits.

    Hot buckets never emit all their pairs: each member is first compared with its bucket's smallest
    fingerprint, those links are contracted to components, and only members of different components
    are then compared with each other."""
    masks = F.array(*[F.lit(_signed(m)) for m in block_masks(blocks, distance)])
    rows = fps.select("fp").distinct().select("fp", F.posexplode(masks).alias("tab", "mask")).select("tab", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared = rows.groupBy("tab", "key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last")).where("pivot <> last").select("tab", "key", "pivot")
    members = stage(rows.join(shuffled(shared), ["tab", "key"]), "buckets")

    stars = members.where(F.col("fp") != F.col("pivot")).where(_near(F.col("fp"), F.col("pivot"), distance))
    first = stage(connected_components(stars, "fp", "pivot").select(F.col("id").alias("fp"), F.col("component").alias("root")), "stars")

    labelled = members.select("tab", "key", "fp").join(shuffled(first), "fp", "left").select("tab", "key", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = labelled.groupBy("tab", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("tab", "key")
    open_rows = stage(labelled.join(shuffled(mixed), ["tab", "key"]), "mixed")
    x, y = open_rows.alias("x"), shuffled(open_rows.alias("y"))
    pairs = x.join(
        y,
        (F.col("x.tab") == F.col("y.tab")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & _near(F.col("x.fp"), F.col("y.fp"), distance),
    ).select(F.col("x.root").alias("a"), F.col("y.root").alias("b"))
    second = connected_components(pairs, "a", "b").select(F.col("id").alias("root"), F.col("component").alias("top"))

    # ids that only the second round linked are their own first root
    known = first.select("fp", "root").union(second.join(shuffled(first.select("root").distinct()), "root", "left_anti").select(F.col("root").alias("fp"), "root"))
    return stage(known.join(shuffled(second), "root", "left").select("fp", F.coalesce("top", "root").alias("root")), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable by links, itself included."""
    marks = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    links = link_fingerprints(marks, distance, blocks)
    lowest = marks.groupBy("fp").agg(F.min("doc_id").alias("low")).join(shuffled(links), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # only linked fingerprints have more than one row per root
    groups = links.select("root").distinct().join(shuffled(lowest), "root").groupBy("root").agg(F.min("low").alias("group_low"))
    by_fp = lowest.join(shuffled(groups), "root", "left").select("fp", F.coalesce("group_low", "low").alias("component_id"))
    return marks.join(shuffled(by_fp), "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that another document of their group stands for."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("_ll_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_ll_gone"), "left_anti")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
