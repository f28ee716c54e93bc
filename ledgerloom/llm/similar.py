"""Near-dedup of texts by the similarity of their word shingles, with SimHash blocks as the search.

Two texts link if the Jaccard similarity of their sets of `shingle`-word shingles is `similarity` or more.
Texts of one set are collapsed first. Every set gets a SimHash fingerprint of FP_BITS bits and is filed once
per block, under BLOCK_BITS of the fingerprint's bits and an anchor, the smallest of its shingles by the
block's own hash. Bits alone would need hundreds of blocks at this similarity, and ever more in a larger
table, as unrelated fingerprints agree by chance; they hardly ever share an anchor, so the number of blocks
depends on the similarity and the RECALL at exactly the threshold alone (`blocks_for`). Pairs in a block are
kept if their fingerprints' Hamming distance allows the similarity.

Groups of near copies never emit all their pairs. A key with more than FEW sets chooses pivots: the sets very near a
pivot leave the key, and all sets that may be similar to one of them are connected to the pivot (`hot_links`); what
pivots leave is compared by fingerprints in tiles, which return each set's link to its local root. What is so connected
are regions: sets that meet in a block, and whose sizes and fingerprints allow the similarity, are in one region. Within
a region the shingle sets themselves are compared, tile by tile. The work of tiles is quadratic in a region's sets.

Defined results: null texts and texts without words have the empty set and are copies of each other; a text
shorter than a shingle has one shingle, itself; rows with equal ids are one document, linked if any of their
texts is; rows with a null id are never dropped; empty tables give empty results; other columns pass through
untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, prepare, shuffled, small, stage
from .words import mix, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Chance that a pair of exactly the threshold's similarity shares a block.
RECALL = 0.99
BLOCK_BITS = 8
LANES = 4
FP_BITS = 64 * LANES
#: Standard deviations by which a pair's distance may exceed what its similarity makes likely.
SLACK = 4.0
#: Sets of one key that are compared in one tile without pivots; how many pivots larger keys choose; fingerprints on one side of a tile of what is left.
FEW, PIVOTS, PRINTS = 16, 3, 1024
#: Sets on one side of a tile.
TILE = 256
#: Ids of sets in regions are broadcast up to so many.
WANTED = 200_000

_STEPS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_NAMES = ["doc_id", "n", "s1", "s2", *[f"f{i}" for i in range(LANES)]]


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes, in LANES unsigned numbers; the smallest hash decides ties."""
    n = len(hashes)
    if not n:
        return np.zeros(LANES, np.uint64)
    ones = np.zeros(FP_BITS, np.int64)
    lead = None
    for at in range(0, n, 4096):
        lanes = mix(mix(hashes[at : at + 4096, None] + _STEPS) * _STEPS[::-1])
        bits = np.unpackbits(lanes.astype(">u8").view(np.uint8).reshape(-1, 8 * LANES), axis=1)
        lead = bits[0] if lead is None else lead
        for part in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            ones += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    major = (2 * ones > n) | ((2 * ones == n) & (lead == 1))
    return np.packbits(major).view(">u8").astype(np.uint64)


def differing(similarity: float) -> float:
    """Share of differing bits at a Jaccard similarity: the angle of two equally large sets, which differ most."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def blocks_for(similarity: float = SIMILARITY, recall: float = RECALL, bits: int = BLOCK_BITS) -> int:
    """Number of blocks: a pair shares an anchor with the chance of its similarity, and each bit by `differing`."""
    once = similarity * (1 - differing(similarity)) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-once))) if once < 1 else 1


def block_keys(hashes: np.ndarray, marks: np.ndarray, blocks: int, bits: int = BLOCK_BITS) -> np.ndarray:
    """A set's key in every block, of its shingle hashes and its fingerprint."""
    own = mix(np.arange(1, blocks + 1, dtype=np.uint64) * _STEPS[0])
    low = np.full(blocks, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(low, mix((hashes[at : at + 4096, None] ^ own) * _STEPS[1]).min(axis=0), out=low)
    on = np.unpackbits(marks.astype(">u8").view(np.uint8))
    chosen = on[(np.arange(blocks)[:, None] * bits + np.arange(bits)) % FP_BITS].astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    return mix(mix(low ^ own) + chosen * _STEPS[2])


def shingle_sets(docs: DataFrame, shingle: int, blocks: int) -> DataFrame:
    """(doc_id, n, s1, s2, fingerprint, keys) of docs(doc_id, t binary): n, s1 and s2 tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, keys = np.zeros((len(batch), 3 + LANES), np.uint64), np.zeros((len(batch), blocks), np.uint64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                h = shingle_hashes(text.lower() if text else text, shingle)
                marks[i, :3] = len(h), h.sum(dtype=np.uint64), mix(h).sum(dtype=np.uint64)
                marks[i, 3:] = fingerprint(h)
                keys[i] = block_keys(h, marks[i, 3:], blocks)
            lists = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * blocks, pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in marks.T), lists], [*_NAMES, "keys"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in _NAMES) + ", keys array<long>")


def _bound(bits: int, similarity: float) -> int:
    """Bits in which two fingerprints of so many may differ at the similarity."""
    p = differing(similarity)
    return math.ceil(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def _grouped_links(near: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): every set that has a link, and the smallest set it reaches by links of the square matrix `near`."""
    i, j = np.nonzero(near)
    low = rep.copy()
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        if (before == low).all():
            break
    return rep[low != rep], low[low != rep]


def _print_links(similarity: float):
    """(a, b): links of the sets of some tiles of a key whose sizes and fingerprints allow the similarity."""
    bound = _bound(FP_BITS, similarity)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        part = part.sort_values(["key", "i", "j"])
        at = part[["key", "i", "j"]].to_numpy()
        firsts = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        whole = [part[c].to_numpy() for c in ("rep", "side", "n")]
        prints = part[[f"f{k}" for k in range(LANES)]].to_numpy(np.int64).view(np.uint64)
        for start, stop in zip([0, *firsts], [*firsts, len(part)], strict=True):
            (rep, side, n), lanes = (c[start:stop] for c in whole), prints[start:stop]
            near = np.zeros((len(rep), len(rep)), bool)
            for low in range(0, len(rep), 128):
                rows = slice(low, low + 128)
                bits = sum(np.bitwise_count(lanes[rows, None, k] ^ lanes[None, :, k]).astype(np.int16) for k in range(LANES))
                near[rows] = (bits <= bound) & (np.minimum(n[rows, None], n) >= similarity * np.maximum(n[rows, None], n))
            if at[start, 1] != at[start, 2]:
                near &= side[:, None] != side[None, :]
            out.append(_grouped_links(near, rep))
        return pd.DataFrame(dict(zip("ab", map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _tiles(rows: DataFrame, by: str, size: int) -> DataFrame:
    """rows(by, rep, size, ...) with side, i, j: each row once for every tile (i, j) of its group that its side is in."""
    sided = rows.withColumn("k", F.ceil(F.col("size") / size)).withColumn("side", F.pmod(F.xxhash64("rep", by), F.col("k")))
    return sided.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).drop("k", "other")


def hot_links(many: DataFrame, similarity: float) -> list[DataFrame]:
    """(a, b): links of sets(key, rep, n, fingerprint, size) of large keys; what they connect holds all that may be similar.

    A pivot takes the sets within a third of the bound out of its key. Whatever may be similar to one of those is within
    four thirds of the bound of the pivot, so all these join the pivot's region but stay in the key. What PIVOTS pivots
    leave is compared in tiles, by whole fingerprints and sizes. A key's pivots are chosen in one pass, so that every set
    meets them in one join and its key's rest in another, however many pivots there are."""
    lanes, bound = [f"f{i}" for i in range(LANES)], _bound(FP_BITS, similarity)
    pivots = many.groupBy("key").agg(*[F.min_by(F.struct("rep", *lanes), F.xxhash64("rep", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)])
    apart = [sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p{k}.{c}"))) for c in lanes), F.lit(0)).alias(f"apart{k}") for k in range(PIVOTS)]
    met = stage(many.join(pivots, "key").select("key", "rep", "n", *lanes, *[F.col(f"p{k}.rep").alias(f"p{k}") for k in range(PIVOTS)], *apart), "pivots")
    found = [met.where((F.col(f"apart{k}") <= bound + bound // 3) & (F.col("rep") != F.col(f"p{k}"))).select(F.col("rep").alias("a"), F.col(f"p{k}").alias("b")) for k in range(PIVOTS)]
    rest = met.where(" AND ".join(f"apart{k} > {bound // 3}" for k in range(PIVOTS))).select("key", "rep", "n", *lanes)
    left = stage(rest.join(rest.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "hot-blocks")
    return found if left.isEmpty() else [*found, _tile_rows(left, similarity)]


def _tile_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each set of sets(key, rep, n, fingerprint, size) that may be similar to others of its key with the smallest it
    reaches in a tile: fewer rows than sets, however many are alike."""
    # keys of one tile share groups of about PRINTS sets; each larger one has a group per tile
    group = F.when(F.col("size") <= PRINTS, F.pmod(F.xxhash64("key"), F.lit(max(1, sets.count() // PRINTS)))).otherwise(F.xxhash64("key", "i", "j"))
    tiled = _tiles(sets, "key", PRINTS).withColumn("g", group).select("g", "key", "i", "j", "side", "rep", "n", *[f"f{i}" for i in range(LANES)])
    return tiled.groupBy("g").applyInPandas(_print_links(similarity), "a long, b long").distinct()


def regions(sets: DataFrame, similarity: float) -> DataFrame:
    """(rep, region): what sets(rep, n, fingerprint, keys) that meet in a block are connected to, if their sizes and whole
    fingerprints allow the similarity."""
    rows = sets.select(F.explode("keys").alias("key"), "rep")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = rows.join(shuffled(shared), "key")
    blocks = stage(blocks.join(sets.select("rep", "n", *[f"f{i}" for i in range(LANES)]), "rep"), "blocks")
    few, many = blocks.where(F.col("size") <= FEW), blocks.where(F.col("size") > FEW)
    found = reduce(DataFrame.union, [_tile_rows(few, similarity), *(hot_links(many, similarity) if not many.isEmpty() else [])])
    return stage(connected_components(found, "a", "b").select(F.col("id").alias("rep"), F.col("component").alias("region")), "regions")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of elements that each two of some sets of numbers share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    keep = times[place] > 1
    owner, place = owner[keep], np.cumsum(times > 1)[place[keep]] - 1
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, [low, low + 4096])
        has = np.zeros((n, 4096), np.float32)
        has[owner[a:b], place[a:b] - low] = 1
        out += has @ has.T
    return out


def _tile_links(similarity: float):
    """(a, b): links of some tiles' sets to the smallest set they reach there."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tile in part.groupby(["region", "i", "j"], sort=False):
            rep, side = tile["rep"].to_numpy(), tile["side"].to_numpy()
            sets = [np.frombuffer(h, np.uint64) for h in tile["hs"]]
            size = np.array([len(x) for x in sets], np.float64)
            shared = shared_counts(sets).astype(np.float64)
            near = shared >= similarity * (size[:, None] + size[None, :] - shared)
            if tile["i"].iat[0] != tile["j"].iat[0]:
                near &= side[:, None] != side[None, :]
            out.append(_grouped_links(near, rep))
        return pd.DataFrame(dict(zip("ab", map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def linked(docs: DataFrame, sets: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(rep, root) of every set that has a link; docs(doc_id, t binary), sets(rep, n, fingerprint, keys)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.lower() if t else t, shingle).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["rep", "hs", "region"])

    near = regions(sets, similarity)
    wanted = small(near.select(F.col("rep").alias("doc_id"), "region"), WANTED)
    rows = stage(docs.join(wanted, "doc_id").select("doc_id", "t", "region").mapInArrow(hashed, "rep long, hs binary, region long"), "shingle-sets")
    sizes = stage(rows.groupBy("region").agg(F.count("*").alias("size")), "region-sizes")
    tiles = _tiles(rows.join(small(sizes, WANTED), "region"), "region", TILE)
    # regions of one tile share groups of about TILE sets; each larger one has a group per tile
    group = F.when(F.col("size") <= TILE, F.pmod(F.xxhash64("region"), F.lit(max(1, rows.count() // TILE)))).otherwise(F.xxhash64("region", "i", "j"))
    links = tiles.withColumn("g", group).select("g", "region", "i", "j", "side", "rep", "hs").groupBy("g").applyInPandas(_tile_links(similarity), "a long, b long")
    return stage(connected_components(links, "a", "b").select(F.col("id").alias("rep"), F.col("component").alias("root")), "links")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """(doc_id, component_id) of all rows with an id: component_id is the smallest id reachable by links, itself included."""
    prepare(docs.sparkSession)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    marks = stage(shingle_sets(texts, shingle, blocks_for(similarity, recall)), "shingle-marks")
    # equal sets have equal fingerprints and keys
    own = [f"f{i}" for i in range(LANES)]
    sets = stage(marks.groupBy("n", "s1", "s2", *own).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")), "sets")
    links = linked(texts, sets, shingle, similarity)
    tops = sets.select("n", "s1", "s2", "rep").join(links, "rep", "left").select("n", "s1", "s2", F.coalesce("root", "rep").alias("component_id"))
    return marks.join(tops, ["n", "s1", "s2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that another document of their group stands for."""
    gone = similar_documents(docs, id_col, text_col, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("_ll_gone"))
    return docs.join(gone, F.col(id_col) == F.col("_ll_gone"), "left_anti")
