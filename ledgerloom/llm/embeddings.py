"""Embedding near-dedup by sorted projection passes.

Equal vectors are one vector with a count. Each pass orders the unit vectors lexicographically by the
concatenated signs of random projections, taken of the vectors less their mean so that the signs split the
table evenly, and compares every vector with the WINDOW vectors before it. Pairs with a cosine of `threshold`
or more are links; the links of all passes are united to components. The vectors travel once per pass, through
the sort; windows run over the sorted rows, and where a task ends its last rows meet the next task's first.
Within a component every pair is then compared in tiles, so the number of links is exact for whatever the
passes connected, and dense groups larger than a window lose nothing. No pair ever leaves the task that
compares it: passes return links to each vector's local root, tiles return counts.

The number of passes starts at what even signs would need (`passes_for`). The recall is then measured: the
links of SAMPLE vectors, chosen by a hash, are counted against the whole table, and as long as the components hold
too few of them the number of passes is doubled: every pass has planes of its own, so each may bring any pair close.

Defined results: vectors that are null or zero, or hold null or non-finite components, have no links and are
their own component; vectors of different lengths never link; equal vectors link; every row is a vector of its
own, also where ids repeat, and a component is named by the smallest id in it; rows with a null id are left out
of all links and returned with a null component; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, prepare, small, stage

THRESHOLD = 0.9
#: Chance that some pass compares a pair of exactly the threshold's cosine; closer pairs and those that share a component do better.
RECALL = 0.999
#: Share of the sample's links that must be found, and the sample's size.
SEEN, SAMPLE = 0.98, 512
WINDOW = 1024
BITS = 63
#: Passes that share a sort, and vectors on one side of a tile.
AT_ONCE, TILE = 4, 512
#: Means are taken of the most common lengths of vectors, so many of them; other lengths count as centred.
MEANS = 64
SEED = 42


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that n vectors need: two vectors lie within a window if they agree in the first log2(n / window)
    signs, each with the chance 1 - angle / pi."""
    if n <= window:
        return 1
    once = (1 - math.acos(min(1.0, threshold)) / math.pi) ** math.log2(n / window)
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-once))) if once < 1 else 1


def unit_rows(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, row, v): every row, v being its vector scaled to length one as double-precision bytes, null if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None] * len(batch)
            vectors = batch.column(2)
            sizes = np.array([0 if n is None else n for n in vectors.value_lengths().to_pylist()])
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                with np.errstate(all="ignore"):
                    # scaling by the largest component first keeps tiny and huge vectors from under- and overflow
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for i, u, good in zip(at.tolist(), x, np.isfinite(x).all(axis=1), strict=True):
                    if good:
                        out[i] = (u + 0.0).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "row", "v"])

    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    return table.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v")).mapInArrow(run, "id long, row long, v binary")


def _by_size(vectors: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([vectors[i] for i in at.tolist()]), np.float64).reshape(len(at), -1)


def means(vectors: DataFrame, number: int = MEANS) -> dict[int, np.ndarray]:
    """Mean vector of each of the most common lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for at, x in _by_size(batch.column(0).to_pylist()):
                held = sums.setdefault(x.shape[1], [0, np.zeros(x.shape[1])])
                held[0] += len(at)
                held[1] += x.sum(axis=0)
        for size, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total)], ["size", "pos", "n", "total"])

    sums = stage(vectors.select("v").mapInArrow(run, "size int, pos int, n long, total double").groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
    common = sums.where("pos = 0").orderBy(F.desc("n"), "size").limit(number).select("size")
    found: dict[int, dict[int, float]] = {}
    for r in sums.join(F.broadcast(common), "size").select("size", "pos", F.col("total") / F.col("n")).collect():  # at most `number` vectors
        found.setdefault(r[0], {})[r[1]] = r[2]
    return {size: np.array([x[i] for i in range(size)]) for size, x in found.items()}


def _keyed(first: int, passes: int, centres: dict[int, np.ndarray]):
    """Rows (seg, key, did, v) of some passes: seg tells passes and lengths apart."""
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at, x in _by_size(batch.column(1).to_pylist()):
                size, rows = x.shape[1], batch.take(pa.array(at))
                for number in range(first, first + passes):
                    if (number, size) not in planes:
                        planes[number, size] = np.random.default_rng([SEED, number, size]).standard_normal((size, BITS))
                    p = planes[number, size]
                    key = (x @ p > centres.get(size, np.zeros(size)) @ p) @ weights
                    seg = np.full(len(at), size << 16 | number, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(key), rows.column("did"), rows.column("v")], ["seg", "key", "did", "v"])

    return run


def _links(seg: np.ndarray, did: np.ndarray, vectors: list[bytes], new: int, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links to the smallest vector reached, of rows in order; the last `new` are compared with the window before them."""
    n = len(seg)
    low = did.copy()
    pairs = []
    for s in np.unique(seg[n - new :]).tolist():
        at = np.flatnonzero(seg == s)
        x = np.frombuffer(b"".join([vectors[i] for i in at.tolist()]), np.float64).reshape(len(at), -1)
        own = int((at >= n - new).sum())
        i, j = np.nonzero(x[len(at) - own :] @ x.T >= threshold)
        i += len(at) - own
        close = (j < i) & (i - j <= window)
        pairs.append((at[i[close]], at[j[close]]))
    i, j = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
    while len(i):
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        if (before == low).all():
            break
    linked = low != did
    return did[linked], low[linked]


def _neighbours(window: int, threshold: float):
    """Links within sorted rows, and the first and last rows of the task, which meet their neighbours later."""
    names = ["a", "b", "edge", "place", "seg", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seg, did, held, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def edge(at: slice, number: int) -> pa.RecordBatch:
            n = len(did[at])
            return pa.RecordBatch.from_arrays([pa.array(did[at]), pa.nulls(n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(seg[at]), pa.array(held[at], pa.binary())], names)

        for batch in batches:
            for start in range(0, len(batch), window):
                part = batch.slice(start, window)
                keep = max(0, len(seg) - window)
                seg, did = (np.concatenate([old[keep:], np.asarray(part.column(c))]) for old, c in ((seg, "seg"), (did, "did")))
                held = held[keep:] + part.column("v").to_pylist()
                new = len(part)
                a, b = _links(seg, did, held, new, window, threshold)
                blank = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), blank, blank, blank, pa.nulls(len(a), pa.binary())], names)
                if seen < window:  # rows that the task before may have neighbours of
                    yield edge(slice(len(seg) - new, len(seg) - new + min(new, window - seen)), 2 * task + 1)
                seen += new
        if seen:
            yield edge(slice(max(0, len(seg) - window), len(seg)), 2 * task + 2)

    return run


def _across(window: int, threshold: float):
    """Links between the last rows of a task and the first of the next."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["edge", "place"], kind="stable")
        new = int((part["edge"] % 2 == 1).sum())
        if new == 0 or new == len(part):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        a, b = _links(part["seg"].to_numpy(np.int64), part["a"].to_numpy(np.int64), part["v"].tolist(), new, window, threshold)
        return pd.DataFrame({"a": a, "b": b})

    return run


def pass_links(vectors: DataFrame, first: int, passes: int, window: int, threshold: float, centres: dict[int, np.ndarray], total: int) -> DataFrame:
    """(a, b): links of some passes over vectors(did, v). Tasks hold several windows each, so that few windows cross tasks."""
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n, total * passes // (4 * window)))
    keyed = vectors.select("did", "v").mapInArrow(_keyed(first, passes, centres), "seg long, key long, did long, v binary")
    ordered = keyed.repartitionByRange(n, "seg", "key", "did").sortWithinPartitions("seg", "key", "did")
    found = stage(ordered.mapInArrow(_neighbours(window, threshold), "a long, b long, edge long, place long, seg long, v binary"), "pass")
    links = found.where("edge IS NULL").select("a", "b")
    # a task's first rows are edge 2 * task + 1, the last rows of the task before 2 * (task - 1) + 2
    borders = found.where("edge IS NOT NULL").withColumn("border", F.expr("edge div 2")).withColumn("edge", F.expr("CASE WHEN edge % 2 = 1 THEN 1 ELSE 0 END"))
    return links.union(borders.groupBy("border").applyInPandas(_across(window, threshold), "a long, b long")) if n > 1 else links


def _tile_counts(threshold: float):
    """Per vector its links among the tile's vectors, each as often as it occurs: two sides against each other, or one with itself."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, tile in part.groupby(["component", "i", "j"], sort=False):
            side, times, did = tile["side"].to_numpy(), tile["times"].to_numpy(), tile["did"].to_numpy()
            for at, x in _by_size(tile["v"].tolist()):
                near = x @ x.T >= threshold
                if tile["i"].iat[0] == tile["j"].iat[0]:
                    np.fill_diagonal(near, False)
                else:
                    near &= side[at][:, None] != side[at][None, :]
                out.append(pd.DataFrame({"did": did[at], "n": near @ times[at]}))
        return pd.concat(out)

    return run


def link_counts(vectors: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(did, n_links) for members(did, component) of vectors(did, v, times): all pairs within each component, tile by tile."""
    rows = stage(members.join(vectors, "did").select("component", "did", "times", "v"), "members")
    sizes = rows.groupBy("component").agg(F.count("*").alias("size"))
    sized = rows.join(small(stage(sizes, "component-sizes")), "component").withColumn("k", F.ceil(F.col("size") / TILE))
    tiles = (
        sized.withColumn("c", F.pmod(F.xxhash64("did"), F.col("k")))
        .select("component", "did", "times", "v", "size", F.col("c").alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
        .select("component", "did", "times", "v", "size", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    )
    # components of one tile share groups of about TILE vectors; each larger one has a group per tile
    total = rows.count()
    group = F.when(F.col("size") <= TILE, F.pmod(F.xxhash64("component"), F.lit(max(1, total // TILE)))).otherwise(F.xxhash64("component", "i", "j"))
    counted = tiles.withColumn("g", group).select("component", "did", "times", "v", "side", "i", "j", "g").groupBy("g").applyInPandas(_tile_counts(threshold), "did long, n long")
    return counted.groupBy("did").agg(F.sum("n").alias("n_links"))


def true_counts(vectors: DataFrame, threshold: float, sample: int = SAMPLE) -> DataFrame:
    """(did, n_true): links of a sample of vectors(did, v, times), each compared with all vectors."""
    chosen = vectors.orderBy(F.xxhash64("did"), "did").limit(sample).select("did", "v").collect()  # the sample is of fixed size
    asked = vectors.sparkSession.sparkContext.broadcast([(at, x, np.array([r["did"] for r in chosen])[at]) for at, x in _by_size([bytes(r["v"]) for r in chosen])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, times = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for at, x in _by_size(batch.column(2).to_pylist()):
                for _, q, ids in asked.value:
                    if q.shape[1] == x.shape[1]:
                        near = (q @ x.T >= threshold) & (ids[:, None] != did[at][None, :])
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near @ times[at])], ["did", "n"])

    return vectors.select("did", "times", "v").mapInArrow(run, "did long, n long").groupBy("did").agg(F.sum("n").alias("n_true"))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row. passes: as many as the measured recall asks for if not given."""
    prepare(table.sparkSession)
    rows = stage(unit_rows(table, id_col, vector_col), "units")
    valid = rows.where("id IS NOT NULL AND v IS NOT NULL").select("id", "row", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"))
    kinds = stage(valid.groupBy("h1", "h2").agg(F.min("row").alias("did"), F.min("id").alias("low"), F.count("*").alias("times")), "kinds")
    vectors = stage(valid.select(F.col("row").alias("did"), "v").join(kinds.select("did", "times"), "did"), "vectors")
    total = vectors.count()
    want = passes_for(total, threshold, window) if passes is None else passes
    centres, links, done, counts = means(vectors), None, 0, None
    measured = stage(true_counts(vectors, threshold), "sample-links") if passes is None and total > window else None
    while True:
        while done < want:
            some = min(AT_ONCE, want - done)
            found = stage(pass_links(vectors, done, some, window, threshold, centres, total).distinct(), "links")
            links, done = found if links is None else links.union(found), done + some
        components = stage(connected_components(links, "a", "b").select(F.col("id").alias("did"), "component"), "vector-components") if links is not None else None
        if components is None:
            break
        counts = stage(link_counts(vectors, components, threshold), "link-counts")
        if measured is None:
            break
        got = measured.join(counts, "did", "left").agg(F.sum("n_true").alias("all"), F.sum(F.least("n_true", F.coalesce("n_links", F.lit(0)))).alias("seen")).first()
        if (got["seen"] or 0) >= SEEN * (got["all"] or 0):
            break
        want = 2 * done

    named = kinds.join(components, "did", "left").join(counts, "did", "left").withColumn("root", F.coalesce("component", "did"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_kind = named.join(lowest, "root").select("h1", "h2", (F.coalesce("n_links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    known = rows.select("id", F.when(F.col("id").isNotNull() & F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("id").isNotNull() & F.col("v").isNotNull(), F.xxhash64(F.lit(SEED), "v")).alias("h2"))
    component = F.coalesce("component_id", "id")
    return known.join(by_kind, ["h1", "h2"], "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
