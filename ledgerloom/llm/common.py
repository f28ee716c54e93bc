"""Shared helpers of the training-data operators: scratch tables, components, guarded joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows were counted and found to be this few.
BROADCAST_ROWS = 20_000

#: Ids with more edges than HUB_ROWS, and than their share of all edges if HUBS shared them, have their label broadcast.
HUB_ROWS, HUBS = 1_000, 20_000
#: Rounds of components are written by no more tasks than one for so many edges.
EDGES_PER_TASK = 10_000

#: Words are runs of anything but the six ASCII white-space characters, as bytes.split() sees them.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are worked on together up to so many bytes.
SLICE_BYTES = 1 << 20


def _scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{_scratch_root(spark).rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of one text, written through Hadoop's file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: Arrow batches small enough for long texts, and
    shuffle files dropped when the query that made them has been written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to be at most `rows` rows, else df as it is.

    df should be cheap to count: a staged table or an aggregate of one."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffled(df: DataFrame) -> DataFrame:
    """df with a hint against broadcasting it: for a side of a join that grows with the input.

    The planner sizes a table by its files and what is exploded from it as the table itself; so where the input is small
    it would send a side to the driver that is many times its threshold."""
    return df.hint("merge")


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows(u, v) with m, the smallest v of each u; no task gets all rows of a u that has many.

    A u with more than its share of the `total` rows is a hub. There are HUBS of them at most, so their
    smallest v are broadcast; the others' rows meet theirs by shuffle."""
    bound = max(HUB_ROWS, total // HUBS)
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if total <= bound:
        return rows.join(least.select("u", "m"), "u")
    side = shuffled if total > BROADCAST_ROWS else lambda df: df
    hubs = stage(least.where(F.col("n") > bound).select("u", "m").coalesce(1 + total // EDGES_PER_TASK), "hubs")
    if hubs.isEmpty():
        return rows.join(side(least.select("u", "m")), "u")
    plain = side(least.where(F.col("n") <= bound).select("u", "m"))
    return rows.join(F.broadcast(hubs), "u").union(rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(plain, "u").select("u", "v", "m"))


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id that has an edge: columns (id, component), both long.

    Alternating large-star and small-star rounds; every round is written to the shared folder. The rounds
    needed grow with the logarithm of the longest chain; ones that don't end by max_rounds are an error.
    Self-loops and repeated edges are allowed, ids without edges don't appear."""
    flow = stage(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        now = flow.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return flow.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                flow.select("v", "v").distinct()
            )
        seen, tasks = now, 1 + now[0] // EDGES_PER_TASK
        both = flow.union(flow.select("v", "u"))
        low = _with_least(both, 2 * now[0]).where("v > u")
        # every edge of `large` already points from the larger id to the smaller one
        large = low.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = stage(large.distinct().coalesce(tasks), "large-star") if now[0] > HUB_ROWS else large
        least = _with_least(large, now[0])
        small_star = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        flow = stage(small_star.distinct().coalesce(tasks), "components")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def text_slices(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Runs of texts that end where they reach SLICE_BYTES; a longer text is in a run of its own or ends one."""
    part: list[bytes | None] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t or b"")
        if held >= SLICE_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part
