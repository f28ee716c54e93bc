"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table (an offset and a step taken
from hashes of its name). Shards take turns claiming their next free slot until the table is full, so
each holds nearly the same number of slots and a changed list of shards moves few of them. A row's slot is
a hash of its key; the table has a fixed size, so it is broadcast and placement takes constant time.

Defined results: a null key is placed by the hash of the whole row, so rows without keys spread over the
shards; rows with equal keys share a shard; empty tables give empty results; other columns pass through
untouched.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots: a prime, about 1000 for each shard, and the bound of what is broadcast.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
SEED = 42


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] | list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard of every slot."""
    names = list(shards)
    if not names or len(set(names)) != len(names) or len(names) > size or not is_prime(size):
        raise ValueError("shards must be distinct, at least one, and no more than the prime number of slots")
    at = [_number(f"offset:{n}") % size for n in names]
    step = [_number(f"step:{n}") % (size - 1) + 1 for n in names]
    table, free = [-1] * size, size
    while True:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def assign(rows: DataFrame, key_col: str, shards: tuple[str, ...] | list[str] = SHARDS, size: int = TABLE_SIZE, seed: int = SEED) -> DataFrame:
    """rows with `slot` and `shard`; columns of these names are replaced, though one of them may be the key."""
    table = pd.DataFrame({"slot": range(size), "shard": [shards[i] for i in lookup_table(shards, size)]})
    slots = rows.sparkSession.createDataFrame(table, "slot int, shard string")
    # maps can't be hashed, but their text can
    cells = [F.col(f"`{c}`").cast("string") if "map<" in kind else F.col(f"`{c}`") for c, kind in rows.dtypes]
    key = F.coalesce(F.col(f"`{key_col}`").cast("string"), F.concat(F.lit("row:"), F.xxhash64(*cells).cast("string")))
    kept = [f"`{c}`" for c in rows.columns if c not in ("slot", "shard")]
    placed = rows.select(F.struct(F.lit(0).alias("_"), *kept).alias("_d"), F.pmod(F.xxhash64(F.lit(seed), key), F.lit(size)).cast("int").alias("slot"))
    return placed.join(F.broadcast(slots), "slot").select(*[F.col(f"_d.{c}") for c in kept], "slot", "shard")


def write_shards(rows: DataFrame, path: str, key_col: str, shards: tuple[str, ...] | list[str] = SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write rows as Parquet in a folder per shard; a shard's slots are dealt to files_per_shard tasks."""
    placed = assign(rows, key_col, shards, size).withColumn("_file", F.col("slot") % files_per_shard)
    placed.repartition(len(shards) * files_per_shard, "shard", "_file").drop("slot", "_file").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs, "doc_id").select("doc_id", "slot", "shard")
