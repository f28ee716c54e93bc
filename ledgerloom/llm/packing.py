"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised and cut into pieces; only documents longer than a sequence are cut. The lengths'
histogram (at most one row per possible length) describes the whole problem as a configuration linear
program: how often to use each multiset of lengths that fits a sequence. Multiplicative weights solve it
with a bounded-knapsack dynamic program as the pricing step; the fractions are rounded down, the program is
solved again for what that leaves, and the rest is packed by best fit, or by the program's prices where that is shorter. Best fit alone is the floor of every
plan. Pieces then find their place by their rank among
the pieces of their length, so no task ever holds more than a slice of them.

Defined results: null and empty texts give one piece of the end mark alone; repeated rows are packed once
each; null ids pass through; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, small, stage

SEQUENCE_TOKENS = 1024
END_ID = 2
#: First ranks, three numbers for each task and length, are broadcast up to so many rows.
RANK_ROWS = 200_000
#: Parcels of sizes that pricing may look at when the program is solved.
PRICED = 250_000
#: Weights start at this power of a length's share of a sequence: longer pieces are worth a little more for each token, so they go first.
LEAN = 1.1
#: Bounds of the step: the share of its demand that a round's most covered length gains.
LEAST_STEP, MOST_STEP = 0.02, 1.0
#: How often the program is solved: for all pieces, and for what rounding down leaves.
SOLVES = 2
#: Shares of the fractional solution that are tried when rounding; with none of it, its prices alone make the plan.
ROUNDED_SHARES = (1.0, 0.0)

_encodings: dict[str, object] = {}


def public_encoder(name: str, added_tokens: bool = True):
    """Encoder of the installed rank file `name`: token ids as little-endian unsigned 32-bit bytes.

    The file holds the same ids as the vocabulary's json file, but not its added tokens. With `added_tokens` their
    strings get the json's ids wherever a text holds them, else they are ordinary text."""
    if name not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(public_tokenizers.path(name.rsplit(".", 1)[0] + ".json"), encoding="utf-8") as vocabulary:
            added = {t["content"]: t["id"] for t in json.load(vocabulary)["added_tokens"]}
        _encodings[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    encoding = _encodings[name]
    if added_tokens:
        return lambda text: np.array(encoding.encode(text, allowed_special="all"), dtype="<u4").tobytes()
    return lambda text: np.array(encoding.encode_ordinary(text), dtype="<u4").tobytes()


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.tiktoken", with_ids: bool = False, added_tokens: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], part, nth): the pieces of every document.

    nth counts the pieces of one length within the task `part` that made them; write the result before
    using both, so that a recomputed task can't number them anew."""
    prepare(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "part", "nth"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "part int, nth long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = public_encoder(vocabulary, added_tokens)
        part = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                total = len(ids) // 4
                start, stop, n = 0, total % capacity or capacity, 0
                while start < total:
                    raw = ids[4 * start : 4 * stop]
                    size = stop - start
                    row = (doc_id, n, start, size, zlib.crc32(raw), *[np.frombuffer(raw, "<i4")] * with_ids, part, seen[size])
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                    seen[size] += 1
                    start, stop, n = stop, stop + capacity, n + 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def _knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per size of the most valuable multiset that fits and holds at most `most` of each.

    Dynamic program over the capacity; a size's copies come in parcels of 1, 2, 4, ... of them."""
    best = np.zeros(capacity + 1)
    parcels, taken = [], []
    for i in np.argsort(-sizes, kind="stable").tolist():
        left, k = min(int(most[i]), capacity // int(sizes[i])), 1
        while left > 0:
            k = min(k, left)
            weight = k * int(sizes[i])
            got = best[: capacity + 1 - weight] + k * values[i]
            better = got > best[weight:]
            best[weight:] = np.where(better, got, best[weight:])
            parcels.append((i, k, weight))
            taken.append(better)
            left, k = left - k, 2 * k
    counts = np.zeros(len(sizes), np.int64)
    c = capacity
    for (i, k, weight), better in zip(reversed(parcels), reversed(taken), strict=True):
        if c >= weight and better[c - weight]:
            counts[i] += k
            c -= weight
    return counts


def _fractions(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int, step: float) -> tuple[dict[tuple[tuple[int, int], ...], float], np.ndarray]:
    """Configurations (index of a size, count) with fractional multiplicities that cover the demand, by multiplicative weights; and the mean prices.

    Each round takes the configuration worth most, uses it so often that the size it covers most gains `step` of
    its demand, and lowers the prices of what it covers. Rounds go on until the least covered size has gained 1,
    or `rounds` are over, and each size but those has been covered more than needed: multiplicities are scaled by
    the least coverage a configuration's sizes have. Prices are scaled so that no configuration is worth over 1."""
    price, covered, mean = (sizes / capacity) ** LEAN, np.zeros(len(sizes)), np.zeros(len(sizes))
    used_times: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        counts = _knapsack(sizes, price, demand, capacity)
        used = counts > 0
        times = step * float((demand[used] / counts[used]).min())
        key = tuple((int(i), int(counts[i])) for i in np.nonzero(used)[0])
        used_times[key] = used_times.get(key, 0.0) + times
        mean += price / float(price @ counts)
        gain = times * counts / demand
        covered += gain
        price = price * np.exp(-gain)
        price /= price.max()
        if covered.min() >= 1.0:
            break
    return {key: times / max(1e-9, min(float(covered[i]) for i, _ in key)) for key, times in used_times.items()}, mean


def _rounded(demand: np.ndarray, fractions: dict[tuple[tuple[int, int], ...], float], share: float) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """`share` of the fractions rounded down, the most used configurations first, and the demand that leaves."""
    left, plan = demand.copy(), []
    for key, times in sorted(fractions.items(), key=lambda kv: -kv[1]):
        n = min(int(times * share), *(int(left[i]) // a for i, a in key))
        if n > 0:
            plan.append((dict(key), n))
            for i, a in key:
                left[i] -= a * n
    return plan, left


def _priced(sizes: np.ndarray, demand: np.ndarray, capacity: int, price: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """The demand in whole configurations: each holds the largest size left and what is worth most beside it."""
    left, plan = demand.copy(), []
    while left.any():
        here = np.nonzero(left)[0]
        most = left[here].copy()
        most[-1] -= 1
        counts = _knapsack(sizes[here], price[here], most, capacity - int(sizes[here[-1]]))
        counts[-1] += 1
        used = counts > 0
        n = int((left[here][used] // counts[used]).min())
        plan.append(({int(here[i]): int(counts[i]) for i in np.nonzero(used)[0]}, n))
        left[here] -= n * counts
    return plan


def _best_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, largest first: each sequence takes the largest size that still fits, as often as it does."""
    left, plan = demand.copy(), []
    while left.any():
        room, counts = capacity, np.zeros(len(sizes), np.int64)
        while (fit := np.nonzero((sizes <= room) & (left > counts))[0]).size:
            i = fit[-1]
            k = min(int(left[i] - counts[i]), room // int(sizes[i]))
            counts[i] += k
            room -= k * int(sizes[i])
        used = counts > 0
        n = int((left[used] // counts[used]).min())
        plan.append(({int(i): int(counts[i]) for i in np.nonzero(used)[0]}, n))
        left -= n * counts
    return plan


def _sequences(plan: list[tuple[dict[int, int], int]]) -> int:
    return sum(n for _, n in plan)


def solve_configurations(histogram: dict[int, int], capacity: int = SEQUENCE_TOKENS, priced: int = PRICED) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a sequence with their counts, number of such sequences)], using up the histogram exactly.

    The program's fractions are rounded down and it is solved again for what they leave; after each solve the rest is packed
    by best fit or in whole configurations by the weights' starting and mean prices, whichever needs fewer sequences. The
    first plan that reaches the bound of tokens or of halves ends the search; else one by prices alone is tried as well.
    priced bounds the work: few lengths get many rounds of small steps, many lengths fewer and larger ones."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    demand = np.array([histogram[int(k)] for k in sizes], np.int64)
    whole = sizes >= capacity
    full = [({int(k): 1}, int(n)) for k, n in zip(sizes[whole], demand[whole], strict=True)]
    sizes, demand = sizes[~whole], demand[~whole]
    if not len(sizes):
        return full
    least = max(-(-int((sizes * demand).sum()) // capacity), int(demand[2 * sizes > capacity].sum()))
    lean = (sizes / capacity) ** LEAN
    best: list[tuple[dict[int, int], int]] | None = None
    for share in ROUNDED_SHARES:
        for head, left, mean in _solved(sizes, demand, capacity, priced, share):
            rests = (_best_fit(sizes, left, capacity), *(_priced(sizes, left, capacity, price) for price in (lean, mean * lean * capacity / sizes)))
            plan = head + min(rests, key=_sequences)
            if best is None or _sequences(plan) < _sequences(best):
                best = plan
            if _sequences(best) <= least:
                break
        if _sequences(best) <= least:
            break
    plain = _best_fit(sizes, demand, capacity)
    chosen = plain if _sequences(plain) < _sequences(best) else best
    return full + [({int(sizes[i]): a for i, a in counts.items()}, n) for counts, n in chosen]


def _solved(sizes: np.ndarray, demand: np.ndarray, capacity: int, priced: int, share: float) -> Iterator[tuple[list[tuple[dict[int, int], int]], np.ndarray, np.ndarray]]:
    """(plan, demand left, mean prices) after each solve: `share` of the program's fractions is rounded down, and the program
    is solved again for what that leaves, SOLVES times in all or until nothing can be rounded."""
    left, plan, mean = demand.copy(), [], np.ones(len(sizes))
    for _ in range(SOLVES):
        if not left.any():
            break
        here = np.nonzero(left)[0]
        parcels = sum(int(x).bit_length() for x in np.minimum(left[here], capacity // sizes[here]))
        rounds = max(1, min(priced // parcels, math.ceil(2 * len(here) / LEAST_STEP), 2 * int(left.sum())))
        fractions, mean[here] = _fractions(sizes[here], left[here], capacity, rounds, min(MOST_STEP, max(LEAST_STEP, 1.5 * len(here) / rounds)))
        head, rest = _rounded(left[here], fractions, share)
        if not head:
            break
        priced //= 2
        plan = plan + [({int(here[i]): a for i, a in counts.items()}, n) for counts, n in head]
        left = left.copy()
        left[here] = rest
        yield plan, left, mean
    if not plan:
        yield plan, left, mean


def _slots(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, offset of the first copy), sorted."""
    rows, taken, sequence = [], {}, 0
    for counts, n in plan:
        offset = 0
        for size, a in sorted(counts.items(), reverse=True):
            rows.append((size, taken.get(size, 0), sequence, a, offset))
            taken[size] = taken.get(size, 0) + a * n
            offset += a * size
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = SEQUENCE_TOKENS) -> DataFrame:
    """Written pieces with `sequence_id` and `offset`, their place there."""
    spark = cut.sparkSession
    per_task = stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # a histogram has at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(solve_configurations(histogram, capacity)))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(small(stage(firsts, "first-ranks"), RANK_ROWS), ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth")).drop("part", "nth", "first")
    fields = ranked.drop("rank").columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            size, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            row = table[np.searchsorted(keys, size << 44 | rank, "right") - 1]
            nth = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in fields), pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * size)],
                [*fields, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, with_ids: bool = False, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    return pack(stage(pieces(docs, id_col, text_col, capacity, with_ids=with_ids, **options), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): whole sequences of pieces that carry their ids; each has `capacity` ids at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
