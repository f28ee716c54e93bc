"""Prefix trie of conversations by an LCP-aware external mergesort.

Every turn becomes a digest of 16 bytes of its role and text, so a conversation is a byte string of fixed-width turns
whose order is the order of turns. Equal conversations are one string with a count. Tasks sort their strings into runs
that carry the number of turns each string shares with the one before it (its LCP), and write them. Ranges of strings
are then dealt to tasks, which merge their slices of the runs with a loser tree: it compares LCPs, and looks at turns
only where LCPs are equal, after the turns that both share. The merged stream keeps a stack of the nodes on the open
path; a string that shares fewer turns closes, and finishes, the nodes below.

Nodes that lie on the path of a range's first or last string may go on in the ranges beside it. They are a few rows per
range and depth; one task lays them over each other in the order of ranges and finishes them the same way. So a first
turn that a third of all conversations share is spread over as many ranges as it fills.

Defined results: a null role or text is empty; turns are ordered by `turn` (null first), and by the digest where that
is equal; repeated rows are turns of their own; rows with a null id are left out; empty tables have no nodes; other
columns are ignored. A conversation must fit a worker at 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, small, stage

#: A conversation starts with the first HEAD_TURNS turns or fewer of the one whose id is the multiple of EVERY below its own.
EVERY, HEAD_TURNS = 100, 5
DIGEST = 16
#: Bytes of strings that are sorted to one run, and that are merged by one task.
RUN_BYTES, MERGE_BYTES = 32 << 20, 16 << 20
#: Turns of a conversation, or ids of one ending, that are gathered to one row at first.
PIECE = 1 << 16
#: Border nodes are broadcast up to so many.
BORDERS = 200_000

_EMPTY = hashlib.sha256(b"").hexdigest()


def _tasks(df: DataFrame, rows: int) -> int:
    """Tasks for a sort of so many rows: no more than the session's partitions, or one per PIECE rows."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows // 1000), rows // (16 * PIECE))


def turn_rows(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, digest, chars) of every turn of a conversation with an id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * DIGEST))
    return table.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).alias("chars"))


def sequences(turns: DataFrame) -> DataFrame:
    """(conv, seq, chars): each conversation's digests and text lengths in order, four bytes a length.

    Rows are sorted by conversation and turn and gathered where they lie; only the pieces of a conversation that
    crosses tasks, or has more than PIECE turns, meet again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        open_conv, digests, chars = None, [], []
        for batch in batches:
            done: list[tuple] = []
            for conv, digest, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digests and (conv != open_conv or len(digests) == PIECE):
                    done.append((open_conv, part | number, b"".join(digests), np.array(chars, "<i4").tobytes()))
                    digests, chars, number = [], [], number + 1
                open_conv = conv
                digests.append(digest)
                chars.append(n)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((open_conv, part | number, b"".join(digests), np.array(chars, "<i4").tobytes()), kinds, strict=True)], names)

    names, kinds = ["conv", "at", "seq", "chars"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    ordered = turns.repartitionByRange(_tasks(turns, turns.count()), F.col("conv"), F.asc_nulls_first("turn")).sortWithinPartitions(F.col("conv"), F.asc_nulls_first("turn"), F.col("digest"))
    pieces = ordered.select("conv", "digest", "chars").mapInArrow(run, "conv long, at long, seq binary, chars binary")
    gathered = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "chars"))).alias("p"))
    return gathered.select("conv", *(F.expr(f"aggregate(p, X'', (whole, x) -> concat(whole, x.{c}))").alias(c) for c in ("seq", "chars")))


def rebuilt(own: DataFrame, every: int = EVERY, heads: int = HEAD_TURNS) -> DataFrame:
    """The written sequences, each with its first h turns replaced by those of the conversation whose id is the multiple
    of `every` below: h is the unsigned CRC-32 of the decimal id modulo `heads` + 1."""
    firsts = own.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.substring("seq", 1, DIGEST * heads).alias("head"), F.substring("chars", 1, 4 * heads).alias("head_chars"))
    keyed = own.withColumn("base", F.col("conv") - F.col("conv") % every).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % (heads + 1))
    joined = keyed.join(firsts, "base", "left")

    def swapped(c: str, width: int):
        h = (F.col("h") * width).cast("int")
        return F.concat(F.coalesce(F.substring("head" if c == "seq" else "head_chars", F.lit(1), h), F.lit(b"")), F.substring(c, h + 1, F.length(c)))

    return joined.select("conv", swapped("seq", DIGEST).alias("seq"), swapped("chars", 4).alias("chars"))


def ending_digests(convs: DataFrame) -> DataFrame:
    """(s1, s2, ends): SHA-256 of the ascending ids, joined by commas, of the conversations(s1, s2, conv) that end alike.

    Sorted ids are joined to strings of PIECE ids where they lie; the digest then runs over a sequence's strings in order
    and keeps nothing but its state."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []
        for batch in batches:
            done = []
            for s1, s2, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if ids and (key != (s1, s2) or len(ids) == PIECE):
                    done.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = s1, s2
                ids.append(conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["s1", "s2", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, ids[0], ",".join(map(str, ids)))], ["s1", "s2", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for s1, s2, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key == (s1, s2):
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (s1, s2), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["s1", "s2", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], ["s1", "s2", "ends"])

    tasks = _tasks(convs, convs.count())
    pieces = convs.select("s1", "s2", "conv").repartitionByRange(tasks, "s1", "s2", "conv").sortWithinPartitions("s1", "s2", "conv").mapInArrow(join, "s1 long, s2 long, first long, ids string")
    ordered = pieces.repartition(tasks, "s1", "s2").sortWithinPartitions("s1", "s2", "first").select("s1", "s2", "ids")
    return ordered.mapInArrow(digest, "s1 long, s2 long, ends string")


def shared_turns(a: bytes, b: bytes, at: int, width: int = DIGEST) -> int:
    """Leading turns that a and b share, `at` of which are known: strides double while turns agree, then halve."""
    most, stride = min(len(a), len(b)) // width, 1
    while at < most:
        to = min(most, at + stride)
        if a[at * width : to * width] == b[at * width : to * width]:
            at, stride = to, 2 * stride
        elif stride == 1:
            break
        else:
            stride = max(1, (to - at) // 2)
    return at


def sorted_runs(strings: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(run, pos, lcp, seq, chars, low, n, ends): runs of strings(seq, chars, low, n, ends), sorted where they lie."""
    names = ["run", "pos", "lcp", "seq", "chars", "low", "n", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, held = TaskContext.get().partitionId() << 32, [], 0

        def written() -> pa.RecordBatch:
            rows.sort()  # strings are distinct, so nothing else is compared
            lcps, before = [], b""
            for r in rows:
                lcps.append(shared_turns(before, r[0], 0))
                before = r[0]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([number] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array(lcps, pa.int32()), *(pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True))], names)

        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                rows.append(r)
                held += len(r[0]) + len(r[1])
                if held >= run_bytes:
                    yield written()
                    number, rows, held = number + 1, [], 0
        if rows:
            yield written()

    return strings.select("seq", "chars", "low", "n", "ends").mapInArrow(run, "run long, pos int, lcp int, seq binary, chars binary, low long, n long, ends string")


def merged(runs: list[list[tuple]]) -> Iterator[tuple[int, tuple]]:
    """(lcp, row) of the rows of sorted runs in order, by a loser tree. A row is (seq, lcp with the row before it in its run, ...).

    Each head's LCP is with the string that beat it last. Of two heads that lost to the same string, the one that shares
    more with it is smaller, and the other's LCP holds for both; only if both share as much are turns compared."""
    k = len(runs)
    if not k:
        return
    at, heads, lcps = [0] * k, [r[0] for r in runs], [0] * k
    losers = [-1] * k

    def better(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if lcps[a] != lcps[b]:
            return (a, b) if lcps[a] > lcps[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        same = shared_turns(x, y, lcps[a])
        low, high = (a, b) if x[same * DIGEST : (same + 1) * DIGEST] < y[same * DIGEST : (same + 1) * DIGEST] else (b, a)
        lcps[high] = same
        return low, high

    best = [0] * (2 * k)  # leaves are k .. 2k - 1; node i plays the winners of 2i and 2i + 1
    for i in range(2 * k - 1, 0, -1):
        if i >= k:
            best[i] = i - k
        else:
            best[i], losers[i] = better(best[2 * i], best[2 * i + 1])
    winner = best[1] if k > 1 else 0
    while heads[winner] is not None:
        yield lcps[winner], heads[winner]
        at[winner] += 1
        heads[winner] = runs[winner][at[winner]] if at[winner] < len(runs[winner]) else None
        lcps[winner] = heads[winner][1] if heads[winner] is not None else -1
        i = (winner + k) // 2
        while i >= 1:
            winner, losers[i] = better(winner, losers[i])
            i //= 2


class Node:
    """A node of the trie while its subtree is not finished."""

    __slots__ = ("border", "chars", "children", "depth", "digest", "ends", "leaves", "low", "n", "parent", "saved", "slot")

    def __init__(self, parent: Node | None, depth: int, digest: bytes, chars: int):
        self.parent, self.depth, self.digest, self.chars = parent, depth, digest, chars
        self.low, self.n, self.children, self.leaves, self.saved = 1 << 63, 0, 0, 0, 0
        self.ends, self.border, self.slot = None, False, -1

    def finish(self) -> None:
        """Add up what the subtree gave, once all of it is there, and hand it to the parent."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.chars
        if self.parent is not None:
            above = self.parent
            above.low = min(above.low, self.low)
            above.n += self.n
            above.children += 1
            above.leaves += self.leaves
            above.saved += self.saved


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_BORDER = "part int, slot int, border boolean, digest binary, chars int"
_SCHEMA = f"{_NODE}, {_BORDER}"


def _rows(nodes: list[Node], part: int) -> pa.RecordBatch:
    """Finished nodes and those of the borders, which have a slot; a finished child of a border node has the slot of its parent."""
    slots = [n.slot if n.border else n.parent.slot if n.parent is not None and n.parent.border else None for n in nodes]
    columns = [
        pa.array([n.low if n.low < 1 << 63 else None for n in nodes], pa.int64()),
        pa.array([n.depth for n in nodes], pa.int64()),
        pa.array([None if n.parent is None or n.border or n.parent.border else n.parent.low for n in nodes], pa.int64()),
        *(pa.array([getattr(n, c) for n in nodes], pa.int64()) for c in ("n", "children", "leaves", "saved")),
        pa.array([n.ends if n.border else n.ends or _EMPTY for n in nodes], pa.string()),
        pa.array([part] * len(nodes), pa.int32()),
        pa.array(slots, pa.int32()),
        pa.array([n.border for n in nodes], pa.bool_()),
        pa.array([n.digest if n.border else None for n in nodes], pa.binary()),
        pa.array([n.chars for n in nodes], pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.strip().split(" ")[0] for c in _SCHEMA.split(",")])


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one range of strings, whose slices of the runs are merged."""
    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
    if not rows:
        return
    rows.sort(key=lambda r: r[:2])
    runs: dict[int, list[tuple]] = {}
    for run, _, lcp, *rest in rows:
        runs.setdefault(run, []).append((rest[0], lcp, *rest[1:]))
    part, slots, done = TaskContext.get().partitionId(), 0, []
    path: list[Node] = []

    def close(depth: int) -> None:
        while len(path) > depth:
            node = path.pop()
            if not node.border:
                node.finish()
            done.append(node)

    for lcp, (seq, _, chars, low, n, ends) in merged(list(runs.values())):
        first = not path
        close(lcp + 1)
        lengths = np.frombuffer(chars, "<i4").tolist()
        for depth in range(len(path), len(seq) // DIGEST + 1):
            path.append(Node(path[-1] if path else None, depth, seq[(depth - 1) * DIGEST : depth * DIGEST] if depth else b"", lengths[depth - 1] if depth else 0))
            if first:
                path[-1].border, path[-1].slot, slots = True, slots, slots + 1
        path[-1].n, path[-1].low, path[-1].ends = path[-1].n + n, min(path[-1].low, low), ends
    for node in path:
        if not node.border:
            node.border, node.slot, slots = True, slots, slots + 1
    close(0)
    for at in range(0, len(done), PIECE):
        yield _rows(done[at : at + PIECE], part)


def _merge_borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The border nodes of all ranges, in order, laid over each other; and the ids of those that the ranges' rows ask for."""
    path: list[Node] = []
    nodes: list[Node] = []
    asked: list[tuple[int, int, Node]] = []
    part, meeting = -1, False
    for batch in batches:
        for low, depth, n, children, leaves, saved, ends, at, slot, digest, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            meeting = meeting or at != part
            part = at
            if not (meeting and depth < len(path) and path[depth].digest == digest):
                meeting = False
                del path[depth:]
                path.append(Node(path[-1] if path else None, depth, digest, chars))
                nodes.append(path[-1])
            node = path[depth]
            node.low = node.low if low is None else min(node.low, low)
            node.n, node.children, node.leaves, node.saved = node.n + n, node.children + children, node.leaves + leaves, node.saved + saved
            node.ends = node.ends or ends
            asked.append((at, slot, node))
    for node in reversed(nodes):  # children come after their parents
        node.finish()
    for at in range(0, len(nodes), PIECE):
        yield _rows(nodes[at : at + PIECE], -1)
    for at in range(0, len(asked), PIECE):
        some = asked[at : at + PIECE]
        blank = pa.nulls(len(some))
        columns = [pa.array([x.low for _, _, x in some], pa.int64()), *(blank.cast(pa.int64()) for _ in range(6)), blank.cast(pa.string()), pa.array([p for p, _, _ in some], pa.int32()), pa.array([s for _, s, _ in some], pa.int32()), pa.array([True] * len(some)), blank.cast(pa.binary()), blank.cast(pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, [c.strip().split(" ")[0] for c in _SCHEMA.split(",")])


def trie(convs: DataFrame, run_bytes: int = RUN_BYTES, merge_bytes: int = MERGE_BYTES) -> DataFrame:
    """The nodes of the trie of written conversations(conv, seq, chars): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    keyed = convs.withColumns({"s1": F.xxhash64("seq"), "s2": F.xxhash64(F.lit(42), "seq")})
    ends = stage(ending_digests(keyed), "endings")
    strings = keyed.groupBy("s1", "s2", "seq").agg(F.min("conv").alias("low"), F.count("*").alias("n"), F.first("chars").alias("chars")).join(ends, ["s1", "s2"])
    runs = stage(sorted_runs(strings, run_bytes), "runs")
    held = runs.agg(F.coalesce(F.sum(F.length("seq") + F.length("chars") + 100), F.lit(0))).first()[0]
    nodes = stage(runs.repartitionByRange(1 + held // merge_bytes, "seq").mapInArrow(_merge_range, _SCHEMA), "range-nodes")
    border = nodes.where("border").select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "part", "slot", "digest", "chars")
    across = stage(border.repartition(1).sortWithinPartitions("part", "slot").mapInArrow(_merge_borders, _SCHEMA), "border-nodes")
    fields = [c.strip().split(" ")[0] for c in _NODE.split(",")]
    inner = nodes.where("NOT border")
    asked = across.where("border").select("part", "slot", F.col("conv_id").alias("border_id"))
    inside = inner.where("slot IS NULL").select(fields)
    beside = inner.where("slot IS NOT NULL").join(small(asked, BORDERS), ["part", "slot"]).withColumn("parent_conv_id", F.col("border_id")).select(fields)
    return inside.union(beside).union(across.where("NOT border").select(fields))


def conversation_trie(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = EVERY, heads: int = HEAD_TURNS, **options) -> DataFrame:
    """The trie of the table's rebuilt conversations."""
    prepare(table.sparkSession)
    own = stage(sequences(turn_rows(table, id_col, turn_col, role_col, text_col)), "conversations")
    return trie(stage(rebuilt(own, every, heads), "rebuilt"), **options)


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = r"""
WITH k AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
t AS (SELECT conv_id, turn, length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'said': said, 'chars': chars} ORDER BY turn NULLS FIRST, sha256(said)) AS own FROM t GROUP BY conv_id),
h AS (SELECT conv_id, own, conv_id - conv_id % 100 AS base,
             xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h FROM o, k),
r AS (SELECT a.conv_id, coalesce(b.own[1:a.h], []) || a.own[a.h + 1:] AS seq FROM h a LEFT JOIN o b ON b.conv_id = a.base),
p AS (SELECT conv_id, unnest(range(len(seq) + 1)) AS depth, seq FROM r),
n AS (SELECT seq[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
c AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * n.path[depth].chars ELSE 0 END AS saved FROM n LEFT JOIN c ON n.path = c.path),
u AS (SELECT path[1:above] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS above FROM v) GROUP BY 1)
SELECT v.conv_id, v.depth, m.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves::BIGINT AS n_leaves, u.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN u ON u.path = v.path LEFT JOIN n m ON v.depth > 0 AND m.path = v.path[1:v.depth - 1]
"""
