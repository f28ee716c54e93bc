"""Substring dedup over a log-structured fingerprint index.

Equal windows of `window` words hold equal minimal hashes of their `GRAM`-word grams, so a document is
indexed by those anchors alone, about one per five words. The index keeps immutable runs of anchors,
bucketed and sorted by hash, with the first and last document of each. A new batch is merge-joined with
the runs; wherever an anchor has another document, the windows around it are verified by 96-bit hashes of
their word sequences (with the anchor, 160 bits that must agree), taken from the texts themselves. Windows
repeated among the texts of one slice are settled there, so a passage that is everywhere sends one row per
slice. Verified windows are kept in runs of their own. When there are FAN_IN runs, the next batch first
merges them into one. A manifest of the runs makes the index last: the next load, in a session of its own,
is deduplicated against all that was indexed before.

A batch must have larger ids than those before it. Defined results: null texts have no words; texts
shorter than a window are left alone; rows with equal ids are one document to the index, so they never
remove each other's words; rows with a null id are neither indexed nor changed; empty tables give empty
results; other columns pass through untouched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_path, prepare, scratch_path, stage, text_slices, write_text
from .words import FACTORS, rolled, word_bounds, word_hashes

WINDOW = 13
GRAM = 5
FAN_IN = 2
BATCHES = 3

def _window_min(h: np.ndarray, length: int) -> np.ndarray:
    """Smallest of every run of `length`."""
    out, have = h, 1
    while 2 * have <= length:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = length - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """The windows of some texts: which document each starts in, at which word, and its anchor."""

    def __init__(self, texts: list[bytes | None], window: int):
        texts = [t or b"" for t in texts]
        self._text = b" ".join(texts)
        self._starts, self._ends = word_bounds(self._text)
        self._window = window
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        words = len(self._starts)
        n = words - window + 1
        self.owner = self.at = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n <= 0:
            return
        low = _window_min(rolled(self._hashes(0), GRAM, FACTORS[0][1]), window - GRAM + 1)
        first = np.searchsorted(self._starts, offsets)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        self._inside = owner[:n] == owner[window - 1 :]
        self.owner = owner[:n][self._inside]
        self.at = (np.arange(n) - first[owner[:n]])[self._inside]
        self.anchor = low[self._inside]

    def _hashes(self, seed: int) -> np.ndarray:
        return word_hashes(self._text, self._starts, self._ends, seed)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, anchor) where either changes from one window to the next."""
        new = np.ones(len(self.owner), bool)
        new[1:] = (self.owner[1:] != self.owner[:-1]) | (self.anchor[1:] != self.anchor[:-1])
        return self.owner[new], self.anchor[new]

    def identities(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the chosen windows' words, of 64 and 32 bits."""
        first, second = (rolled(self._hashes(seed), self._window, FACTORS[seed][1])[self._inside][chosen] for seed in (0, 1))
        return first.view(np.int64), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, doc) of docs(doc, t binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(1).to_pylist()):
                owner, h = Windows(part, window).anchors()
                ids = batch.column(0).slice(at, len(part)).take(pa.array(owner))
                at += len(part)
                yield pa.RecordBatch.from_arrays([_signed(h), ids], ["h", "doc"])

    return docs.mapInArrow(run, "h long, doc long")


def verified_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w1, w2, doc, pos) of the windows of docs(doc, t binary, hs array<long>) whose anchor is in hs.

    w1 and w2 are null where a smaller document of the same slice has the window: that one is a repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(1).to_pylist()):
                ids, hs = batch.column(0).slice(at, len(part)), batch.column(2).slice(at, len(part))
                at += len(part)
                found = Windows(part, window)
                wanted = np.sort(np.asarray(hs.flatten()).view(np.uint64))
                if not len(wanted) or not len(found.anchor):
                    continue
                # an anchor wanted for another document of the slice only costs a row that nothing matches
                chosen = wanted[np.minimum(np.searchsorted(wanted, found.anchor), len(wanted) - 1)] == found.anchor
                w1, w2 = found.identities(chosen)
                doc, pos = np.asarray(ids)[found.owner[chosen]], found.at[chosen].astype(np.int32)
                order = np.lexsort((pos, doc, w2, w1))
                w1, w2, doc, pos = w1[order], w2[order], doc[order], pos[order]
                new = np.ones(len(w1), bool)
                new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
                repeat = doc != doc[np.nonzero(new)[0]][np.cumsum(new) - 1] if len(doc) else new
                yield pa.RecordBatch.from_arrays([pa.array(w1, mask=repeat), pa.array(w2, mask=repeat), pa.array(doc), pa.array(pos)], ["w1", "w2", "doc", "pos"])

    return docs.mapInArrow(run, "w1 long, w2 int, doc long, pos int")


class FingerprintIndex:
    """Anchor runs and verified-window runs in the shared folder.

    With a `path` the index outlives its session: save() writes a manifest of the runs there, and an index made
    with the same path goes on from it. Without one its files go when it is closed."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, fan_in: int = FAN_IN, path: str | None = None):
        prepare(spark)
        self.spark, self.window, self.fan_in, self.path = spark, window, fan_in, path
        #: one bucket per shuffle partition: an aggregate by hash is written without another exchange
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: name in the catalog and path of each run of anchors, path of each run of windows, largest id indexed
        self.runs: list[tuple[str, str]] = []
        self.windows: list[str] = []
        self.above: int | None = None
        self._gone: list[str] = []
        #: a run that isn't part of the index yet
        self._begun: tuple[str, str] | None = None
        if path is not None:
            self._open()

    def __enter__(self) -> FingerprintIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _new_path(self, name: str) -> str:
        return scratch_path(self.spark, name) if self.path is None else f"{self.path.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def _open(self) -> None:
        try:
            found = self.spark.read.text(f"{self.path.rstrip('/')}/manifest.json", wholetext=True).first()
        except AnalysisException:
            return  # a new index
        known = json.loads(found["value"])
        if known["window"] != self.window:
            raise ValueError(f"the index has windows of {known['window']} words")
        self.windows, self.above = known["windows"], known["above"]
        for run in known["runs"]:
            name = f"ledgerloom_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} (h BIGINT, first BIGINT, last BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {run['buckets']} BUCKETS LOCATION '{run['path']}'")
            self.runs.append((name, run["path"]))

    def save(self) -> None:
        """Write the manifest, then drop the files of runs that were merged since the last one."""
        buckets = {path: int(self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"]) for name, path in self.runs}
        runs = [{"path": path, "buckets": buckets[path]} for _, path in self.runs]
        write_text(self.spark, f"{self.path.rstrip('/')}/manifest.json", json.dumps({"window": self.window, "above": self.above, "runs": runs, "windows": self.windows}))
        for path in self._gone:
            drop_path(self.spark, path)
        self._gone = []

    def _write_run(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"ledgerloom_run_{uuid.uuid4().hex}", self._new_path("run")
        self._begun = (name, path)
        rows.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        return name, path

    def _write_windows(self, rows: DataFrame) -> str:
        path = self._new_path("windows")
        rows.groupBy("w1", "w2").agg(F.min("doc").alias("doc")).write.parquet(path)
        return path

    def _known_windows(self) -> list[DataFrame]:
        return [self.spark.read.schema("w1 long, w2 int, doc long").parquet(path) for path in self.windows]

    def _history(self, run: DataFrame) -> DataFrame:
        """run(h, first, last) merge-joined with every earlier run: adds old_first and old_last."""
        out = run.withColumn("old_first", F.lit(None).cast("long")).withColumn("old_last", F.lit(None).cast("long"))
        for name, _ in self.runs:
            old = self.spark.table(name).select("h", F.col("first").alias("f"), F.col("last").alias("l"))
            out = out.join(old, "h", "left").select("h", "first", "last", F.least("old_first", "f").alias("old_first"), F.greatest("old_last", "l").alias("old_last"))
        return out

    def add(self, texts: DataFrame, upto: int | None = None, last: bool = False) -> DataFrame:
        """Index the rows of texts(doc, t) whose id is over all indexed ids, up to `upto` if given.

        texts also holds the documents that were indexed before: those that share an anchor with a new one for
        the first time are read again. Returns (doc, starts): where the new documents' windows repeat those of a
        smaller id. After a `last` batch nothing is kept for a next one."""
        if len(self.runs) >= self.fan_in:
            self.compact()
        texts = texts if upto is None else texts.where(F.col("doc") <= upto)
        new = F.lit(True) if self.above is None else F.col("doc") > self.above
        at = scratch_path(self.spark, "anchors")
        anchors(texts.where(new), self.window).write.parquet(at)
        found = self.spark.read.schema("h long, doc long").parquet(at)
        run = self._write_run(found.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
        shared = stage(
            self._history(self.spark.table(run[0])).where("first < last OR old_first IS NOT NULL").select("h", F.when(F.col("old_first") == F.col("old_last"), F.col("old_first")).alias("promoted")),
            "shared-anchors",
        )
        hits = found.join(shared.select("h"), "h").select("doc", "h").union(shared.where("promoted IS NOT NULL").select("promoted", "h"))
        wanted = hits.groupBy("doc").agg(F.collect_set("h").alias("hs"))
        windows_at = scratch_path(self.spark, "windows")
        verified_windows(texts.join(wanted, "doc").select("doc", "t", "hs"), self.window).write.parquet(windows_at)
        windows = self.spark.read.schema("w1 long, w2 int, doc long, pos int").parquet(windows_at)

        open_rows = windows.where("w1 IS NOT NULL")
        seen = reduce(DataFrame.union, [w.select("w1", "w2", "doc", F.lit(-1).alias("pos")) for w in self._known_windows()], open_rows)
        # the running minimum over increasing ids streams: no key's rows are held together
        smallest = F.min("doc").over(W.partitionBy("w1", "w2").orderBy("doc").rowsBetween(W.unboundedPreceding, W.currentRow))
        repeats = seen.withColumn("first", smallest).where("doc > first AND pos >= 0").select("doc", "pos").union(windows.where("w1 IS NULL").select("doc", "pos"))
        out = stage(repeats.where(new).groupBy("doc").agg(F.collect_set("pos").alias("starts")), "repeated-windows")
        if last:
            self._forget([run])
            drop_path(self.spark, run[1])
            self._begun = None
        else:
            largest = self.spark.table(run[0]).agg(F.max("last")).first()[0] if upto is None else upto
            self.above = largest if self.above is None or largest is not None and largest > self.above else self.above
            self.windows.append(self._write_windows(open_rows.select("w1", "w2", "doc")))
            self.runs.append(run)
            self._begun = None
        drop_path(self.spark, at)
        drop_path(self.spark, windows_at)
        return out

    def compact(self) -> None:
        """Merge all runs into one; the sorted buckets are joined as they lie."""
        (first, _), *rest = self.runs
        merged = self.spark.table(first)
        for name, _ in rest:
            other = self.spark.table(name).select("h", F.col("first").alias("f"), F.col("last").alias("l"))
            merged = merged.join(other, "h", "full").select("h", F.least("first", "f").alias("first"), F.greatest("last", "l").alias("last"))
        run = self._write_run(merged)
        windows = self._write_windows(reduce(DataFrame.union, self._known_windows()))
        old = [*(path for _, path in self.runs), *self.windows]
        self._forget(self.runs)
        if self.path is None:
            for path in old:
                drop_path(self.spark, path)
        else:
            self._gone += old
        self.runs, self.windows, self._begun = [run], [windows], None

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files of a table with a path stay

    def close(self) -> None:
        """Leave no names in the catalog, no files of an index without a path, and none of a batch that failed."""
        if self._begun:
            self._forget([self._begun])
            drop_path(self.spark, self._begun[1])
        self._forget(self.runs)
        if self.path is None:
            for path in [*(path for _, path in self.runs), *self.windows]:
                drop_path(self.spark, path)
        self.runs, self.windows = [], []


def _cut(text: bytes, starts: list[int], window: int) -> tuple[bytes, int]:
    """text without the words of the windows at starts and the white space after them; the words removed."""
    edges = np.append(word_bounds(text)[0], len(text))
    words = len(edges) - 1
    at = np.array(starts)
    cover = np.bincount(at, minlength=words + 1) - np.bincount(at + window, minlength=words + 1)
    gone = np.cumsum(cover)[:words] > 0
    turns = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True]))))
    kept = [text[edges[a] : edges[b]] for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
    return text[: edges[0]] + b"".join(kept), int(gone.sum())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """docs with repeated words cut out of the text, and n_words (before) and n_removed, which replace columns of these names.

    The table goes through a new index in `batches` ranges of ids."""
    docs = docs.drop("n_words", "n_removed")
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("t"))
    cuts = rows.select(F.col("doc").cast("double")).approxQuantile("doc", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    with FingerprintIndex(spark, window) as index:
        starts = reduce(DataFrame.union, [index.add(rows, upto, last=upto is None) for upto in [*sorted({int(c) for c in cuts}), None]])

    starts_col = "_ll_starts"
    joined = docs.join(starts.select(F.col("doc").alias("_ll_doc"), F.col("starts").alias(starts_col)), F.col(id_col) == F.col("_ll_doc"), "left").drop("_ll_doc")
    fields = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", n_words long, n_removed long"
    at = fields.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = batch.column(at).cast(pa.binary()).to_pylist(), [], []
            for i, where in enumerate(batch.column(len(fields)).to_pylist()):
                n_words.append(len((texts[i] or b"").split()))
                removed = 0
                if where:
                    texts[i], removed = _cut(texts[i], where, window)
                n_removed.append(removed)
            columns = [batch.column(i) for i in range(len(fields))]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*fields, "n_words", "n_removed"])

    return joined.select(*[f"`{f}`" for f in fields], starts_col).mapInArrow(run, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM hit, range(0, 13) AS r(k)),
g AS (SELECT doc_id, list(pos) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(ps, i), false)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
