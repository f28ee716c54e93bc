import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import lines, prefixtrie, queries, resampling  # noqa: E402

DOCS = "doc_id long, text string"


def brute_lines(rows):
    """What each row keeps, loses and had."""
    def key(x):
        x = x.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), x)

    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                held[key(x)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINES = ["shared line number one", "  SHARED line number one\t", "short", "ünïcode länge 10", "only here %d", "", " ", "ÄÖ capital stays Ä", "äö capital stays ä", "line\rwith return"]


def line_rows():
    rng = random.Random(1)
    rows = [(i, "\n".join(x % i if "%d" in x else x for x in rng.choices(LINES, k=rng.randint(1, 9)))) for i in range(60)]
    return rows + [(70, None), (71, ""), (72, "\n\n"), (5, "shared line number one\nown words of this row"), (5, "shared line number one"), (None, "shared line number one"), (-3, "only here 7\nshared line number one"), (80, "a passage as long as any " * 40_000 + "\nshared line number one")]


def test_lines_match_brute_force(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], DOCS + ", pos string, n_lines int").repartition(5)
    found = lines.dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "pos", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in found.collect()), key=repr) == brute_lines(rows)
    assert lines.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_a_line_of_most_documents_is_met_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "HUB_ROWS", 3)
    rows = line_rows()
    found = lines.dedup_lines(spark.createDataFrame(rows, DOCS))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in found.collect()), key=repr) == brute_lines(rows)


def test_lines_of_more_documents_than_a_threshold(spark):
    rows = [(i, "found in three documents\nfound in two documents" if i < 2 else "found in three documents") for i in range(3)]
    found = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS), min_docs=3).collect()}
    assert found == {0: rows[0][1], 1: "found in two documents", 2: ""}


def plain_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain_features(text):
    w = plain_words(text)
    return w + [a + b" " + b for a, b in zip(w, w[1:])]


def brute_resample(rows, target, percent=25, least=20):
    raw, wanted = Counter(f for _, t in rows for f in plain_features(t)), Counter(f for t in target for f in plain_features(t))
    s, t = Counter(), Counter()
    for side, counts in ((s, raw), (t, wanted)):
        for f, n in counts.items():
            side[zlib.crc32(f) % 10_000] += n
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    out = []
    for i, text in rows:
        f = plain_features(text)
        weight = sum(gain[zlib.crc32(x) % 10_000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def text_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Zebra", "ÉTÉ", "über", "naïve", "x-y", "3rd", "\x1b"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "!!! ???"), (203, rows[0][1]), (None, rows[1][1] * 4), (-5, "Same same SAME " * 20), (204, "long text of a few words " * 60_000)]
    return rows, [" ".join(rng.choice(vocabulary[:9]) for _ in range(30)) for _ in range(12)] + [None]


def found_rows(frame):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("chunk,shard", [(8 << 20, 16 << 20), (700, 2000)])
def test_resampling_matches_brute_force(spark, tmp_path, chunk, shard):
    rows, target = text_rows()
    spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n_words int, rank string").repartition(3).write.parquet(str(tmp_path / "d"))
    found = resampling.resample(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([(t,) for t in target], "text string"), chunk_bytes=chunk, shard_bytes=shard)
    assert found_rows(found) == brute_resample(rows, target)


def test_longer_runs_and_other_buckets(spark):
    text = "a b c a b c"
    found = resampling.Features([text.encode(), b"", None, b"c A"], 3)
    strings = [x.decode() for x in found.strings.to_pylist()]
    assert dict(zip(strings, found.counts.tolist(), strict=True)) == Counter(["a", "b", "c", "a", "b", "c", "a b", "b c", "c a", "a b", "b c", "a b c", "b c a", "c a b", "a b c", "c", "a", "c a"])
    assert found.n_words.tolist() == [6, 0, 0, 2] and found.n_features.tolist() == [15, 0, 0, 3]


def test_resampling_of_empty_tables(spark):
    empty, target = spark.createDataFrame([], DOCS), spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, target).count() == 0
    rows = [(1, "some words here")]
    assert found_rows(resampling.resample(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "text string"))) == brute_resample(rows, [])


def test_documents_that_change_between_readings_are_an_error(spark):
    then, now = (spark.createDataFrame([(1, bytearray(t))], "doc_id long, t binary") for t in (b"some words", b"other words"))
    sent = resampling.dictionary(resampling.chunk_features(then, 2, False)).where("chunk IS NOT NULL").select("shard", "chunk", "checksum", "found")
    gains = np.zeros(resampling.BUCKETS, np.int64)
    assert resampling.document_weights(then, sent, gains, 2).count() == 1
    with pytest.raises(Exception, match="differ between their two readings"):
        resampling.document_weights(now, sent, gains, 2).collect()


def brute_trie(table):
    own = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(rows)] for c, rows in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=repr)


def trie_rows(frame):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in frame.collect()), key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def chats(n=120):
    rng = random.Random(9)
    table = []
    for c in range(n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 8, 12])):
            # a first turn that most share, and copies
            said = "the hot first turn" if t == 0 and c % 3 else f"turn {t} of {rng.choice([1, 2, 3, c])} é"
            table.append((c, t, rng.choice(["user", "user", None]) if t else "user", said))
    table += [(1000 + i, 0, "user", "the hot first turn") for i in range(40)]
    return table + [(7, None, None, None), (7, None, "x", None), (7, 0, "user", "again"), (7, 0, "user", "again"), (None, 0, "user", "no id"), (2003, 0, "user", "short"), (900, 3, "user", "")]


@pytest.mark.parametrize("run_bytes,merge_bytes", [(32 << 20, 16 << 20), (300, 6000)])
def test_trie_matches_brute_force(spark, run_bytes, merge_bytes):
    table = chats()
    rows = spark.createDataFrame([(*r, 1, 2) for r in table], TURNS + ", n int, part int").repartition(6)
    found = prefixtrie.conversation_trie(rows, run_bytes=run_bytes, merge_bytes=merge_bytes)
    assert trie_rows(found) == brute_trie(table)


def test_trie_of_few_conversations(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    for table in ([(101, 0, "user", "a")], [(0, 0, "user", "a"), (0, 0, "user", "a")], [(3, t, "u", "x" * (t % 7)) for t in range(600)]):
        assert trie_rows(prefixtrie.conversation_trie(spark.createDataFrame(table, TURNS), merge_bytes=4000)) == brute_trie(table)


def test_pieces_of_a_long_conversation_meet_again(spark, monkeypatch):
    table = [(c, t, "u", f"x{t % 5}") for c in (5, 6, 205) for t in range(700)]
    monkeypatch.setattr(prefixtrie, "_tasks", lambda df, rows: 7)
    assert trie_rows(prefixtrie.conversation_trie(spark.createDataFrame(table, TURNS))) == brute_trie(table)


def test_loser_tree_carries_lcps():
    rng = random.Random(4)
    strings = sorted({b"".join(bytes([rng.choice(b"abc")]) * 16 for _ in range(rng.randint(0, 9))) for _ in range(500)})
    runs = [[] for _ in range(7)]
    for s in strings:
        own = rng.choice(runs)
        own.append((s, prefixtrie.shared_turns(own[-1][0], s, 0) if own else 0))
    merged = list(prefixtrie.merged([r for r in runs if r]))
    assert [row[0] for _, row in merged] == strings
    for before, (lcp, row) in zip([b"", *strings], merged, strict=False):
        n = len(os.path.commonprefix([before, row[0]])) // 16
        assert lcp == n
    assert list(prefixtrie.merged([])) == []


def test_queries_return_the_columns_asked_for(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, "u", "a b")], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    kinds = {n: dict(queries.QUERIES[n](spark, str(tmp_path)).dtypes) for n in queries.QUERIES if n.startswith(("op11", "op12", "op13"))}
    assert kinds["op12_line_dedup"] == {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}
    assert set(kinds["op13_importance_resampling"].items()) == {(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")}
    assert kinds["op11_conversation_prefix_trie"] == {c: "string" if c == "ends_sha256" else "bigint" for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")}
