import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import common, embeddings, simhash, substring  # noqa: E402

DOCS = "doc_id long, text string"


def components(ids, links):
    low = {i: i for i in ids}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 7), (7, 8), (5, 5), (2, 1)] + [(100, 100 + i) for i in range(1, 50)]
    found = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {x for e in edges for x in e}
    assert found == components(nodes, edges)
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_follows_its_definition():
    for text in ("", None, "one", "A b C d", "a b c d e f g", "x " * 50, "é à ü B c d\x0be", "nb\xa0sp a b c"):
        assert simhash.fingerprint(text.encode() if text is not None else None) == plain_simhash(text)


def test_masks_cover_every_pair_within_the_distance():
    masks = simhash.block_masks(7, 4)
    assert len(masks) == 35
    rng = random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def near_texts(n):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 300)) for _ in range(160)]
    rows = []
    for i in range(n):
        words = list(base) if i % 3 else [str(rng.random()) for _ in range(40)]
        if i % 3 == 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    return rows


def test_simhash_groups_match_brute_force(spark):
    rows = near_texts(90) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "x"), (7, near_texts(90)[7][1])]
    fps = {i: plain_simhash(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.fp % (1 << 64) for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == components(fps, links)


def test_simhash_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e", "x"), (2, "a b c d e", "y"), (3, "a b c d e", "z")], DOCS + ", fp string")
    assert sorted((r.doc_id or -1, r.fp) for r in simhash.dedup(rows).collect()) == [(-1, "x"), (2, "y")]


def test_dense_embedding_groups_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    dense = centre + 0.05 * rng.standard_normal((700, 16))
    loose = rng.standard_normal((150, 16))
    pairs = loose[:40] + 0.15 * rng.standard_normal((40, 16))
    x = np.concatenate([dense, loose, pairs])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None] * 8), (9005, [1.0]), (None, x[0].tolist()), (9006, (1e-200 * x[0]).tolist())]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in embeddings.near_duplicates(frame, window=64).collect()}
    x = np.concatenate([x, x[:1]])
    ids = [*range(len(rows)), 9006]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    links = [(ids[i], ids[j]) for i, j in near]
    expected = components(ids, links)
    recall = sum(found[i].n_links for i in ids) / (2 * len(links))
    assert recall >= 0.99
    assert sum(found[i].component_id == expected[i] for i in ids) / len(ids) > 0.99
    assert all(found[i].n_links <= sum(i in e for e in links) for i in ids[-30:])
    for i in (9001, 9002, 9003, 9004, 9005):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[None].component_id is None


def test_passes_grow_with_the_table():
    assert [embeddings.passes_for(n) for n in (0, 1, 1024)] == [1, 1, 1]
    grown = [embeddings.passes_for(10**k) for k in range(4, 10)]
    assert grown == sorted(grown) and grown[0] > 1
    assert embeddings.passes_for(10**6, threshold=1.0) == 1


def test_separate_near_pairs_all_link(spark):
    rng = np.random.default_rng(11)
    one = rng.standard_normal((1500, 32))
    x = np.concatenate([one, one + 0.45 * rng.standard_normal((1500, 32))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.any()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame).collect()}
    assert sum(found.values()) >= 0.99 * near.sum()
    assert all(found[i] <= n for i, n in enumerate(near.sum(axis=1).tolist()))


def test_vectors_that_share_a_direction_link_as_well(spark):
    rng = np.random.default_rng(13)
    one = rng.standard_normal((1200, 32))
    x = np.concatenate([one, one + 0.25 * rng.standard_normal((1200, 32))]) + 8 * np.eye(32)[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.97
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame, threshold=0.97, window=64).collect()}
    assert sum(found.values()) >= 0.97 * near.sum() > 0
    assert all(found[i] <= n for i, n in enumerate(near.sum(axis=1).tolist()))


def test_vectors_of_every_length_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [1.0]), (5, [3.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, 0.01]), (7, [0.5, -0.5]), (8, [1.0, 0.0]), (None, [1.0, 0.0])]
    found = embeddings.near_duplicates(spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, row string")).collect()
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in found)
    assert got == [(-1, 0, -1, None), (1, 3, 1, True), (2, 0, 2, True), (3, 3, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True), (7, 3, 1, False), (8, 3, 1, False)]


def test_labels_of_hubs_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HUB_ROWS", 10)
    edges = [(1000, i) for i in range(200)] + [(i, 5000 + i) for i in range(0, 200, 3)] + [(9000, 9001)]
    found = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == components({x for e in edges for x in e}, edges)


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None)], schema)).count() == 1


def brute_substring(rows, window=13):
    words = {i: (t or "").encode().split() for i, t in rows if i is not None}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = [w for k, w in enumerate(ws) if k not in gone]
    return out


def passages(n):
    rng = random.Random(11)
    shared = [[rng.choice("the of and a in to is it".split()) if rng.random() < 0.6 else f"w{rng.randint(0, 60)}" for _ in range(rng.randint(13, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = [f"u{i}_{k}" if rng.random() < 0.5 else rng.choice(["the", "of"]) for k in range(rng.randint(0, 50))]
        if i % 2:
            part = list(rng.choice(shared))
            if i % 5 == 0:
                part[len(part) // 2] = "other"
            text[len(text) // 2 : len(text) // 2] = part
        rows.append((i, (" " if i % 3 else "\n").join(text)))
    return rows


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_substring_matches_brute_force(spark, batches):
    rows = passages(120) + [(500, None), (501, ""), (502, "short text"), (503, passages(120)[51][1]), (504, "L" * 70 + " x " * 40), (505, "L" * 70 + " x " * 40)]
    found = substring.dedup(spark.createDataFrame(rows, DOCS), batches=batches).collect()
    expected = brute_substring(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.text or "").encode().split() == expected[r.doc_id]
        assert r.n_words - r.n_removed == len(expected[r.doc_id])


def test_index_goes_on_in_another_session(spark, tmp_path):
    rows = passages(150)
    expected = brute_substring(rows)
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "doc long, t binary")
    found = {}
    for upto in (30, 60, 90, 120, 149):
        with substring.FingerprintIndex(spark, path=str(tmp_path / "index")) as index:
            assert index.above == (upto - 30 if 30 < upto < 149 else None if upto == 30 else 120)
            found |= {r.doc: r.starts for r in index.add(texts, upto).collect()}
            index.save()
            assert len(index.runs) == len(index.windows) <= substring.FAN_IN
    kept = {i: substring._cut(t.encode(), found[i], 13)[0] if i in found else t.encode() for i, t in rows}
    assert {i: t.split() for i, t in kept.items()} == expected
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("ledgerloom_run")]
    with pytest.raises(ValueError):
        substring.FingerprintIndex(spark, window=9, path=str(tmp_path / "index"))


def test_substring_edges(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(None, long, 1), (4, long, 2), (4, long, 3), (5, "\n" + long.replace(" ", "\n") + "\n tail", 4)], DOCS + ", n_words int")
    found = sorted((r.doc_id or -1, r.text, r.n_removed) for r in substring.dedup(rows).collect())
    assert found == [(-1, long, 0), (4, long, 0), (4, long, 0), (5, "\ntail", 30)]
    assert substring.dedup(spark.createDataFrame([], DOCS)).count() == 0
