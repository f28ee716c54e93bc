import random
from itertools import combinations

import pytest

pytest.importorskip("ledgerloom.llm")

from test_dedup import components  # noqa: E402

from ledgerloom.llm import similar, words  # noqa: E402

DOCS = "doc_id long, text string"


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, changes):
    w = text.split()
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"new{rng.random()}"
    return " ".join(w)


def corpus(seed=5):
    rng = random.Random(seed)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([30, 60, 200, 600]))) for _ in range(120)]
    rows = list(texts)
    for t in texts[:90]:
        size = len(t.split())
        rows += [edited(rng, t, max(1, size * c // 1000)) for c in (5, 15, 22, 40)]
    hot = texts[0] + " " + texts[1]
    rows += [edited(rng, hot, 1) for _ in range(60)]
    return list(enumerate(rows))


def test_pairs_of_the_similarity_and_above_link(spark):
    rows = corpus() + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "ONE  two"), (9005, corpus()[3][1].upper())]
    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8]
    assert len(near) > 300
    found = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, DOCS)).collect()}
    expected = components(sets, near)
    assert len(found) == len(rows)
    assert sum(found[a] == found[b] for a, b in near) >= 0.98 * len(near)
    # nothing links that brute force doesn't link
    assert all(expected[found[i]] == expected[i] for i in found)
    assert found[9001] == found[9002] == 9000 and found[9004] == 9003 and found[9005] == found[3]


def test_pairs_within_a_group_that_shares_a_template_link(spark):
    """Keys of a template's anchors hold every text of the group; pairs of little more than the threshold must not get lost there."""
    rng = random.Random(31)
    template = " ".join(f"t{i}" for i in range(100))
    rows, near = [], []
    for i in range(450):
        own = f"{template} " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(90))
        w = own.split()
        for k in rng.sample(range(105, 185, 6), 4):
            w[k] = f"new{rng.random()}"
        rows += [(2 * i, own), (2 * i + 1, " ".join(w))]
        if jaccard(shingles(own), shingles(rows[-1][1])) >= 0.8:
            near.append((2 * i, 2 * i + 1))
    assert len(near) > 400
    found = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert sum(found[a] == found[b] for a, b in near) >= 0.99 * len(near)
    assert len(set(found.values())) >= 450


def test_number_of_blocks_follows_from_the_similarity():
    assert similar.blocks_for(1.0) == 1 and similar.blocks_for(0.8) < similar.blocks_for(0.7)


def test_similar_edges(spark):
    long = " ".join(f"w{i}" for i in range(50))
    empty = spark.createDataFrame([], DOCS + ", rep string")
    assert similar.dedup(empty).count() == similar.similar_documents(empty).count() == 0
    rows = spark.createDataFrame([(None, long, "x"), (2, long, "y"), (3, long + " end", "z"), (2, long, "again"), (7, "other text", "o"), (7, long, "same id")], DOCS + ", rep string")
    kept = similar.dedup(rows)
    assert kept.columns == ["doc_id", "text", "rep"]
    assert sorted((r.doc_id or -1, r.rep) for r in kept.collect()) == [(-1, "x"), (2, "again"), (2, "y")]


def test_word_hashes_of_long_texts_are_those_of_short_ones():
    text = (" ".join(f"word{i}" for i in range(400_000)) + " " + "L" * 3_000_000 + " tail").encode()
    starts, ends = words.word_bounds(text)
    found = words.word_hashes(text, starts, ends, 1)
    for i in (0, 1, 399_999, 400_000, 400_001):
        one = text[starts[i] : ends[i]]
        assert words.word_hashes(one, *words.word_bounds(one), 1)[0] == found[i]
    assert len(set(found.tolist())) == len(found)
