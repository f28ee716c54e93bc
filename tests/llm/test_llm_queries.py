import os
import random

import pytest

pytest.importorskip("ledgerloom.llm")

from helpers import SMALL, assert_same, connect  # noqa: E402
from test_dedup import brute_substring, components, plain_simhash  # noqa: E402
from test_other import plain_measures  # noqa: E402
from test_similar import jaccard, shingles  # noqa: E402

import corpus_pipeline  # noqa: E402
from ledgerloom.llm import queries  # noqa: E402

here = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are not here")


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), connect(), queries.ORACLE_SQL[name])


@here
def test_language_query_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op8_language_id"](spark, SMALL).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found) > 0


def written(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_quality_query_equals_its_sql_where_hosts_fall(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "bad #", "en", "farm", 5) for i in range(120)] + [(200 + i, good, "en", "farm", 9) for i in range(4)] + [(300 + i, good if i % 9 else "short", "en", f"site{i % 6}", 9) for i in range(240)]
    rows += [(900, good, "en", None, 9), (901, None, None, None, 0), (902, good + "\n" + good, "en", "site1", 9)]
    sf_dir = written(spark, tmp_path, rows)
    found = queries.QUERIES["op10_quality_rules"](spark, sf_dir)
    assert_same(found, connect(sf_dir), queries.ORACLE_SQL["op10_quality_rules"])
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert not any(kept[200 + i] for i in range(4)) and kept[301] and kept[900]


def test_simhash_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(21)
    base = [f"w{rng.randint(0, 90)}" for _ in range(150)]
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 150, 5)] + [None, "", "One  two", "one two", *(" ".join(rng.choice(base) for _ in range(40)) for _ in range(20))]
    found = queries.QUERIES["op4_simhash_near_dedup"](spark, written(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    fps = {i: plain_simhash(t) for i, t in enumerate(texts)}
    low = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found.collect()} == {i: (f"{fps[i]:016x}", low[i]) for i in fps}


def test_packing_query_leaves_no_gaps(spark, tmp_path):
    rng = random.Random(22)
    texts = [None, "", "<|endoftext|>", *(" ".join(rng.choice(["the", "of", "Straße"]) for _ in range(rng.randint(1, 1500))) for _ in range(50))]
    found = queries.QUERIES["op7_best_fit_packing"](spark, written(spark, tmp_path, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]))
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    places = {}
    for r in found.collect():
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 90))) for _ in range(60)]
    texts += [texts[3], texts[4] + " end", texts[5] + " " + texts[6], "a b c " * 30, None, ""]
    rows = [(i, t, rng.choice(["en", "de"]), f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, apply in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(apply(spark, docs, str(tmp_path)), name)
        found = docs.collect()
        if name == "quality_rules":
            measured = {i: plain_measures(t) for i, t in kept.items()}
            kept = {i: t for i, t in kept.items() if measured[i][0] >= 20 and 100 * measured[i][4] <= 30 * measured[i][0]}
        elif name == "simhash_near_dedup":
            sets = {i: shingles(t) for i, t in kept.items()}
            low = components(sets, [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8])
            kept = {i: t for i, t in kept.items() if low[i] == i}
        elif name == "substring_dedup":
            left = brute_substring(list(kept.items()))
            kept = {i: b" ".join(w).decode() for i, w in left.items() if w}
        elif name == "mix_sources":
            assert {r.doc_id for r in found} <= set(kept) and all(" ".join(r.text.split()) == kept[r.doc_id] for r in found)
            total = sum(len(t.split()) for t in kept.values())
            assert 0.8 * total <= sum(len(r.text.split()) for r in found) <= total
            copies = [r.doc_id for r in found]
            continue
        else:
            assert sorted(r.doc_id for r in found if r.piece == 0) == sorted(copies)
            assert all(len(r.ids) == r.length for r in found)
            continue
        assert docs.columns == columns
        assert {r.doc_id: " ".join(r.text.split()) for r in found} == {i: " ".join(t.split()) for i, t in kept.items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(found)


def test_pipeline_of_an_empty_table_and_of_clashing_names(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [])).count() == 0
    names = "doc_id long, text string, lang string, source string, n_chars long, epoch int, slot int, rep string, component_id long, n_words int, key string"
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(40)), "en", "s", 9, 1, 2, "r", 3, 4, "k") for i in range(6)]
    docs = spark.createDataFrame(rows, names)
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(apply(spark, docs, str(tmp_path)), name)
        assert set(docs.columns) == {c.split(" ")[0] for c in names.split(", ")} and docs.count() == 6
    assert {(r.rep, r.key, r.slot) for r in docs.collect()} == {("r", "k", 2)}
