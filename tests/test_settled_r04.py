"""What a reviewer found in the third round's second reading: each of these failed before."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from ledgerloom.llm import packing, similar
from ledgerloom.operators import assemble, modeljson, scanned, segment


def test_sets_of_a_hot_key_meet_its_pivots_in_one_join(spark, monkeypatch):
    """However many pivots a key chooses, its sets are joined twice: with the pivots, and with the size of what they leave."""
    rng, bound = random.Random(3), similar._bound(similar.FP_BITS, 0.8)
    near = [rng.getrandbits(256) for _ in range(12)]
    prints = [p ^ sum(1 << b for b in rng.sample(range(256), rng.randint(0, bound // 2))) for p in near for _ in range(10)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(1, r, 50, *[signed(p >> 64 * k & (1 << 64) - 1) for k in range(4)], len(prints)) for r, p in enumerate(prints)]
    sets = spark.createDataFrame(rows, "key long, rep long, n long, f0 long, f1 long, f2 long, f3 long, size long")
    staged, stage = [], similar.stage
    monkeypatch.setattr(similar, "stage", lambda df, name: staged.append(out := stage(df, name)) or out)
    links = {tuple(r) for part in similar.hot_links(sets, 0.8) for r in part.collect()}
    assert sum(df.count() for df in staged) <= 2 * len(prints)
    top = list(range(len(prints)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        top[max(root(a), root(b))] = min(root(a), root(b))
    alike = [(a, b) for a, b in combinations(range(len(prints)), 2) if (prints[a] ^ prints[b]).bit_count() <= bound]
    assert len(alike) > 300 and all(root(a) == root(b) for a, b in alike)


def test_folds_take_sorted_streams_not_a_frame_for_each_group(spark):
    """A page's or file's rows are folded as they come: no pandas frame is made for each of them."""
    pages = spark.createDataFrame([("a", 1, "NFE", True)], "file_id string, page int, document_type string, is_continuation boolean").withColumn("confidence", F.lit(1.0))
    words = spark.createDataFrame([("a", 1, "x", 1, 2, 3, 4)], "file_id string, page int, text string, left int, top int, width int, height int")
    for found in (assemble.merge_pages(pages), assemble.word_rows(words)):
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan


def test_files_and_pages_that_cross_batches_are_whole(spark):
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pages = spark.createDataFrame([(f, p, "NFE", p > 1) for f in ("a", "b", None) for p in range(1, 9)], "file_id string, page int, document_type string, is_continuation boolean").withColumn("confidence", F.lit(1.0))
        assert sorted((r.file_id or "", r.pages) for r in assemble.merge_pages(pages).collect()) == [(f, list(range(1, 9))) for f in ("", "a", "b")]
        words = spark.createDataFrame([(f, 1, f"{f}{i}", 50 * (i % 4), 40 * (i // 4), 30, 10) for f in "ab" for i in range(8)], "file_id string, page int, text string, left int, top int, width int, height int")
        rows = sorted((r.file_id, r.row_no, r.cy, r.top, r.bottom, r.text) for r in assemble.word_rows(words).collect())
        assert rows == [(f, n, 40.0 * n + 5, 40 * n, 40 * n + 10, " ".join(f"{f}{4 * n + i}" for i in range(4))) for f in "ab" for n in (0, 1)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)



def test_scanned_rows_are_dealt_once(spark):
    """Rows that lie by page stay there: neither head rows nor second readings deal rows with their words anew."""
    flat = spark.createDataFrame([("p", 5, t, x, 10, 90.0) for t, x in (("12345", 40), ("PECA", 100), ("PC", 300), ("7", 400))], "page string, row_no int, text string, left int, width int, confidence double")
    held = flat.groupBy("page", "row_no").agg(F.collect_list(F.struct("text", "left", "width", "confidence")).alias("words"))
    assert scanned.placed_words(held).select("page", "row_no", "text", "words").collect() == scanned.row_words(flat, ["page"]).select("page", "row_no", "text", "words").collect()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame(held.collect(), held.schema).repartition(8, "page")
        again = spark.createDataFrame([("p", 5, "3")], "page string, row_no int, quantity string").repartition(8, "page")
        found = scanned.scanned_items(scanned.placed_words(rows).withColumn("page_width", F.lit(1000)), ["page"], again)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(page") == plan.count("REPARTITION_BY_NUM")
        assert [(r.code, r.quantity) for r in found.collect()] == [("12345", "7")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_compact_text_is_not_dealt_with_pages(spark):
    pages = spark.createDataFrame([("f", 1, "DANFE x"), ("f", 2, "y")], "file_id string, page int, text string")
    signed = segment.page_signatures(pages)
    for grouped in (segment.group_pages(signed), segment.group_pages(signed, range_pages=1, keep=["kind"])):
        assert [r.doc_index for r in grouped.orderBy("page").collect()] == [1, 2]
    assert sorted(segment.group_pages(signed, range_pages=1, keep=["kind"]).columns) == ["doc_index", "file_id", "kind", "page", "score", "starts"]


def test_documents_of_a_file_stay_where_they_lie(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answers = spark.createDataFrame([(1, '{"documents":[{"pages":["3"],"notes":"b"},{"pages":["1","3"],"notes":"a"}]}'), (2, "{}")], "f long, json string").repartition(8, "f")
        found = modeljson.normalize_documents(modeljson.explode_documents(answers, ["f"]), answers.select("f", F.lit(4).alias("total_pages")), ["f"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(f") == plan.count("REPARTITION_BY_NUM")
        rows = sorted((r.f, r.doc_index, r.pages, r.notes[:1]) for r in found.collect())
        assert rows == [(1, 1, [1], "a"), (1, 2, [2], "A"), (1, 3, [3], "b"), (1, 4, [4], "A"), *[(2, i, [i], "A") for i in range(1, 5)]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_packing_solves_the_program_again_for_what_rounding_leaves(monkeypatch):
    solved, fractions = [], packing._fractions

    def counted(sizes, demand, *more):
        solved.append(int(demand.sum()))
        return fractions(sizes, demand, *more)

    monkeypatch.setattr(packing, "_fractions", counted)
    histogram = {600: 100, 300: 100, 400: 50, 124: 300}
    plan = packing.solve_configurations(histogram)
    # the first solve is of all pieces, the next of what its rounded configurations leave
    assert solved[0] == 550 and 0 < solved[1] < 100
    assert sum(n for _, n in plan) <= 145
    assert {k: sum(c.get(k, 0) * n for c, n in plan) for k in histogram} == histogram
