import random

import pytest

pytest.importorskip("ledgerloom.llm")

import corpus_pipeline  # noqa: E402
from ledgerloom.llm import packing  # noqa: E402


def test_query_and_stage_read_added_tokens_as_the_tokenizer_does(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rng = random.Random(4)
    texts = ["end of one <|endoftext|> start", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a<|endoftext|>\n\n b", "<|endoftext", "<|ENDOFTEXT|>", "", None]
    texts += [" ".join(rng.choice(["the", "Straße", "don't", "<|endoftext|>", "\n ", "日本"]) for _ in range(n)) for n in (5, 400, 1500)]
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert ids[0] == [437, 286, 530, 220, 50256, 923, 2]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for r in corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect():
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length]
    lengths = packing.op7_best_fit_packing(spark, str(tmp_path)).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in lengths} == {i: len(x) for i, x in ids.items()}
