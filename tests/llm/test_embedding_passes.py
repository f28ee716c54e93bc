import numpy as np
import pytest

pytest.importorskip("ledgerloom.llm")

from ledgerloom.llm import embeddings, queries  # noqa: E402


def table(n=2400, size=24, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 2, size)) + 0.4
    near = base + rng.standard_normal(base.shape) * 0.42 * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(size)
    return np.concatenate([base, near])


def links(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    return near.sum(axis=1)


def written(spark, tmp_path, x):
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return spark.read.parquet(str(tmp_path / "embeddings.parquet"))


def test_query_of_several_passes_finds_the_links_of_brute_force(spark, tmp_path):
    x = table()
    expected = links(x)
    assert len(x) > 2 * embeddings.WINDOW and expected.sum() > 1000
    written(spark, tmp_path, x)
    found = {r.vec_id: r.n_links for r in queries.QUERIES["op2_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    assert all(found[i] <= expected[i] for i in range(len(x)))
    assert sum(found.values()) >= 0.9 * expected.sum()


def test_passes_go_on_until_the_sample_is_found(spark, tmp_path, monkeypatch):
    x = table(1200)
    used = []
    monkeypatch.setattr(embeddings, "passes_for", lambda *_: 1)
    monkeypatch.setattr(embeddings, "pass_links", lambda *args, own=embeddings.pass_links: used.append(args[2]) or own(*args))
    found = {r.vec_id: r.n_links for r in embeddings.near_duplicates(written(spark, tmp_path, x), window=32).collect()}
    assert sum(used) > 1 and sum(found.values()) >= 0.95 * links(x).sum()
