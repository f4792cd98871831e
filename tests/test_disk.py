"""What queries on candidate pairs save and move stays in proportion to the texts."""

import os

import pytest

from simspark.operators import graphs
from simspark.plans import documents  # noqa: F401  registers its queries
from simspark.plans.registry import QUERIES


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = [[word() for _ in range(600)] for _ in range(60)]
    for i in range(0, 60, 6):
        texts[i + 1] = [*texts[i][:-1], "other"]
    rows = [(i, " ".join(t), "en", f"p{i % 5}") for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("long")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path), sum(len(r[1]) for r in rows)


def saved_bytes(spark, tmp_path, monkeypatch, name, path):
    monkeypatch.setattr(graphs, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = QUERIES[name](spark, path).collect()
    return rows, sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(tmp_path) for f in files)


@pytest.mark.parametrize("name", ["near_dup_jaccard_pairs", "program_pair_stats", "program_pair_coverage_score", "dacd_distance_pairs", "rerank_fused", "token_effect_func_similarity", "badge_summary", "program_pair_base_score"])
def test_shingles_are_not_saved(spark, tmp_path, monkeypatch, long_texts, name):
    path, size = long_texts
    rows, saved = saved_bytes(spark, tmp_path, monkeypatch, name, path)
    assert rows and saved < size
