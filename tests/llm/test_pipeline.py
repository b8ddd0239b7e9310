"""The corpus pipeline stage by stage on a small corpus."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(30, 90))]
        toxic = int(i % 6 == 0)
        if toxic:
            for bad in ("vile", "rotten", "vile"):
                words.insert(rng.randrange(len(words)), bad)
        docs.append((i, " ".join(words), "en", f"s{i % 4}", 0))
        if i % 3 < 2:
            labels.append((i, 1, toxic))
    docs += [(1000 + i, docs[3 * i + 1][1], "en", "s0", 0) for i in range(20)]
    docs += [(2000 + i, docs[5 * i + 2][1] + " extra", "en", "s1", 0) for i in range(20)]
    docs += [(3000, None, None, None, None), (3001, "", "en", None, 0)]
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Scratch(spark, "test").save(stage(spark, docs, sf_dir), name)
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "packing":
            assert docs.columns == columns
    toxic = {i for i in range(600) if i % 6 == 0}
    assert len(toxic & set(ids["toxicity"])) < 0.2 * len(toxic)
    assert {i for i in range(600)} - toxic <= set(ids["toxicity"])
    exact = set(ids["exact_dedup"])
    assert not exact & {1000 + i for i in range(20) if 3 * i + 1 not in toxic} and len(exact) == len(ids["exact_dedup"])
    near = set(ids["simhash"])
    assert not near & {2000 + i for i in range(20) if 5 * i + 2 not in toxic}
    assert {i for i in range(600) if i not in toxic} <= near
    assert set(ids["mixing"]) <= near
    assert set(ids["packing"]) == set(ids["mixing"])


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:3] == ["doc_id", "start", "length"]
