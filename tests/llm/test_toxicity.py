"""Operator 6 against a plain FTRL-proximal learner, and its bounds."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import xxhash

from patchloom.llm import toxicity

SCHEMA = "doc_id long, text string"


def places(text):
    """Feature places by their definition: words, neighbours, and words with one between them."""
    h = [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", (text or "").lower())]
    m, top = 2**64, 64 - 20
    pair, skip, mix = int(toxicity._PAIR), int(toxicity._SKIP), int(toxicity._MIX)
    found = {x * mix % m >> top for x in h}
    found |= {((x * pair % m) ^ y) * mix % m >> top for x, y in zip(h, h[1:], strict=False)}
    found |= {((x * skip % m) ^ y) * mix % m >> top for x, y in zip(h, h[2:], strict=False)}
    return sorted(found)


def plain_ftrl(rows):
    """Scores of a learner with one dictionary entry per coordinate."""
    z, n = {}, {}
    toxic = sum(y for _, y in rows)
    bias, bias_n = math.log((toxic + 0.5) / (len(rows) - toxic + 0.5)), 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    def score(x):
        return 1 / (1 + math.exp(-max(-500, min(500, bias + sum(weight(i) for i in x)))))

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-max(-500, min(500, bias + sum(w.values()))))) - y
            for i in x:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w[i]
                n[i] = before + g * g
            bias_n += g * g
            bias -= toxicity.ALPHA * g / (toxicity.BETA + math.sqrt(bias_n))
    return score


def test_scores_against_a_plain_learner(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)] + ["Ärger"]
    texts = {i: " ".join(rng.choice(words, rng.integers(0, 30))) + (" vile rotten vile" if i % 4 == 0 else "") for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(i, 0) for i in range(1, 400, 6)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark, docs, labels).collect()}
    from pyspark.sql import functions as F

    used = labels.where(~toxicity.held_out()).withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in used)
    score = plain_ftrl([(places(texts[r.doc_id]), r.toxic) for r in used])
    assert max(abs(got[i] - score(places(x))) for i, x in texts.items()) < 1e-9
    assert sum(got[i] >= 0.7 for i in texts if i % 4 == 0) > 90 and not any(got[i] >= 0.7 for i in texts if i % 4)


def test_training_rows_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(5, f"text {i}") for i in range(3000)] + [(i, "other") for i in range(6, 60)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5, 60)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, most=10).collect()
    assert len(rows) == 10
    assert [r.text for r in toxicity.training_rows(docs, labels).where("text LIKE 'text%'").collect()] == ["text 999"] * (zlib.crc32(b"5") % 3 != 1)
    monkeypatch.setattr(toxicity, "MAX_TRAINING_BYTES", 40)
    bias, _, _ = toxicity.train(spark, docs, labels)
    assert np.isfinite(bias)
