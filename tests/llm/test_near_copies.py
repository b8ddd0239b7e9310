"""The similarity mode of operator 3 against all pairs, with files cut into blocks too."""

from __future__ import annotations

import random

import numpy as np
import pytest

from patchloom.llm import near_copies


def brute(texts):
    sets = [set(near_copies.shingle_hashes(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    common = [word() for _ in range(6)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 120))] + common
        for _ in range(rng.randint(1, 9)):
            copy = [word() if rng.random() < 0.01 else w for w in base]
            out.append(" ".join(copy))
    return [*out, "", None, "one two", "One TWO"]


@pytest.mark.parametrize("most", [near_copies.FILE, 4])
def test_groups(spark, texts, most):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.root for r in near_copies.similar_groups(spark, docs, most=most).collect()}
    want = brute(texts)
    a = np.array([[got[i] == got[j] for j in range(len(texts))] for i in range(len(texts))])
    b = np.array([[x == y for y in want] for x in want])
    assert (a == b).all()


def test_one_of_each(spark, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = near_copies.one_of_each(spark, docs)
    assert kept.columns == docs.columns
    want = brute(texts)
    firsts = {w: min(i for i in range(len(texts)) if want[i] == w) for w in want}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(firsts.values()) and None in ids
    assert near_copies.one_of_each(spark, docs.limit(0)).count() == 0


def test_pair_that_shares_only_a_crowded_file(spark):
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    for _ in range(20_000):
        base = words(44)
        a, b = " ".join(base + words(5)), " ".join(base + words(5))
        x, y = near_copies.shingle_hashes(a), near_copies.shingle_hashes(b)
        (fa, ka), (fb, kb) = near_copies.sketch(x), near_copies.sketch(y)
        shared = [i for i in range(near_copies.KEYS) if ka[i] == kb[i]]
        if len(shared) == 1 and ((fa ^ fb) & (2**64 - 1)).bit_count() <= near_copies.RADIUS:
            break
    assert len(shared) == 1 and len(np.intersect1d(x, y)) == 0.8 * len(np.union1d(x, y))
    lines = [" ".join(base[i : i + 5]) for i in range(40)]
    common = next(t for t in lines if near_copies.sketch(near_copies.shingle_hashes(t))[1][shared[0]] == ka[shared[0]])
    docs = spark.createDataFrame([(0, a), (1, b), *((i, common) for i in range(2, 12))], "doc_id long, text string")
    for most in (near_copies.FILE, 4):
        got = {r.doc_id: r.root for r in near_copies.similar_groups(spark, docs, most=most).collect()}
        assert got[0] == got[1] and len({got[i] for i in range(2, 12)}) == 1 and got[0] != got[2]
