"""Operator 9 against every window of whole tables, on colliding hashes, and on shared passages."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

from patchloom.llm import substring_dedup, suffix_sort

DATA = "/root/testdata/sf0.01"


def brute(texts: list[bytes], length: int) -> list[tuple]:
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            key = hashlib.blake2b(t[i : i + length], digest_size=12).digest()
            count[key] = count.get(key, 0) + 1
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, dtype=np.int64)
        for i in range(len(t) - length + 1):
            if count[hashlib.blake2b(t[i : i + length], digest_size=12).digest()] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        covered = np.cumsum(hit)[: len(t)] > 0
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_against_all_windows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:5] for r in substring_dedup.op9_substring_dedup(spark, DATA).collect()}
    want = brute([(r.text or "").encode() for r in docs], 400)
    assert len(got) == len(docs) and [got[r.doc_id] for r in docs] == want


def test_collisions_are_met_with_another_base(monkeypatch):
    rng = random.Random(5)
    common = bytes(rng.choice(b"abc") for _ in range(30))
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) + common + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    aoff = np.array([p.index(common) + 10 for p in pieces])
    nwin = np.array([len(p) - 19 for p in pieces])
    group, single = np.zeros(40, dtype=np.int64), np.ones(40, dtype=bool)
    want = substring_dedup.repeated_strings(group, single, aoff, nwin, pieces, 20)
    made: list[int] = []

    class Weak(suffix_sort.PrefixHash):
        """All substrings of one length are equal under the first base."""

        def __init__(self, data, base=suffix_sort.BASES[0]):
            super().__init__(np.zeros_like(data) if base == suffix_sort.BASES[0] else data, base)
            made.append(base)

    monkeypatch.setattr(substring_dedup, "PrefixHash", Weak)
    assert sorted(substring_dedup.repeated_strings(group, single, aoff, nwin, pieces, 20)) == sorted(want)
    assert made == list(suffix_sort.BASES[:2])


def test_shared_passages(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(n))
    long, short, own = words(51), words(39), words(60)
    texts = [(1, f"{words(70)} {long} {words(9)}"), (2, f"{long}\n{words(40)}"), (3, f"{words(30)} {short} {words(50)}"), (4, f"{short} {words(80)}")]
    texts += [(5, f"{own} {own} {words(20)}"), (6, words(300)), (7, "same text " * 60), (8, "same text " * 60), (9, None), (10, "")]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark, spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.n_shared > 0} == {1, 2, 7, 8}
    assert got[1].n_removed == 0 and got[5].n_shared == 0
