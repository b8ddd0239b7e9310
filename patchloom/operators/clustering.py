"""Average-linkage grouping of small candidate sets, and the grouping of repair suggestions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_GROUPS = 4
MIN_GROUP = 2


def average_linkage(similarity: np.ndarray, k: int) -> list[list[int]]:
    """k clusters by repeated merging of the two with the largest mean similarity; ties go to the lowest pair."""
    clusters = [[i] for i in range(len(similarity))]
    sums = similarity.astype(float).copy()
    while len(clusters) > k:
        sizes = np.array([len(c) for c in clusters])
        means = np.triu(sums / np.outer(sizes, sizes), 1) + np.tril(np.full(sums.shape, -np.inf))
        a, b = divmod(int(np.argmax(np.round(means, 12))), len(clusters))
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        sums = np.delete(np.delete(sums, b, 0), b, 1)
        clusters[a] = sorted(clusters[a] + clusters[b])
        del clusters[b]
    return sorted(clusters)


def quality(similarity: np.ndarray, clusters: list[list[int]]) -> float:
    """Sum over clusters with two members or more of their mean pairwise similarity."""
    total = 0.0
    for c in clusters:
        if len(c) > 1:
            part = similarity[np.ix_(c, c)]
            total += float(part[np.triu_indices(len(c), 1)].mean())
    return total


def groups(similarity: np.ndarray, most: int = MAX_GROUPS, least: int = MIN_GROUP) -> list[list[int]]:
    """The best split into 2 to most clusters; clusters under least members then join the largest group so far."""
    n = len(similarity)
    if n < 2:
        return [list(range(n))] if n else []
    best, best_quality = [list(range(n))], -1.0
    for k in range(2, min(most, n) + 1):
        found = average_linkage(similarity, k)
        if (q := quality(similarity, found)) > best_quality + 1e-12:
            best, best_quality = found, q
    out: list[list[int]] = []
    for c in best:
        if len(c) >= least or not out:
            out.append(list(c))
        else:
            max(out, key=len).extend(c)
    return [sorted(c) for c in out]


def cosine_matrix(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms > 0, norms, 1)
    return unit @ unit.T


def group_vectors(rows: DataFrame, keys: list[str], member: str, vector: str, most: int = MAX_GROUPS) -> DataFrame:
    """keys, member, group_id: groups within each problem. Problems are small; who calls makes them so."""
    kinds = dict(rows.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(member).reset_index(drop=True)
        found = groups(np.round(cosine_matrix(np.stack(pdf[vector].to_numpy()).astype(float)), 9), most)
        group_id = np.zeros(len(pdf), dtype=np.int32)
        for i, c in enumerate(found):
            group_id[c] = i
        return pdf[[*keys, member]].assign(group_id=group_id)

    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, member]) + ", group_id int"
    return rows.select(*keys, member, vector).groupBy(*keys).applyInPandas(solve, schema)
